from quern.llm import template_html as th


def text(source):
    return "\n".join(b[0] for b in th.Page(source).article)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="post-comments-open"><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="ad-box">Buy</div><article><header><h1>A &amp; B</h1></header>
    <p><b>one<br><p>two&nbsp;  three &lt;x&gt;</p><ul><li>four<li>five</ul><aside>side</aside><form><p>Search</p></form><script>var t="</p>";</script>
    <pre>a
    b</pre>tail</article><div id="comments"><p>First!</p></div><footer>&copy; x</footer></body></html>"""
    assert text(page) == "A & B\none\ntwo three <x>\nfour\nfive\na b\ntail"
    assert text(None) == text("") == text("<nav>x</nav>") == text("<p") == ""
    assert text("<body><div><a href=x>menu</a></div><p>Body &am") == "Body &am"
    assert text("a < b <p class='x'>c</p") == "a < b\nc"
    assert text("<p>" + "<b>x " * 20000) == " ".join(["x"] * 20000)


def page(k, notice="Subscribe to our letter!"):
    return f"<html><body><article><h1>Title {k}</h1><p>{notice}</p><p>Content of page {k}</p></article></body></html>"


def test_templates(spark):
    rows = [(k, f"http://a.example.org/{k}", page(k), "x") for k in range(12)]
    rows += [(100 + k, f"http://copies.example.org/{k}", page(0), "x") for k in range(12)]
    rows += [(200 + k, f"http://few.example.org/{k}", page(k), "x") for k in range(3)]
    rows += [(300, None, page(1), "x"), (301, "http://a.example.org/301", None, "x"), (None, "", "", "x"), (5, rows[5][1], rows[5][2], "x")]
    got = th.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    whole = lambda k: f"Title {k}\nSubscribe to our letter!\nContent of page {k}"
    for r in got:
        if r.page_id in (301, None):
            assert r.text == ""
        elif r.page_id < 100:
            assert r.text == f"Title {r.page_id}\nContent of page {r.page_id}"
        else:
            assert r.text == whole({1: 0, 2: r.page_id - 200, 3: 1}[r.page_id // 100])
    assert th.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def odd_page(k, menu, advert):
    links = "".join(f"<div class=k2><a href=/{m}>{m}</a></div>" for m in menu)
    return f"<html><body><div class=k1>{links}</div><div class=k3><div>Words of page {k}, nobody has them</div><div>More of {k}</div></div><div class=k4>{advert}</div><div class=k5>All rights with the site</div></body></html>"


def test_templates_decide_where_names_say_nothing(spark):
    stock = ["alpha", "beta", "gamma", "delta"]
    rows = [(k, f"http://a.example.org/{k}", odd_page(k, (stock[k % 4], stock[(k + 1) % 4]), "Buy " + stock[k % 3])) for k in range(24)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for names in (True, False):
        for r in th.extract(table, names=names).collect():
            assert r.text == f"Words of page {r.page_id}, nobody has them\nMore of {r.page_id}"


def test_statistics_against_exact_vectors(spark):
    stock = ["alpha", "beta", "gamma"]
    rows = [(k, "h1" if k % 3 else "h2", k, odd_page(k % 17, (stock[k % 3], "same"), stock[k % 2])) for k in range(40)]
    table = spark.createDataFrame(rows, "page_id long, host string, key long, html string")
    exact = {}
    for _, host, key, source in rows:
        p = th.Page(source)
        for path, n in p.tags.items():
            exact.setdefault((host, th._signed(path), 0), {})[key] = n
        for b in p.blocks:
            own = exact.setdefault((host, th._block_token(b[1], b[0]), 1), {})
            own[key] = own.get(key, 0) + 1
    got = th._statistics(table.repartition(5)).where("token <> 0").collect()
    assert {(r.host, r.token, r.kind): (r.pages, r.total) for r in got} == {k: (len(v), sum(v.values())) for k, v in exact.items()}
    # equal folded vectors stand for equal vectors
    groups = lambda of: {frozenset(k for k in exact if of(k) == v) for v in {of(k) for k in exact}}
    folded = {(r.host, r.token, r.kind): (r.host, r.vector) for r in got}
    assert groups(lambda k: (k[0], frozenset(exact[k].items()))) == groups(lambda k: folded[k])
