import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import audio, templates, tokenizer, tokens
from quern.operators import attention, blockwise, datasets, measures, reports, rows, scoring
from quern.sources import prepared, readers, store


def softmax_loss(x, target, z_weight=0.0, cap=None):
    x = np.asarray(x, np.float64)
    x = x if cap is None else cap * np.tanh(x / cap)
    z = x.max() + np.log(np.exp(x - x.max()).sum())
    return z - x[target] + z_weight * z * z, z


@pytest.mark.parametrize("size", [1, 3, 7, 64])
@pytest.mark.parametrize("cap, weight", [(None, 0.0), (5.0, 0.1)])
def test_blockwise_loss_for_any_block(spark, size, cap, weight):
    rng = np.random.default_rng(size)
    data = [(i, [float(x) for x in rng.normal(scale=10, size=7)], i % 7) for i in range(12)] + [(12, [1000.0, -1000.0, 999.0], 2)]
    df = spark.createDataFrame(data, "id long, logits array<double>, target int")
    for r in blockwise.blockwise_cross_entropy(df, "logits", "target", "id", size, weight, cap).collect():
        loss, z = softmax_loss(data[r.id][1], data[r.id][2], weight, cap)
        assert r.loss == pytest.approx(loss, rel=1e-9, abs=1e-9) and r.log_z == pytest.approx(z, rel=1e-9)
    head = rng.normal(size=(11, 7))
    out = blockwise.loss_of_embeddings(df.where("id < 12"), head, "logits", "target", "id", size, weight, cap).collect()
    assert len(out) == 12
    for r in out:
        assert r.loss == pytest.approx(softmax_loss(head @ data[r.id][1], data[r.id][2], weight, cap)[0], rel=1e-9, abs=1e-9)


def test_blockwise_loss_needs_its_target(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 2)], "id long, logits array<double>, target int")
    with pytest.raises(Exception, match="found in 0 blocks"):
        blockwise.blockwise_cross_entropy(df, "logits", "target", "id", 2).collect()
    with pytest.raises(Exception, match="outside of the head"):
        blockwise.loss_of_embeddings(df, np.zeros((2, 2)), "logits", "target", "id", 2).collect()


MESSAGES = "messages array<struct<role:string,content:string>>"


def rendered(spark, template, messages, **constants):
    df = spark.createDataFrame([(1, messages)], f"id int, {MESSAGES}")
    r = templates.Template(template, tuple(constants.items())).rendered(df).first()
    return r.text, [r.text[s.begin : s.end] for s in r.spans]


def test_templates(spark):
    chat = [("system", "Be brief."), ("user", " Hi <b> "), ("assistant", "Yes."), ("user", None), ("assistant", "")]
    header = "{{ bos }}{% for m in messages %}<{{ m['role'] }}>{% if m.role == 'assistant' %}{% generation %}{{ m['content'] }}</s>{% endgeneration %}{% else %}{{ m['content'] | trim }}{% endif %}{% endfor %}"
    assert rendered(spark, header, chat, bos="[B]") == ("[B]<system>Be brief.<user>Hi <b><assistant>Yes.</s><user><assistant></s>", ["Yes.", "</s>", "</s>"])
    blocks = "{% for m in messages %}\n  {% if loop.first and m.role != 'user' %}\nS:{{ m.content ~ loop.index0 }}\n  {% elif not loop.last or m.content is defined and false %}\n{{ loop.index }}:{{ m['content'] + '!' }}\n  {% else %}\nend\n  {%- endif %}\n{% endfor %}{# gone #}"
    assert rendered(spark, blocks, chat)[0] == "S:Be brief.0\n2: Hi <b> !\n3:Yes.!\n4:!\nend"
    assert rendered(spark, "{{ messages[0]['content'] | upper }}{% if 'b' in messages[1].content %}b{% endif %}{% if add %}x{% endif %}", chat, add=True)[0] == "BE BRIEF.bx"
    assert rendered(spark, "a\n  {%- for m in messages -%}\n  x\n {%- endfor %}\n", [("user", "u")] * 3) == ("axxx", [])
    assert rendered(spark, "{% for m in messages %}x{% endfor %}", []) == ("", []) and rendered(spark, "{% for m in messages %}x{% endfor %}", None) == ("", [])
    for bad in ("{% for m in messages %}", "{{ m. }}", "{% set x = 1 %}", "{{ x | tojson }}", "{% if a %}{% endfor %}", "{{ 1 2 }}"):
        with pytest.raises(ValueError):
            templates.Template(bad)
    with pytest.raises(ValueError, match="names nothing"):
        rendered(spark, "{{ nothing }}", chat)


def test_masks_by_spans(spark):
    chats = spark.createDataFrame([(1, [("user", "a b"), ("assistant", "c d")]), (2, [("user", "x")])], f"id int, {MESSAGES}")
    template = "{% for m in messages %}{{ m.role }}: {% if m.role == 'assistant' %}{% generation %}{{ m.content }}.{% endgeneration %}{% else %}{{ m.content }}{% endif %}{{ '\\n' }}{% endfor %}"
    words = tokenizer.tokenizer("words", vocabulary=1000)
    form = datasets.ChatFormat(template=template)
    got = form.tokens(chats, words, on_missing="drop").collect()
    assert [(r.id, list(r["mask"])) for r in got] == [(1, [0, 0, 0, 0, 1, 1])]
    ids = spark.createDataFrame([("user: a b\nassistant: c d.\n",)], "t string").select(tokens.word_hash_ids(F.col("t"), 1000).alias("i")).first().i
    assert got[0].ids == ids
    with pytest.raises(Exception, match="no assistant token"):
        form.tokens(chats, words).collect()
    assert [sum(r["mask"]) for r in datasets.ChatFormat(template=template, mask_user_turns=False).tokens(chats, words).orderBy("id").collect()] == [6, 2]
    with pytest.raises(ValueError, match="mark generations"):
        datasets.ChatFormat(template="{% for m in messages %}{{ m.content }}{% endfor %}")
    # a span that begins or ends inside of a token takes it whole; two spans may touch one token
    text = spark.createDataFrame([("ab cd ef", [(1, 4), (4, 5)]), ("ab cd", [(2, 3)])], "text string, spans array<struct<begin:int,end:int>>")
    assert [list(r["mask"]) for r in tokenizer.masked_by_spans(text.where("text = 'ab cd ef'"), words).collect()] == [[1, 1, 0]]
    assert tokenizer.masked_by_spans(text.where("text = 'ab cd'"), words, on_missing="drop").count() == 0
    with pytest.raises(ValueError, match="doesn't tell"):
        tokenizer.masked_by_spans(text, tokenizer.tokenizer("bytes"))


def test_reports_are_written_and_read_back(spark, tmp_path):
    a = spark.createDataFrame([(d, p, (d + p) % 3, -0.5 * p) for d in range(5) for p in range(4)], "doc_id long, pos int, token int, log_prob double")
    b = a.withColumn("log_prob", F.col("log_prob") * 2).repartition(3)
    vocabulary = spark.createDataFrame([(0, "<a&"), (1, "\n")], "token int, entry string")
    assert reports.write_comparison(a, b, vocabulary, f"{tmp_path}/r", per_page=2) == 3
    pages = ["".join(p.read_text() for p in sorted((tmp_path / "r" / f"page={k}").glob("part-*"))) for k in range(3)]
    assert [p.count('<div class="lp">') for p in pages] == [2, 2, 1] and all(p.startswith("<html>") and p.rstrip().endswith("</html>") for p in pages)
    assert '<span data-diff="1.500" data-lp1="-1.500" data-lp2="-3.000">&lt;a&amp;</span>' in pages[0] and ">[2]</span>" in pages[0] and "⏎" in pages[0]
    totals = {r.doc_id: (r.n_tokens, r.total_diff, r.largest, r.n_better) for r in reports.difference_totals(reports.compared(a, b)).collect()}
    assert totals == {d: (4, 3.0, 1.5, 3) for d in range(5)}
    for wrong in (b.where("pos < 3"), b.withColumn("token", F.col("token") + 1)):
        with pytest.raises(Exception, match="the tables differ"):
            reports.compared(a, wrong).collect()
    best = reports.spans(a.limit(1).withColumn("entry", F.lit("x")).withColumn("b", F.lit('"y"')), {"lp": "log_prob"}, best="b").first().span
    assert best == '<span data-lp="0.000" data-best="&quot;y&quot;">x</span>' or best.startswith('<span data-lp="-')


def test_metrics_as_lines(spark, tmp_path):
    log = reports.MetricLog(spark, f"{tmp_path}/m")
    log.parameters({"rate": 0.1})
    log.log({"train": {"loss": 2.0}, "n": 1}, step=0)
    table = spark.createDataFrame([(k, (1.0 / k, k)) for k in (3, 1, 2)], "step long, train struct<loss:double,tokens:long>")
    log.log_table(table, "step")
    log.log({"aside": 1})
    log.summary({"best": {"loss": 0.5}, "n": 7})
    log.artifact("/x", "y")
    assert log.finish() == {"best/loss": 0.5, "n": 1, "train/loss": pytest.approx(1 / 3), "train/tokens": 3}
    records = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/m").collect()]
    assert len(records) == 9 and sum(r["event"] == "finish" for r in records) == 1
    assert {"event": "log", "step": 2, "metrics": {"train/loss": 0.5, "train/tokens": 2}} in records
    assert [r for r in records if r["event"] == "finish"][0]["summary"]["n"] == 1


def test_requests_are_scored_and_checked(spark):
    requests = spark.createDataFrame([(0, [1, 2, 3], 2), (1, [4, 5], 1), (2, [6, 7, 8], 1), (3, list(range(10, 22)), 11)], "idx long, ids array<int>, prompt_length int")
    score = lambda p: p.withColumn("log_prob", -F.col("target").cast("double")).withColumn("best", F.when(F.col("target") == 8, 0).otherwise(F.col("target")))
    got = {r.request: (r.log_prob, r.greedy) for r in scoring.score_requests(requests, 10, 2, score).collect()}
    assert got == {0: (-3.0, True), 1: (-5.0, True), 2: (-15.0, False), 3: (-21.0, True)}
    with pytest.raises(Exception, match="missing: request 1"):
        scoring.score_requests(requests, 10, 2, lambda p: score(p).where("segment <> 1")).collect()
    with pytest.raises(Exception, match="scored twice: request"):
        scoring.score_requests(requests, 10, 2, lambda p: score(p).union(score(p))).collect()
    with pytest.raises(Exception, match="not asked for: request 9|missing: request 1"):
        scoring.score_requests(requests, 10, 2, lambda p: score(p).withColumn("segment", F.when(F.col("segment") == 1, 9).otherwise(F.col("segment")))).collect()
    with pytest.raises(Exception, match="answered twice"):
        scoring.covered(requests, scoring.per_request(score(scoring.positions(scoring.packed_prompts(requests, 10, 2)))).union(spark.createDataFrame([(1, 0.0, True)], "request long, log_prob double, greedy boolean"))).collect()
    logits = spark.createDataFrame([([0.0, 2.0, 1.0], 2)], "l array<double>, t int").select(*scoring.from_logits(F.col("l"), F.col("t"))).first()
    assert logits[0] == pytest.approx(1 - np.log(np.exp([0, 2, 1]).sum())) and logits[1] == 1


@pytest.mark.parametrize("mask", [dict(), dict(offset=2), dict(offset=-2), dict(window=4), dict(window=3, offset=-1), dict(window=5, causal=False), dict(causal=False, segments=False), dict(window=1), dict(window=2, offset=-4)])
def test_attention_pairs_equal_a_plain_loop(spark, mask):
    segs = {0: [0, 0, 0, 1, 1, 2, 2, 2, 2, 2, 2], 1: [0] * 9}
    table = spark.createDataFrame([(s, p, g) for s, own in segs.items() for p, g in enumerate(own)], "seq long, pos int, segment int")
    allowed = spark.createDataFrame([(q, k) for q in range(11) for k in range(11) if (q * k) % 3 != 1], "q int, k int")
    for explicit in (None, allowed):
        m = attention.Mask(**mask, explicit=explicit)
        want = {(s, q, k) for s, own in segs.items() for q in range(len(own)) for k in range(len(own)) if (not m.causal or k <= q + m.offset) and (m.window is None or 0 <= q - k < m.window) and (not m.segments or own[q] == own[k]) and (explicit is None or (q * k) % 3 != 1)}
        met = attention.pairs(table, m)
        got = [tuple(r) for r in met.collect()]
        assert len(got) == len(want) and set(got) == want
        assert {(r.seq, r.q, k) for r in attention.runs(met).collect() for k in range(r.first, r["last"] + 1)} == want
    runs = {(r.seq, r.q, r.first, r["last"]) for r in attention.causal_runs(table, 3).collect()}
    assert runs == {(r.seq, r.q, r.first, r["last"]) for r in attention.runs(attention.pairs(table, attention.Mask(window=3))).collect()}


def test_log_mel_against_a_direct_transform(spark):
    how = audio.MelFeatures(rate=2000, frame=40, hop=16, mels=6, seconds=None)
    rng = np.random.default_rng(0)
    x = rng.normal(size=200).astype(np.float32)
    got = audio.log_mel(x, how)
    padded = np.concatenate([x[20:0:-1], x, x[-2:-22:-1]]).astype(np.float64)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / 40) for i in range(40)]
    bank = audio.mel_bank(2000, 40, 6)
    want = []
    for f in range(200 // 16):
        frame = [padded[f * 16 + i] * window[i] for i in range(40)]
        power = [abs(sum(v * np.exp(-2j * np.pi * k * i / 40) for i, v in enumerate(frame))) ** 2 for k in range(21)]
        want.append([np.log10(max(sum(p * w for p, w in zip(power, row)), 1e-10)) for row in bank])
    want = np.array(want)
    assert got.shape == (12, 6) and np.allclose(got, (np.maximum(want, want.max() - 8) + 4) / 4, atol=1e-5)
    assert (bank >= 0).all() and (bank.sum(1) > 0).all()
    assert audio.log_mel(np.zeros(0), how).shape == (0, 6)
    assert audio.log_mel(np.ones(5), audio.MelFeatures(seconds=0.1)).shape == (10, 80)


def test_audio_with_text(spark, tmp_path):
    import wave

    for name, rate in (("a", 8000), ("b", 16000)):
        with wave.open(f"{tmp_path}/{name}.wav", "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes((np.sin(np.arange(rate) / 9) * 9000).astype("<i2").tobytes())
    lines = [{"audio": f"{tmp_path}/{n}.wav", "sentence": s} for n, s in (("a", "hey"), ("b", "you"), ("gone", "no"))]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    records = readers.read_audio_text(spark, f"{tmp_path}/t.jsonl")
    assert {r.text: r.rate for r in records.collect()} == {"hey": 8000, "you": 16000, "no": None}
    how = audio.MelFeatures(seconds=1.0)
    out = audio.audio_examples(audio.audio_text(records, how, tokenizer.tokenizer("bytes"), length=8), ignore=ord("y"))
    got = {r.rate: r for r in out.collect()}
    assert list(got[8000].features.shape) == [100, 80] and len(got[16000].features.data) == 8000 and got[None].features is None
    assert got[8000].ids == [256, *b"hey", 257, 0, 0, 0] and got[8000].attention_mask == [1] * 5 + [0] * 3 and got[8000].loss_mask == [1, 1, 0, 1, 0, 0, 0, 0]
    with pytest.raises(Exception, match="sampling rates"):
        audio.features(records.where("rate = 8000"), how, resample=False).collect()
    arrays = [{"audio": {"array": [0.1, 0.2], "sampling_rate": 16000}, "sentence": "x"}]
    (tmp_path / "arrays.jsonl").write_text("\n".join(map(json.dumps, arrays)))
    r = readers.read_audio_text(spark, f"{tmp_path}/arrays.jsonl").first()
    assert r.text == "x" and r.rate == 16000 and r.samples == pytest.approx([0.1, 0.2])


def test_tables_from_configurations(spark, tmp_path):
    words, eos = tokenizer.tokenizer("words", vocabulary=1000), tokenizer.tokenizer("bytes")
    for k in range(3):
        (tmp_path / f"d{k}.jsonl").write_text("\n".join(json.dumps({"text": f"t{k}{i}", "prompt": f"q{i} ", "response": f"r{k}", "messages": [{"role": "user", "content": f"u{i}"}, {"role": "assistant", "content": f"a b{k}"}]}) for i in range(4)))
    pattern = f"{tmp_path}/d*.jsonl"
    table = prepared.build_table(spark, f"{tmp_path}/text", pattern, datasets.TextFormat(), eos)
    assert table.count() == 12 and {r.shard for r in table.collect()} == {"d0_jsonl", "d1_jsonl", "d2_jsonl"}
    assert [256, *b"t10", 257] in [r.ids for r in table.collect()]
    assert prepared.build_table(spark, f"{tmp_path}/text", None, datasets.TextFormat(), eos).count() == 12
    assert prepared.build_table(spark, f"{tmp_path}/none", None, datasets.TextFormat(), eos) is None
    assert prepared.load_table(spark, f"{tmp_path}/text", datasets.TextFormat(), eos).count() == 12
    with pytest.warns(UserWarning):
        prepared.load_table(spark, f"{tmp_path}/text", datasets.TextFormat("other"), eos)
    template = "{% for m in messages %}{% if m.role == 'assistant' %}{% generation %}{{ m.content }} {% endgeneration %}{% else %}{{ m.content }} {% endif %}{% endfor %}"
    chats = prepared.build_table(spark, f"{tmp_path}/chat", pattern, datasets.ChatFormat(template=template), words)
    assert [list(r["mask"]) for r in chats.collect()] == [[0, 1, 1]] * 12 and store.read_ledger(spark, f"{tmp_path}/chat")["fields"] == {"ids": 36, "mask": 36}
    examples = prepared.supervised_set(spark, f"{tmp_path}/sup", pattern, eos, 8).collect()
    assert len(examples) == 12
    for r in examples:  # "q0 r1": a prompt of three bytes
        assert len(r.tokens) == 8 and r.tokens[:3] == [*f"q{chr(r.tokens[1])} ".encode()] and list(r["mask"]) == [0, 0, 1, 1, 0, 0, 0, 0]
    short = prepared.supervised_set(spark, f"{tmp_path}/sup", pattern, eos, 3).first()
    assert short.tokens[1:] == [*b"r", short.tokens[2]] and list(short["mask"]) == [0, 0, 0]
    turns = prepared.single_turn_set(spark, f"{tmp_path}/turns", pattern, eos, 8).collect()
    assert len(turns) == 12 and all(r.tokens[2:5] == [*b"a b"] and r.tokens[6] == 257 and list(r["mask"]) == [0, 1, 1, 1, 1, 1, 0, 0] for r in turns)


def test_bytes_of_a_real_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = tokens.vocabulary_bytes(spark, path).cache()
    assert vocabulary.where("entry = '<|endoftext|>'").first().bytes == 0 and vocabulary.count() == 50257
    texts = ["Hello  world, été 日本\n", "a", ""]
    ids = [Tokenizer.from_file(path).encode(t).ids for t in texts]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "id int, ids array<int>")
    # a token that is part of a character decodes to a replacement sign, so whole characters are compared
    got = {r.id: r.bytes for r in tokens.token_bytes(df, vocabulary, "id").collect()}
    assert got[1] == 1 and 2 not in got
    ascii_ = spark.createDataFrame([(0, Tokenizer.from_file(path).encode("Hello  world, all!").ids)], "id int, ids array<int>")
    assert tokens.token_bytes(ascii_, vocabulary, "id").first().bytes == len("Hello  world, all!")
    with pytest.raises(Exception, match="no entry for id 99999999"):
        tokens.token_bytes(spark.createDataFrame([(0, [99999999])], "id int, ids array<int>"), vocabulary, "id").collect()


def test_keys_of_batches_and_averages(spark):
    df = spark.range(50).withColumnRenamed("id", "idx")

    def draw(batch, keys):
        return batch.assign(x=[int(np.random.default_rng(int(k) & (1 << 63) - 1).integers(1000)) for k in keys])

    one, two = (sorted(map(tuple, rows.map_batches_keyed(df.repartition(n), draw, "idx long, x long", 7, size=n).collect())) for n in (1, 5))
    assert one == two and len({x for _, x in one}) > 20
    results = spark.createDataFrame([("a", "acc", 1.0), ("b", "acc", 0.0), ("all", "acc", 0.9), ("a", "acc_stderr", 9.0), ("a", "alias", 1.0), ("c", "acc", None), ("c", "f1", 0.25)], "task string, metric string, value double")
    counts = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0), ("all", None)], "task string, n long")
    got = {r.metric: (r.macro, r.micro, r.tasks) for r in measures.task_averages(results, counts).collect()}
    assert got == {"acc": (0.5, 0.75, 2), "f1": (0.25, None, 1)}
    sizes = spark.createDataFrame([("a", 1, 100, 2), ("b", 1, 50, 2)], "source string, docs long, tokens long, seqs long")
    names = {r.name: r.value for r in measures.statistic_names(measures.corpus_statistics(sizes, "source", {"a": 3.0, "b": 1.0}, 40), "source").collect()}
    assert names["data/stats/train/a/truncation"] == pytest.approx(0.25) and names["data/stats/train/b/padding"] == pytest.approx(0.375)
    assert names["data/stats/train/b/normalized"] == 0.25 and names["data/stats/train/b/tokens_per_epoch"] == 320 and "data/stats/train/a/padding" not in names
    big = spark.createDataFrame([(1e9 + k,) for k in range(3)], "x double")
    assert measures.moments(big, "x").first().variance == pytest.approx(2 / 3)
