"""Further registered queries: composed datasets, loaders, measures over tags, row functions and scalars, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quern.functions import scalars, tokenizer, tokens
from quern.operators import datasets, formats, indexing, measures, mixing, packing, rows
from quern.plans.catalog import _BATCH_SQL, _FLAT, _LOSS, _PAIRS, _SCHEDULE, _TOK, LENGTH, VOCABULARY, _losses, _positions, _supervised, _table, _tokens
from quern.sources import readers, store

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def _scratch(spark) -> str:
    """A new folder in the shared one of spark.checkpoint.dir; a temporary one where that is unset and Spark runs locally."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/quern-{uuid.uuid4().hex}"


_D = "d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)"

# tokenizers


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, 0 AS k, coalesce(text, '') AS rest, NULL::VARCHAR AS piece FROM documents
UNION ALL SELECT doc_id, k + 1, substr(rest, cut + 1), substr(rest, 1, cut) FROM (SELECT doc_id, k, rest,
  CASE WHEN length(rest) > 1000 AND regexp_matches(substr(rest, 1001), '[ \t\n\r]') THEN 1000 + length(regexp_extract(substr(rest, 1001), '^[^ \t\n\r]*')) ELSE length(rest) END AS cut
  FROM p WHERE rest <> '') q)
SELECT doc_id, (k - 1)::INT AS piece, length(piece)::BIGINT AS n_chars, md5(piece) AS digest FROM p WHERE k > 0""")
def long_texts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokenizer.split_long(F.coalesce("text", F.lit("")), 1000)).alias("piece", "part"))
    return docs.where("part <> ''").select("doc_id", "piece", F.length("part").cast("long").alias("n_chars"), F.md5("part").alias("digest"))


@query(f"WITH {_TOK} SELECT doc_id, len(ids)::BIGINT AS n_tokens, coalesce(list_sum(list_transform(range(len(ids)), lambda i: ids[i + 1] * (i + 1))), 0)::BIGINT AS checksum FROM tok")
def merged_pieces(spark, sf_dir):
    """Texts in pieces of 1000 characters, encoded one by one and joined again: the ids of the whole."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokenizer.split_long(F.coalesce("text", F.lit("")), 1000)).alias("piece", "text"))
    whole = tokenizer.merged(tokenizer.encode_words(docs, VOCABULARY), "doc_id", "piece")
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _positions("ids").alias("checksum"))


@query("SELECT doc_id, (strlen(coalesce(text, '')) + 2)::BIGINT AS n_tokens, 256::INT AS first, 257::INT AS last FROM documents")
def plugged_tokenizer(spark, sf_dir):
    """The tokenizer of bytes, which adds neither bos nor eos itself."""
    ids = tokenizer.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer.tokenizer("bytes"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.get("ids", F.lit(0)).alias("first"), F.element_at("ids", -1).alias("last"))


@query(f"WITH {_TOK}, u AS (SELECT doc_id, unnest(ids) AS t FROM tok) SELECT doc_id, sum(t % 7 + 1)::BIGINT AS bytes FROM u GROUP BY doc_id")
def token_bytes(spark, sf_dir):
    """Bytes of every token by a lookup in the vocabulary's table; an entry of id t is t mod 7 + 1 bytes long."""
    table = spark.range(VOCABULARY).select(F.col("id").cast("int").alias("t"), tokens.byte_length(F.repeat(F.lit("x"), (F.col("id") % 7 + 1).cast("int"))).alias("bytes"))
    each = _table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens.word_hash_ids(F.col("text"), VOCABULARY)).alias("t"))
    # the vocabulary bounds what is broadcast
    return each.join(F.broadcast(table), "t").groupBy("doc_id").agg(F.sum("bytes").cast("long").alias("bytes"))


# packed datasets

_GLOBAL = """fold AS (SELECT i, n, 0 AS pack, n AS used, 1 AS segs, 0 AS off FROM ord WHERE i = 0
  UNION ALL SELECT o.i, o.n, CASE WHEN f.used + o.n > {length} OR f.segs >= {segments} THEN f.pack + 1 ELSE f.pack END,
    CASE WHEN f.used + o.n > {length} OR f.segs >= {segments} THEN o.n ELSE f.used + o.n END,
    CASE WHEN f.used + o.n > {length} OR f.segs >= {segments} THEN 1 ELSE f.segs + 1 END,
    CASE WHEN f.used + o.n > {length} OR f.segs >= {segments} THEN 0 ELSE f.used END
  FROM fold f JOIN ord o ON o.i = f.i + 1)"""


@query(f"WITH RECURSIVE {_TOK}, ord AS (SELECT idx AS i, least(len(ids), 512) AS n FROM tok), {_GLOBAL.format(length=512, segments=8)} SELECT i::BIGINT AS idx, pack::BIGINT AS pack FROM fold")
def greedy_pack_global(spark, sf_dir):
    """One greedy pass over the whole table, whatever its partitions; blocks of 64 rows, so that packs cross them."""
    table = _tokens(spark, sf_dir).select("idx", F.least(F.size("ids"), F.lit(512)).cast("long").alias("n"))
    return packing.greedy_packs_global(table, {"n": 512}, 8, rows=64)


_ORD_PAIRS = f"{_PAIRS}, q AS (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS i, s, n AS whole FROM p WHERE n > s AND n > 0)"


def _pairs(spark, sf_dir):
    """Prompts with a response, indexed."""
    found = _supervised(spark, sf_dir).where((F.size("ids") > F.col("sources_len")) & (F.size("ids") > 0))
    return indexing.dense_index(found.select("conv_id", "ids", "sources_len"), "conv_id")


def _pack_sums(df):
    return df.select("pack", F.size(F.filter("segments", lambda s: s >= 0)).cast("long").alias("n_tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_loss"), _positions("mask").alias("positions"))


@query(f"""WITH RECURSIVE {_ORD_PAIRS}, ord AS (SELECT i, least(whole, 96) AS n FROM q), {_GLOBAL.format(length=96, segments=4)},
m AS (SELECT pack, f.n, off, greatest(greatest(s - greatest(whole - 96, 0), 0) - 1, 0) AS a FROM fold f JOIN q USING (i))
SELECT pack::BIGINT AS pack, sum(n)::BIGINT AS n_tokens, sum(greatest(n - 1 - a, 0))::BIGINT AS n_loss,
  sum(CASE WHEN n - 1 > a THEN (n - 1 - a) * (off + 1) + (a + n - 2) * (n - 1 - a) // 2 ELSE 0 END)::BIGINT AS positions FROM m GROUP BY pack""")
def packed_prompts(spark, sf_dir):
    return _pack_sums(packing.packed_prompts(_pairs(spark, sf_dir).withColumnRenamed("sources_len", "prompt_length"), 96, 4))


@query(f"""WITH RECURSIVE {_ORD_PAIRS}, ord AS (SELECT i, least(whole, 96) AS n FROM q), {_GLOBAL.format(length=96, segments=64)},
m AS (SELECT pack, f.n, off, greatest(s - greatest(whole - 96, 0), 0) AS a FROM fold f JOIN q USING (i))
SELECT pack::BIGINT AS pack, sum(n)::BIGINT AS n_tokens, sum(n - a)::BIGINT AS n_loss, sum((n - a) * (off + 1) + (a + n - 1) * (n - a) // 2)::BIGINT AS positions FROM m GROUP BY pack""")
def supervised_packs(spark, sf_dir):
    return _pack_sums(datasets.supervised_dataset(_pairs(spark, sf_dir), 96))


_CHATS = r"""w AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM conversations),
c AS (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn) - n AS first, sum(n + 1) OVER (PARTITION BY conv_id) AS whole FROM w),
k AS (SELECT conv_id, any_value(whole) AS whole FROM c GROUP BY conv_id HAVING sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) > 0),
q AS (SELECT conv_id, whole, row_number() OVER (ORDER BY conv_id) - 1 AS i FROM k)"""


@query(f"""WITH RECURSIVE {_CHATS}, ord AS (SELECT i, least(whole, 256)::BIGINT AS n FROM q), {_GLOBAL.format(length=256, segments=64)},
b AS (SELECT f.pack, f.off, f.n AS len, c.first, least(c.first + c.n, 256) - c.first AS n FROM fold f JOIN q USING (i) JOIN c ON c.conv_id = q.conv_id WHERE c.role = 'assistant' AND c.first < 256)
SELECT f.pack::BIGINT AS pack, any_value(f.t)::BIGINT AS n_tokens, coalesce(any_value(x.n_loss), 0)::BIGINT AS n_loss, coalesce(any_value(x.positions), 0)::BIGINT AS positions
FROM (SELECT pack, sum(n) AS t FROM fold GROUP BY pack) f LEFT JOIN (SELECT pack, sum(n) AS n_loss, sum(n * (off + first) + n * (n - 1) // 2) AS positions FROM b WHERE n > 0 GROUP BY pack) x USING (pack) GROUP BY f.pack""")
def chat_packs(spark, sf_dir):
    """Conversations packed; the mask of a position is that of the next token."""
    chats = formats.chat_tokens(formats.messages(_table(spark, sf_dir, "conversations")), VOCABULARY, "drop").select("conv_id", "ids", "mask")
    return _pack_sums(datasets.chat_dataset(indexing.dense_index(chats, "conv_id"), 256))


@query(f"WITH {_TOK}, {_FLAT} SELECT seq::BIGINT AS seq, sum(t * (pos + 1))::BIGINT AS checksum FROM chunk GROUP BY seq")
def format_dispatch(spark, sf_dir):
    """A text format by its configured name, to sequences."""
    table = _tokens(spark, sf_dir, True).select("idx", "ids")
    return datasets.dataset_for(datasets.format_of({"type": "text"}), table, LENGTH).select("seq", _positions("tokens").alias("checksum"))


@query(f"WITH {_PAIRS} SELECT conv_id, least(n, 48)::BIGINT AS n_tokens, s::BIGINT AS prompt_length FROM p WHERE s <= 47 AND n > s")
def sft_examples(spark, sf_dir):
    kept = datasets.sft_examples(_supervised(spark, sf_dir).withColumnRenamed("sources_len", "prompt_length"), 48)
    return kept.select("conv_id", F.size("ids").cast("long").alias("n_tokens"), F.col("prompt_length").cast("long"))


@query(f"""WITH RECURSIVE {_TOK}, ord AS (SELECT idx AS i, least(len(ids), 512) AS n FROM tok), {_GLOBAL.format(length=512, segments=8)}
SELECT pack::BIGINT AS pack, sum(t.id_sum)::BIGINT AS token_sum, sum(t.w * len_i)::BIGINT AS weights, min(i)::BIGINT AS first_segment FROM fold f
JOIN (SELECT idx AS i, len(ids[1:512]) AS len_i, coalesce(list_sum(ids[1:512]), 0) AS id_sum, idx % 5 AS w FROM tok) t USING (i) GROUP BY pack HAVING sum(len_i) > 0""")
def packed_columns(spark, sf_dir):
    """Two columns read through one packing: ids, and a weight a token."""
    table = _tokens(spark, sf_dir).select("idx", F.slice("ids", 1, 512).alias("ids"))
    table = table.withColumn("w", F.transform("ids", lambda _: (F.col("idx") % 5).cast("int")))
    packs = packing.greedy_packs_global(table.select("idx", F.size("ids").cast("long").alias("n")), {"n": 512}, 8)
    whole = packing.packed_columns(table, packs, {"ids": (512, 0), "w": (512, 0)})
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    whole = whole.where(F.get("segments", F.lit(0)) >= 0)
    # a pack may begin with empty rows, which have no segment to see
    first = packs.groupBy("pack").agg(F.min("idx").alias("first_segment"))
    return whole.select("pack", total("ids").alias("token_sum"), total("w").alias("weights")).join(first, "pack")


@query(f"""WITH RECURSIVE {_TOK}, ord AS (SELECT idx AS i, least(len(ids), 512) AS n FROM tok), {_GLOBAL.format(length=512, segments=8)},
p AS (SELECT pack, sum(n) AS n FROM fold GROUP BY pack) SELECT (count(*) * 512)::BIGINT AS positions, round(sum(512 - n) / (count(*) * 512)::DOUBLE, 9) AS padding FROM p""")
def padding_share(spark, sf_dir):
    table = _tokens(spark, sf_dir).select("idx", F.slice("ids", 1, 512).alias("ids"))
    packs = packing.greedy_packs_global(table.select("idx", F.size("ids").cast("long").alias("n")), {"n": 512}, 8)
    return measures.padding_share(packing.packed_columns(table, packs, {"ids": (512, 0)})).select("positions", F.round("padding", 9).alias("padding"))


@query(f"WITH RECURSIVE {_TOK}, ord AS (SELECT idx AS i, least(len(ids), 512) AS n FROM tok), {_GLOBAL.format(length=512, segments=8)}, s AS (SELECT pack, list_sort(list(i)) AS s FROM fold WHERE n > 0 GROUP BY pack) SELECT pack::BIGINT AS pack, list_concat(CASE WHEN full_ THEN [] ELSE [-1::BIGINT] END, s, list_transform(range(8), lambda x: -1::BIGINT))[1:8]::BIGINT[] AS segments FROM (SELECT s.pack, s.s, t.n = 512 AS full_ FROM s JOIN (SELECT pack, sum(n) AS n FROM fold GROUP BY pack) t USING (pack))")
def unique_segments(spark, sf_dir):
    """The distinct segments of each pack, padding among them, ascending, filled to eight."""
    table = _tokens(spark, sf_dir).select("idx", F.slice("ids", 1, 512).alias("ids"))
    packs = packing.greedy_packs_global(table.select("idx", F.size("ids").cast("long").alias("n")), {"n": 512}, 8)
    whole = packing.packed_columns(table, packs, {"ids": (512, 0)}).where(F.get("segments", F.lit(0)) >= 0)
    return whole.select("pack", packing.unique_segments(F.col("segments"), 8).alias("segments"))


# sources and mixtures


@query(f"WITH {_D} SELECT (e * (n - 20) + i)::BIGINT AS idx, doc_id FROM d, range(2) AS r(e) WHERE i < n - 20")
def single_source(spark, sf_dir):
    """A source without its last 20 rows, twice over."""
    table = _tokens(spark, sf_dir).select("doc_id", "idx")
    return datasets.Single(epochs=2, hold_out=20).train(table, table.count()).select("idx", "doc_id")


@query(f"WITH {_D} SELECT i::BIGINT AS idx, doc_id FROM d WHERE i < 96")
def first_batches(spark, sf_dir):
    """Three batches of 32 rows."""
    table = _tokens(spark, sf_dir).select("doc_id", "idx")
    return datasets.Single(max_train_batches=3, batch=32).train(table, table.count()).select("idx", "doc_id")


@query("""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS j, count(*) OVER (PARTITION BY lang) * 3 // 4 AS n FROM documents WHERE lang IN ('de', 'en')),
size AS (SELECT max(n) AS n FROM d), b AS (SELECT unnest(range((2 * n + 9) // 10)) AS b FROM size)
SELECT d.lang AS source, j::BIGINT AS source_idx, count(*)::BIGINT AS times FROM b, range(5) AS r(i), d WHERE d.j = (b * 5 + i) % d.n AND d.j < d.n GROUP BY ALL""")
def mixture_budget(spark, sf_dir):
    """Two sources, half and half, each cut to three quarters as a simulated experiment has it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang").where(F.col("lang").isin("de", "en"))
    lengths = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    first = mixing.lookup({"de": 0, "en": lengths["de"]}, F.col("lang"))
    sources = indexing.ordered_index(docs, ("lang", "doc_id"), "i").select(F.col("lang").alias("source"), (F.col("i") - first).alias("source_idx"), "doc_id")
    mix = datasets.Mixture((mixing.Stage(0, {"de": 1.0, "en": 1.0}),), block=10, experiment=3.0, target=4.0)
    n = -(-2 * max(int(x * 3 / 4) for x in lengths.values()) // 10) * 10
    return mix.table(sources, lengths, n).groupBy("source", "source_idx").agg(F.count("*").alias("times"))


_SMALL = f"s AS (SELECT doc_id, i, {_BATCH_SQL} FROM d)"


@query(f"WITH {_D}, {_SMALL} SELECT step::BIGINT AS step, pos::BIGINT AS pos, doc_id FROM s WHERE step >= 12 QUALIFY count(*) OVER (PARTITION BY step) = size")
def resumed_batches(spark, sf_dir):
    table = _tokens(spark, sf_dir).select("doc_id", "idx")
    return mixing.from_step(mixing.batches(table, _SCHEDULE, table.count(), False), 12).select("step", "pos", "doc_id")


@query(f"WITH {_D}, {_SMALL}, f AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY step) = size) SELECT step::BIGINT AS step, (pos * 4 // size)::BIGINT AS device, (pos - pos * 4 // size * (size // 4))::BIGINT AS device_pos, doc_id FROM f")
def device_slices(spark, sf_dir):
    table = _tokens(spark, sf_dir).select("doc_id", "idx")
    batches = mixing.batches(table, _SCHEDULE, table.count(), False)
    return mixing.device_slices(batches, _SCHEDULE, 4).select("step", "device", "device_pos", "doc_id")


@query(f"WITH {_D}, {_SMALL}, f AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY step) = size) SELECT step::BIGINT AS step, list(doc_id ORDER BY pos) AS doc_ids FROM f GROUP BY step")
def batchify(spark, sf_dir):
    table = _tokens(spark, sf_dir).select("doc_id", "idx")
    return mixing.batchify(mixing.batches(table, _SCHEDULE, table.count(), False), "doc_id").withColumnRenamed("doc_id", "doc_ids")


@query(f"WITH {_D}, {_SMALL} SELECT step::BIGINT AS step, pos::BIGINT AS pos, doc_id FROM s WHERE step IN (0, 3, 11)")
def rows_of_steps(spark, sf_dir):
    table = _tokens(spark, sf_dir).select("doc_id", "idx")
    return mixing.rows_of_steps(table, _SCHEDULE, [3, 0, 11, 3]).select("step", "pos", "doc_id")


@query("""WITH a AS (SELECT supplier.s_suppkey::BIGINT AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), b AS (SELECT c_custkey::BIGINT AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT i::BIGINT AS idx, k AS key, [1, 0, 1]::INT[] AS tag_bits FROM a UNION ALL SELECT (i + (SELECT count(*) FROM supplier))::BIGINT, k, [0, 1, 1]::INT[] FROM b""")
def tagged_concat(spark, sf_dir):
    parts, lengths = {}, {}
    for table, key, tags in (("supplier", "s_suppkey", ["seller", "party"]), ("customer", "c_custkey", ["buyer", "party"])):
        df = indexing.dense_index(_table(spark, sf_dir, table).select(F.col(key).cast("long").alias("key")), "key")
        lengths[table] = df.count()
        parts[table] = (df, lengths[table], tags)
    order = {"supplier": (*parts["supplier"][:2], ["seller", "party"]), "customer": (*parts["customer"][:2], ["buyer", "party"])}
    out, tags = datasets.tagged_concat(order)
    at = [tags.index(t) for t in ("seller", "buyer", "party")]
    return out.select("idx", "key", F.array(*(F.get("tag_bits", F.lit(k)) for k in at)).alias("tag_bits"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'missing' ELSE 'extra' END AS side, c_custkey::BIGINT AS key FROM customer WHERE (c_custkey % 2 = 0) <> (c_custkey % 3 = 0)")
def coverage(spark, sf_dir):
    """Even keys are asked for, multiples of three are answered."""
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"))
    asked, answered = keys.where("key % 2 = 0"), keys.where("key % 3 = 0")
    missing, extra = datasets.coverage(asked, answered, "key")
    return missing.select(F.lit("missing").alias("side"), "key").union(extra.select(F.lit("extra"), "key"))


@query("SELECT DISTINCT c_custkey::BIGINT AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, sf_dir):
    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"))
    return asked.join(_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("key")), "key", "left_semi").distinct()


@query("""WITH a AS (SELECT event_type AS v, min(event_id) AS o, 0 AS p FROM events GROUP BY 1), b AS (SELECT role AS v, min(conv_id * 1000 + turn) AS o, 1 AS p FROM conversations GROUP BY 1),
u AS (SELECT v, min({'p': p, 'o': o}) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY v) SELECT v AS value, (row_number() OVER (ORDER BY place.p, place.o, v) - 1)::BIGINT AS ord FROM u""")
def ordered_union(spark, sf_dir):
    a = _table(spark, sf_dir, "events").select(F.col("event_type").alias("value"), F.col("event_id").cast("long").alias("ord"))
    b = _table(spark, sf_dir, "conversations").select(F.col("role").alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("ord"))
    return datasets.ordered_union(a, b, "value", "ord").select("value", "ord")


# rows


@query("SELECT event_type AS value, (row_number() OVER (ORDER BY min(event_id)) - 1)::INT AS id FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def dictionary(spark, sf_dir):
    found = rows.dictionary(_table(spark, sf_dir, "events"), "event_type", "event_id")
    return found.select(F.col("event_type").alias("value"), F.col("id").cast("int"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def arrays_and_rows(spark, sf_dir):
    """Turns as arrays, and the arrays as rows again."""
    arrays = rows.to_arrays(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turn"))
    return rows.to_rows(arrays.join(turns, "conv_id"), "turn", "role", "text").select("conv_id", "turn", "role", "text")


@query("SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::INT AS l_linenumber, (l_quantity * 2 + 1)::DOUBLE AS twice FROM lineitem WHERE l_quantity * 2 > 40")
def mapped_rows(spark, sf_dir):
    """A chain of an expression, a batch function that drops rows and another expression."""
    table = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("q"))
    chain = rows.Chain().map(q=F.col("q") * 2).map_batches(lambda b: b[b["q"] > 40], "l_orderkey long, l_linenumber int, q double").identity().map(twice=F.col("q") + 1)
    return chain.run(table).select("l_orderkey", "l_linenumber", "twice")


@query("SELECT vec_id, embedding[1:8]::DOUBLE[] AS a, embedding[9:]::DOUBLE[] AS b FROM embeddings")
def flat_leaves(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    table = _table(spark, sf_dir, "embeddings").select("vec_id", F.slice(e, 1, 8).alias("a"), F.slice(e, F.lit(9), F.size(e) - 8).alias("b"))
    return rows.unflat_leaves(rows.flat_leaves(table, "vec_id", "a", "b"), "vec_id", "a", "b")


# measures


@query(f"""WITH {_TOK}, {_LOSS}, e AS (SELECT lang AS tag, loss, tokens FROM l UNION ALL SELECT source, loss, tokens FROM l UNION ALL SELECT NULL, loss, tokens FROM l)
SELECT coalesce(tag, 'all') AS tag, round(sum(loss) / nullif(sum(tokens), 0)::DOUBLE, 6) AS micro, sum(tokens)::BIGINT AS tokens FROM e GROUP BY tag""")
def losses_of_tags(spark, sf_dir):
    """Every document has two tags, its language and its source."""
    table = _losses(spark, sf_dir).withColumn("tags", F.split("tag", "/"))
    out = measures.losses_of_tags(table, "tags", "loss", "tokens")
    return out.select(F.coalesce("tag", F.lit("all")).alias("tag"), F.round("micro", 6).alias("micro"), "tokens")


@query(f"""WITH {_TOK}, {_LOSS}, t AS (SELECT lang, lang || '/' || source AS tag, sum(loss) AS loss, sum(tokens) AS tokens FROM l GROUP BY lang, source)
SELECT 'eval/' || tag || '/loss' AS name, round(loss / tokens::DOUBLE, 6) AS value FROM t
UNION ALL SELECT 'eval/' || lang || '/macro_loss', round(avg(loss / tokens::DOUBLE), 6) FROM t GROUP BY lang
UNION ALL SELECT 'eval/' || lang || '/micro_loss', round(sum(loss) / sum(tokens)::DOUBLE, 6) FROM t GROUP BY lang""")
def log_names(spark, sf_dir):
    tagged = measures.tagged_losses(_losses(spark, sf_dir), "tag", "loss", "tokens")
    return measures.log_names(tagged, "eval").select("name", F.round("value", 6).alias("value"))


@query("SELECT round(avg(m), 6) AS loss FROM (SELECT event_id // 32 AS b, avg(value) AS m FROM events GROUP BY 1) WHERE b < 50")
def mean_loss(spark, sf_dir):
    table = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 32).alias("b"), "value")
    return measures.mean_loss(table, "b", "value", 50).select(F.round("loss", 6).alias("loss"))


@query("SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY event_type")
def moments(spark, sf_dir):
    out = measures.moments(_table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("SELECT pos::INT AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos")
def position_moments(spark, sf_dir):
    out = measures.position_moments(_table(spark, sf_dir, "embeddings"), "embedding")
    return out.select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""WITH s AS (SELECT o_custkey % 100 AS step, count(*) AS examples, sum(o_orderkey) AS tokens FROM orders GROUP BY 1)
SELECT step::BIGINT AS step, (sum(tokens) OVER (ORDER BY step))::BIGINT AS total_tokens, round(examples / 2.0::DOUBLE, 6) AS examples_per_second, round(tokens / 2.0::DOUBLE, 6) AS tokens_per_second, round(tokens / 2.0::DOUBLE * 6 / 1000 * 100, 6) AS mfu FROM s""")
def throughput(spark, sf_dir):
    """Steps of two seconds."""
    steps = _table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).cast("long").alias("step")).agg(F.count("*").alias("examples"), F.sum("o_orderkey").cast("long").alias("tokens"))
    out = measures.throughput(steps.withColumn("seconds", F.lit(2.0)), flops_per_token=6.0, peak=1000.0)
    return out.select("step", "total_tokens", *(F.round(x, 6).alias(x) for x in ("examples_per_second", "tokens_per_second", "mfu")))


@query("SELECT 'ckpt-' || event_id AS path FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_checkpoint(spark, sf_dir):
    table = _table(spark, sf_dir, "events").select(F.concat(F.lit("ckpt-"), F.col("event_id").cast("string")).alias("path"), "ts", "event_id")
    return measures.latest(table, "path", "ts", "event_id")


@query("""WITH v AS (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id < 100), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v), c AS (SELECT least(floor((x - lo) / ((hi - lo) / 16)), 15)::INT AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT b::INT AS bin, coalesce(n, 0)::BIGINT AS count FROM range(16) AS r(b) LEFT JOIN c ON c.bin = b""")
def value_histogram(spark, sf_dir):
    """Over the first 100 vectors, the limit of a report."""
    table = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return measures.value_histogram(table, "e", 16, 100, "vec_id").select("bin", "count")


# scalars


@query("""SELECT o_orderkey::BIGINT AS o_orderkey, (o_orderkey % 100)::DOUBLE * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 AS seconds,
  ((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 60)::DOUBLE AS clock FROM orders""")
def durations(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    text = lambda n: (k % n).cast("string")
    table = _table(spark, sf_dir, "orders").select(k.alias("o_orderkey"), F.concat(text(100), F.lit("d"), text(24), F.lit("h"), text(60), F.lit("m")).alias("units"), F.concat_ws(":", text(24), text(60), text(60)).alias("clock"))
    return table.select("o_orderkey", scalars.duration_seconds(F.col("units")).alias("seconds"), scalars.duration_seconds(F.col("clock")).alias("clock"))


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_orderkey::DOUBLE AS seconds FROM orders")
def duration_round_trip(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    return _table(spark, sf_dir, "orders").select(k.alias("o_orderkey"), scalars.duration_seconds(scalars.duration_text(k)).alias("seconds"))


@query(r"""SELECT item_id, '<span title="' || printf('%.3f', item_id / 8.0) || '">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</span>' AS span,
  'Q: ' || text || chr(10) || 'A: ' AS question, replace(replace(text || chr(10) || '#### ' || item_id, chr(10), ' '), '####', 'The answer is') AS answer FROM benchmark""")
def report_and_prompts(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark")
    worked = F.concat("text", F.lit("\n#### "), F.col("item_id").cast("string"))
    return items.select("item_id", scalars.log_prob_span(F.col("text"), F.col("item_id") / 8.0).alias("span"), scalars.question(F.col("text")).alias("question"), scalars.answer(worked).alias("answer"))


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Do ' || text ELSE 'Do ' || text || ' with ' || item_id END AS prompt FROM benchmark""")
def instruction_prompts(spark, sf_dir):
    given = F.when(F.col("item_id") % 2 == 0, F.lit("")).otherwise(F.col("item_id").cast("string"))
    return _table(spark, sf_dir, "benchmark").select("item_id", scalars.prompt_of(F.col("text"), given, "Do {instruction} with {input}", "Do {instruction}").alias("prompt"))


@query("""SELECT event_id, 'run/' || CASE event_type WHEN 'click' THEN 'press' ELSE event_type END AS name, ((event_id + 63) // 64 * 64)::BIGINT AS rounded,
  CASE WHEN event_id >= 1000 THEN 0.25::DOUBLE WHEN event_id >= 100 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS rate FROM events""")
def names_and_schedules(spark, sf_dir):
    kind = scalars.without_suffix(F.concat("event_type", F.lit(",none")))
    name = scalars.under("run", scalars.renamed(kind, {"click": "press"}))
    return _table(spark, sf_dir, "events").select("event_id", name.alias("name"), scalars.up_to_multiple(F.col("event_id"), 64).alias("rounded"), scalars.value_at(F.col("event_id"), [(0, 1.0), (100, 0.5), (1000, 0.25)]).alias("rate"))


@query("""WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_max(embedding)::DOUBLE AS m FROM embeddings)
SELECT vec_id, (list_position(e, m) - 1)::INT AS choice, round(m - (m + ln(list_sum(list_transform(e, lambda x: exp(x - m))))), 6) AS log_prob FROM z""")
def greedy_choice(spark, sf_dir):
    table = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return table.select("vec_id", scalars.sampled(F.col("e"), 0.0, F.col("vec_id")).alias("s")).select("vec_id", "s.choice", F.round("s.log_prob", 6).alias("log_prob"))


@query("SELECT source, lang, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source, lang")
def split_tables(spark, sf_dir):
    """Each source's rows in a place of their own, read back by it."""
    parts = store.split_by(_table(spark, sf_dir, "documents"), f"{_scratch(spark)}/split", "source", "lang")
    return parts.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT doc_id, lang, text, source, n_chars FROM documents WHERE source IN ('src1', 'src2')")
def restricted_shards(spark, sf_dir):
    """JSON lines written by source, read again with their shard's name, two of the shards."""
    place = _scratch(spark)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = _table(spark, sf_dir, "documents").select(*columns)
    docs.withColumn("shard", F.col("source")).write.partitionBy("shard").option("ignoreNullFields", False).json(place)
    names = readers.shard_names(readers.files(spark, f"{place}/*"))
    found = readers.with_shards(readers.read(spark, f"{place}/*/*", "jsonl", schema=docs.schema), names)
    chosen = [n for n in names if n.split("/")[0] in ("shard=src1", "shard=src2")]
    return readers.restrict_shards(found, chosen).select(*columns)


@query("SELECT conv_id, first(text ORDER BY turn) FILTER (WHERE role = 'user') AS prompt, first(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS response FROM conversations GROUP BY conv_id HAVING prompt IS NOT NULL AND response IS NOT NULL")
def chat_source(spark, sf_dir):
    """Conversations written as JSON lines with other names of fields and roles, read by the chat reader."""
    place = _scratch(spark)
    chats = formats.messages(_table(spark, sf_dir, "conversations"))
    turns = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    chats.select("conv_id", turns.alias("turns")).write.json(place)
    read = readers.read_chat(spark, f"{place}/*.json", messages="turns", role="from", content="value", user="human")
    return formats.single_turn(read).select("conv_id", "prompt", "response")


@query(f"WITH {_TOK} SELECT source, count(*)::BIGINT AS rows, sum(len(ids))::BIGINT AS tokens FROM tok GROUP BY source")
def built_store(spark, sf_dir):
    """A token table built by groups of shards, as its ledger accounts for it."""
    place = _scratch(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    process = lambda df: tokenizer.encode_words(df, VOCABULARY)
    built = store.build_or_load(spark, place, docs, process, {"vocab_size": VOCABULARY}, shard="source", groups=3)
    ledger = store.read_ledger(spark, place)
    rows_of = spark.createDataFrame(list(ledger["shards"].items()), "source string, rows long")
    return rows_of.join(built.groupBy("source").agg(F.sum(F.size("ids")).cast("long").alias("tokens")), "source")
