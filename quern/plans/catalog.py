"""Registered queries of the library and the SQL that checks them.

The test tables have no token ids or losses of their own: tokens come from the word-hash tokenizer, a
token's loss is a fixed function of its id, in thousandths, so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import arrays, tokens
from quern.operators import formats, indexing, measures, mixing, packing, sequences, shuffling

VOCABULARY = 32000
END = 32000
LENGTH = 128
SHARD_ROWS = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(spark: SparkSession, sf_dir: str, end: bool = False) -> DataFrame:
    """documents with a dense idx and ids; end adds the END token."""
    docs = indexing.dense_index(_table(spark, sf_dir, "documents"), "doc_id")
    ids = tokens.word_hash_ids(F.col("text"), VOCABULARY)
    return docs.withColumn("ids", F.concat(ids, F.array(F.lit(END))) if end else ids).drop("text")


def _positions(mask):
    """The sum of the positions where a mask is 1, counted from one."""
    return F.aggregate(F.transform(mask, lambda m, i: m.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)


def _checksum(array: str):
    return F.aggregate(F.transform(array, lambda t, i: t.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum")


_TOK = r"""tok AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, lang, source,
  list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> ''),
                 lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT % 32000) AS ids FROM documents)"""
_FLAT = """flat AS (SELECT t, row_number() OVER (ORDER BY idx, i) - 1 AS g
  FROM (SELECT idx, unnest(list_append(ids, 32000)) AS t, generate_subscripts(list_append(ids, 32000), 1) AS i FROM tok)),
chunk AS (SELECT t, g // 128 AS seq, g % 128 AS pos FROM flat WHERE g // 128 < (SELECT count(*) FROM flat) // 128)"""
_GREEDY = """ord AS (SELECT idx, idx // 64 AS shard, idx % 64 AS k, len(ids) AS n FROM tok),
fold AS (SELECT shard, idx, k, n, 0 AS pack, n AS used, 1 AS segs FROM ord WHERE k = 0
  UNION ALL SELECT o.shard, o.idx, o.k, o.n,
    CASE WHEN f.used + o.n > 512 OR f.segs >= 8 THEN f.pack + 1 ELSE f.pack END,
    CASE WHEN f.used + o.n > 512 OR f.segs >= 8 THEN o.n ELSE f.used + o.n END,
    CASE WHEN f.used + o.n > 512 OR f.segs >= 8 THEN 1 ELSE f.segs + 1 END
  FROM fold f JOIN ord o ON o.shard = f.shard AND o.k = f.k + 1)"""

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


# tokens and formats


@query(f"WITH {_TOK} SELECT doc_id, len(ids)::BIGINT AS n_tokens, coalesce(list_sum(ids), 0)::BIGINT AS id_sum FROM tok")
def token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", tokens.word_hash_ids(F.col("text"), VOCABULARY).alias("ids"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query("SELECT item_id, 'BOS ' || text || ' EOS' AS framed, [item_id, item_id + 1, item_id * 2]::INT[] AS ids FROM benchmark")
def framed_and_pass_through(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark")
    line = F.concat_ws(" ", F.col("item_id").cast("string"), (F.col("item_id") + 1).cast("string"), (F.col("item_id") * 2).cast("string"))
    return items.select("item_id", tokens.framed(F.col("text"), "BOS", "EOS").alias("framed"), tokens.pass_through_ids(line).alias("ids"))


@query(f"WITH {_TOK} SELECT doc_id, list_concat(ids[1:256], list_transform(range(greatest(256 - len(ids), 0)), lambda x: 0::BIGINT))::INT[] AS padded, ids[greatest(len(ids) - 255, 1):]::INT[] AS kept FROM tok")
def pad_and_truncate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", tokens.word_hash_ids(F.col("text"), VOCABULARY).alias("ids"))
    return docs.select("doc_id", tokens.padded(F.col("ids"), 256).alias("padded"), tokens.kept_right(F.col("ids"), 256).alias("kept"))


@query("""WITH f AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations)
SELECT u.conv_id, u.text AS prompt, a.text AS response FROM f u JOIN f a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.r = 1
WHERE u.role = 'user' AND u.r = 1 AND u.text IS NOT NULL AND a.text IS NOT NULL""")
def chat_single_turn(spark, sf_dir):
    return formats.single_turn(formats.messages(_table(spark, sf_dir, "conversations"))).select("conv_id", "prompt", "response")


@query(r"""WITH m AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM conversations),
o AS (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn) - n AS first FROM m)
SELECT conv_id, sum(n + 1)::BIGINT AS n_tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS n_loss,
  sum(CASE WHEN role = 'assistant' THEN n * (first + 1) + n * (n - 1) // 2 ELSE 0 END)::BIGINT AS positions FROM o
GROUP BY conv_id HAVING sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) > 0""")
def chat_assistant_mask(spark, sf_dir):
    chats = formats.chat_tokens(formats.messages(_table(spark, sf_dir, "conversations")), VOCABULARY, "drop")
    return chats.select("conv_id", F.size("ids").cast("long").alias("n_tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_loss"), _positions("mask").alias("positions"))


def _supervised(spark, sf_dir):
    pairs = formats.single_turn(formats.messages(_table(spark, sf_dir, "conversations")))
    return formats.supervised(pairs, VOCABULARY, "\n")


_PAIRS = r"""f AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations),
p AS (SELECT u.conv_id, len(list_filter(regexp_split_to_array(u.text || chr(10), '[ \t\n\r]+'), lambda x: x <> '')) AS s,
  len(list_filter(regexp_split_to_array(u.text || chr(10) || a.text, '[ \t\n\r]+'), lambda x: x <> '')) AS n
  FROM f u JOIN f a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.r = 1 WHERE u.role = 'user' AND u.r = 1)"""


@query(f"WITH {_PAIRS} SELECT conv_id, n::BIGINT AS n_tokens, s::BIGINT AS sources_len, (CASE WHEN s = 0 THEN n - 1 ELSE n - s END)::BIGINT AS n_loss, (n * (n - 1) // 2 - greatest(s - 1, 0) * greatest(s, 0) // 2)::BIGINT AS positions FROM p")
def supervised_mask(spark, sf_dir):
    rows = _supervised(spark, sf_dir).withColumn("mask", arrays.prompt_mask(F.col("ids"), F.col("sources_len")))
    return rows.select("conv_id", F.size("ids").cast("long").alias("n_tokens"), F.col("sources_len").cast("long"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_loss"), _positions("mask").alias("positions"))


@query(f"WITH {_PAIRS} SELECT conv_id, least(n, 64)::BIGINT AS n_tokens, greatest(s - greatest(n - 64, 0), 0)::BIGINT AS sources_len FROM p")
def prompt_completion(spark, sf_dir):
    rows = formats.prompt_completion(_supervised(spark, sf_dir), 64)
    return rows.select("conv_id", F.size("ids").cast("long").alias("n_tokens"), F.col("sources_len").cast("long"))


# sequences


@query(f"WITH {_TOK}, {_FLAT} SELECT seq::BIGINT AS seq, sum(t * (pos + 1))::BIGINT AS checksum FROM chunk GROUP BY seq")
def concat_chunk(spark, sf_dir):
    return sequences.concat_and_chunk(_tokens(spark, sf_dir, True), LENGTH).select("seq", _checksum("tokens"))


@query(f"""WITH {_TOK}, {_FLAT} SELECT seq::BIGINT AS seq, count(*)::BIGINT AS n_tokens, sum((pos < 127)::INT)::BIGINT AS n_loss,
  (1 + sum((t = 32000 AND pos < 127)::INT))::BIGINT AS n_segments, sum(t * (pos + 1))::BIGINT AS checksum,
  sum(CASE WHEN t = 32000 THEN 128 * 129 // 2 - (pos + 1) * (pos + 2) // 2 ELSE 0 END)::BIGINT AS segments FROM chunk GROUP BY seq""")
def causal_masks(spark, sf_dir):
    seqs = sequences.concat_and_chunk(_tokens(spark, sf_dir, True), LENGTH)
    mask = F.aggregate(arrays.causal_loss_mask(F.col("tokens")), F.lit(0).cast("long"), lambda a, x: a + x)
    return seqs.select("seq", F.size("tokens").cast("long").alias("n_tokens"), mask.alias("n_loss"), arrays.n_end_segments(F.col("tokens"), END).cast("long").alias("n_segments"), _checksum("tokens"), _positions(arrays.end_segments(F.col("tokens"), END)).alias("segments"))


@query(f"""WITH {_TOK}, {_FLAT}, n AS (SELECT seq, pos, t, coalesce(lead(t) OVER w, first(t) OVER w) AS nx FROM chunk WINDOW w AS (PARTITION BY seq ORDER BY pos))
SELECT seq::BIGINT AS seq, sum((pos < 127 AND nx <> 32000)::INT)::BIGINT AS n_loss, sum((pos < 127 AND nx <> 32000)::INT * (pos + 1))::BIGINT AS positions FROM n GROUP BY seq""")
def ignore_mask(spark, sf_dir):
    seqs = sequences.concat_and_chunk(_tokens(spark, sf_dir, True), LENGTH)
    mask = arrays.ignore_mask(F.col("tokens"), arrays.causal_loss_mask(F.col("tokens")), END)
    return seqs.select("seq", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_loss"), _positions(mask).alias("positions"))


@query(f"WITH {_TOK} SELECT doc_id, (sum(len(ids)) OVER (ORDER BY idx) - len(ids))::BIGINT AS start, (sum(len(ids)) OVER (ORDER BY idx))::BIGINT AS stop FROM tok")
def row_bounds(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("doc_id", "idx", F.size("ids").cast("long").alias("n"))
    out = indexing.exclusive_sums(rows, "n", "start")
    return out.select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop"))


def _packs(spark, sf_dir):
    rows = _tokens(spark, sf_dir).withColumn("shard", F.floor(F.col("idx") / SHARD_ROWS)).withColumn("n", F.size("ids").cast("long"))
    return rows, packing.greedy_packs(rows, {"n": 512}, 8, "shard", on_long="alone")


@query(f"WITH RECURSIVE {_TOK}, {_GREEDY} SELECT shard::BIGINT AS shard, idx::BIGINT AS idx, pack::BIGINT AS pack FROM fold")
def greedy_pack(spark, sf_dir):
    return _packs(spark, sf_dir)[1]


@query(f"WITH RECURSIVE {_TOK}, {_GREEDY} SELECT shard::BIGINT AS shard, pack::BIGINT AS pack, count(*)::BIGINT AS n_segments, least(sum(n), 512)::BIGINT AS n_tokens, (512 - least(sum(n), 512))::BIGINT AS n_padding FROM fold GROUP BY shard, pack")
def pack_fill(spark, sf_dir):
    rows, packs = _packs(spark, sf_dir)
    sums = rows.select("shard", "idx", "n").join(packs, ["shard", "idx"]).groupBy("shard", "pack").agg(F.count("*").alias("n_segments"), F.least(F.sum("n"), F.lit(512)).cast("long").alias("n_tokens"))
    return sums.withColumn("n_padding", 512 - F.col("n_tokens"))


@query(f"""WITH RECURSIVE {_TOK}, {_GREEDY} SELECT f.shard::BIGINT AS shard, f.pack::BIGINT AS pack, f.idx::BIGINT AS segment,
  coalesce(list_sum(list_transform(t.ids[1:512], lambda x: x % 1000)), 0)::BIGINT AS loss FROM fold f JOIN tok t USING (idx) WHERE len(t.ids) > 0""")
def per_segment_loss(spark, sf_dir):
    rows, packs = _packs(spark, sf_dir)
    whole = packing.packed(rows, packs, 512, "shard")
    each = whole.select("shard", "pack", F.inline(F.arrays_zip("tokens", "segments"))).where("segments >= 0")
    return each.groupBy("shard", "pack", F.col("segments").alias("segment")).agg(F.sum(F.col("tokens") % 1000).cast("long").alias("loss"))


@query(f"""WITH RECURSIVE {_TOK}, {_GREEDY} SELECT f.shard::BIGINT AS shard, f.pack::BIGINT AS pack, f.idx::BIGINT AS segment,
  len(list_filter(t.ids[17:512], lambda x: x % 10 = 3)) = 0 AS correct FROM fold f JOIN tok t USING (idx) WHERE len(t.ids) > 0""")
def per_segment_correct(spark, sf_dir):
    """A token counts as wrong if its id ends in 3; the first 16 tokens of a row are its masked source."""
    rows, packs = _packs(spark, sf_dir)
    whole = packing.packed(rows, packs, 512, "shard")
    each = whole.select("shard", "pack", F.posexplode(F.arrays_zip("tokens", "segments"))).select("shard", "pack", "pos", "col.*").where("segments >= 0").withColumn("source", F.lit(16))
    masked = packing.segment_mask(each, "source", ["shard", "pack", "segments"])
    return masked.groupBy("shard", "pack", F.col("segments").alias("segment")).agg(F.bool_and((F.col("tokens") % 10 != 3) | (F.col("mask") == 0)).alias("correct"))


_FIRST_FIT = """ord AS (SELECT idx, idx // 64 AS shard, idx % 64 AS k, least(len(ids), 512) AS n FROM tok),
step AS (SELECT shard, idx, k, n, CASE WHEN n = 0 THEN NULL ELSE 0 END AS pack, CASE WHEN n = 0 THEN 0 ELSE 1 END AS fresh,
    CASE WHEN n = 0 OR n = 512 THEN []::STRUCT(p BIGINT, t BIGINT, r BIGINT)[] ELSE [{p: 0::BIGINT, t: n::BIGINT, r: 1::BIGINT}] END AS opened FROM ord WHERE k = 0
  UNION ALL SELECT shard, idx, k, n, CASE WHEN n = 0 THEN NULL WHEN slot IS NULL THEN fresh ELSE slot END, CASE WHEN n > 0 AND slot IS NULL THEN fresh + 1 ELSE fresh END,
    list_filter(CASE WHEN n = 0 THEN opened WHEN slot IS NULL THEN list_append(opened[greatest(len(opened) - 2, 1):], {p: fresh::BIGINT, t: n::BIGINT, r: 1::BIGINT})
      ELSE list_transform(opened, lambda x: CASE WHEN x.p = slot THEN {p: x.p, t: x.t + n, r: x.r + 1} ELSE x END) END, lambda x: x.r < 8 AND x.t < 512)
  FROM (SELECT o.shard, o.idx, o.k, o.n, s.fresh, s.opened, (list_filter(s.opened, lambda x: x.t + o.n <= 512)[1]).p AS slot FROM step s JOIN ord o ON o.shard = s.shard AND o.k = s.k + 1))"""


@query(f"WITH RECURSIVE {_TOK}, {_FIRST_FIT} SELECT shard::BIGINT AS shard, idx::BIGINT AS idx, pack::BIGINT AS pack FROM step WHERE n > 0")
def first_fit_pack(spark, sf_dir):
    rows = _tokens(spark, sf_dir).withColumn("shard", F.floor(F.col("idx") / SHARD_ROWS)).withColumn("n", F.least(F.size("ids"), F.lit(512)).cast("long"))
    return packing.first_fit_packs(rows, 512, 8, 4, "shard", n="n")


@query(f"""WITH {_TOK}, {_FLAT}, s AS (SELECT seq, pos, coalesce(sum((t = 32000)::INT) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM chunk)
SELECT q.seq::BIGINT AS seq, count(*)::BIGINT AS n_allowed FROM s q JOIN s k ON q.seq = k.seq AND k.pos <= q.pos AND q.pos - k.pos < 32 AND q.seg = k.seg GROUP BY q.seq""")
def attention_mask(spark, sf_dir):
    """Pairs that may attend in each sequence: causal, within a window of 32, of one segment."""
    seqs = sequences.concat_and_chunk(_tokens(spark, sf_dir, True), LENGTH).select("seq", arrays.end_segments(F.col("tokens"), END).alias("segs"))
    return seqs.select("seq", arrays.attended(F.col("segs"), 32).alias("n_allowed"))


# rows by index


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1 - 50)::BIGINT AS idx FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) - 1 BETWEEN 50 AND 149")
def slice_rows(spark, sf_dir):
    return indexing.slice_rows(_tokens(spark, sf_dir), 50, 150).select("doc_id", "idx")


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, e::INT AS epoch, (e * n + i)::BIGINT AS idx FROM d, range(3) AS r(e)")
def epochs(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("doc_id", "idx")
    return indexing.epochs(rows, 3, rows.count())


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), w(pos, i) AS (VALUES (0, 7), (1, 2), (2, 5), (3, 7), (4, 0)) SELECT pos::BIGINT AS pos, i::BIGINT AS idx, doc_id FROM w JOIN d USING (i)")
def get_batch(spark, sf_dir):
    return indexing.get_batch(_tokens(spark, sf_dir).select("doc_id", "idx"), [7, 2, 5, 7, 0]).select("pos", "idx", "doc_id")


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, i >= n - 20 AS validation FROM d")
def hold_out(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("doc_id", "idx")
    training, validation = indexing.hold_out(rows, 20, rows.count())
    return training.select("doc_id", F.lit(False).alias("validation")).union(validation.select("doc_id", F.lit(True)))


# permutations; the parameters are fixed, so that SQL can follow


@query("WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT o.i::BIGINT AS idx, s.doc_id FROM d o JOIN d s ON s.i = (7919 * o.i + 13) % o.n")
def lcg_shuffle(spark, sf_dir):
    """7919 is prime to every row count of the test tables."""
    rows = _tokens(spark, sf_dir).select("doc_id", "idx")
    return shuffling.permuted(rows, shuffling.lcg(F.col("idx"), rows.count(), 7919, 13)).select("idx", "doc_id")


_KEYS = [11, 222, 3333, 44444, 555555]


def _feistel_sql() -> str:
    """Rounds over `half` bits for the row count at hand, walked by a recursive query."""
    rounds = "SELECT i, v, v >> h AS l, v & m AS r, n, h, m, f FROM walk"
    for k in _KEYS:
        rounds = f"SELECT i, v, r AS l, xor(l, (r * f + ({k} & m)) & m) AS r, n, h, m, f FROM ({rounds})"
    return f"""WITH RECURSIVE c AS (SELECT count(*) AS n, greatest(1, (greatest(1, length(bin(count(*) - 1))) + 1) // 2) AS h FROM documents),
p AS (SELECT n, h, (1 << h) - 1 AS m, 2654435761 & ((1 << h) - 1) AS f FROM c),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
walk AS (SELECT d.i, d.i::BIGINT AS v, n::BIGINT AS n, h::BIGINT AS h, m::BIGINT AS m, f::BIGINT AS f, 0 AS k FROM d, p
  UNION ALL SELECT i, (l << h) | r, n, h, m, f, 1 FROM ({rounds.replace('FROM walk', 'FROM walk WHERE k = 0 OR v >= n')})),
done AS (SELECT i, v FROM walk WHERE k = 1 AND v < n)
SELECT done.i::BIGINT AS idx, d.doc_id FROM done JOIN d ON d.i = done.v"""


@query(_feistel_sql())
def feistel_shuffle(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("doc_id", "idx")
    return shuffling.permuted(rows, shuffling.feistel(F.col("idx"), rows.count(), _KEYS)).select("idx", "doc_id")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
e AS (SELECT i, doc_id, i // 64 AS k, least(64, n - i // 64 * 64) AS size FROM d)
SELECT o.i::BIGINT AS idx, s.doc_id FROM e o JOIN e s ON s.i = o.k * 64 + (o.i % 64 + 2 * o.k + 5) % o.size""")
def era_shuffle(spark, sf_dir):
    """Eras of 64 rows, each turned by another amount."""
    rows = _tokens(spark, sf_dir).select("doc_id", "idx")
    n = rows.count()
    parameters = spark.range(-(-n // 64)).select(F.col("id").alias("era"), F.lit(1).cast("long").alias("a"), (2 * F.col("id") + 5).alias("b"))
    return shuffling.era_permuted(rows, n, 64, parameters).select("idx", "doc_id")


# mixtures and batches

_BLOCK = 100


def _mixture_rows(n_docs: int) -> int:
    """Twice the documents, in whole blocks, so that sources are used up and start again at any size."""
    return -(-2 * n_docs // _BLOCK) * _BLOCK


def _stage_start(n: int, eighths: int) -> int:
    return n * eighths // 8 // _BLOCK * _BLOCK


def _mixed(spark, sf_dir, stages):
    """stages: (start in eighths of the mixture, weights)."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    lengths = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    starts, before = {}, 0
    for lang in sorted(lengths):
        starts[lang], before = before, before + lengths[lang]
    # one index over all sources, less where each begins
    first = mixing.lookup(starts, F.col("lang"))
    rows = indexing.ordered_index(docs, ("lang", "doc_id"), "i").select(F.col("lang").alias("source"), "doc_id", (F.col("i") - first).alias("source_idx"))
    n = _mixture_rows(sum(lengths.values()))
    index = mixing.mixture_index(spark, [mixing.Stage(_stage_start(n, e), w) for e, w in stages], _BLOCK, n, lengths)
    return index.join(rows, ["source", "source_idx"]).select("idx", "source", "source_idx", "doc_id")


def _mix_sql(stages: list[tuple[int, dict[str, int]]]) -> str:
    """stages: start in eighths and rows of each source in a block of 100, in layout order."""
    layout, bounds = [], []
    for k, (eighths, counts) in enumerate(stages):
        stop = f"n * {stages[k + 1][0]} // 8 // 100 * 100" if k + 1 < len(stages) else "n"
        bounds.append(f"SELECT {k} AS stage, n * {eighths} // 8 // 100 * 100 AS start, {stop} AS stop FROM size")
        slots = [(source, i, count) for source, count in counts.items() for i in range(count)]
        layout += [f"({k}, {slot}, '{source}', {i}, {count})" for slot, (source, i, count) in enumerate(slots)]
    return f"""WITH size AS (SELECT (2 * count(*) + 99) // 100 * 100 AS n FROM documents), st AS ({' UNION ALL '.join(bounds)}),
lay(stage, slot, source, i, cnt) AS (VALUES {', '.join(layout)}),
used AS (SELECT l.stage, l.source, coalesce((SELECT sum(e.cnt * ((s.stop - s.start) // 100)) FROM (SELECT DISTINCT stage, source, cnt FROM lay) e JOIN st s USING (stage) WHERE e.stage < l.stage AND e.source = l.source), 0) AS base
  FROM (SELECT DISTINCT stage, source FROM lay) l),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS j, count(*) OVER (PARTITION BY lang) AS n FROM documents),
b AS (SELECT b, st.start, lay.*, used.base, row_number() OVER (PARTITION BY b ORDER BY md5('0-' || b || '-' || slot)) - 1 AS place
  FROM (SELECT unnest(range(n // 100)) AS b FROM size) r JOIN st ON b * 100 >= start AND b * 100 < stop JOIN lay USING (stage) JOIN used USING (stage, source))
SELECT (b * 100 + place)::BIGINT AS idx, source, j::BIGINT AS source_idx, doc_id FROM b JOIN d ON d.lang = b.source AND d.j = (base + cnt * ((b * 100 - start) // 100) + i) % d.n"""


@query(_mix_sql([(0, {"en": 50, "de": 30, "fr": 20})]))
def mixture_constant(spark, sf_dir):
    return _mixed(spark, sf_dir, [(0, {"en": 0.5, "de": 0.3, "fr": 0.2, "es": 0.0})])


@query(_mix_sql([(0, {"en": 60, "de": 40}), (2, {"fr": 25, "es": 75}), (5, {"en": 34, "de": 33, "es": 33})]))
def mixture_staged(spark, sf_dir):
    thirds = {"en": 1.0, "de": 1.0, "es": 1.0}
    return _mixed(spark, sf_dir, [(0, {"en": 3.0, "de": 2.0}), (2, {"fr": 1.0, "es": 3.0}), (5, thirds)])


_SCHEDULE = mixing.Schedule(((0, 8), (10, 16), (20, 32)))
_BATCH_SQL = """CASE WHEN i < 80 THEN i // 8 WHEN i < 240 THEN 10 + (i - 80) // 16 ELSE 20 + (i - 240) // 32 END AS step,
CASE WHEN i < 80 THEN i % 8 WHEN i < 240 THEN (i - 80) % 16 ELSE (i - 240) % 32 END AS pos,
CASE WHEN i < 80 THEN 8 WHEN i < 240 THEN 16 ELSE 32 END AS size"""


@query(f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), s AS (SELECT doc_id, {_BATCH_SQL} FROM d)
SELECT step::BIGINT AS step, pos::BIGINT AS pos, doc_id FROM s QUALIFY count(*) OVER (PARTITION BY step) = size""")
def batch_schedule(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("doc_id", "idx")
    return mixing.batches(rows, _SCHEDULE, rows.count(), False).select("step", "pos", "doc_id")


@query(f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), s AS (SELECT doc_id, {_BATCH_SQL} FROM d)
SELECT step::BIGINT AS step, any_value(size)::BIGINT AS n_rows, (any_value(size) - count(*))::BIGINT AS n_padding FROM s GROUP BY step""")
def padded_batches(spark, sf_dir):
    rows = _tokens(spark, sf_dir).select("doc_id", "idx")
    out = mixing.batches(rows, _SCHEDULE, rows.count(), True)
    return out.groupBy("step").agg(F.count("*").alias("n_rows"), F.count_if("padding").alias("n_padding"))


# measures


@query(f"""WITH {_TOK} SELECT lang, count(*)::BIGINT AS docs, sum(len(ids))::BIGINT AS tokens, (sum(len(ids)) // 4096)::BIGINT AS seqs,
  round((sum(len(ids)) % 4096) / nullif(sum(len(ids)) // 4096 * 4096, 0)::DOUBLE, 9) AS truncated FROM tok GROUP BY lang""")
def corpus_sizes(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("lang", F.size(tokens.word_hash_ids(F.col("text"), VOCABULARY)).alias("n"))
    return measures.corpus_sizes(rows, "lang", "n").withColumn("truncated", F.round("truncated", 9))


def _losses(spark, sf_dir):
    ids = tokens.word_hash_ids(F.col("text"), VOCABULARY)
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("tag"), F.octet_length("text").cast("long").alias("bytes"), ids.alias("ids"))
    return rows.withColumn("tokens", F.size("ids").cast("long")).withColumn("loss", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x % 1000))


_LOSS = "l AS (SELECT doc_id, lang, source, len(ids) AS tokens, coalesce(list_sum(list_transform(ids, lambda x: x % 1000)), 0) AS loss FROM tok)"


@query(f"""WITH {_TOK}, {_LOSS}, t AS (SELECT lang, lang || '/' || source AS tag, sum(loss) AS loss, sum(tokens) AS tokens FROM l GROUP BY lang, source)
SELECT tag, round(loss / tokens::DOUBLE, 6) AS micro, round(loss / tokens::DOUBLE, 6) AS macro, tokens::BIGINT AS tokens FROM t
UNION ALL SELECT lang, round(sum(loss) / sum(tokens)::DOUBLE, 6), round(avg(loss / tokens::DOUBLE), 6), sum(tokens)::BIGINT FROM t GROUP BY lang""")
def tag_hierarchy(spark, sf_dir):
    out = measures.tagged_losses(_losses(spark, sf_dir), "tag", "loss", "tokens")
    return out.select("tag", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"), "tokens")


@query(f"""WITH {_TOK}, {_LOSS}, b AS (SELECT doc_id // 16 AS batch, sum(loss) AS loss, sum(tokens) AS tokens, sum(strlen(text)) AS bytes FROM l JOIN documents USING (doc_id) GROUP BY 1)
SELECT round(sum(loss / greatest(bytes, 1)::DOUBLE * log2(exp(1.0)) * tokens) / sum(tokens), 6) AS bpb, sum(tokens)::BIGINT AS tokens FROM b""")
def bits_per_byte(spark, sf_dir):
    rows = _losses(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 16))
    return measures.bits_per_byte(rows, "batch", "loss", "tokens", "bytes").select(F.round("bpb", 6).alias("bpb"), "tokens")


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 32)), 31)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT b::INT AS bin, round(lo + b * ((hi - lo) / 32), 8) AS low, round(lo + (b + 1) * ((hi - lo) / 32), 8) AS high, coalesce(n, 0)::BIGINT AS count
FROM e, range(32) AS r(b) LEFT JOIN c ON c.bin = b""")
def histogram(spark, sf_dir):
    out = measures.histogram(_table(spark, sf_dir, "lineitem"), "l_extendedprice", 32)
    return out.select("bin", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"), "count")


@query("SELECT event_type, round(coalesce(sum(value * user_id) / nullif(sum(user_id), 0), 0), 4) AS mean, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def running_mean_merge(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(measures.weighted_mean("value", "user_id"), 4).alias("mean"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT label, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s FROM embeddings)
SELECT label, round(sqrt(sum(s)), 6) AS norm FROM s GROUP BY GROUPING SETS ((label), ())""")
def leaf_norms(spark, sf_dir):
    return measures.norms(_table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", F.round("norm", 6).alias("norm"))


@query("""WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_max(embedding)::DOUBLE AS m FROM embeddings),
y AS (SELECT vec_id, e, m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))) AS z FROM z)
SELECT vec_id, round(z - list_sum(list_transform(e, lambda x: exp(x - z) * x)), 6) AS entropy FROM y""")
def entropy(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(arrays.entropy(F.col("e")), 6).alias("entropy"))


@query("SELECT vec_id, round(list_reverse_sort(embedding)[1]::DOUBLE - list_reverse_sort(embedding)[2]::DOUBLE, 6) AS gap FROM embeddings")
def top2_gap(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(arrays.top2_gap(F.col("e")), 6).alias("gap"))


@query("""WITH z AS (SELECT vec_id, embedding[vec_id % 64 + 1]::DOUBLE AS t, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_max(embedding)::DOUBLE AS m FROM embeddings)
SELECT vec_id, round(m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))) - t, 6) AS loss FROM z""")
def cross_entropy(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(arrays.cross_entropy(F.col("e"), (F.col("vec_id") % 64).cast("int")), 6).alias("loss"))


@query("""WITH t AS (SELECT event_type AS metric, user_id, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)
SELECT metric, round(avg(v), 6) AS macro, round(sum(v * n) / sum(n), 6) AS micro FROM t GROUP BY metric""")
def task_averages(spark, sf_dir):
    tasks = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"), "user_id").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return measures.averages(tasks, "metric", "v", "n").select("metric", F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


@query("""WITH c AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT event_id, user_id, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
SELECT event_id, run::BIGINT AS run, (row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1)::INT AS run_pos FROM r""")
def segment_runs(spark, sf_dir):
    return measures.run_positions(_table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "run", F.col("run_pos").cast("int"))


@query("SELECT source, count(*)::BIGINT AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def split_by_category(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"""WITH {_TOK}, s AS (SELECT source, idx // 128 AS part, count(*) AS n, sum(len(ids)) AS t FROM tok GROUP BY 1, 2)
SELECT source, count(*)::BIGINT AS shards, sum(n)::BIGINT AS rows, sum(t)::BIGINT AS tokens, min(n)::BIGINT AS least, max(n)::BIGINT AS most FROM s GROUP BY source""")
def ledger_totals(spark, sf_dir):
    parts = _tokens(spark, sf_dir).groupBy("source", F.floor(F.col("idx") / 128).alias("part")).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("t"))
    return parts.groupBy("source").agg(F.count("*").alias("shards"), F.sum("n").alias("rows"), F.sum("t").cast("long").alias("tokens"), F.min("n").alias("least"), F.max("n").alias("most"))
