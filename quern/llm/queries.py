"""One query per operator, each over its whole table, and the SQL that can check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import byte_bpe, classlm, decontam, filter_audit, passages, pieces, quality, secret_scan, simhash, suffix_dedup, template_html, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.classify(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(_table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_html.extract(_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.cascade(docs, keep_measures=base)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return out.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("failed_rule").isNull()).alias("kept"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    counts = [count(rank).alias(f"n_{name}") for rank, name in enumerate(secret_scan.KINDS[: secret_scan.STRONG])]
    return found.select("doc_id", *counts, F.sha2(secret_scan.labels("base"), 256).alias("base_sha256"), secret_scan.labels("spans").alias("spans"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents only, with the items that they hold."""
    found = decontam.findings(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    each = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"), F.max("reparameterised").alias("reparameterised"))
    return each.withColumn("n_items", F.size("item_ids").cast("long"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a passage with another, their class and the words that repeat."""
    found = passages.repeated_passages(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("passages", lambda s: F.concat_ws(":", s["first"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "class_id", F.size("passages").cast("long").alias("n_passages"), spans.alias("passages"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.failure_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.audit(counts).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    hexes = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return vector_codes.with_label_errors(codes).select("vec_id", hexes.alias("code"), "error", "label_error", F.lit(vector_codes.digest_of(books)).alias("codebooks_sha256"))


_OP5_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS r(i)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, range(3) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
      length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
      length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS caps, length(regexp_replace(text, '[^!]+', '', 'g')) AS ex, len(ls) AS nl
      FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 5 * n_words OR 2 * caps > word_chars
       OR 10 * ex > 5 * n_words OR (n_dup_lines >= 3 AND 2 * n_dup_lines > nl) OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM m
"""


_OP11_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, i::INT AS step, list_sum(list_transform(range(1, i), lambda k: 1 << (strpos('ABCDE', o[k]) - 1)))::INT AS applied, (1 << (strpos('ABCDE', o[i]) - 1))::INT AS bit FROM o, range(1, 6) AS r(i)),
t AS (SELECT part, o, step, bit,
  sum(CASE WHEN fails & (coalesce(applied, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails & coalesce(applied, 0) = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & coalesce(applied, 0) <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails & coalesce(applied, 0) = 0 AND fails & bit <> 0 THEN n * good ELSE 0 END) AS good_lost,
  sum(CASE WHEN fails & coalesce(applied, 0) = 0 AND fails & bit <> 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, o, step, bit)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM t
"""


def _op13_sql() -> str:
    """The rounds one after another, each over components, in SQL."""
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, w) AS r, vec_id, label, w FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""", """x AS MATERIALIZED (SELECT r, i // (n // 8) AS part, i % (n // 8) AS pos, w[i + 1] AS v FROM (SELECT r, w, len(w) AS n, unnest(range(len(w))) AS i FROM v))""", "c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v FROM x WHERE r <= 16)"]
    for k in range(7):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'entry': entry}}) AS b FROM (SELECT r, x.part, entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL) GROUP BY ALL)")
        if k < 6:
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce((s - ((s % n) + n) % n) // n, c.v) AS v FROM c{k} c LEFT JOIN
  (SELECT part, b.entry AS entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM a{k} JOIN x USING (r, part) GROUP BY ALL) USING (part, entry, pos))""")
    parts.append("e AS (SELECT r, string_agg(printf('%02x', b.entry), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM a6 GROUP BY r)")
    parts.append("h AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM c6)")
    return f"WITH {', '.join(parts)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN e USING (r), h"


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_simhash": op1_simhash, "op2_toxicity": op2_toxicity, "op3_classlm": op3_classlm, "op4_html": op4_html, "op5_quality": op5_quality, "op6_pieces": op6_pieces, "op7_secrets": op7_secrets, "op8_decontam": op8_decontam, "op9_passages": op9_passages, "op10_suffixes": op10_suffixes, "op11_filter_audit": op11_filter_audit, "op12_byte_bpe": op12_byte_bpe, "op13_vector_codes": op13_vector_codes, "pipeline": pipeline}
ORACLES = {"op5_quality": _OP5_SQL, "op11_filter_audit": _OP11_SQL, "op13_vector_codes": _op13_sql()}
