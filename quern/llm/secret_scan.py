"""Secrets in texts, with multipart credentials linked.

Assignments to secret names, access identifiers and hexadecimal runs are reported wherever they stand.
Weaker parts (account names, random strings, endpoints) are only reported if a complementary part lies
within SCOPE code points of them: an identifier needs a secret, a secret needs an identifier or an endpoint, an
endpoint needs a secret. Parts of one text are linked by an interval join on buckets of SCOPE.

Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows get equal
results; rows are told apart by id and text. An empty table gives an empty result; other columns pass
through, but for those of the names returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import stage

#: Kinds by rank; the first three are reported unconditionally.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
STRONG = 3
SCOPE = 200
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(r"""(?ai:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[^\s"',;]{3,}""")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""(?ai:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?ai:hostname|host|endpoint|server)["']?\x20*[:=]\x20*["']?[^\s"',;]{4,}""")


def _looks_random(s: str) -> bool:
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= 3.5


def parts(text: str) -> list[int]:
    """rank, start, end of every part, one after another."""
    out = []
    marked = "=" in text or ":" in text
    if marked:
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 12:
                out += (0, m.start(), m.end())
    for rank, pattern in ((1, _ACCESS), (2, _HEX)):
        for m in pattern.finditer(text):
            out += (rank, m.start(), m.end())
    if marked:
        for m in _IDENTIFIER.finditer(text):
            out += (3, m.start(), m.end())
        for m in _ENDPOINT.finditer(text):
            out += (5, m.start(), m.end())
    for m in _RANDOM.finditer(text):
        if _looks_random(m.group()):
            out += (4, m.start(), m.end())
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _parts_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([parts(t) if t else [] for t in texts], dtype=object)


def _structs(flat: Column) -> Column:
    """The numbers of parts() as an array of (start, rank, end)."""
    at = F.sequence(F.lit(0), (F.size(flat) / 3 - 1).cast("int"))
    made = F.transform(at, lambda i: F.struct(F.get(flat, 3 * i + 1).alias("start"), F.get(flat, 3 * i).alias("rank"), F.get(flat, 3 * i + 2).alias("end")))
    return F.when(F.size(flat) > 0, made).otherwise(F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint>>"))


def _linked(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, weak): the weak parts that have a complementary part within SCOPE."""
    has_weak = F.exists("parts", lambda p: p["rank"] >= STRONG)
    each = found.where(has_weak).select("doc_id", "text_key", F.inline("parts"))
    role = F.when(F.col("rank").isin(1, 3), 1).when(F.col("rank").isin(0, 2, 4), 2).otherwise(4)
    each = each.withColumn("role", role)
    weak = each.where(F.col("rank") >= STRONG)
    # a weak part asks in all buckets within SCOPE of it; the other part is in each bucket that it covers
    first, last = F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE)
    weak = weak.withColumn("bucket", F.explode(F.sequence(first, last)))
    covered = F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE)))
    other = each.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), covered.alias("bucket"), F.col("role").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    complementary = ((F.col("role") == 1) & (F.col("r") == 2)) | ((F.col("role") == 2) & F.col("r").isin(1, 4)) | ((F.col("role") == 4) & (F.col("r") == 2))
    apart = (F.col("s") >= F.col("end")) | (F.col("e") <= F.col("start"))
    near = (F.col("s") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("e") + SCOPE) & apart
    same = (weak.text_key == other.k) & weak.doc_id.eqNullSafe(other.d) & (weak.bucket == other.bucket)
    both = weak.join(other, same & complementary & near, "left_semi")
    return both.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "rank", "end")).alias("weak"))


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, base, spans), a row for each of df; arrays of (start, rank, end), sorted.

    base holds the unconditional spans, spans those and the linked weak ones; rank indexes KINDS.
    """
    t = F.col(text).cast("string")
    found = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("text_key"), _parts_udf(t).alias("flat"))
    found = stage(found.select("doc_id", "text_key", _structs(F.col("flat")).alias("parts")), "parts")
    weak = _linked(found).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "weak")
    out = found.join(weak, (found.text_key == weak.k) & found.doc_id.eqNullSafe(weak.d), "left")
    base = F.filter("parts", lambda p: p["rank"] < STRONG)
    none = F.array().cast("array<struct<start:bigint,rank:bigint,end:bigint>>")
    return out.select("doc_id", "text_key", F.sort_array(base).alias("base"), F.sort_array(F.concat(base, F.coalesce("weak", none))).alias("spans"))


def labels(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for text, a, b in zip(texts, starts, ends, strict=True):
        at, pieces = 0, []
        for s, e in zip(a, b, strict=True):
            if e <= at:
                continue
            if s >= at:
                pieces += (text[at:s], MASK)
            at = e
        out.append("".join(pieces) + text[at:])
    return pd.Series(out, dtype=object)


def redact(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with MASK in place of every span; overlapping spans give one. Texts without spans are unchanged.

    The spans are a table of known size: Spark sends them to the texts where they are small, and shuffles otherwise.
    """
    names = {x: f"__secret_{x}" for x in ("id", "key", "starts", "ends")}
    found = scan(df, text, doc_id).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    found = stage(found.select(F.col("doc_id").alias(names["id"]), F.col("text_key").alias(names["key"]), F.col("spans.start").alias(names["starts"]), F.col("spans.end").alias(names["ends"])), "secrets")
    same = df[doc_id].eqNullSafe(found[names["id"]]) & (F.xxhash64(df[text].cast("string")) == found[names["key"]])
    joined = df.join(found, same, "left")
    none = F.array().cast("array<bigint>")
    new = F.when(F.col(names["starts"]).isNotNull(), _masked(F.coalesce(text, F.lit("")), F.coalesce(names["starts"], none), F.coalesce(names["ends"], none))).otherwise(F.col(text))
    return joined.withColumn(text, new).select(*df.columns)
