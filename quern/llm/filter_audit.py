"""Audit of filters that are applied one after another: what each removes, in every order.

A document's failures are a set of filters. It goes through the lattice of the sets already applied: for each edge (applied set,
next filter), 80 of them for five filters, it is removed there, was removed before, or stays. Documents of the same
part, failures and labels behave alike, so they are counted first, on their own machine before any shuffle; the counts are dealt to the
edges, the edges are summed, and each of the 600 steps of the 120 orders reads the edge that its path takes.

Filters, with failure conditions over the words (maximal runs of other than ASCII white space) of the whole text:
A under 200 words, B under half of them distinct, C over 3 % capitals A-Z, D any of #$%&*|, E identical to the text of a smaller doc_id.
Texts are compared by their SHA-256.

Null texts are empty, null parts the empty string; rows without an id never fail E and have no labels. Repeated rows
count each; a document with several rows of labels has a label if one of them has it. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_or_empty, words_of

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Rows without an id are dealt to so many tasks where ids are joined.
_SPREAD = 1024


def own_failures(text: Column) -> Column:
    """The bits of A to D, A the lowest, for a text without nulls."""
    words = words_of(text)
    n, different = F.size(words), F.size(F.array_distinct(words))
    fails = [n < MIN_WORDS, 100 * different < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text), F.rlike(text, F.lit("[#$%&*|]"))]
    bits = [F.when(fail, F.lit(1 << k)).otherwise(F.lit(0)) for k, fail in enumerate(fails)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failure_counts(df: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(part, failures, good, toxic, n): documents by the bits that they fail and their labels.

    Copies of a text differ in E alone, and of them only the rows of the smallest id don't fail it, so a text's rows
    are counted by id first, then by what they share, wherever they are; no group of copies is gathered.
    """
    body = text_or_empty(text)
    docs = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own_failures(body).alias("own"), F.unhex(F.sha2(body, 256)).alias("digest"))
    rows = docs.groupBy("digest", "id", "part", "own").agg(F.count("*").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_SPREAD))).otherwise(0)
    marked = rows.withColumn("spread", spread).join(marks.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left")
    known = marked.select("digest", "part", "own", "id", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # of each kind of rows of a text: all, those without an id, and those of the smallest id
    kinds = known.groupBy("digest", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    # a text has few kinds: of parts and labels
    least = kinds.groupBy("digest").agg(F.min("first.id").alias("least"))
    both = kinds.join(least, "digest")
    kept = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    cells = both.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("own").alias("failures"), kept.alias("n")), F.struct((F.col("own") + 16).alias("failures"), (F.col("n") - kept).alias("n")))).alias("c"))
    return cells.groupBy("part", "c.failures", "good", "toxic").agg(F.sum("c.n").alias("n")).where("n > 0")


def edges(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, applied, next) with sums for each edge of the lattice: bits of the filters applied, and the number of the next one."""
    every = (1 << len(filters)) - 1
    lattice = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(k).alias("next"), F.lit(1 << k).alias("bit")) for s in range(every + 1) for k in range(len(filters)) if not s >> k & 1))
    each = counts.select("*", F.inline(lattice))
    fails, before = F.col("failures").bitwiseAND(F.col("bit")) != 0, F.col("failures").bitwiseAND(F.col("applied")) != 0
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("part", "applied", "next").agg(
        total(~fails & ~before).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(F.col("failures") == F.col("bit")).alias("unique_fails"),
        total(fails & ~before & F.col("good")).alias("good_lost"),
        total(fails & ~before & F.col("toxic")).alias("toxic_lost"),
    )


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step) with the sums of the edge that the step takes, and shapley: a filter's removals over all orders.

    counts: (part, failures, good, toxic, n). A part has a row for every step, zeros included.
    """
    spark = counts.sparkSession
    size = len(filters)
    paths = []
    for order in permutations(range(size)):
        applied = 0
        for step, k in enumerate(order, 1):
            paths.append(("".join(filters[i] for i in order), step, applied, k))
            applied |= 1 << k
    # given by the filters, whatever the tables hold
    steps = F.broadcast(spark.createDataFrame(paths, "filter_order string, step int, applied int, next int"))
    found = edges(counts, filters)
    # orders that go through an edge: those of the filters before it by those of the filters after it
    through = F.element_at(F.array(*(F.lit(factorial(s) * factorial(size - 1 - s)) for s in range(size))), F.bit_count("applied") + 1)
    shapley = found.groupBy("part", "next").agg(F.sum(F.col("removed") * through).cast("long").alias("shapley"))
    return found.join(steps, ["applied", "next"]).join(shapley, ["part", "next"]).drop("applied", "next")
