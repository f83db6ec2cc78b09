"""Corpus sizes, tagged losses, bits per byte, histograms, norms, averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.indexing import exclusive_sums, ordered_index


def corpus_sizes(df: DataFrame, group: str, tokens: str, length: int = 4096) -> DataFrame:
    """Documents, tokens, whole sequences of `length`, and tokens cut off as a share of those kept, for each group."""
    sums = df.groupBy(group).agg(F.count("*").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))
    seqs = F.floor(F.col("tokens") / length)
    return sums.withColumn("seqs", seqs).withColumn("truncated", F.try_divide(F.col("tokens") - seqs * length, seqs * length))


def corpus_statistics(sizes: DataFrame, group: str, weights: dict[str, float] | None = None, length: int = 4096, sequences: str = "seqs") -> DataFrame:
    """sizes (group, docs, tokens, sequences) with truncation or padding, and with weights: weight, normalized, and tokens an epoch of the mixture.

    What sequences don't hold of the tokens is truncation, what they hold besides is padding, as shares of what they hold. A group without
    a weight, or with none above zero, has no epoch. Tokens an epoch: those of the whole mixture until the group is used up.
    """
    held = F.col(sequences) * length
    padding = 1 - F.try_divide(F.col("tokens"), held)
    out = sizes.withColumn("truncation", F.when(padding < 0, -padding)).withColumn("padding", F.when(padding >= 0, padding))
    if weights is None:
        return out
    total = sum(weights.values())
    table = sizes.sparkSession.createDataFrame([(k, float(w), w / total) for k, w in weights.items()], f"{group} string, weight double, normalized double")
    # a row a source of the mixture
    out = out.join(F.broadcast(table), group, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("normalized", F.coalesce("normalized", F.lit(0.0)))
    return out.withColumn("tokens_per_epoch", F.try_divide(held, F.nullif(F.col("normalized"), F.lit(0.0))))


def statistic_names(statistics: DataFrame, group: str, prefix: str = "data/stats/train") -> DataFrame:
    """(name, value) of corpus_statistics(), nulls left out."""
    values = [c for c in statistics.columns if c != group]
    each = F.array(*(F.struct(F.concat_ws("/", F.lit(prefix), group, F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in values))
    return statistics.select(F.inline(each)).where("value is not null")


def weighted_mean(value: str, weight: str):
    """The mergeable running mean; zero where nothing has weight."""
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(0.0))


def with_parents(df: DataFrame, tag: str, name: str = "parent") -> DataFrame:
    """A row for each proper prefix of a tag a/b/c: a and a/b."""
    parts = F.split(tag, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return df.where(F.size(parts) > 1).withColumn(name, F.explode(prefixes))


def tagged_losses(df: DataFrame, tag: str, loss: str, tokens: str) -> DataFrame:
    """(tag, micro, macro, tokens) for tags and their parents.

    micro weighs by tokens; a parent's macro is the mean of its tags' means, a tag's own equals its micro.
    """
    leaf = df.groupBy(F.col(tag).alias("tag")).agg(F.sum(loss).alias("loss"), F.sum(tokens).alias("tokens"))
    leaf = leaf.withColumn("mean", F.col("loss") / F.col("tokens"))
    parents = with_parents(leaf, "tag").groupBy("parent").agg(F.sum("loss").alias("loss"), F.sum("tokens").alias("tokens"), F.avg("mean").alias("macro"))
    own = leaf.select("tag", F.col("mean").alias("micro"), F.col("mean").alias("macro"), "tokens")
    return own.union(parents.select("parent", F.col("loss") / F.col("tokens"), "macro", "tokens"))


def bits_per_byte(df: DataFrame, batch: str, loss: str, tokens: str, bytes_: str) -> DataFrame:
    """loss / max(bytes, 1) in bits for each batch, then their token-weighted mean."""
    each = df.groupBy(batch).agg(F.sum(loss).alias("loss"), F.sum(tokens).alias("tokens"), F.sum(bytes_).alias("bytes"))
    each = each.withColumn("bpb", F.col("loss") / F.greatest(F.col("bytes"), F.lit(1)) * F.log2(F.exp(F.lit(1.0))))
    return each.agg((F.sum(F.col("bpb") * F.col("tokens")) / F.sum("tokens")).alias("bpb"), F.sum("tokens").alias("tokens"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, count) of equal width from minimum to maximum, the last bin closed; empty bins count 0."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    k = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(k.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, "bin", "left")
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("n", F.lit(0)).alias("count"))


def norms(df: DataFrame, key: str, values: str) -> DataFrame:
    """The Frobenius norm of each key's arrays, and of all (key null)."""
    squares = df.select(key, F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("s"))
    return squares.groupingSets([[squares[key]], []], squares[key]).agg(F.sqrt(F.sum("s")).alias("norm"))


def averages(df: DataFrame, metric: str, value: str, n: str) -> DataFrame:
    """macro (mean of tasks) and micro (weighted by n) for each metric."""
    return df.groupBy(metric).agg(F.avg(value).alias("macro"), (F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("micro"))


def task_averages(results: DataFrame, counts: DataFrame, task: str = "task", metric: str = "metric", value: str = "value", n: str = "n") -> DataFrame:
    """(metric, macro, micro, tasks) of results (task, metric, value), weighted by counts (task, n).

    Left out are metrics that tell an error ("stderr" in the name) or an alias, tasks without a count, which are averages
    themselves, and tasks without the metric. A metric that no task is left for has no row; micro is null where n adds up to nothing.
    """
    kept = results.where(~F.contains(F.col(metric), F.lit("stderr")) & (F.col(metric) != "alias") & F.col(value).isNotNull())
    each = kept.join(counts.where(F.col(n).isNotNull()).select(task, n), task)
    return each.groupBy(metric).agg(F.avg(value).alias("macro"), F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n)).alias("micro"), F.count("*").alias("tasks"))


def run_positions(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with run (number of the run of equal values within key) and run_pos (position in it)."""
    line = Window.partitionBy(key).orderBy(order)
    change = F.when(F.col(value) == F.lag(value).over(line), 0).otherwise(1)
    runs = df.withColumn("__change", change).withColumn("run", F.sum("__change").over(line)).drop("__change")
    return runs.withColumn("run_pos", F.row_number().over(Window.partitionBy(key, "run").orderBy(order)) - 1)


def moments(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """n, mean and population variance, whose sums are merged around the mean, so that large values don't cancel."""
    x = F.col(value).cast("double")
    return (df.groupBy(by) if by else df.groupBy()).agg(F.count(value).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"))


def position_moments(df: DataFrame, values: str) -> DataFrame:
    """(pos, mean, std): the mean and population deviation of each position over all arrays."""
    each = df.select(F.posexplode(values).alias("pos", "x"))
    return each.groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def losses_of_tags(df: DataFrame, tags: str, loss: str, tokens: str) -> DataFrame:
    """(tag, micro, tokens) where a row counts for each of its several tags, and for the null tag, all rows, once."""
    each = df.select(F.explode(F.array_distinct(tags)).alias("tag"), loss, tokens).union(df.select(F.lit(None).cast("string"), loss, tokens))
    return each.groupBy("tag").agg(F.try_divide(F.sum(loss), F.sum(tokens)).alias("micro"), F.sum(tokens).cast("long").alias("tokens"))


def log_names(df: DataFrame, prefix: str) -> DataFrame:
    """(name, value) of tagged_losses(): leaves log a loss, parents a macro and a micro loss."""
    tags = df.select("tag", "micro", "macro")
    parents = with_parents(tags, "tag").select(F.col("parent").alias("tag")).distinct().withColumn("is_parent", F.lit(True))
    named = tags.join(parents, "tag", "left")
    at = F.concat(F.lit(f"{prefix}/"), F.col("tag"), F.lit("/"))
    pair = lambda name, value: F.struct(F.concat(at, F.lit(name)).alias("name"), F.col(value).alias("value"))
    own = F.when(F.col("is_parent"), F.array(pair("macro_loss", "macro"), pair("micro_loss", "micro"))).otherwise(F.array(pair("loss", "micro")))
    return named.select(F.inline(own))


def mean_loss(df: DataFrame, batch: str, loss: str, max_batches: int | None = None) -> DataFrame:
    """The unweighted mean of batches' mean losses, of the first max_batches if given."""
    rows = df if max_batches is None else df.where(F.col(batch) < max_batches)
    return rows.groupBy(batch).agg(F.avg(loss).alias("loss")).agg(F.avg("loss").alias("loss"))


def throughput(steps: DataFrame, tokens: str = "tokens", examples: str = "examples", seconds: str = "seconds", flops_per_token: float | None = None, peak: float | None = None) -> DataFrame:
    """A step table with its running totals and rates; with flops, the share of the peak that is used."""
    # running totals by blocks of steps, so that no task orders all of them
    placed = exclusive_sums(ordered_index(steps, ("step",), "__at"), tokens, "__earlier", "__at")
    out = placed.withColumn("total_tokens", F.col("__earlier") + F.col(tokens)).drop("__at", "__earlier").withColumn("examples_per_second", F.col(examples) / F.col(seconds)).withColumn("tokens_per_second", F.col(tokens) / F.col(seconds))
    return out.withColumn("mfu", F.col("tokens_per_second") * flops_per_token / peak * 100) if flops_per_token and peak else out


def epoch_progress(processed, rows: int, epochs: int = 1):
    return processed / (rows * epochs)


def total_tokens(length: int, rows: int) -> int:
    return length * rows


def latest(df: DataFrame, path: str, *by: str) -> DataFrame:
    """The path of the greatest (by, ...)."""
    return df.agg(F.max_by(path, F.struct(*by)).alias(path))


def padding_share(df: DataFrame, segments: str = "segments") -> DataFrame:
    """Positions and the share of them that is padding (segment -1)."""
    each = df.select(F.size(segments).alias("n"), F.size(F.filter(segments, lambda s: s == -1)).alias("p"))
    return each.agg(F.sum("n").cast("long").alias("positions"), F.try_divide(F.sum("p"), F.sum("n")).alias("padding"))


def value_histogram(df: DataFrame, values: str, bins: int, max_rows: int | None = None, idx: str = "idx") -> DataFrame:
    """A histogram of the numbers in arrays, of the first max_rows rows if given (a report's limit)."""
    rows = df if max_rows is None else df.where(F.col(idx) < max_rows)
    return histogram(rows.select(F.explode(values).alias("value")), "value", bins)
