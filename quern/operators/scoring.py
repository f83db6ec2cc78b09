"""Scoring of requests: prompts with completions are packed, scored by position, and the scores go back to their requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.packing import packed_prompts


def positions(packs: DataFrame) -> DataFrame:
    """(pack, pos, token, target, segment) of the positions that count: target is the token after a position, in its segment."""
    at = F.arrays_zip("tokens", "segments", "mask")
    following = F.transform(at, lambda p, i: F.struct(p["tokens"].alias("token"), F.get("tokens", i + 1).alias("target"), p["segments"].alias("segment"), p["mask"].alias("mask")))
    return packs.select("pack", F.posexplode(following).alias("pos", "p")).where("p.mask = 1 and p.segment >= 0").select("pack", "pos", "p.token", "p.target", "p.segment")


def per_request(scored: DataFrame) -> DataFrame:
    """(request, log_prob, greedy): sums over a segment's positions; greedy: the best token was the target at all of them.

    scored: (pack, pos, segment, target, log_prob, best). A position that was scored twice would count twice, so it raises.
    """
    each = scored.groupBy("segment", "pack").agg(F.sum("log_prob").alias("log_prob"), F.bool_and(F.col("best") == F.col("target")).alias("greedy"), F.count("*").alias("n"), F.count_distinct("pos").alias("different"))
    twice = F.raise_error(F.concat(F.lit("scored twice: request "), F.col("segment").cast("string"))).cast("double")
    return each.select(F.col("segment").alias("request"), F.when(F.col("n") == F.col("different"), F.col("log_prob")).otherwise(twice).alias("log_prob"), "greedy")


def covered(requests: DataFrame, answers: DataFrame, request: str = "idx") -> DataFrame:
    """(request, log_prob, greedy): one answer for each request; one that is missing, doubled or not asked for raises.

    The check is part of the join that brings answers to requests, so it costs no pass of its own.
    """
    summed = answers.groupBy("request").agg(F.count("*").alias("__n"), F.first("log_prob").alias("log_prob"), F.first("greedy").alias("greedy"))
    both = requests.groupBy(F.col(request).alias("request")).agg(F.count("*").alias("__asked")).join(summed, "request", "full")
    wrong = F.when(F.col("__asked").isNull(), "not asked for").when(F.col("__n").isNull(), "missing").when(F.col("__asked") > 1, "asked twice").when(F.col("__n") > 1, "answered twice")
    error = F.raise_error(F.concat(wrong, F.lit(": request "), F.col("request").cast("string"))).cast("double")
    return both.select("request", F.when(wrong.isNull(), F.col("log_prob")).otherwise(error).alias("log_prob"), "greedy")


def score_requests(requests: DataFrame, length: int, max_segments: int, score: Callable[[DataFrame], DataFrame], idx: str = "idx", ids: str = "ids", prompt: str = "prompt_length", pad: int = 0) -> DataFrame:
    """(request, log_prob, greedy) of requests (idx dense, ids, prompt_length): the log probability of each completion.

    score takes positions() and adds log_prob, of the target, and best, the likeliest token. Rows over the length keep their last tokens.
    """
    packs = packed_prompts(requests.select(idx, ids, prompt), length, max_segments, pad, idx, ids, prompt)
    return covered(requests, per_request(score(positions(packs))), idx)


def from_logits(logits: Column, target: Column) -> tuple[Column, Column]:
    """log_prob and best of one position's logits."""
    from quern.functions.arrays import log_sum_exp

    return F.get(logits, target) - log_sum_exp(logits), (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
