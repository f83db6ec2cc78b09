"""Array columns of sequences: masks, segments, entropy, gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def causal_loss_mask(tokens: Column) -> Column:
    """1 but for the last position."""
    return F.transform(tokens, lambda _, i: (i < F.size(tokens) - 1).cast("int"))


def ignore_mask(tokens: Column, mask: Column, ignore: int) -> Column:
    """mask, with zero where the next token, circularly, is `ignore`."""
    following = lambda i: F.get(tokens, F.pmod(i + 1, F.size(tokens)))
    return F.transform(mask, lambda m, i: F.when(following(i) == ignore, 0).otherwise(m))


def end_segments(tokens: Column, end: int) -> Column:
    """For each position the number of `end` tokens before it: the segments between them, each repeated by its length."""
    ends = F.filter(F.transform(tokens, lambda t, i: F.when(t == end, i)), lambda i: i.isNotNull())
    stops = F.concat(ends, F.array(F.size(tokens) - 1))
    runs = F.transform(stops, lambda stop, k: F.array_repeat(k, stop - F.coalesce(F.get(stops, k - 1), F.lit(-1))))
    # most sequences have no end, which is seen without a function of each position
    without = tokens.isNotNull() & ~F.coalesce(F.array_contains(tokens, end), F.lit(False))
    return F.when(without, F.array_repeat(F.lit(0), F.size(tokens))).otherwise(F.flatten(runs))


def attended(segments: Column, window: int) -> Column:
    """Pairs (query, key) of positions: the key not after the query, fewer than `window` before it, of its segment."""
    seen = lambda s, i: F.slice(segments, F.greatest(i - (window - 2), F.lit(1)), F.least(i + 1, F.lit(window)))
    each = F.transform(segments, lambda s, i: F.size(F.filter(seen(s, i), lambda k: k == s)).cast("long"))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def n_end_segments(tokens: Column, end: int) -> Column:
    """The number of segments that end_segments tells apart."""
    before_last = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.size(F.filter(before_last, lambda t: t == end)) + 1


def prompt_mask(tokens: Column, prompt: Column) -> Column:
    """1 from the last prompt token on, but for the last position."""
    return F.transform(tokens, lambda _, i: ((i >= prompt - 1) & (i < F.size(tokens) - 1)).cast("int"))


def segments_of_lengths(lengths: Column) -> Column:
    """Each index repeated by its length."""
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))


def entropy(logits: Column) -> Column:
    """log Z minus the mean logit under the softmax."""
    z = log_sum_exp(logits)
    return z - F.aggregate(F.transform(logits, lambda x: F.exp(x - z) * x), F.lit(0.0), lambda a, x: a + x)


def top2_gap(logits: Column) -> Column:
    """The best logit minus the second best."""
    best = F.slice(F.sort_array(logits, False), 1, 2)
    return F.get(best, 0) - F.get(best, 1)


def cross_entropy(logits: Column, target: Column, z_weight: float = 0.0) -> Column:
    z = log_sum_exp(logits)
    return z - F.get(logits, target) + z_weight * z * z
