"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a condition on a text's measures that rejects it. On a bounded random sample every rule's cost (time
of evaluating it alone, less that of a job that reads the sample only) and selectivity (share of rows rejected)
are estimated; rules are then chained in descending order of rejections per cost in nested CASE expressions. A measure
is bound inside the branch of the first rule that asks for it and serves those after it, so rules after the first that holds
cost nothing and no measure is computed twice; only measures that the caller keeps are computed for every row. A rule may have a guard, a cheaper condition without
which it cannot hold. Order and guards change the time only: the verdict is that of the conjunction.

Null and empty texts have no words and fail. Repeated rows are judged one by one, other columns pass
through untouched (columns made here carry the prefix of PREFIX), an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, SPACE_CLASS, text_or_empty

SYMBOLS = "#*$%&|<>"
PREFIX = "__quality_"


@dataclass(frozen=True)
class Rule:
    """reject: a condition over the measures in needs; guard: one over guard_needs that holds wherever reject does."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[Mapping[str, Column]], Column]
    guard_needs: tuple[str, ...] = ()
    guard: Callable[[Mapping[str, Column]], Column] | None = None


#: What the verdict is made of. Shares are of words, lines or characters.
RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 50),
    # repeated windows cover half of the words: there are n / 6 or more of them, of which every other at most is distinct
    Rule("repeats", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], ("n_same_windows", "n_words"), lambda m: 12 * m["n_same_windows"] >= m["n_words"]),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m["n_symbols"] > 5 * m["n_words"]),
    Rule("shouting", ("n_capitals", "word_chars"), lambda m: 2 * m["n_capitals"] > m["word_chars"]),
    Rule("exclamations", ("n_exclamations", "n_words"), lambda m: 10 * m["n_exclamations"] > 5 * m["n_words"]),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda m: (m["n_dup_lines"] >= 3) & (2 * m["n_dup_lines"] > m["n_lines"])),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, characters: str) -> Column:
    """Characters of a class, given as inside of brackets."""
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("long")


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def _windows(words: Column) -> Column:
    """A hash of each 3-word window."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _window_keys(windows: Column, bits: Column) -> Column:
    """A number for each window: its hash, with the low bits replaced by its position."""
    return F.transform(windows, lambda h, i: _shift("shiftleft", _shift("shiftright", h, bits), bits).bitwiseOR(i.cast("long")))


def _repeated_positions(keys: Column, bits: Column) -> Column:
    """keys sorted: windows whose neighbour has the same hash, as ascending positions."""
    same = lambda a, b: F.coalesce(_shift("shiftright", a.bitwiseXOR(b), bits) == 0, F.lit(False))
    low = _shift("shiftleft", F.lit(1).cast("long"), bits) - 1
    twice = F.filter(keys, lambda k, i: same(k, F.get(keys, i - 1)) | same(k, F.get(keys, i + 1)))
    return F.sort_array(F.transform(twice, lambda k: k.bitwiseAND(low)))


def _covered(positions: Column) -> Column:
    """Words in the union of 3-word windows at ascending positions."""
    step = F.transform(positions, lambda p, i: F.least(F.lit(3).cast("long"), p - F.coalesce(F.get(positions, i - 1), p - 3)))
    return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(windows: Column) -> Column:
    """Words in windows whose hash is there twice or more."""

    def covered(twice: Column) -> Column:
        bits = F.coalesce(F.length(F.bin(F.size(windows).cast("long"))), F.lit(1)).cast("int")
        few = F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i.cast("long"))), lambda p: p.isNotNull())
        many = _let(F.sort_array(_window_keys(windows, bits)), lambda keys: _repeated_positions(keys, bits))
        # a few hashes are looked for one by one; where there are more, a sort brings equal ones together
        return F.when(F.size(twice) == 0, F.lit(0).cast("long")).otherwise(_let(F.when(F.size(twice) <= FEW, few).otherwise(many), _covered))

    repeated = lambda hashes: F.array_distinct(F.filter(hashes, lambda h, i: h == F.get(hashes, i - 1)))
    return _let(_let(F.sort_array(windows), repeated), covered)


def _trimmed(parts: Column) -> Column:
    """Parts of a text split at white space, without the empty ones at its ends."""
    left, right = (F.when(end == "", 1).otherwise(0) for end in (F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)))
    return F.slice(parts, left + 1, F.greatest(F.size(parts) - left - right, F.lit(0)))


def _repeated(items: Column) -> Column:
    return (F.size(items) - F.size(F.array_distinct(items))).cast("long")


#: What measures are made of, besides the text.
PARTS = {"n_words": "words", "windows": "words", "n_repeat_words": "windows", "n_same_windows": "windows", "n_lines": "lines", "n_dup_lines": "lines"}
#: Up to so many repeated hashes are looked for one by one.
FEW = 16


def _made(name: str, text: Column, of: Column | None) -> Column:
    """A measure, or what several are made of, from a text that isn't null and from its part."""
    made = {
        "words": lambda: _let(F.split(text, SPACE_CLASS), _trimmed),
        "windows": lambda: _windows(of),
        "lines": lambda: F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        "n_words": lambda: F.size(of).cast("long"),
        "n_repeat_words": lambda: _repeat_words(of),
        "n_same_windows": lambda: _repeated(of),
        "word_chars": lambda: F.length(_without(text, SPACE)).cast("long"),
        "n_symbols": lambda: _count(text, SYMBOLS),
        "n_capitals": lambda: _count(text, "A-Z"),
        "n_exclamations": lambda: (F.length(text) - F.length(_without(text, "!"))).cast("long"),
        "n_lines": lambda: F.size(of).cast("long"),
        "n_dup_lines": lambda: _repeated(of),
    }
    return made[name]()


def _bound(names: Sequence[str], text: Column, known: Mapping[str, Column], body: Callable[[Mapping[str, Column]], Column]) -> Column:
    """body of known and the measures named; those that aren't known, and what they are made of, are computed once."""
    name = next((x for x in names if x not in known), None)
    if name is None:
        return body(known)
    part = PARTS.get(name)
    if part is not None and part not in known:
        return _bound((part, *names), text, known, body)
    return _let(_made(name, text, known.get(part)), lambda value: _bound(names, text, {**known, name: value}, body))


def measure(name: str, text: Column) -> Column:
    """A measure of a text that isn't null."""
    return _bound((name,), text, {}, lambda m: m[name])


def _verdict(ordered: Sequence[Rule], text: Column, known: Mapping[str, Column]) -> Column:
    """The name of the first rule that rejects a text that isn't null; null if none does.

    A measure is bound by the first rule that asks for it, for itself and for all after it. What only follows a
    guard is bound in the guard's branch.
    """
    if not ordered:
        return F.lit(None).cast("string")
    rule, rest = ordered[0], ordered[1:]
    own = F.lit(rule.name)
    if rule.guard is None or set(rule.needs) <= set(known):
        return _bound(rule.needs, text, known, lambda m: F.when(rule.reject(m), own).otherwise(_verdict(rest, text, m)))

    def guarded(m: Mapping[str, Column]) -> Column:
        held = F.when(rule.guard(m), _bound(rule.needs, text, m, rule.reject)).otherwise(F.lit(False))
        return F.when(held, own).otherwise(_verdict(rest, text, m))

    return _bound(rule.guard_needs, text, known, guarded)


def rejects(rule: Rule, text: Column) -> Column:
    """Whether a rule rejects a text that isn't null."""
    return _verdict((rule,), text, {}).isNotNull()


def _seconds(df: DataFrame, value: Column) -> tuple[float, int]:
    began = time.perf_counter()
    found = df.agg(F.count_if(value)).first()[0]
    return time.perf_counter() - began, found


def order_rules(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 256) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) in the order in which the cascade should try them.

    The sample is drawn from all of df; about sample_rows, twice that at most. Rules that are too fast to time are
    timed again on the sample's rows repeated. It only sets the order of evaluation, never a verdict.
    """
    share = min(1.0, sample_rows / max(1, df.count()))
    sample = df.select(text_or_empty(text).alias("text")).sample(share, 7).limit(2 * sample_rows).persist()
    rows = max(1, sample.count())
    several = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(8))))
    nothing = F.col("text").isNull()
    _seconds(sample, nothing)
    idle, idle_several = (_seconds(x, nothing)[0] for x in (sample, several))
    found = []
    for rule in rules:
        verdict = rejects(rule, F.col("text"))
        took, rejected = _seconds(sample, verdict)
        cost = took - idle
        if cost < 0.3:
            cost = max(_seconds(several, verdict)[0] - idle_several, 1e-3) / 8
        found.append((rule, cost / rows, rejected / rows))
    sample.unpersist()
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def cascade(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 256, keep_measures: Sequence[str] = ()) -> DataFrame:
    """df with failed_rule (string, null where all rules pass) and the measures of keep_measures.

    The columns failed_rule and keep_measures replace columns of the same names.
    """
    ordered = [rule for rule, _, _ in order_rules(df, text, rules, sample_rows)]
    t = F.col(PREFIX + "text")
    made = _bound(keep_measures, t, {}, lambda m: F.struct(_verdict(ordered, t, m).alias("failed_rule"), *(m[x].alias(x) for x in keep_measures)))
    kept = [c for c in df.columns if c != "failed_rule" and c not in keep_measures]
    # filters on the results don't pass a generator; pushed below it, they would repeat the measures' expressions many times over
    out = df.withColumn(PREFIX + "text", text_or_empty(text)).select(*kept, F.explode(F.array(made)).alias(PREFIX))
    return out.select(*kept, *(F.col(PREFIX)[x].alias(x) for x in ("failed_rule", *keep_measures)))
