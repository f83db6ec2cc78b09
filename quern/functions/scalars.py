"""Scalar helpers as column expressions: durations, flat names, escapes, prompts, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed values: seconds of a unit
UNIT_SECONDS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}


def duration_seconds(text: Column) -> Column:
    """Seconds of "1w3d2h32m" or "4:13:02.266", as a double; null for other forms, an error where negative."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, f"(\\d+){unit}", 1), F.lit("")), F.lit("999999999")).cast("double"), F.lit(0.0)) * UNIT_SECONDS[unit]
    units = sum((part(u) for u in UNIT_SECONDS), F.lit(0.0))
    clock = F.aggregate(F.split(text, ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))
    return (
        F.when(text.startswith("-"), F.raise_error(F.concat(F.lit("negative duration: "), text)).cast("double"))
        .when(text.rlike("^(\\d+w)?(\\d+d)?(\\d+h)?(\\d+m)?(\\d+s)?$") & (text != ""), units)
        .when(text.rlike("^\\d+(:\\d+){0,2}(\\.\\d+)?$"), clock)
    )


def duration_text(seconds: Column) -> Column:
    """Whole seconds as weeks, days, hours, minutes and seconds, parts of zero left out; "0s" for none."""
    left, parts = seconds.cast("long"), []
    for unit, size in UNIT_SECONDS.items():
        n = F.floor(left / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit("")))
        left = left % size
    made = F.concat(*parts)
    negative = F.raise_error(F.lit("negative duration"))
    return F.when(seconds < 0, negative).when(made == "", F.lit("0s")).otherwise(made)


def flat_columns(schema: StructType, prefix: str = "", name: str = "") -> list[Column]:
    """The leaves of nested structs as columns named a/b/c."""
    out = []
    for f in schema.fields:
        path, label = f"{prefix}`{f.name}`", f"{name}{f.name}"
        if isinstance(f.dataType, StructType):
            out += flat_columns(f.dataType, path + ".", label + "/")
        else:
            out.append(F.col(path).alias(label))
    return out


def escaped_html(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def visible(text: Column) -> Column:
    """Line feeds, tabs and runs of spaces as signs: ⏎ (with the feed), ⇥, ␣ for each space of a run."""
    text = F.replace(F.replace(text, F.lit("\n"), F.lit("⏎\n")), F.lit("\t"), F.lit("⇥"))
    return F.regexp_replace(text, " (?= )|(?<= ) ", "␣")


def log_prob_span(token: Column, log_prob: Column) -> Column:
    """A token as a span with its log probability to three decimals."""
    return F.concat(F.lit('<span title="'), F.call_function("format_number", log_prob, F.lit("0.000")), F.lit('">'), escaped_html(token), F.lit("</span>"))


def renamed(value: Column, names: dict[str, str]) -> Column:
    """A value by a map of names; others stay."""
    if not names:
        return value
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), value)


def without_suffix(name: Column, suffix: str = ",none") -> Column:
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def under(prefix: str, name: Column) -> Column:
    """prefix/name."""
    return F.concat_ws("/", F.lit(prefix), name) if prefix else name


def up_to_multiple(x: Column, of: int) -> Column:
    """The next multiple at or above a whole number, in whole numbers."""
    return x.cast("long") + F.pmod(-x.cast("long"), F.lit(of).cast("long"))


def prompt_of(instruction: Column, given: Column, with_input: str, without_input: str) -> Column:
    """A prompt from a template with {instruction} and {input}, or one without the input where there is none."""
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{instruction}"), instruction), F.lit("{input}"), F.coalesce(given, F.lit("")))
    return F.when(F.coalesce(given, F.lit("")) == "", fill(without_input)).otherwise(fill(with_input))


def question(text: Column) -> Column:
    return F.concat(F.lit("Q: "), text, F.lit("\nA: "))


def answer(text: Column) -> Column:
    """A worked answer on one line, its mark spelled out."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("####"), F.lit("The answer is"))


def value_at(step: Column, segments: list[tuple[int, float]]) -> Column:
    """The value of a schedule [(first step, value)] at a step."""
    starts = [s for s, _ in segments]
    if not starts or starts[0] != 0 or starts != sorted(set(starts)):
        raise ValueError("a schedule starts at 0 and ascends")
    out = F.lit(segments[0][1])
    for start, value in segments[1:]:
        out = F.when(step >= start, F.lit(value)).otherwise(out)
    return out


def sampled(logits: Column, temperature: float, draw: Column) -> Column:
    """(choice, log_prob): the greedy choice at temperature 0, else that of the Gumbel trick; draw: a seed for the row."""
    top = F.array_max(logits)
    z = lambda x: top + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))
    if temperature == 0:
        score = logits
    else:
        # uniform in (0, 1) from 53 bits of a hash
        uniform = lambda k: (F.shiftrightunsigned(F.xxhash64(draw, k), 11) + 0.5) / float(1 << 53)
        score = F.transform(logits, lambda x, k: x / temperature - F.log(-F.log(uniform(k))))
    choice = (F.array_position(score, F.array_max(score)) - 1).cast("int")
    return F.struct(choice.alias("choice"), (F.get(logits, choice) - z(logits)).alias("log_prob"))
