"""Chat templates as column expressions: a template is read once, on the driver, and its rendering is one expression.

What is understood: text, {{ expression }}, {% for x in messages %}, {% if %} with elif and else, {% generation %} around what the
model is to learn, and {# comments #}. Expressions are strings, numbers, true and false, names (of the loop, of `constants`), fields as
x.y or x['y'], an element as x[0], loop.first, loop.last, loop.index and loop.index0, + and ~ to join, ==, !=, in ("a" in x), and, or, not,
`is defined`, | trim, | upper, | lower and parentheses. A line feed after a block tag goes, as do blanks before one that begins its
line; "-" in a tag strips all white space on its side. Anything else raises when the template is read. A null renders as nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.S)
_WORD = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+~|().\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_PIECE = "array<struct<text:string,generated:boolean>>"


@dataclass
class _Loop:
    item: Column
    at: Column
    size: Column


Scope = dict[str, object]
Expression = Callable[[Scope], object]


class _Reader:
    """An expression as a function of what its names stand for."""

    def __init__(self, text: str):
        self.words: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            found = _WORD.match(text, at)
            if not found:
                raise ValueError(f"not understood in a template: {text[at:]!r}")
            self.words.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.k = 0

    def peek(self) -> tuple[str, str]:
        return self.words[self.k] if self.k < len(self.words) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, word = self.peek()
        if kind == "end" or (value is not None and word != value):
            raise ValueError(f"{value or 'an expression'} expected in a template, found {word or 'its end'!r}")
        self.k += 1
        return word

    def whole(self) -> Expression:
        out = self.either()
        if self.peek()[0] != "end":
            raise ValueError(f"not understood in a template: {self.peek()[1]!r}")
        return out

    def either(self) -> Expression:
        out = self.both()
        while self.peek() == ("name", "or"):
            self.take()
            out = (lambda a, b: lambda s: _truth(a(s)) | _truth(b(s)))(out, self.both())
        return out

    def both(self) -> Expression:
        out = self.negated()
        while self.peek() == ("name", "and"):
            self.take()
            out = (lambda a, b: lambda s: _truth(a(s)) & _truth(b(s)))(out, self.negated())
        return out

    def negated(self) -> Expression:
        if self.peek() == ("name", "not"):
            self.take()
            return (lambda a: lambda s: ~_truth(a(s)))(self.negated())
        return self.compared()

    def compared(self) -> Expression:
        left = self.joined()
        kind, word = self.peek()
        if word in ("==", "!="):
            self.take()
            right = self.joined()
            return (lambda s: left(s).eqNullSafe(right(s))) if word == "==" else (lambda s: ~left(s).eqNullSafe(right(s)))
        if (kind, word) == ("name", "in"):
            self.take()
            right = self.joined()
            return lambda s: F.coalesce(F.contains(right(s), left(s)), F.lit(False))
        if (kind, word) == ("name", "is"):
            self.take()
            wanted = self.take() != "not"
            if not wanted:
                self.take("defined")
            return lambda s: left(s).isNotNull() if wanted else left(s).isNull()
        return left

    def joined(self) -> Expression:
        out = self.filtered()
        while self.peek()[1] in ("+", "~"):
            sign = self.take()
            add = (lambda a, b: lambda s: F.concat(_text(a(s)), _text(b(s)))) if sign == "~" else (lambda a, b: lambda s: _sum(a(s), b(s)))
            out = add(out, self.filtered())
        return out

    def filtered(self) -> Expression:
        out = self.value()
        while self.peek()[1] == "|":
            self.take()
            name = self.take()
            known = {"trim": lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""), "upper": F.upper, "lower": F.lower}
            if name not in known:
                raise ValueError(f"unknown filter in a template: {name}")
            out = (lambda a, f: lambda s: f(a(s)))(out, known[name])
        return out

    def value(self) -> Expression:
        kind, _ = self.peek()
        word = self.take()
        if kind == "str":
            text = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S)
            out: Expression = lambda s: F.lit(text)
        elif kind == "num":
            number = int(word)
            out = lambda s: F.lit(number)
        elif word == "(":
            out = self.either()
            self.take(")")
        elif kind == "name" and word in ("true", "false", "True", "False"):
            out = lambda s: F.lit(word.lower() == "true")
        elif kind == "name":
            out = lambda s: _named(s, word)
        else:
            raise ValueError(f"not understood in a template: {word!r}")
        while self.peek()[1] in (".", "["):
            if self.take() == ".":
                part: object = self.take()
            else:
                kind, word_ = self.peek()
                part = int(self.take()) if kind == "num" else self.take()[1:-1]
                if kind not in ("num", "str"):
                    raise ValueError("an element is named by a number or a string")
                self.take("]")
            out = (lambda a, p: lambda s: _part(a(s), p))(out, part)
        return out


def _named(scope: Scope, name: str) -> object:
    if name not in scope:
        raise ValueError(f"a template names {name}, which is not given")
    return scope[name]


def _part(value: object, part: object) -> Column:
    if isinstance(value, _Loop):
        known = {"first": value.at == 0, "last": value.at == value.size - 1, "index0": value.at, "index": value.at + 1}
        if part not in known:
            raise ValueError(f"loop.{part} is not known")
        return known[part]
    return F.get(value, F.lit(part)) if isinstance(part, int) else value[part]


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _sum(a: Column, b: Column) -> Column:
    return F.concat(_text(a), _text(b))


def _truth(value: Column) -> Column:
    return F.coalesce(value.cast("boolean"), F.lit(False))


def _parts(template: str) -> list[tuple[str, str]]:
    """(kind, content): text, {{ }} and {% %} in order, white space taken off as tags say."""
    raw = _TAG.split(template)
    out: list[tuple[str, str]] = []
    for k, part in enumerate(raw):
        if k % 2 == 0:
            before, after = raw[k - 1] if k else "", raw[k + 1] if k + 1 < len(raw) else ""
            at_line_start = k == 0
            if before[-3:-2] == "-":
                part = part.lstrip()
            elif before.endswith(("%}", "#}")):
                rest = part[1:] if part.startswith("\n") else part[2:] if part.startswith("\r\n") else part
                at_line_start, part = len(rest) < len(part), rest
            if after[2:3] == "-":
                part = part.rstrip()
            elif after.startswith(("{%", "{#")):
                line = part.rsplit("\n", 1)[-1]
                if not line.strip() and ("\n" in part or at_line_start):
                    part = part[: len(part) - len(line)]
            if part:
                out.append(("text", part))
        elif part.startswith("{#"):
            continue
        else:
            out.append((part[:2], part[2:-2].removeprefix("-").removesuffix("-").strip()))
    return out


def _body(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[Callable[[Scope, bool], list[Column]], int, str]:
    """What stands from `at` to one of the tags `ends`: a function to arrays of pieces; where it ends, and with what."""
    steps: list[Callable[[Scope, bool], Column]] = []

    def piece(text: Column, generated: bool) -> Column:
        return F.array(F.struct(_text(text).alias("text"), F.lit(generated).alias("generated"))).cast(_PIECE)

    def whole(scope: Scope, generated: bool) -> Column:
        found = [s(scope, generated) for s in steps]
        return F.concat(*found) if found else F.array().cast(_PIECE)

    while at < len(parts):
        kind, content = parts[at]
        at += 1
        if kind == "text":
            steps.append((lambda t: lambda s, g: piece(F.lit(t), g))(content))
        elif kind == "{{":
            steps.append((lambda e: lambda s, g: piece(e(s), g))(_Reader(content).whole()))
        else:
            word = content.split(None, 1)[0] if content else ""
            if word in ends:
                return whole, at, content
            if word == "generation":
                inner, at, _ = _body(parts, at, ("endgeneration",))
                steps.append((lambda f: lambda s, g: f(s, True))(inner))
            elif word == "for":
                named = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", content, re.S)
                if not named:
                    raise ValueError(f"not understood in a template: {content!r}")
                inner, at, _ = _body(parts, at, ("endfor",))
                steps.append(_repeated(named[1], _Reader(named[2]).whole(), inner))
            elif word == "if":
                cases, tag = [], content
                while not tag.startswith("endif"):
                    test = _Reader(tag.split(None, 1)[1]).whole() if tag.split(None, 1)[0] in ("if", "elif") else None
                    inner, at, tag = _body(parts, at, ("elif", "else", "endif"))
                    cases.append((test, inner))
                steps.append(_chosen(cases))
            else:
                raise ValueError(f"not understood in a template: {content!r}")
    if ends:
        raise ValueError(f"a template lacks {ends[-1]}")
    return whole, at, ""


def _repeated(name: str, over: Expression, inner) -> Callable[[Scope, bool], Column]:
    def step(scope: Scope, generated: bool) -> Column:
        items = over(scope)
        each = F.flatten(F.transform(items, lambda item, i: inner({**scope, name: item, "loop": _Loop(item, i, F.size(items))}, generated)))
        return F.coalesce(each, F.array().cast(_PIECE))

    return step


def _chosen(cases: list) -> Callable[[Scope, bool], Column]:
    def step(scope: Scope, generated: bool) -> Column:
        out = F.array().cast(_PIECE)
        for test, inner in reversed(cases):
            own = inner(scope, generated)
            out = own if test is None else F.when(_truth(test(scope)), own).otherwise(out)
        return out

    return step


@dataclass(frozen=True)
class Template:
    """A template that was read; constants: names that it may use besides `messages`, such as bos_token."""

    source: str
    constants: tuple[tuple[str, object], ...] = ()

    def __post_init__(self):
        _body(_parts(self.source), 0, ())

    @property
    def marks_generations(self) -> bool:
        return any(kind == "{%" and content == "generation" for kind, content in _parts(self.source))

    def pieces(self, messages: Column) -> Column:
        """The rendering as an array of (text, generated)."""
        render, _, _ = _body(_parts(self.source), 0, ())
        return render({"messages": messages, **{k: F.lit(v) for k, v in self.constants}}, False)

    def rendered(self, df: DataFrame, messages: str = "messages", text: str = "text", spans: str = "spans") -> DataFrame:
        """df with the rendered text, and the (begin, end) of its generated parts in characters, in order, empty ones left out."""
        out = df.withColumn("__pieces", self.pieces(F.col(messages)))
        # ends by a running sum: pieces are few, each may be long
        sizes = F.transform("__pieces", lambda p: F.char_length(p["text"]))
        ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
        out = out.withColumn("__ends", ends)
        spans_ = F.filter(F.transform("__pieces", lambda p, i: F.struct((F.get("__ends", i) - F.char_length(p["text"])).alias("begin"), F.get("__ends", i).alias("end"), p["generated"].alias("g"))), lambda s: s["g"] & (s["end"] > s["begin"]))
        return out.withColumn(text, F.array_join(F.col("__pieces.text"), "")).withColumn(spans, F.transform(spans_, lambda s: F.struct(s["begin"], s["end"]))).drop("__pieces", "__ends")
