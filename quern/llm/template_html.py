"""Main text of web pages, with templates deduced from pages of the same host.

Tokens are tags with their paths (names and classes from the root) and whole text blocks with theirs. A token's
occurrence vector (how often it is on which page) is folded into a 64-bit sum that partial aggregation can merge, so no
task gathers a host. Tokens of a host with equal vectors form a class. A class is valid if it has a tag, two tokens or more,
and spans TEMPLATE_SHARE of the host's pages, MIN_PAGES of them and as many different contents at
least (copies of one page make no template). Valid classes nest by their paths into the host's template: their texts are fixed
and go, and the places that their tags open are its slots. A slot that occurs on MIN_PAGES pages or more is
filled from a stock, as menus, adverts and footers are, if most of its texts also stand in it on pages of other
content; all that is in such a slot goes.

In the remaining slots, and on pages too few for a template, names decide what belongs to the article: what is
inside article or main if a page has these, else the body without blocks that are mostly links, and never
navigation, headers, footers, sidebars, notices, adverts, forms, scripts or comments.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line
feed. Null, empty and text-less pages give an empty text; unclosed tags end with their parent, a tag cut
off by the page's end goes. Pages without a url have no template. Repeated rows give equal results, an empty table
an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import bit_map, in_bit_map, stage, unstage

MIN_PAGES = 4
TEMPLATE_SHARE = 0.9
#: Share of a slot's texts that come from a stock.
STOCK = 0.5
#: Bits of the map of template texts that every task holds; it only spares rows.
FILTER_BITS = 1 << 23
SALTS = 16

# fixed values: element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select option object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("nav footer aside form button dialog menu head label input fieldset legend audio video canvas".split()) | RAW
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification alert overlay pagination pager popup promo promoted promotion recommended related reply replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar tracking widget widgets respond".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog status".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<(?=/?[a-zA-Z])[^<>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACES = re.compile(r"\s+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_OUT, _MAIN = 1, 2

_roles: dict[tuple[str, str], int] = {}


def _role(tag: str, attributes: str, inside: bool) -> int:
    """_OUT for parts that never belong to an article, _MAIN for its container."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return _OUT
    out = _MAIN if tag in ("article", "main") else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return out
    known = _roles.get((tag, attributes))
    if known is None:
        known = out
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "role":
                known |= _OUT if value.lower() in ROLES else _MAIN if value.lower() in ("main", "article") else 0
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                known |= _OUT
            elif name in ("class", "id") and tag not in ("body", "html", "article", "main") and MARKS & {x.lower() for x in _PIECES.findall(value)}:
                known |= _OUT
            elif name in ("class", "id") and tag == "article" and {"comment", "reply", "ad", "promo", "related"} & {x.lower() for x in _PIECES.findall(value)}:
                known |= _OUT
        if len(_roles) < 50_000:
            _roles[tag, attributes] = known
    return known


class Page:
    """blocks: (text, path, in the article's container, share of linked characters, left out by name); tags: path -> count.

    article: the blocks that names leave. Without names there are blocks only, of all parts but scripts and the like.
    """

    def __init__(self, source: str | None, names: bool = True):
        self.blocks: list[tuple[str, int, bool, float]] = []
        self.tags: Counter = Counter()
        # text of the current block, and text that names leave out inside of it
        self._text: list[str] = []
        self._aside: list[str] = []
        self._linked = 0
        self._stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self._open: Counter = Counter()
        self._read(source or "")
        kept = [b for b in self.blocks if not b[4]]
        if not names:
            self.article = self.blocks
        elif any(b[2] for b in kept):
            self.article = [b for b in kept if b[2]]
        else:
            self.article = [b for b in kept if b[3] <= 0.5]

    def _flush(self) -> None:
        if self._text:
            text = _SPACES.sub(" ", "".join(self._text)).strip()
            if text:
                _, path, role, _ = self._stack[-1]
                self.blocks.append((text, path, bool(role & _MAIN), self._linked / len(text), False))
            self._text, self._linked = [], 0
        self._flush_aside()

    def _flush_aside(self) -> None:
        if self._aside:
            text = _SPACES.sub(" ", "".join(self._aside)).strip()
            if text:
                self.blocks.append((text, self._stack[-1][1], False, 0.0, True))
            self._aside = []

    def _add(self, raw: str) -> None:
        _, _, role, linked = self._stack[-1]
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            if role & _OUT:
                self._aside.append(text)
            else:
                self._text.append(text)
                self._linked += len(text) if linked else 0

    def _close(self, tag: str) -> None:
        if self._open[tag]:
            while True:
                name = self._stack[-1][0]
                if name in BLOCK:
                    self._flush()
                elif not self._stack[-2][2] & _OUT:
                    self._flush_aside()
                self._stack.pop()
                self._open[name] -= 1
                if name == tag:
                    break

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            self._add(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            if tag in BLOCK:
                self._flush()
                if self._open["p"]:
                    self._close("p")
            elif tag in ("br", "wbr"):
                self._add(" " if tag == "br" else "")
            _, path, role, linked = self._stack[-1]
            own = _CLASS.search(m[3]) if "class" in m[3] else None
            path = xxhash.xxh64_intdigest(f"{path}/{tag}.{(own[1] or own[2] or own[3]) if own else ''}".encode("utf-8", "surrogatepass"))
            self.tags[path] += 1
            if tag in VOID:
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    stop = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                    at = stop.start() if stop else end
                    close = source.find(">", at)
                    at = close + 1 if close >= 0 else end
                continue
            self._stack.append((tag, path, role | _role(tag, m[3], bool(role & _MAIN)), linked or tag == "a"))
            self._open[tag] += 1
        self._flush()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_token(path: int, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{path}:{text}".encode("utf-8", "surrogatepass")))


def _mark(host: str, token: int) -> int:
    """Spark's xxhash64 of the two."""
    return xxhash.xxh64_intdigest(token.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), 42))


_PAGE_TOKEN = 0
_TAG_KIND, _TEXT_KIND = 0, 1
_STATS = "host string, token long, kind int, slot long, pages long, total long, vector long, contents long"


def _content(page: Page) -> int:
    """One of 64 bits for a page's three longest blocks, by which pages of other content are told apart."""
    longest = sorted((b[0] for b in page.blocks), key=lambda t: (-len(t), t))[:3]
    return 1 << (xxhash.xxh64_intdigest("\n".join(longest).encode("utf-8", "surrogatepass")) & 63)


def _statistics(pages: DataFrame) -> DataFrame:
    """Occurrence vectors of the tokens of every host's pages, merged in each task, then by Spark.

    Texts are counted whether names would leave them or not; slot is the path of a token. A row that comes twice cancels
    itself out of the vectors of all its tokens alike.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[str, int, int, int], list[int]] = {}
            for host, key, source in zip(batch["host"], batch["key"], batch["html"], strict=True):
                page = Page(source)
                content = _content(page)
                counts = Counter({(_signed(p), _TAG_KIND, _signed(p)): n for p, n in page.tags.items()})
                counts.update((_block_token(b[1], b[0]), _TEXT_KIND, _signed(b[1])) for b in page.blocks)
                counts[_PAGE_TOKEN, _TAG_KIND, 0] = 1
                for token, n in counts.items():
                    s = sums.setdefault((host, *token), [0, 0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] ^= xxhash.xxh64_intdigest(f"{key}:{n}")
                    s[3] |= content
            yield pd.DataFrame([(*k, s[0], s[1], _signed(s[2]), _signed(s[3])) for k, s in sums.items()], columns=["host", "token", "kind", "slot", "pages", "total", "vector", "contents"])

    parts = pages.where("host is not null").select("host", "key", "html").mapInPandas(rows, _STATS)
    return parts.groupBy("host", "token", "kind", "slot").agg(*(f(c).alias(c) for c, f in (("pages", F.sum), ("total", F.sum), ("vector", F.bit_xor), ("contents", F.bit_or))))


def templates(pages: DataFrame) -> DataFrame:
    """(host, token, is_slot) of the fixed texts and stock slots of each host's template. pages: host, key, html."""
    stats = stage(_statistics(pages), "tokens")
    often = stats.where(F.col("pages") >= MIN_PAGES)
    whole = stats.where((F.col("token") == _PAGE_TOKEN) & (F.col("kind") == _TAG_KIND)).select("host", F.col("pages").alias("all_pages"))
    classes = often.groupBy("host", "vector", "pages", "total").agg(F.count_if(F.col("kind") == _TAG_KIND).alias("tags"), F.count("*").alias("tokens"), F.bit_or("contents").alias("contents"))
    valid = classes.where((F.col("tags") >= 1) & (F.col("tokens") >= 2) & (F.bit_count("contents") >= MIN_PAGES)).join(whole, "host").where(F.col("pages") >= TEMPLATE_SHARE * F.col("all_pages"))
    fixed = often.where(F.col("kind") == _TEXT_KIND).join(valid.select("host", "vector", "pages", "total"), ["host", "vector", "pages", "total"]).select("host", "token", F.lit(False).alias("is_slot"))
    # only hosts that have a template have slots
    stocked = F.sum(F.when(F.bit_count("contents") >= 2, F.col("total")).otherwise(0))
    texts = stats.where(F.col("kind") == _TEXT_KIND).groupBy("host", "slot").agg(stocked.alias("stocked"), F.sum("total").alias("total"), F.bit_or("contents").alias("contents"))
    slots = texts.where((F.bit_count("contents") >= MIN_PAGES) & (F.col("stocked") > STOCK * F.col("total"))).join(valid.select("host").distinct(), "host", "left_semi")
    out = stage(fixed.union(slots.select("host", F.col("slot").alias("token"), F.lit(True))), "templates")
    unstage(stats)
    return out


def _tokens(page: Page) -> list[tuple[int, int]]:
    """For each block of the article the tokens by which a template may have it: its text and its slot."""
    return [(_block_token(b[1], b[0]), _signed(b[1])) for b in page.article]


def extract(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id", names: bool = True) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; without names the templates decide alone."""
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    named = named.withColumn("host", F.nullif(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(""))).withColumn("key", F.xxhash64("page_id", "url", "html"))
    fixed = templates(named)
    held = bit_map(fixed, F.xxhash64("host", "token"), FILTER_BITS)
    schema = T.StructType([named.schema["page_id"], *(T.StructField(x, T.StringType()) for x in ("url", "host")), T.StructField("key", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(x, t) for x, t in (("blocks", T.ArrayType(T.StringType())), ("texts", T.ArrayType(T.LongType())), ("slots", T.ArrayType(T.LongType()))))])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        for batch in batches:
            out = {x: [] for x in ("text", "blocks", "texts", "slots")}
            for host, source in zip(batch["host"], batch["html"], strict=True):
                page = Page(source, names)
                tokens = _tokens(page) if host else []
                doubtful = tokens and in_bit_map(bits, np.array([_mark(host, t) for pair in tokens for t in pair], np.uint64).view(np.int64)).any()
                out["text"].append("\n".join(b[0] for b in page.article))
                out["blocks"].append([b[0] for b in page.article] if doubtful else None)
                out["texts"].append([t for t, _ in tokens] if doubtful else None)
                out["slots"].append([t for _, t in tokens] if doubtful else None)
            yield batch[["page_id", "url", "host", "key"]].reset_index(drop=True).assign(**{x: pd.Series(v, dtype=object) for x, v in out.items()})

    # pages are parsed once here, whatever reads them after
    read = stage(named.mapInPandas(rows, schema), "parsed")
    plain = read.where("texts is null").select("page_id", "url", "text")
    doubtful = read.where("texts is not null")
    asked = doubtful.select("key", "host", F.explode(F.concat(F.transform("texts", lambda t: F.struct(t.alias("token"), F.lit(False).alias("is_slot"))), F.transform("slots", lambda t: F.struct(t.alias("token"), F.lit(True).alias("is_slot"))))).alias("t"))
    # a slot of a large host is asked for by all its pages: pages are dealt to SALTS tasks, the templates copied to each
    asked = asked.select("key", "host", "t.*", F.pmod("key", F.lit(SALTS)).alias("salt")).distinct()
    salted = fixed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sure = asked.join(salted, ["host", "token", "is_slot", "salt"], "left_semi").groupBy("key").agg(F.collect_set(F.when(F.col("is_slot"), F.col("token"))).alias("gone_slots"), F.collect_set(F.when(~F.col("is_slot"), F.col("token"))).alias("gone_texts"))
    none = F.array().cast("array<bigint>")
    both = doubtful.join(sure, "key", "left").withColumn("gone_slots", F.coalesce("gone_slots", none)).withColumn("gone_texts", F.coalesce("gone_texts", none))
    kept = F.filter("blocks", lambda b, i: ~F.array_contains("gone_texts", F.get("texts", i)) & ~F.array_contains("gone_slots", F.get("slots", i)))
    return plain.union(both.select("page_id", "url", F.array_join(kept, "\n").alias("text"))).withColumn("n_chars", F.length("text").cast("long"))
