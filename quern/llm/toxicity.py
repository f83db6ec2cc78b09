"""Toxicity: a counterfactual-regularised classifier.

Features are lower-cased words, their beginnings, and beginnings met LEVELS times or more. Those of MIN_ROWS toxic
training rows or more are counted over all other training rows, too; a z score of the log odds ranks them, and the
strongest FEATURES are kept. A logistic regression is fitted on the rows of at most TRAINING_ROWS labelled ids.

Identity terms are listed ones and those that the data show: the TERMS commonest words met in MIN_ROWS toxic rows
and no fewer others, each paired with the term that fills most of the same slots (the word before, the word
after) among those about as common. In every fitted text that names a term, it is swapped for its partner, and the
squared change of the score is penalised, so that the mention itself does not carry a score.

Only rows whose crc32 of the id as text leaves no HELD_OUT remainder are learnt from. Null and empty
texts score what the intercept gives. Texts are scored whole; repeated rows score alike; an empty table
gives an empty result. Without toxic or without other training rows, the model is the base rate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import bit_map, in_bit_map, maybe_among, stage, unstage

HELD_OUT = (4, 2)
FEATURES = 4096
TRAINING_ROWS = 30_000
MIN_ROWS = 3
#: Weaker features are left to chance.
MIN_Z = 3.0
PREFIXES = (4, 5, 6, 7)
LEVELS = (2, 3, 5)
PENALTY = 1.0
#: Identity terms of the data, and the buckets that the slots around them are counted in.
TERMS = 512
SLOTS = 256
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")

# fixed values: identity terms by kind; a swap stays within a line
IDENTITY = [
    x.split()
    for x in (
        "men women males females boys girls",
        "man woman male female boy girl",
        "gay straight lesbian bisexual homosexual heterosexual",
        "christian muslim jewish hindu buddhist atheist catholic protestant",
        "christians muslims jews hindus buddhists atheists catholics protestants",
        "black white asian latino hispanic african european",
        "american mexican chinese indian french german spanish russian arab",
        "americans mexicans indians germans spaniards russians arabs immigrants refugees",
        "blind deaf disabled elderly young old",
        "transgender cisgender trans queer",
        "männer frauen jungen mädchen",
        "muslime christen juden",
        "hommes femmes garçons filles",
        "musulmans chrétiens juifs",
        "hombres mujeres niños niñas",
        "musulmanes cristianos judíos",
    )
]
#: Each listed term's partner, the next of its kind.
LISTED = {w: line[(k + 1) % len(line)] for line in IDENTITY for k, w in enumerate(line)}


def features(text: str | None) -> set[str]:
    """Words, their beginnings ("wors+"), and beginnings met k times or more ("wors+3")."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in PREFIXES:
        starts = Counter()
        for w, times in words.items():
            if len(w) > n:
                starts[w[:n]] += times
        out.update(w + "+" for w in starts)
        out.update(f"{w}+{k}" for w, times in starts.items() if times > 1 for k in LEVELS if times >= k)
    return out


class Known:
    """Finds those features of a text that are among names, as features() would."""

    def __init__(self, names):
        self.names = set(names)
        self.stems = {x.split("+")[0] for x in self.names if "+" in x}
        self.seen: dict[str, tuple[str, ...]] = {}

    def _stems(self, word: str) -> tuple[str, ...]:
        if len(self.seen) > 200_000:
            self.seen.clear()
        found = self.seen[word] = tuple(word[:n] for n in PREFIXES if len(word) > n and word[:n] in self.stems)
        return found

    def find(self, text: str | None) -> list[str]:
        words = Counter(_WORD.findall((text or "").lower()))
        names, seen, starts, out = self.names, self.seen, Counter(), []
        for w, times in words.items():
            if w in names:
                out.append(w)
            stems = seen.get(w)
            for stem in self._stems(w) if stems is None else stems:
                starts[stem] += times
        for stem, times in starts.items():
            out += [x for x in (stem + "+", *(f"{stem}+{k}" for k in LEVELS if times >= k)) if x in names]
        return sorted(out)


def counterfactual(text: str, partner: Mapping[str, str]) -> str | None:
    """The text with every identity term swapped for its partner; None if there is none."""
    changed = False

    def swap(m: re.Match) -> str:
        nonlocal changed
        other = partner.get(m.group().lower())
        changed |= other is not None
        return other or m.group()

    out = _WORD.sub(swap, text)
    return out if changed else None


def held_out(doc_id: str):
    """Whether a row is kept from training; a null id counts as an empty text's."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def _frequencies(training: DataFrame, among=None) -> DataFrame:
    """(feature, n): rows with the feature, summed in each task before the shuffle; with among, of those in a bit map."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[k : k + 2000] for b in batches for k in range(0, len(b), 2000)):
            counts = Counter()
            for text in batch["text"]:
                counts.update(features(text))
            out = pd.DataFrame({"feature": list(counts), "n": np.fromiter(counts.values(), np.int64, len(counts))})
            if among is not None:
                hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in out["feature"]), np.uint64, len(out))
                out = out[in_bit_map(among.value, hashes.view(np.int64))]
            yield out

    return training.select("text").mapInPandas(rows, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def feature_counts(training: DataFrame) -> DataFrame:
    """(feature, toxic, other) of the features of MIN_ROWS toxic rows or more, over all training rows."""
    toxic = stage(_frequencies(training.where("label = 1")).where(F.col("n") >= MIN_ROWS), "toxic_counts")
    # the map only spares rows; the join decides
    other = _frequencies(training.where("label = 0"), bit_map(toxic, F.xxhash64("feature")))
    joined = toxic.withColumnRenamed("n", "toxic").join(other.withColumnRenamed("n", "other"), "feature", "left")
    out = stage(joined.withColumn("other", F.coalesce("other", F.lit(0))), "feature_counts")
    unstage(toxic)
    return out


def select_features(counts: DataFrame, n_toxic: int, n_other: int) -> list[str]:
    """The FEATURES names of highest |z| of the log odds between toxic and other rows."""
    log_odds = lambda k, n: F.log((F.col(k) + 0.5) / (n - F.col(k) + 0.5))
    error = F.sqrt(sum(1 / (x + 0.5) for x in (F.col("toxic"), n_toxic - F.col("toxic"), F.col("other"), n_other - F.col("other"))))
    z = F.abs(log_odds("toxic", n_toxic) - log_odds("other", n_other)) / error
    return [r.feature for r in counts.where(z >= MIN_Z).orderBy(z.desc(), "feature").limit(FEATURES).collect()]


def _slot(side: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{side}:{word}") % SLOTS


def identity_terms(counts: DataFrame, fitted: DataFrame) -> dict[str, str]:
    """Each term of the data and its partner; what the driver holds is TERMS x SLOTS numbers at most."""
    # a word that is met in toxic rows mostly is no neutral mention
    neutral = counts.where((F.col("other") >= F.col("toxic")) & ~F.col("feature").contains("+"))
    top = neutral.withColumn("n", F.col("toxic") + F.col("other")).orderBy(F.desc("n"), "feature").limit(TERMS).collect()
    number = {r.feature: k for k, r in enumerate(top)}
    if len(number) < 2:
        return {}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter()
            for text in batch["text"]:
                words = ["", *_WORD.findall((text or "").lower()), ""]
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    k = number.get(word)
                    if k is not None:
                        found[k * SLOTS + _slot("before", before)] += 1
                        found[k * SLOTS + _slot("after", after)] += 1
            yield pd.DataFrame({"at": list(found), "n": np.fromiter(found.values(), np.int64, len(found))})

    cells = fitted.select("text").mapInPandas(rows, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    slots = np.zeros(len(top) * SLOTS, np.float32)
    slots[cells["at"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float32)
    slots = slots.reshape(len(top), SLOTS)
    # the overlap of two terms' shares of slots
    root = np.sqrt(slots / np.maximum(slots.sum(1, keepdims=True), 1))
    alike = root @ root.T
    often = np.log(np.array([r.n for r in top], np.float64))
    alike[np.abs(often[:, None] - often[None, :]) > np.log(4)] = -1
    np.fill_diagonal(alike, -1)
    best = alike.argmax(1)
    return {r.feature: top[best[k]].feature for k, r in enumerate(top) if alike[k, best[k]] > 0}


def _fit(pairs: list[tuple[np.ndarray, np.ndarray | None]], labels: np.ndarray, size: int, steps: int = 400) -> np.ndarray:
    """Weights and the intercept (last) by accelerated gradient steps on log loss, L2 and the change under swaps."""

    def matrix(sets):
        lengths = np.array([len(s) for s in sets], np.int64)
        return np.repeat(np.arange(len(sets)), lengths), np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)

    rows, cols = matrix([p[0] for p in pairs])
    swapped = [i for i, p in enumerate(pairs) if p[1] is not None]
    srows, scols = matrix([pairs[i][1] for i in swapped])
    swapped = np.array(swapped, np.int64)
    n = len(labels)
    # the rows fitted may lack a class that others have
    share = np.clip(labels.mean(), 0.5 / n, 1 - 0.5 / n)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    weight /= weight.sum()
    score = lambda w, r, c, k: 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], k) + w[-1], -30, 30)))
    w = np.zeros(size + 1)
    w[-1] = np.log(share / (1 - share))
    velocity, step = np.zeros_like(w), 4.0
    for k in range(steps):
        ahead = w + 0.9 * velocity
        p = score(ahead, rows, cols, n)
        slope = weight * (p - labels)
        extra = np.zeros(0)
        if len(swapped):
            q = score(ahead, srows, scols, len(swapped))
            change = PENALTY * 2 * (p[swapped] - q) * weight[swapped]
            np.add.at(slope, swapped, change * p[swapped] * (1 - p[swapped]))
            extra = -change * q * (1 - q)
        gradient = np.append(np.bincount(cols, slope[rows], size), slope.sum())
        if len(swapped):
            gradient += np.append(np.bincount(scols, extra[srows], size), extra.sum())
        gradient[:-1] += 2e-4 * ahead[:-1]
        velocity = 0.9 * velocity - step * gradient / (1 + np.sqrt(k) / 4)
        w = w + velocity
    return w


def train(docs: DataFrame, labels: DataFrame, identity: Mapping[str, str] | None = None) -> dict:
    """{"weights": name -> weight, "intercept", "identity": term -> partner} from labelled rows that aren't held out.

    Features are counted over all of them. The regression is fitted, and slots of terms are counted, on the rows of at
    most TRAINING_ROWS ids, those of the lowest hashes; that bounds what the driver holds. identity: the listed terms
    and their partners, those of LISTED if not given; terms of the data come to these.
    """
    marks = labels.where(~held_out("doc_id")).where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("label"))
    marks = stage(marks.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "label"), "marks")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # texts without a label aren't shuffled
    texts = texts.where(maybe_among(marks.select("doc_id"), "doc_id"))
    # the same plan at every size: a table of marks that is sent to the texts while it is small grows out of that
    training = stage(texts.join(marks.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "label"), "training")
    unstage(marks)
    classes = {r.label: r["count"] for r in training.groupBy("label").count().collect()}
    toxic, other = classes.get(1, 0), classes.get(0, 0)
    if not toxic or not other:
        share = (toxic + 0.5) / (toxic + other + 1)
        return {"weights": {}, "intercept": float(np.log(share / (1 - share))), "identity": {}}
    counts = feature_counts(training)
    names = select_features(counts, toxic, other)
    number = {x: i for i, x in enumerate(names)}
    chosen = training.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    fitted = stage(training.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "text", "label"), "fitted")
    unstage(training)
    partner = {**identity_terms(counts, fitted), **(LISTED if identity is None else identity)}
    unstage(counts)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(names)
        numbers = lambda text: [number[x] for x in known.find(text)]
        for batch in batches:
            swapped = [counterfactual(t or "", partner) for t in batch["text"]]
            other = pd.Series([None if t is None else numbers(t) for t in swapped], dtype=object)
            own = pd.Series([numbers(t) for t in batch["text"]], dtype=object)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "label": batch["label"].to_numpy(), "own": own, "swapped": other})

    schema = T.StructType([fitted.schema["doc_id"], T.StructField("label", T.LongType()), T.StructField("own", T.ArrayType(T.IntegerType())), T.StructField("swapped", T.ArrayType(T.IntegerType()))])
    found = sorted(fitted.mapInPandas(rows, schema).collect(), key=lambda r: (r.doc_id, r.own))
    unstage(fitted)
    pairs = [(np.array(r.own, np.int64), None if r.swapped is None else np.array(r.swapped, np.int64)) for r in found]
    w = _fit(pairs, np.array([r.label for r in found], float), len(names))
    return {"weights": dict(zip(names, w[:-1].tolist(), strict=True)), "intercept": float(w[-1]), "identity": partner}


def classify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from THRESHOLD on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, known = shared.value["weights"], Known(shared.value["weights"])
        for texts in batches:
            sums = np.array([sum(weights[x] for x in known.find(t)) for t in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums + shared.value["intercept"], -30, 30))))

    return docs.withColumn("score", score(F.col(text).cast("string"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
