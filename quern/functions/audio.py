"""Audio to log-mel features: framed Fourier transforms and a mel filter bank, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.tokenizer import Tokenizer, encode

#: Frames whose spectra are held at once.
_FRAMES_AT_ONCE = 4096


@dataclass(frozen=True)
class MelFeatures:
    """seconds: what every recording is padded or cut to; None keeps its length."""

    rate: int = 16_000
    frame: int = 400
    hop: int = 160
    mels: int = 80
    seconds: float | None = 30.0


def resampled(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Samples at another rate, linearly between neighbours."""
    if rate == wanted:
        return samples
    n = int(len(samples) * wanted / rate)
    return np.interp(np.arange(n) * rate / wanted, np.arange(len(samples)), samples).astype(np.float32)


def _mel(hertz: np.ndarray) -> np.ndarray:
    """The mel scale that is linear to 1,000 Hz (15 mels) and logarithmic above (27 mels for a factor of 6.4)."""
    return np.where(hertz < 1000, hertz * 3 / 200, 15 + 27 / np.log(6.4) * np.log(np.maximum(hertz, 1000) / 1000))


def _hertz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((np.maximum(mel, 15) - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=8)
def mel_bank(rate: int, frame: int, mels: int) -> np.ndarray:
    """(mels, bins): triangles between neighbouring mel points, each of area one."""
    bins = np.linspace(0, rate / 2, frame // 2 + 1)
    points = _hertz(np.linspace(_mel(np.array(0.0)), _mel(np.array(rate / 2)), mels + 2))
    rise = (bins[None] - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    fall = (points[2:, None] - bins[None]) / (points[2:] - points[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (points[2:] - points[:-2]))[:, None]


def log_mel(samples: np.ndarray, how: MelFeatures) -> np.ndarray:
    """(frames, mels) of samples at how.rate: log10 of mel energies, at most 8 below the largest, shifted and scaled by (x + 4) / 4."""
    samples = np.asarray(samples, np.float64)
    if how.seconds is not None:
        n = int(how.seconds * how.rate)
        samples = np.pad(samples[:n], (0, max(0, n - len(samples))))
    if not len(samples):
        return np.zeros((0, how.mels), np.float32)
    half = how.frame // 2
    padded = np.pad(samples, half, mode="reflect" if len(samples) > half else "constant")
    n = len(samples) // how.hop
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(how.frame) / how.frame)
    bank, out = mel_bank(how.rate, how.frame, how.mels), np.zeros((n, how.mels))
    for k in range(0, n, _FRAMES_AT_ONCE):
        at = np.arange(k, min(k + _FRAMES_AT_ONCE, n)) * how.hop
        power = np.abs(np.fft.rfft(padded[at[:, None] + np.arange(how.frame)] * window, axis=1)) ** 2
        out[k : k + len(at)] = power @ bank.T
    logs = np.log10(np.maximum(out, 1e-10))
    return ((np.maximum(logs, logs.max(initial=-10.0) - 8) + 4) / 4).astype(np.float32)


def features(df: DataFrame, how: MelFeatures, resample: bool = True, samples: str = "samples", rate: str = "rate", name: str = "features") -> DataFrame:
    """df with features, struct of data (row by row) and shape, in place of its samples.

    Other rates are resampled, or with resample=False raise: a batch has one rate. Rows without samples have null features.
    """

    @F.pandas_udf("data array<float>, shape array<long>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sounds, rates in batches:
            found = set(rates[sounds.notna()].tolist())
            if not resample and found - {how.rate}:
                raise ValueError(f"sampling rates {sorted(found)}; {how.rate} is asked for")
            out = [None if s is None else log_mel(resampled(np.asarray(s, np.float32), int(r), how.rate), how) for s, r in zip(sounds, rates, strict=True)]
            yield pd.DataFrame({"data": [None if x is None else x.reshape(-1) for x in out], "shape": [None if x is None else np.array(x.shape) for x in out]})

    both = made(F.col(samples), F.col(rate))
    return df.withColumn("__f", both).drop(samples).withColumn(name, F.when(F.col("__f.data").isNotNull(), F.col("__f"))).drop("__f")


def audio_text(df: DataFrame, how: MelFeatures, tok: Tokenizer, length: int = 448, pad: int = 0, text: str = "text", **options) -> DataFrame:
    """df with features, ids and attention_mask: recordings with their texts' tokens, cut or padded to `length`.

    attention_mask is 1 where there is a token.
    """
    ids = encode(features(df, how, **options), tok, text)
    n = F.least(F.size("ids"), F.lit(length))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n))
    return ids.withColumn("attention_mask", mask).withColumn("ids", F.slice(F.concat("ids", F.array_repeat(F.lit(pad), length)), 1, length))


def audio_examples(df: DataFrame, ignore: int | None = None) -> DataFrame:
    """df of audio_text() with loss_mask: 1 where the next token is one and isn't `ignore`; the last position has none."""
    following = lambda i: F.get("ids", i + 1)
    wanted = lambda m, i: (m == 1) & (F.coalesce(F.get("attention_mask", i + 1), F.lit(0)) == 1)
    kept = (lambda m, i: wanted(m, i) & (following(i) != ignore)) if ignore is not None else wanted
    return df.withColumn("loss_mask", F.transform("attention_mask", lambda m, i: F.coalesce(kept(m, i), F.lit(False)).cast("int")))
