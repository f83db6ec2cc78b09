"""Sharded sources: format by name or content, globs with ranges, shard names, ordered rows."""

from __future__ import annotations

import io
import itertools
import json
import re
import wave
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.formats import single_turn

#: Files that are looked into at once.
_LOOKING = 16

_RANGE = re.compile(r"\{(-?\d+)\.\.(-?\d+)\}")
_FORMATS = {"jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "parquet": "parquet", "txt": "text"}


def expand(pattern: str) -> list[str]:
    """Ranges {1..3} spelled out; what the file systems know themselves ({a,b}, *) stays."""
    parts = _RANGE.split(pattern)
    choices = [[parts[0]]]
    for low, high, rest in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        width = len(low) if low.startswith("0") else 0
        step = 1 if int(low) <= int(high) else -1
        choices += [[str(k).zfill(width) for k in range(int(low), int(high) + step, step)], [rest]]
    return ["".join(x) for x in itertools.product(*choices)]


def sniff(name: str, first_line: str = "") -> str:
    """The format by the last two extensions; .json holds lines of objects if its first line is one, whole, else one value. What follows that line doesn't matter."""
    for part in reversed(name.rsplit("/", 1)[-1].split(".")[-2:]):
        kind = _FORMATS.get(part.lower())
        if kind == "json" and first_line.lstrip().startswith("{"):
            try:
                json.loads(first_line.lstrip().split("\n", 1)[0])
            except ValueError:
                return "json"
            return "jsonl"
        if kind:
            return kind
    raise ValueError(f"unknown format: {name}")


def shard_names(paths: list[str]) -> dict[str, str]:
    """Name of each shard: the path without the common beginning, dots as underscores; equal names raise."""
    if not paths:
        return {}
    start = len(commonprefix([p.rsplit("/", 1)[0] + "/" for p in paths]).rsplit("/", 1)[0]) + 1 if len(paths) > 1 else len(paths[0].rsplit("/", 1)[0]) + 1
    names = {}
    for p in paths:
        name = p[start:].replace(".", "_")
        if name in names:
            raise ValueError(f"two shards are named {name}")
        names[name] = p
    return names


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Full paths of the files that a pattern of the file system names; a folder's files, at any depth, come in its place."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found, left = [], list(fs.globStatus(where) or [])
    while left:
        status = left.pop()
        if status.getPath().getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            left += fs.listStatus(status.getPath())
        else:
            found.append(status.getPath().toString())
    return sorted(found)


def files(spark: SparkSession, pattern: str) -> list[str]:
    """All files of a pattern with ranges, in order; a part that names none raises."""
    out = []
    for part in expand(pattern):
        found = _listed(spark, part)
        if not found:
            raise FileNotFoundError(f"no file for {part}")
        out += found
    return out


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file that isn't blank, however long, decompressed if its name says so; of a file that begins with [ that alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    stream = where.getFileSystem(conf).open(where)
    stream = codec.createInputStream(stream) if codec else stream
    begun = b""
    try:
        while chunk := bytes(stream.readNBytes(1 << 16)):
            begun = (begun + chunk).removeprefix(b"\xef\xbb\xbf").lstrip()
            if begun[:1] == b"[":
                return "["
            if b"\n" in begun:
                break
        return begun.split(b"\n", 1)[0].decode("utf-8", "replace")
    finally:
        stream.close()


def kinds_of(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files by format, each by its own name and, where that leaves a choice, its own first line; several are looked into at once."""

    def kind(path: str) -> str:
        named = sniff(path)
        return sniff(path, first_line(spark, path)) if named == "json" else named

    out: dict[str, list[str]] = {}
    with ThreadPoolExecutor(_LOOKING) as pool:
        for path, found in zip(paths, pool.map(kind, paths), strict=True):
            out.setdefault(found, []).append(path)
    return out


def _read(spark: SparkSession, paths: list[str], kind: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None or kind == "text" else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(*paths)
    if kind == "text":
        return spark.read.text(paths).select(F.concat("value", F.lit("\n")).alias("text"))
    return reader.option("multiLine", kind == "json").json(paths)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read(spark: SparkSession, pattern: str, kind: str | None = None, columns: list[str] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Rows of all files, with columns pushed into the scan; a missing column raises.

    Every file is read by its own format; where there are several, columns meet by name, and are null where a format lacks them.
    """
    if kind is not None:
        df = _read(spark, expand(pattern), kind, schema)
        return df if columns is None else df.select(*columns)
    kinds = kinds_of(spark, files(spark, pattern))
    if len(kinds) == 1:
        parts = [_read(spark, expand(pattern), next(iter(kinds)), schema)]
    else:
        parts = [_read(spark, [_escaped(p) for p in paths], k, schema) for k, paths in sorted(kinds.items())]
    return _union(parts if columns is None else [p.select(*columns) for p in parts])


def read_sharded(spark: SparkSession, pattern: str, schema: StructType | str | None = None) -> DataFrame:
    """read(), with the name and the number of each row's file as shard and shard_idx."""
    found = files(spark, pattern)
    names = shard_names(found)
    return _union([with_shards(_read(spark, [_escaped(p) for p in paths], k, schema), names) for k, paths in sorted(kinds_of(spark, found).items())])


def _escaped(path: str) -> str:
    """A path that stands for itself where patterns are understood."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_jsonl(spark: SparkSession, pattern: str, **options) -> DataFrame:
    return read(spark, pattern, "jsonl", **options)


def read_json(spark: SparkSession, pattern: str, **options) -> DataFrame:
    return read(spark, pattern, "json", **options)


def read_parquet(spark: SparkSession, pattern: str, **options) -> DataFrame:
    return read(spark, pattern, "parquet", **options)


def read_hub(spark: SparkSession, folder: str, name: str | None = None, split: str = "train") -> DataFrame | None:
    """A data set's copy on disk, folder[/name]/split or files that begin with the split; None for a split that it lacks."""
    root = f"{folder.rstrip('/')}/{name}" if name else folder.rstrip("/")
    for pattern in (f"{root}/{split}/*", f"{root}/{split}-*", f"{root}/{split}.*"):
        if _listed(spark, pattern):
            return read(spark, pattern)
    return None


def read_supervised(spark: SparkSession, pattern: str, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """The two fields of a record as prompt and response."""
    return read(spark, pattern).select(F.col(prompt).alias("prompt"), F.col(response).alias("response"))


def read_chat(spark: SparkSession, pattern: str, messages: str = "messages", role: str = "role", content: str = "content", user: str = "user", assistant: str = "assistant") -> DataFrame:
    """messages: array of (role, content), with the names of roles that the formats expect; other columns stay."""
    return with_roles(read(spark, pattern), messages, role, content, user, assistant)


def with_roles(df: DataFrame, messages: str = "messages", role: str = "role", content: str = "content", user: str = "user", assistant: str = "assistant") -> DataFrame:
    """df with messages of (role, content), whose roles have the names that the formats expect."""
    plain = F.transform(messages, lambda m: F.struct(F.when(m[role] == user, "user").when(m[role] == assistant, "assistant").otherwise(m[role]).alias("role"), m[content].alias("content")))
    return df.withColumn("messages", plain)


def read_chat_single_turn(spark: SparkSession, pattern: str, **names) -> DataFrame:
    """prompt and response: the first user and the first assistant message of each conversation."""
    return single_turn(read_chat(spark, pattern, **names)).select("prompt", "response")


def read_audio(spark: SparkSession, pattern: str) -> DataFrame:
    """path, rate, samples (first channel, -1 to 1) of 16-bit PCM wave files; other bytes give null samples."""
    content = spark.read.format("binaryFile").load(expand(pattern)).select("path", "content")
    return content.withColumn("__s", _sounds("content")).select("path", "__s.rate", "__s.samples")


def read_audio_text(spark: SparkSession, pattern: str, audio: str = "audio", text: str = "sentence", files_at: str | None = None) -> DataFrame:
    """text, rate, samples of records whose audio is a path, or a struct of path, or of array and sampling_rate.

    Paths name wave files, below files_at if given; they are joined to the records by their names, so each file is read once.
    """
    records = read(spark, pattern)
    kind = records.schema[audio].dataType
    if isinstance(kind, StructType) and "array" in kind.fieldNames():
        return records.select(F.col(text).alias("text"), F.col(f"{audio}.sampling_rate").cast("int").alias("rate"), F.col(f"{audio}.array").cast("array<float>").alias("samples"))
    place = F.col(f"{audio}.path") if isinstance(kind, StructType) else F.col(audio)
    place = F.concat(F.lit(f"{files_at.rstrip('/')}/"), place) if files_at else place
    folder = files_at or pattern.rsplit("/", 1)[0]
    sounds = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)
    named = sounds.select(_normal(F.col("path")).alias("__path"), "content")
    wanted = records.select(F.col(text).alias("text"), _normal(place).alias("__path"))
    return wanted.join(named, "__path", "left").withColumn("__s", _sounds("content")).select("text", "__s.rate", "__s.samples")


def _sounds(content: str) -> Column:
    @F.pandas_udf("rate int, samples array<float>")
    def sounds(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(None, None) if x is None else _wave(bytes(x)) for x in batch]
            yield pd.DataFrame({"rate": pd.array([r for r, _ in found], "Int32"), "samples": pd.Series([x for _, x in found], dtype=object)})

    return sounds(content)


def _wave(content: bytes) -> tuple[int | None, np.ndarray | None]:
    try:
        with wave.open(io.BytesIO(content)) as w:
            if w.getsampwidth() != 2:
                return w.getframerate(), None
            data = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
            return w.getframerate(), (data[:, 0] / 32768).astype(np.float32)
    except (wave.Error, EOFError):
        return None, None


def synthetic_tokens(spark: SparkSession, n: int, length: int, vocabulary: int, seed: int = 0) -> DataFrame:
    """idx and `length` ids each, drawn from a hash of seed, row and position."""
    ids = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: F.pmod(F.xxhash64(F.lit(seed), "id", k), F.lit(vocabulary)).cast("int"))
    return spark.range(n).select(F.col("id").alias("idx"), ids.alias("ids"))


def _normal(path: Column) -> Column:
    """A path without its scheme and the slashes before it, its references decoded."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^[a-zA-Z][a-zA-Z0-9]*:/*|^/+", "/")


def with_shards(df: DataFrame, shards: dict[str, str]) -> DataFrame:
    """df of a file source with shard (name) and shard_idx; a file that shards does not list raises."""
    rows = [(path, name, k) for k, (name, path) in enumerate(shards.items())]
    table = df.sparkSession.createDataFrame(rows, "__path string, shard string, shard_idx int")
    table = table.select(F.regexp_replace("__path", "^[a-zA-Z][a-zA-Z0-9]*:/*|^/+", "/").alias("__file"), "shard", "shard_idx")
    # a row a file of the listing
    named = df.withColumn("__file", _normal(F.col("_metadata.file_path"))).join(F.broadcast(table), "__file", "left")
    check = F.when(F.col("shard").isNull(), F.raise_error(F.concat(F.lit("not a shard: "), F.col("__file")))).otherwise(F.col("shard"))
    return named.withColumn("shard", check).drop("__file")


def restrict_shards(df: DataFrame, names: list[str], shard: str = "shard") -> DataFrame:
    """Rows of the shards named."""
    return df.where(F.col(shard).isin(names))


def from_row(df: DataFrame, row: int) -> DataFrame:
    """Rows of a Parquet source from `row` on in each file."""
    return df.where(F.col("_metadata.row_index") >= row)


def assign_groups(n_shards: int, groups: int | None) -> list[list[int]]:
    """Shards in contiguous groups, the rest to the first ones; None or as many groups as shards: one each."""
    if groups is None or groups >= n_shards:
        return [[k] for k in range(n_shards)]
    size, rest = divmod(n_shards, groups)
    starts = [k * size + min(k, rest) for k in range(groups + 1)]
    return [list(range(a, b)) for a, b in zip(starts, starts[1:])]


def split_source(urls: dict[str, list[str]], split: str) -> list[str] | None:
    """Paths of train or validation; none listed: None, another split: an error."""
    if split not in ("train", "validation"):
        raise ValueError(f"unknown split {split}")
    return urls.get(split) or None
