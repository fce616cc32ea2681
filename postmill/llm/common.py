"""Helpers that the corpus operators share: tables, checkpoints, words, rolling hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.tables import checkpoint, shared_folder

#: Text handed to one step of a Python task at a time; a longer single document comes alone.
BATCH_BYTES = 8 << 20


__all__ = ["bounded", "checkpoint", "item_words", "lower_words", "mix", "over_texts", "plain_words", "removed", "shared_folder", "table", "texts", "window_hashes", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(batch.column(text).cast(pa.large_binary()).fill_null(b""))
        ends = np.cumsum(np.fromiter(map(len, lengths), np.int64, len(lengths)))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A column of strings as UTF-8 bytes."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def over_texts(docs: DataFrame, keep: list[str], schema: str, step: Callable[[list[bytes | None]], dict]) -> DataFrame:
    """`keep` columns of `docs` beside what `step` makes of each text; narrow, whole texts.

    `step` gets the texts of one batch and returns a column (list or array) for each new field.
    """
    kinds = dict(docs.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            made = {c: batch.column(c) for c in keep} | step(texts(batch))
            yield pa.RecordBatch.from_pydict(made)

    return docs.select(*keep, F.col("text")).mapInArrow(run, f"{fields}, {schema}")


#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, with A-Z in lower case; others become spaces.
_ITEM_BYTES = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    """Words of letters and digits after lower-casing A-Z; no words in a null."""
    return text.translate(_ITEM_BYTES).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words `[^\x20\x09-\x0D]+`, unchanged."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """Words `[^\x20\x09-\x0D]+` after lower-casing A-Z."""
    return text.translate(_LOWER).split() if text else []


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs."""
    x = a * _MIX[0] + b
    x ^= x >> np.uint64(32)
    x *= _MIX[1]
    x ^= x >> np.uint64(29)
    return x


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` consecutive word hashes, in a logarithmic number of steps."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, runs, size, rest = None, 0, words, 1, length
    while rest:
        if rest & 1:
            piece = runs[done : done + n]
            out = piece if out is None else mix(out, piece)
            done += size
        rest >>= 1
        if rest:
            runs = mix(runs[:-size], runs[size:])
            size *= 2
    return out


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """`df` written as Parquet (below the shared checkpoint folder unless told where), and read again."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that was `written`, by the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
