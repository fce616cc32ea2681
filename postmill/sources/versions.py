"""Stored state in versions: what a reader sees changes all at once, or not at all."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@dataclass(frozen=True)
class Version:
    """A version that is being written."""

    number: int
    path: str

    def folder(self, name: str) -> str:
        return f"{self.path}/v={self.number}/{name}"


class Versions:
    """Numbered folders `v=<n>` below a path, and a table of those that were committed.

    A version is written whole and then committed by one more row of the table, which Spark's committer adds by
    moving a file. A run that ends before leaves the version before it as the latest; the next run writes over what it left.
    One run writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        """`version` and `committed_at` of what was committed."""
        schema = "version long, committed_at timestamp"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def latest(self, before: int | None = None) -> int | None:
        """The last committed version, or the last before one; None if there is none."""
        found = self.commits() if before is None else self.commits().where(F.col("version") < before)
        return found.agg(F.max("version")).first()[0]

    def folder(self, version: int, name: str) -> str:
        return Version(version, self.path).folder(name)

    @contextmanager
    def writing(self) -> Iterator[Version]:
        """The next version; it is committed at the end of the block, unless that fails."""
        version = Version((self.latest() or 0) + 1, self.path)
        yield version
        row = self.spark.range(1).select(F.lit(version.number).cast("long").alias("version"), F.current_timestamp().alias("committed_at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
