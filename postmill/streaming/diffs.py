"""New postings of a stream of snapshots, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postmill.operators.snapshots import new_postings


def stream_new_postings(snapshots: DataFrame, seen_path: str, out_path: str, checkpoint_path: str) -> StreamingQuery:
    """Starts a query that appends to `out_path` the postings of each batch that no earlier batch held.

    Postings are told by site and exact title, as in a comparison of two snapshots. Each batch writes its part
    under its number, so a batch that is run again after a failure overwrites what it wrote before.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        keys = "site_id string, title string, batch long"
        try:
            seen = spark.read.schema(keys).parquet(seen_path).where(f"batch < {number}")
        except Exception as e:  # the first batch has no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = spark.createDataFrame([], keys)
        new = new_postings(rows, seen)
        new.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        # Only keys that no batch before had: together they are each key once.
        told = spark.read.schema(rows.schema).parquet(f"{out_path}/batch={number}")
        told.select("site_id", "title").distinct().write.mode("overwrite").parquet(f"{seen_path}/batch={number}")

    return snapshots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
