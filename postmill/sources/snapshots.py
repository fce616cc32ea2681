"""Stored results: nested JSON of a run, new postings, audit verdicts, keyword lists, dated snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from postmill.functions.text import trim
from postmill.operators.snapshots import toggle_hidden
from postmill.operators.tables import checkpoint
from postmill.sources.versions import Versions

POSTING = "title: string, organization: string, regDate: string, deadlineDate: string, url: string, status: string"
RESULTS = f"site struct<id: string, name: string, url: string, category: string>, postings array<struct<{POSTING}>>, crawledAt string, error string"


class MissingSnapshot(FileNotFoundError):
    """The snapshot that a run needs is not there."""


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """Keywords of a text file, one a line, trimmed, without blank lines."""
    lines = spark.read.text(path).select(trim("value").alias("w")).where("w <> ''")
    return [r["w"] for r in lines.collect()]


def _read(spark: SparkSession, path: str, schema: str, required: bool) -> DataFrame:
    """JSON of one array, or of a row on each line; an empty table, or an error if `required`, where there is none."""
    try:
        lines = spark.read.text(path).where(trim("value") != "")
        first = lines.select(F.left(trim("value"), F.lit(1)).alias("c")).first()
        return spark.read.schema(schema).option("multiLine", first is not None and first["c"] == "[").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if required:
            raise MissingSnapshot(path) from e
        return spark.createDataFrame([], schema)


def read_results(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """Nested results, a row for each site; an empty table, or an error if `required`, where there is no file."""
    return _read(spark, path, RESULTS, required)


def read_new_postings(spark: SparkSession, path: str, required: bool = False) -> DataFrame:
    """Flat new postings (`site_id`, `site_name` and posting columns); an empty table where there is no file."""
    p = _read(spark, path, f"{POSTING.replace(':', '')}, siteId string, siteName string", required)
    return p.withColumnsRenamed({"siteId": "site_id", "siteName": "site_name", "regDate": "reg_date", "deadlineDate": "deadline_date"})


def flat_postings(results: DataFrame, sites: DataFrame) -> DataFrame:
    """A row for each posting of nested results with its place: `site_ord` is that of `sites`, or behind them all for a site that isn't listed."""
    known = sites.select(F.col("site_id").alias("_id"), F.col("site_ord").cast("long").alias("_ord"))
    ordered = results.join(known, F.col("site.id") == F.col("_id"), "left").withColumn("site_ord", F.coalesce("_ord", F.lit(1 << 22)))
    rows = ordered.select("site_ord", F.col("site.id").alias("site_id"), F.col("site.name").alias("site_name"), "error", F.posexplode("postings").alias("post_ord", "p"))
    return rows.select(
        "site_ord", "post_ord", "site_id", "site_name", "error", "p.title", "p.organization", F.col("p.regDate").alias("reg_date"),
        F.col("p.deadlineDate").alias("deadline_date"), "p.url", "p.status",
    )


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _joined(*objects: Column) -> Column:
    """JSON objects as one; empty ones add nothing."""
    bodies = (F.nullif(F.substring(o, F.lit(2), F.length(o) - 2), F.lit("")) for o in objects)
    return F.concat(F.lit("{"), F.concat_ws(",", *bodies), F.lit("}"))


def posting_json(
    title: Column | str = "title", organization: Column | str = "organization", reg: Column | str = "reg_date", deadline: Column | str = "deadline_date", url: Column | str = "url", status: Column | str = "status", **more: Column | str
) -> Column:
    """A posting's JSON: missing deadlines and links are null, a missing status is left out; `more` fields follow."""
    always = {"title": title, "organization": organization, "regDate": reg, "deadlineDate": deadline, "url": url}
    text = F.to_json(F.struct(*(_as_column(c).alias(n) for n, c in always.items())), {"ignoreNullFields": "false"})
    extra = F.to_json(F.struct(_as_column(status).alias("status"), *(_as_column(c).alias(n) for n, c in more.items())))
    return _joined(text, extra)


def write_snapshot(postings: DataFrame, path: str, date: str) -> None:
    """Flat postings of one day, a Parquet partition of the snapshot folder."""
    postings.withColumn("snapshot_date", F.lit(date).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def snapshot_on(spark: SparkSession, path: str, date: str) -> DataFrame:
    """The snapshot of a day; partition pruning reads nothing else."""
    return spark.read.parquet(path).where(F.col("snapshot_date") == F.lit(date).cast("date"))


def snapshot_before(spark: SparkSession, path: str, date: str) -> DataFrame:
    """The latest snapshot earlier than a day; empty if there is none."""
    all_days = spark.read.parquet(path)
    day = all_days.where(F.col("snapshot_date") < F.lit(date).cast("date")).agg(F.max("snapshot_date")).first()[0]
    return all_days.where(F.col("snapshot_date") == F.lit(day)) if day else all_days.limit(0)


def write_array(rows: DataFrame, json: Column, path: str, *order: str) -> None:
    """JSON objects in order as one array, a file in the folder `path`.

    An array in a file is written by one task, as a row's comma depends on its place; for tables without bound there
    is `write_snapshot`.
    """
    place = Window.orderBy(*order)
    made = rows.select(json.alias("value"), *order)
    made = made.withColumn("n", F.row_number().over(place)).withColumn("last", F.lead(F.lit(1)).over(place).isNull())
    text = F.concat(F.when(F.col("n") == 1, "[\n").otherwise(""), F.lit("  "), "value", F.when(F.col("last"), "\n]").otherwise(","))
    lines = made.orderBy("n").select(text.alias("value"))
    if rows.isEmpty():
        lines = rows.sparkSession.createDataFrame([("[]",)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_results(nested: DataFrame, path: str, order: str = "site_ord") -> None:
    """Nested results as one array, read again by `read_results`: sites in the order of a column `order`, or by their ids."""
    posting = F.transform("postings", lambda p: posting_json(*(p[f] for f in ("title", "organization", "regDate", "deadlineDate", "url", "status"))))
    head, tail = F.to_json(F.struct("site")), F.to_json(F.struct("crawledAt", "error"))
    list_ = F.concat(F.lit('{"postings":['), F.array_join(posting, ","), F.lit("]}"))
    rows = nested if order in nested.columns else nested.withColumn(order, F.col("site.id"))
    write_array(rows, _joined(head, list_, tail), path, order)


def write_new_postings(new: DataFrame, path: str) -> None:
    """Flat new postings with `siteId` and `siteName` as one array, in order."""
    write_array(new, posting_json(siteId="site_id", siteName="site_name"), path, "site_ord", "post_ord")


def write_verdicts(verdicts: DataFrame, sites: DataFrame, path: str) -> None:
    """Verdicts of an audit as one array in the sites' order."""
    fields = {"siteId": "site_id", "siteName": "site_name", "status": "status", "crawledCount": "crawled", "actualCount": "actual", "matchedTitles": "matched", "unmatchedTitles": "unmatched", "message": "message"}
    rows = verdicts.join(sites.select("site_id", "site_ord", "site_name"), "site_id")
    write_array(rows, F.to_json(F.struct(*(F.col(c).alias(n) for n, c in fields.items()))), path, "site_ord")


def read_hidden(spark: SparkSession, path: str) -> DataFrame:
    """The stored hidden set as it was last committed; empty where there is none."""
    stored = Versions(spark, path)
    last = stored.latest()
    return _read(spark, stored.folder(last, "hidden"), "site_id string, title string", True) if last else spark.createDataFrame([], "site_id string, title string")


def change_hidden(spark: SparkSession, path: str, changes: DataFrame | None) -> DataFrame:
    """Stores the hidden set after `changes` (`site_id`, `title`, `hide`, `seq`), or an empty one for none, and gives it.

    The new set is a version of its own: until it is committed, and if it never is, readers get the old one.
    """
    old = read_hidden(spark, path)
    now = checkpoint(toggle_hidden(old, changes) if changes is not None else old.limit(0))
    with Versions(spark, path).writing() as version:
        now.write.mode("overwrite").json(version.folder("hidden"))
    return now
