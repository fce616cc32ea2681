"""Queries over what is stored: postings of the test documents are written as a run writes them, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.audit import audit
from postmill.operators.snapshots import nested_results, new_postings
from postmill.operators.tables import shared_folder
from postmill.plans.derived import POSTINGS_SQL, SITES_SQL, postings, sites
from postmill.sources.snapshots import change_hidden, flat_postings, read_hidden, read_new_postings, read_results, snapshot_before, snapshot_on, write_new_postings, write_results, write_snapshot, write_verdicts
from postmill.sources.versions import Versions


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a run as one JSON array, the second of two versions, read back flat."""
    folder, known = _folder(spark), sites(spark, sf_dir)
    stored = Versions(spark, folder)
    nested = nested_results(postings(spark, sf_dir), known).join(known.select(F.col("site_id").alias("_id"), "site_ord"), F.col("site.id") == F.col("_id")).drop("_id")
    for some in (nested.limit(1), nested):
        with stored.writing() as version:
            write_results(some, version.folder("results.json"))
    flat = flat_postings(read_results(spark, stored.folder(stored.latest(), "results.json")), known)
    return flat.select("site_id", "site_name", "error", "post_ord", "title", "organization", "reg_date", "deadline_date", "url", "status")


STORED_RESULTS_SQL = f"""WITH {POSTINGS_SQL}, {SITES_SQL}
SELECT s.site_id, s.site_name, s.error, CAST(row_number() OVER (PARTITION BY s.site_id ORDER BY post_ord) - 1 AS INTEGER) AS post_ord, title, organization, reg_date, deadline_date, url, status
FROM postings p JOIN sites s ON s.site_id = p.site_id"""


def stored_new_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that the previous snapshot lacks, as one JSON array read back."""
    folder, p = _folder(spark), postings(spark, sf_dir)
    write_new_postings(new_postings(p.where("post_ord % 5 <> 0"), p.where("post_ord % 5 in (0, 1)")), folder)
    return read_new_postings(spark, folder, required=True).select("site_id", "site_name", "title", "organization", "reg_date", "deadline_date", "url", "status")


STORED_NEW_SQL = f"""WITH {POSTINGS_SQL}
SELECT site_id, site_name, title, organization, reg_date, deadline_date, url, status FROM postings c
WHERE post_ord % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM postings p WHERE p.post_ord % 5 IN (0, 1) AND p.site_id = c.site_id AND p.title = c.title)"""


def stored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over pages that show every second posting, as one JSON array read back."""
    folder, p, known = _folder(spark), postings(spark, sf_dir), sites(spark, sf_dir)
    shown = p.where("post_ord % 2 = 0").groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post_ord", "title"))), lambda x: x["title"]), "\n").alias("page_text"))
    pages = known.select("site_id", F.col("error").alias("crawl_error")).join(shown, "site_id", "left").withColumn("check_error", F.lit(None).cast("string"))
    write_verdicts(audit(p, pages), known, folder)
    read = spark.read.schema("siteId string, status string, crawledCount int, matchedTitles int, unmatchedTitles array<string>").option("multiLine", True).json(folder)
    return read.select(F.col("siteId").alias("site_id"), "status", F.col("crawledCount").alias("crawled"), F.col("matchedTitles").alias("matched"), F.array_join("unmatchedTitles", "|").alias("unmatched"))


STORED_VERDICTS_SQL = rf"""WITH {POSTINGS_SQL}, {SITES_SQL},
shown AS (SELECT site_id, string_agg(title, chr(10) ORDER BY post_ord) AS page_text FROM postings WHERE post_ord % 2 = 0 GROUP BY site_id),
marked AS (SELECT s.site_id, s.error, p.post_ord, p.title, coalesce(trim(left(regexp_replace(p.title, '\.\.\.\z', ''), 20)) <> '' AND contains(coalesce(page_text, ''), trim(left(regexp_replace(p.title, '\.\.\.\z', ''), 20))), false) AS hit
  FROM sites s LEFT JOIN postings p ON p.site_id = s.site_id LEFT JOIN shown h ON h.site_id = s.site_id),
counted AS (SELECT site_id, any_value(error) AS error, count(post_ord) AS n, count(*) FILTER (hit) AS m, array_to_string(list(title ORDER BY post_ord) FILTER (post_ord IS NOT NULL AND NOT hit), '|') AS missed FROM marked GROUP BY site_id)
SELECT site_id, CASE WHEN error IS NOT NULL THEN 'skip' WHEN n = 0 OR m >= n * CAST(0.7 AS DOUBLE) THEN 'pass' WHEN m >= n * CAST(0.3 AS DOUBLE) THEN 'warn' ELSE 'fail' END AS status,
  CAST(CASE WHEN error IS NULL THEN n ELSE 0 END AS INTEGER) AS crawled, CAST(CASE WHEN error IS NULL THEN m ELSE 0 END AS INTEGER) AS matched, CASE WHEN error IS NULL THEN coalesce(missed, '') ELSE '' END AS unmatched FROM counted"""


def stored_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hidden set after two changes, each stored as a version: postings are hidden, and some of them shown again."""
    folder, p = _folder(spark), postings(spark, sf_dir)
    for k, (where, hide) in enumerate((("post_ord % 4 = 1", True), ("post_ord % 8 = 1", False))):
        change_hidden(spark, folder, p.where(where).select("site_id", "title", F.lit(hide).alias("hide"), F.lit(k).alias("seq")))
    return read_hidden(spark, folder)


STORED_HIDDEN_SQL = f"""WITH {POSTINGS_SQL}
SELECT DISTINCT site_id, title FROM postings h WHERE post_ord % 4 = 1 AND NOT EXISTS (SELECT 1 FROM postings s WHERE s.post_ord % 8 = 1 AND s.site_id = h.site_id AND s.title = h.title)"""


def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated snapshots: one of a day, written twice, and the last one before it."""
    folder, p = _folder(spark), postings(spark, sf_dir).select("site_id", "post_ord", "title")
    for day, where in (("2026-03-01", "post_ord % 3 = 0"), ("2026-03-03", "post_ord % 3 = 1"), ("2026-03-03", "post_ord % 3 = 2"), ("2026-03-09", "post_ord % 7 = 0")):
        write_snapshot(p.where(where), folder, day)
    found = {"on": snapshot_on(spark, folder, "2026-03-03"), "before": snapshot_before(spark, folder, "2026-03-03")}
    parts = [rows.select(F.lit(name).alias("which"), F.col("snapshot_date").cast("string").alias("snapshot_date"), "site_id", "post_ord", "title") for name, rows in found.items()]
    return parts[0].unionByName(parts[1])


STORED_SNAPSHOTS_SQL = f"""WITH {POSTINGS_SQL}
SELECT 'on' AS which, '2026-03-03' AS snapshot_date, site_id, post_ord, title FROM postings WHERE post_ord % 3 = 2
UNION ALL SELECT 'before', '2026-03-01', site_id, post_ord, title FROM postings WHERE post_ord % 3 = 0"""

QUERIES = {"stored_results": stored_results, "stored_new_postings": stored_new_postings, "stored_verdicts": stored_verdicts, "stored_hidden": stored_hidden, "stored_snapshots": stored_snapshots}
ORACLE_SQL = {"stored_results": STORED_RESULTS_SQL, "stored_new_postings": STORED_NEW_SQL, "stored_verdicts": STORED_VERDICTS_SQL, "stored_hidden": STORED_HIDDEN_SQL, "stored_snapshots": STORED_SNAPSHOTS_SQL}
