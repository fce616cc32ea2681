"""From captured pages to stored results: one call reads, gathers, compares with the run before, audits, and commits."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.audit import audit, audit_summary
from postmill.operators.snapshots import new_postings, run_summary
from postmill.plans.gather import results, run
from postmill.sources.boards import find_site, site_table
from postmill.sources.page_source import board_pages
from postmill.sources.snapshots import flat_postings, read_new_postings, read_results, write_new_postings, write_results, write_verdicts
from postmill.sources.versions import Versions


@dataclass(frozen=True)
class Stored:
    """A committed run: its number and the folder of its files."""

    version: int
    path: str

    def results(self, spark: SparkSession) -> DataFrame:
        return read_results(spark, f"{self.path}/results.json")

    def new_postings(self, spark: SparkSession) -> DataFrame:
        return read_new_postings(spark, f"{self.path}/new-postings.json", required=True)


def whole_run(
    spark: SparkSession, captured: str, out: str, keywords: list[str], as_of: datetime, site: str | None = None, answers: DataFrame | None = None, specs: DataFrame | None = None, sites: DataFrame | None = None, **source: str
) -> Stored:
    """Gathers the pages captured in a folder and stores `results.json`, `new-postings.json` and `verify-results.json` below `out`.

    The run before is the last one committed there; without one all postings are new. `site` limits the run to one board (an
    error naming all boards if there is no such one); `answers` are of the board that answers in JSON, `specs` rows of boards
    in place of the declared ones, `source` options of the page source. All three files are committed together.
    """
    sites = site_table(spark) if sites is None else sites
    pages = board_pages(spark, captured, html="true" if specs is not None else "false", text="true", **source)
    if site is not None:
        sites = find_site(sites, site)
        pages = pages.where(F.col("site_id") == site)
    snapshot, read = run(pages, sites, keywords, as_of, answers, specs)
    # A board that nothing was captured of, and that hasn't answered, gave no answer.
    heard = read.select("site_id").union(snapshot.select("site_id")).distinct().withColumn("_heard", F.lit(True))
    silent = sites.join(heard, "site_id", "left").where("_heard is null").select("site_id", F.lit("no captured pages").alias("error"))
    nested = results(snapshot, read.select("site_id", "error").unionByName(silent), sites, as_of.strftime("%Y-%m-%dT%H:%M:%S.000Z"))
    placed = nested.join(sites.select(F.col("site_id").alias("_id"), "site_ord"), F.col("site.id") == F.col("_id")).drop("_id")
    stored = Versions(spark, out)
    before = stored.latest()
    with stored.writing() as version:
        write_results(placed, version.folder("results.json"))
        current = read_results(spark, version.folder("results.json"))
        flat = flat_postings(current, sites)
        previous = flat_postings(read_results(spark, stored.folder(before, "results.json")), sites) if before else flat.limit(0)
        write_new_postings(new_postings(flat, previous), version.folder("new-postings.json"))
        first = pages.where("error is null").groupBy("site_id").agg(F.min_by("text", "page").alias("page_text"))
        errors = current.select(F.col("site.id").alias("site_id"), F.col("error").alias("crawl_error"))
        judged = audit(flat, errors.join(first, "site_id", "left").withColumn("check_error", F.lit(None).cast("string")))
        write_verdicts(judged, sites, version.folder("verify-results.json"))
    return Stored(version.number, f"{stored.path}/v={version.number}")


def summary(spark: SparkSession, stored: Stored) -> dict[str, int]:
    """Figures of a stored run: sites that answered and failed, postings, new ones, and verdicts of each kind."""
    verdicts = spark.read.option("multiLine", True).json(f"{stored.path}/verify-results.json")
    figures = run_summary(stored.results(spark)).first().asDict() | {"new": stored.new_postings(spark).count()}
    return figures | audit_summary(verdicts).first().asDict()
