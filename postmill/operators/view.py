"""The listing that a reader sees: recent postings once each, facets, figures, and filters."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import trim
from postmill.functions.times import is_new, within_days, within_month_view
from postmill.operators.dedup import dedup_view
from postmill.operators.html import WHITE
from postmill.operators.snapshots import without_hidden
from postmill.operators.tables import checkpoint


@dataclass
class Choice:
    """What the reader has chosen; hidden postings are shown only while there are any."""

    site: str | None = None
    only_new: bool = False
    period_days: int = 0
    search: str = ""
    show_hidden: bool = False

    def toggled(self, site: str) -> Choice:
        """Choosing the chosen site again clears it."""
        return Choice(None if site == self.site else site, self.only_new, self.period_days, self.search, self.show_hidden)


def listed(postings: DataFrame, as_of: datetime, zone: str = "UTC") -> DataFrame:
    """Recent postings of sites that answered, once each, with `rank_place` to break ties of dates.

    `postings` may have `error`, the site's; rows with one are left out.
    """
    if "error" in postings.columns:
        postings = postings.where(F.coalesce("error", F.lit("")) == "")
    return dedup_view(postings.where(within_month_view("reg_date", as_of, zone)), "rank_place")


def site_counts(listing: DataFrame) -> DataFrame:
    """Postings of each site that has any, most first; equal counts in order of appearance."""
    counts = listing.groupBy("site_id").agg(F.count("*").alias("n"), F.min("rank_place").alias("_at"))
    return counts.orderBy(F.desc("n"), "_at").drop("_at")


def site_order(listing: DataFrame) -> DataFrame:
    """`site_counts` with `place`, from 1: one row for each site that has postings."""
    counts = listing.groupBy("site_id").agg(F.count("*").alias("n"), F.min("rank_place").alias("_at"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_at")).cast("long")).drop("_at")


def figures(listing: DataFrame) -> DataFrame:
    return listing.agg(F.countDistinct("site_id").alias("sites"), F.count("*").alias("postings"))


def latest_crawl(times: DataFrame, column: str = "crawled_at") -> DataFrame:
    """The latest readable time of all results, errors included; the epoch if there is none."""
    read = F.try_to_timestamp(F.col(column).cast("string"))
    return times.agg(F.coalesce(F.max(read), F.lit("1970-01-01 00:00:00").cast("timestamp")).alias("crawled_at"))


def chosen(listing: DataFrame, choice: Choice, as_of: datetime, hidden: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
    """Rows of a listing that the reader's choice leaves; literal, case-blind search in three columns."""
    rows = listing
    if hidden is not None and not choice.show_hidden:
        rows = without_hidden(rows, hidden)
    if choice.site:
        rows = rows.where(F.col("site_id") == choice.site)
    if choice.only_new:
        rows = rows.where(is_new("reg_date", as_of, zone))
    if choice.period_days > 0:
        rows = rows.where(within_days("reg_date", as_of, choice.period_days, zone))
    query = F.lower(trim(F.lit(choice.search)))
    if choice.search.strip(WHITE):
        found = F.lit(False)
        for c in ("title", "organization", "site_name"):
            found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), query)
        rows = rows.where(found)
    return rows


#: How the texts of dates are compared: as the locale of the listing's readers orders them, Hangul before Latin letters.
COLLATION = "ko"


def ordered(rows: DataFrame, collation: str = COLLATION) -> DataFrame:
    """Latest dates first, as texts in a collation; equal dates by the place where a posting's key first stood."""
    return rows.orderBy(F.collate(F.coalesce("reg_date", F.lit("")), collation).desc(), "rank_place")


def ranked(rows: DataFrame, collation: str = COLLATION) -> DataFrame:
    """`rows` with `rank`, the place in `ordered`: ranges of the order are numbered side by side, then moved on by what is before."""
    date = F.collate(F.coalesce("reg_date", F.lit("")), collation)
    dealt = rows.withColumn("_d", date).repartitionByRange(F.desc("_d"), "rank_place").sortWithinPartitions(F.desc("_d"), "rank_place")
    dealt = checkpoint(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() % (1 << 33)))
    # One row for each partition.
    counts = dealt.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(counts.drop("count")), "_part").withColumn("rank", F.col("_before") + F.col("_nth") + 1).drop("_d", "_part", "_nth", "_before")
