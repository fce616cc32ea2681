"""Exact removal of repeated postings.

Postings have `site_id`, `site_ord` and `post_ord`, which order them, `title`, `url` and `reg_date`.
Each function is one shuffle by key; the first winner is found with aggregates over windows, so no
group is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import crawl_key, view_key

ORDER = ("site_ord", "post_ord")


def has_url(c: str = "url") -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _place() -> Column:
    return F.struct(*ORDER)


def dedup_crawl(postings: DataFrame) -> DataFrame:
    """One posting for each crawl key: the first that the key's owning site has.

    The first site to hold a key owns it. A later posting with a URL takes the key over as long as
    the owner's first posting of the key has none, whatever the owner's other postings have. So the owner is
    the earliest site whose posting has a URL as had its site's first one; else the last with a URL; else
    the first.
    """
    by_key = Window.partitionBy("_key")
    by_site = Window.partitionBy("_key", "site_id").orderBy(*ORDER)
    p = postings.withColumn("_key", crawl_key("title")).withColumn("_url", has_url())
    p = p.withColumn("_first_url", F.first("_url").over(by_site)).withColumn("_nth", F.row_number().over(by_site))
    least = lambda c: F.min(F.when(c, F.struct(_place().alias("at"), "site_id"))).over(by_key)["site_id"]
    most = lambda c: F.max(F.when(c, F.struct(_place().alias("at"), "site_id"))).over(by_key)["site_id"]
    owner = F.coalesce(least(F.col("_url") & F.col("_first_url")), most(F.col("_url")), least(F.lit(True)))
    return p.withColumn("_owner", owner).where("site_id = _owner and _nth = 1").drop("_key", "_url", "_first_url", "_nth", "_owner")


def dedup_view(postings: DataFrame, key_place: str | None = None) -> DataFrame:
    """One posting for each view key: with a URL before without, then of the latest date, then the first.

    `key_place` names a column for the place of the key's first posting, by which listings break ties.
    """
    by_key = Window.partitionBy("_key")
    best = by_key.orderBy(F.col("_url").desc(), F.coalesce("reg_date", F.lit("")).desc(), *ORDER)
    p = postings.withColumn("_key", view_key("title")).withColumn("_url", has_url())
    p = p.withColumn("_at", F.min(_place()).over(by_key)).withColumn("_nth", F.row_number().over(best)).where("_nth = 1")
    return (p.withColumnRenamed("_at", key_place) if key_place else p.drop("_at")).drop("_key", "_url", "_nth")


def distinct_titles(postings: DataFrame) -> DataFrame:
    """The first posting of each title within a site."""
    own = Window.partitionBy("site_id", "title").orderBy("post_ord")
    return postings.withColumn("_nth", F.row_number().over(own)).where("_nth = 1").drop("_nth")
