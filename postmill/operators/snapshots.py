"""Comparing snapshots, and shapes that snapshots are stored in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(rows: DataFrame, flag: str | None = None) -> DataFrame:
    """Distinct site and title of `rows` as `_s` and `_t`; a null is an empty text in every comparison."""
    keys = rows.select(F.coalesce("site_id", F.lit("")).alias("_s"), F.coalesce("title", F.lit("")).alias("_t")).distinct()
    return keys.withColumn(flag, F.lit(True)) if flag else keys


def _same() -> Column:
    return (F.coalesce("site_id", F.lit("")) == F.col("_s")) & (F.coalesce("title", F.lit("")) == F.col("_t"))


def new_postings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Postings whose site and exact title the previous snapshot lacks; repeats stay."""
    return current.join(_keys(previous), _same(), "left_anti")


def mark_new(current: DataFrame, new: DataFrame) -> DataFrame:
    """`current` with `is_new`: whether `new` has the same site and title."""
    return current.join(_keys(new, "_seen"), _same(), "left").withColumn("is_new", F.coalesce("_seen", F.lit(False))).drop("_seen", "_s", "_t")


def without_hidden(postings: DataFrame, hidden: DataFrame) -> DataFrame:
    """Postings that the reader has not hidden by site and title."""
    return postings.join(_keys(hidden), _same(), "left_anti")


def toggle_hidden(hidden: DataFrame, changes: DataFrame) -> DataFrame:
    """The hidden set after `changes` (`site_id`, `title`, `hide`, `seq`): the last one of a posting holds."""
    last = changes.groupBy(F.coalesce("site_id", F.lit("")).alias("site_id"), F.coalesce("title", F.lit("")).alias("title")).agg(F.max_by("hide", "seq").alias("hide"))
    kept = _keys(hidden).withColumnsRenamed({"_s": "site_id", "_t": "title"}).join(last, ["site_id", "title"], "left_anti")
    return kept.unionByName(last.where("hide").select("site_id", "title"))


def nested_results(postings: DataFrame, sites: DataFrame) -> DataFrame:
    """One row for each site with its postings in order; sites without any keep an empty list."""
    item = F.struct("post_ord", "title", "organization", F.col("reg_date").alias("regDate"), F.col("deadline_date").alias("deadlineDate"), "url", "status")
    lists = postings.groupBy("site_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    plain = F.transform("p", lambda x: x.dropFields("post_ord"))
    site = F.struct(F.col("site_id").alias("id"), F.col("site_name").alias("name"), F.col("site_url").alias("url"))
    empty = F.filter(plain, lambda x: F.lit(False))
    joined = sites.join(lists, "site_id", "left").orderBy("site_ord")
    return joined.select(site.alias("site"), F.coalesce(plain, empty, F.array().cast("array<struct<title:string,organization:string,regDate:string,deadlineDate:string,url:string,status:string>>")).alias("postings"), F.col("crawled_at").alias("crawledAt"), "error")


def preview(postings: DataFrame, count: int = 3) -> DataFrame:
    """The first titles of each site in order, and how many more there are.

    Each task keeps its first few of a site before they are dealt out (a window of `row_number` up to a bound), so no
    site is sorted in one task.
    """
    nth = F.row_number().over(Window.partitionBy("site_id").orderBy("post_ord"))
    few = postings.select("site_id", "post_ord", "title").withColumn("_nth", nth).where(F.col("_nth") <= count)
    first = few.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "title"))), lambda x: x["title"]).alias("titles"))
    counts = postings.groupBy("site_id").agg(F.greatest(F.count("*") - count, F.lit(0)).alias("more"))
    return counts.join(first.withColumnRenamed("site_id", "_s"), F.col("site_id").eqNullSafe(F.col("_s"))).select("site_id", "titles", "more")


def run_summary(results: DataFrame) -> DataFrame:
    """Sites that gave an answer and that failed, and postings in all, of nested results."""
    failed = F.coalesce("error", F.lit("")) != ""
    return results.agg(F.count_if(~failed).alias("ok_sites"), F.count_if(failed).alias("failed_sites"), F.coalesce(F.sum(F.size("postings")), F.lit(0)).cast("long").alias("postings"))
