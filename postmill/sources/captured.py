"""Captured board pages, read by Spark from any folder that it can open; errors as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from postmill.functions.text import trim
from postmill.operators.html import first, parse

SCHEMA = "site_id string, page int, url string, html string, error string"


def captured_pages(spark: SparkSession, path: str, sites: list[str] | None = None, pages: int | None = None) -> DataFrame:
    """`site_id`, `page`, `url`, `html` and `error` of the files `<site>/<page>.html` below `path`.

    A `<page>.url` beside a page holds its address, an `error.txt` what went wrong; it gives a row without page, and the
    site's pages, if any, are not used. `sites` reads only these, each that has no files giving a row with an error;
    `pages` reads at most so many of each site, the first by number.
    """
    found = _files(spark, f"{path}/{{{','.join(sites)}}}" if sites else path, bool(sites))
    number = F.regexp_extract("name", r"^(\d+)\.\w+$", 1).try_cast("int")
    named = found.withColumn("page", number)
    failed = named.where("name = 'error.txt'").select("site_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), trim("value").alias("error"))
    html = named.where("page is not null and name like '%.html'").join(failed.select("site_id"), "site_id", "left_anti").select("site_id", "page", F.col("value").alias("html"))
    if pages is not None:
        html = html.withColumn("_nth", F.row_number().over(Window.partitionBy("site_id").orderBy("page"))).where(F.col("_nth") <= pages).drop("_nth")
    urls = named.where("page is not null and name like '%.url'").select("site_id", "page", trim("value").alias("url"))
    rows = html.join(urls, ["site_id", "page"], "left").select("site_id", "page", "url", "html", F.lit(None).cast("string").alias("error")).unionByName(failed)
    if sites:
        asked = spark.createDataFrame([(s,) for s in sites], "site_id string").join(named.select("site_id").distinct(), "site_id", "left_anti")
        rows = rows.unionByName(asked.withColumn("error", F.lit("no captured pages")), allowMissingColumns=True)
    return rows


def _files(spark: SparkSession, path: str, tolerant: bool) -> DataFrame:
    """`site_id`, `name` and `value` (the whole text) of each file."""
    try:
        files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,url,txt}").text(path)
    except AnalysisException as e:
        if not tolerant or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "site_id string, name string, value string")
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    parts = F.split(at, "/")
    return files.select(F.element_at(parts, -2).alias("site_id"), F.element_at(parts, -1).alias("name"), "value")


def until_last_page(pages: DataFrame, pagers: dict[str, str], most: int = 10) -> DataFrame:
    """`pages` without those behind the last one: of a site in `pagers` up to `most`, and to the first page without its selector.

    The selector may hold `{next}` for the number of the next page. Other sites keep all pages.
    """

    @F.arrow_udf("boolean")
    def leads_on(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in columns:
            rows = zip(*(c.to_pylist() for c in batch), strict=True)
            yield pa.array([s not in pagers or first(parse(h or ""), pagers[s].replace("{next}", str((p or 1) + 1))) is not None for s, p, h in rows], pa.bool_())

    on = leads_on("site_id", "page", "html")
    end = F.min(F.when(~F.col("_on"), F.coalesce("page", F.lit(1)))).over(Window.partitionBy("site_id"))
    kept = pages.withColumn("_on", on).withColumn("_end", end).where("_end is null or coalesce(page, 1) <= _end")
    return kept.where(~F.col("site_id").isin(list(pagers)) | (F.coalesce("page", F.lit(1)) <= most)).drop("_on", "_end")
