"""Queries over the page source and what is stored: pages made of the test documents are captured in files, and read as a run reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.board_rows import spec_postings, spec_rows, spec_table
from postmill.operators.tables import shared_folder
from postmill.plans import board_pages as B
from postmill.plans.gather import PAGE_ROWS, postings_of
from postmill.sources.boards import BOARDS
from postmill.sources.page_source import asked_pages, board_pages, register

_COLUMNS = ["site_id", "page", "url", "html", "error", "applied", "variant", "attempts"]
#: Pages of the board with a pager lead on but for those of this remainder.
_LAST = (8, 6)
_PAGED = ("gojobs", "seoul", "kaah")


def pages_of(spark: SparkSession, sf_dir: str, site: str) -> DataFrame:
    """Pages of a board as rows of the sink."""
    none = F.lit(None).cast("string")
    made = B.board_pages(spark, sf_dir, B.LAYOUTS[site])
    return made.select(F.lit(site).alias("site_id"), "page", "url", "html", none.alias("error"), F.lit("").alias("applied"), none.alias("variant"), F.lit(None).cast("int").alias("attempts"))


def captured(spark: SparkSession, *pages: DataFrame) -> str:
    """Writes pages as files of a new folder, and gives its path."""
    register(spark)
    path = f"{shared_folder(spark)}/captured-{uuid.uuid4().hex}"
    for some in pages:
        some.select(*_COLUMNS).write.format("board_pages").mode("append").save(path)
    return path


def _postings(rows: DataFrame) -> DataFrame:
    return rows.select("site_id", F.floor(F.col("post_ord") / PAGE_ROWS).cast("int").alias("page"), F.pmod("post_ord", F.lit(PAGE_ROWS)).cast("int").alias("post_ord"), "title", "organization", "reg_date", "deadline_date", "url", "status")


def _with_pager(pages: DataFrame) -> DataFrame:
    next_ = F.concat(F.lit('<a onclick="fn_egov_link_page('), (F.col("page") + 1).cast("string"), F.lit(')">next</a>'))
    return pages.withColumn("html", F.when(F.pmod("page", F.lit(_LAST[0])) == _LAST[1], F.col("html")).otherwise(F.concat("html", next_)))


def source_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of three boards from captured files, one of them up to the page without pager."""
    pages = [_with_pager(p) if s == "gojobs" else p for s in _PAGED for p in [pages_of(spark, sf_dir, s)]]
    read = board_pages(spark, captured(spark, *pages), html="false")
    return _postings(postings_of(read.where("error is null").select("site_id", "page", "rows")))


_ROWS = "page, post_ord, title, organization, reg_date, deadline_date, url, status"


def _board(site: str) -> str:
    return f"SELECT '{site}' AS site_id, {_ROWS} FROM ({B.board_sql(B.LAYOUTS[site])})"


_ENDED = f"page <= (SELECT coalesce(min(page), 9) FROM items WHERE page % {_LAST[0]} = {_LAST[1]}) AND page < 10"
SOURCE_POSTINGS_SQL = f"""WITH {B.ITEMS_SQL}
{" UNION ALL ".join(_board(s) for s in _PAGED if s != "gojobs")}
UNION ALL (SELECT * FROM ({_board("gojobs")}) WHERE {_ENDED} QUALIFY row_number() OVER (PARTITION BY title ORDER BY page, post_ord) = 1)"""


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read of each page: the variant chosen, attempts, rows found; and where sites ended in errors."""
    none = F.lit(None).cast("string")
    shell = lambda p: p.withColumn("html", F.lit("<p>shell</p>"))
    framed, bare, tried = (pages_of(spark, sf_dir, s) for s in ("museum-or-kr", "nyj", "khs"))
    frame = framed.where("page % 2 = 0").withColumns({"variant": F.lit("frame-3"), "url": F.lit("https://f/?kboard_id=2")})
    advert = shell(framed).withColumns({"variant": F.lit("frame-1"), "url": F.lit("https://ads")})
    noscript = bare.where("page % 3 = 0").withColumn("variant", F.lit("noscript"))
    failures = [tried.where(f"page % 5 = 1 and page % 10 >= {k}").withColumns({"html": none, "url": none, "attempts": F.lit(k), "error": F.concat(F.lit(f"reset {k} of "), F.col("page").cast("string"))}) for k in (1, 2, 3)]
    whole = pages_of(spark, sf_dir, "cha").where("page = 0").withColumns({"page": F.lit(None).cast("int"), "html": none, "url": none, "error": F.lit("timeout")})
    path = captured(spark, shell(framed.where("page % 2 = 0")), framed.where("page % 2 = 1"), frame, advert, bare.where("page % 3 <> 0"), shell(bare.where("page % 3 = 0")), noscript, tried, *failures, pages_of(spark, sf_dir, "cha"), whole)
    read = board_pages(spark, path, html="false")
    return read.select("site_id", "page", "variant", "attempts", F.size(F.coalesce("rows", F.array().cast(dict(read.dtypes)["rows"]))).alias("n_rows"), "url", "error")


def _counted(site: str, variant: str, url: str) -> str:
    return f"""SELECT '{site}' AS site_id, p.page, {variant} AS variant, 1 AS attempts, CAST(count(b.page) AS INTEGER) AS n_rows, {url} AS url, CAST(NULL AS VARCHAR) AS error
FROM (SELECT DISTINCT page FROM items) p LEFT JOIN ({B.board_sql(B.LAYOUTS[site])}) b ON b.page = p.page GROUP BY p.page"""


#: The third attempt at a page of khs fails on the first page of remainder 6: the site ends there.
SOURCE_PAGES_SQL = f"""WITH {B.ITEMS_SQL},
ended AS (SELECT min(page) AS page FROM items WHERE page % 10 = 6)
{_counted("museum-or-kr", "CASE WHEN p.page % 2 = 0 THEN 'frame-3' ELSE '' END", "CASE WHEN p.page % 2 = 0 THEN 'https://f/?kboard_id=2' ELSE 'https://b/list' END")}
UNION ALL {_counted("nyj", "CASE WHEN p.page % 3 = 0 THEN 'noscript' ELSE '' END", "'https://b/list'")}
UNION ALL (SELECT site_id, page, variant, CAST(CASE WHEN page % 10 = 1 THEN 2 ELSE 1 END AS INTEGER), n_rows, url, error FROM ({_counted("khs", "''", "'https://b/list'")}) WHERE page < (SELECT coalesce(page, 1 << 30) FROM ended))
UNION ALL SELECT 'khs', page, NULL, 3, 0, NULL, 'reset 3 of ' || page FROM ended WHERE page IS NOT NULL
UNION ALL SELECT 'cha', NULL, NULL, 0, 0, NULL, 'timeout'"""


def source_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of a board asked for by four levels of categories, of which lists were captured; of another by a range of pages. Both filters reach the source."""
    ncs, kaah = pages_of(spark, sf_dir, "ncs"), pages_of(spark, sf_dir, "kaah")
    path = captured(spark, ncs, ncs.where("page % 3 = 1").withColumn("applied", F.lit("08")), ncs.where("page % 3 = 0").withColumn("applied", F.lit("08/01/04/01")), kaah)
    chosen = {
        "all four": "site_id = 'ncs' and level1 = '08' and level2 = '01' and level3 = '04' and level4 = '01'", "one there": "site_id = 'ncs' and level1 = '08' and level2 = '77'",
        "none there": "site_id = 'ncs' and level1 = '99'", "pages": "site_id = 'kaah' and page between 1 and 2",
    }
    out = None
    for name, where in chosen.items():
        some = asked_pages(spark, path, where, html="false").withColumn("asked", F.lit(name))
        counts = some.groupBy("asked", "site_id", "page", "applied").agg(F.sum(F.size("rows")).alias("n_rows"))
        out = counts if out is None else out.unionByName(counts)
    return out


def _asked(name: str, site: str, where: str, applied: str) -> str:
    return f"""SELECT '{name}' AS asked, '{site}' AS site_id, p.page, '{applied}' AS applied, count(b.page) AS n_rows
FROM (SELECT DISTINCT page FROM items WHERE {where}) p LEFT JOIN ({B.board_sql(B.LAYOUTS[site])}) b ON b.page = p.page GROUP BY p.page"""


SOURCE_CATEGORIES_SQL = f"""WITH {B.ITEMS_SQL}
{_asked("all four", "ncs", "page % 3 = 0", "08/01/04/01")} UNION ALL {_asked("one there", "ncs", "page % 3 = 1", "08")}
UNION ALL {_asked("none there", "ncs", "true", "")} UNION ALL {_asked("pages", "kaah", "page BETWEEN 1 AND 2", "")}"""

_BY_SPEC = ("nmkpg", "gogung", "museum-or-kr", "museum-go-kr", "musenet", "history-seoul")


def spec_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of boards that rows of a table describe, by the table function."""
    specs = spec_table(spark, {s: BOARDS[s] for s in _BY_SPEC})
    return _postings(spec_postings(spec_rows(B.pages_of_boards(spark, sf_dir, _BY_SPEC), specs), PAGE_ROWS))


SPEC_BOARDS_SQL = " UNION ALL ".join(_board(s) for s in _BY_SPEC)

QUERIES = {"source_postings": source_postings, "source_pages": source_pages, "source_categories": source_categories, "spec_boards": spec_boards}
ORACLE_SQL = {"source_postings": SOURCE_POSTINGS_SQL, "source_pages": SOURCE_PAGES_SQL, "source_categories": SOURCE_CATEGORIES_SQL, "spec_boards": SPEC_BOARDS_SQL}
