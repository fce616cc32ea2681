"""The whole run: captured pages of all boards to one snapshot, its news, and its audit."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import bracketed_organization, normalize_date, optional_date, or_default, trim, truncate
from postmill.operators.board_rows import spec_postings, spec_rows
from postmill.operators.dedup import dedup_crawl
from postmill.operators.extract import Board, json_postings, link_url, rows_of
from postmill.operators.filters import relevant_postings
from postmill.operators.fuzzy import dedup_fuzzy
from postmill.operators.snapshots import nested_results
from postmill.operators.tables import checkpoint
from postmill.sources.boards import BOARDS, JSON_SITE

#: Numbers of a page's postings begin at multiples of this, more rows than any text can hold; pages of a site follow each other.
PAGE_ROWS = 1 << 28

POSTING_COLUMNS = ["site_id", "post_ord", "title", "organization", "reg_date", "deadline_date", "url", "status"]
_FIELDS = ("title", "date", "org", "deadline", "status", "link")


def by_board(boards: dict[str, Board], made, fallback: Column) -> Column:
    """A column that depends on the row's board: boards that ask for the same expression share a branch."""
    groups: dict[str, tuple[Column, list[str]]] = {}
    for site, board in boards.items():
        c = made(board)
        groups.setdefault(str(c), (c, []))[1].append(site)
    out = fallback
    for c, sites in groups.values():
        out = F.when(F.col("site_id").isin(sites), c).otherwise(out)
    return out


def of_board(boards: dict[str, Board], value) -> Column:
    """A board's own text as a column: null for none, and for sites without a board."""
    pairs = [F.lit(x) for site, board in boards.items() for x in (site, value(board)) if value(board) is not None]
    return F.element_at(F.create_map(*pairs).cast("map<string,string>"), F.col("site_id"))


def read_pages(pages: DataFrame, boards: dict[str, Board] = BOARDS) -> DataFrame:
    """`site_id`, `page`, `rows` (raw values) and `error` of `pages` (`site_id`, `page`, `url`, `html`, and `error` if there is one).

    Each page is read by its site's board; sites without one, and pages without text, have no rows. A page that
    can't be read gives its error, never a failed task.
    """

    @F.arrow_udf("rows array<struct<title:string,date:string,org:string,deadline:string,status:string,link:string>>, error string")
    def read(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(f, pa.string()) for f in _FIELDS]))
        for site, url, page in columns:
            rows, errors = [], []
            for s, u, p in zip(site.to_pylist(), url.to_pylist(), page.to_pylist(), strict=True):
                try:
                    rows.append(rows_of(boards[s], p, u or "") if p and s in boards else [])
                    errors.append(None)
                except Exception as e:  # whatever a page's markup leads to
                    rows.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.StructArray.from_arrays([pa.array(rows, kind), pa.array(errors, pa.string())], ["rows", "error"])

    given = F.nullif("error", F.lit("")) if "error" in pages.columns else F.lit(None).cast("string")
    found = pages.select("site_id", F.coalesce("page", F.lit(1)).alias("page"), given.alias("given"), read("site_id", "url", "html").alias("r"))
    return found.select("site_id", "page", "r.rows", F.coalesce("given", "r.error").alias("error"))


def page_postings(pages: DataFrame, boards: dict[str, Board] = BOARDS) -> DataFrame:
    """Postings of `pages` of all boards in one pass; pages that can't be read have none."""
    return postings_of(read_pages(pages, boards), boards)


def postings_of(found: DataFrame, boards: dict[str, Board] = BOARDS) -> DataFrame:
    """Postings of pages that are read."""
    rows = found.select("site_id", "page", F.posexplode("rows").alias("n", "r")).select("site_id", (F.col("page").cast("long") * PAGE_ROWS + F.col("n")).alias("post_ord"), "r.*")
    # Boards differ in these texts most; as values, not branches, they leave a few expressions for all boards.
    own_name, base = F.coalesce(of_board(boards, lambda b: b.organization), F.lit("")), of_board(boards, lambda b: b.base)
    default = or_default("org", own_name)
    org = by_board(boards, lambda b: bracketed_organization("title", own_name, b.bracket_org == "anywhere") if b.bracket_org else F.lit(None).cast("string"), F.lit(None).cast("string"))
    out = rows.select(
        "site_id", "post_ord", by_board(boards, lambda b: trim("title") if b.raw_title else truncate("title"), truncate("title")).alias("title"), F.coalesce(org, default).alias("organization"),
        by_board(boards, lambda b: F.col("date") if b.raw_dates else normalize_date("date"), normalize_date("date")).alias("reg_date"),
        by_board(boards, lambda b: F.nullif("deadline", F.lit("")) if b.raw_dates else optional_date("deadline"), optional_date("deadline")).alias("deadline_date"),
        by_board(boards, lambda b: link_url(b, base=base), F.lit(None).cast("string")).alias("url"), F.nullif("status", F.lit("")).alias("status"),
    )
    once = [s for s, b in boards.items() if b.distinct]
    if not once:
        return out
    own = Window.partitionBy("site_id", "title").orderBy("post_ord")
    numbered = out.withColumn("_nth", F.row_number().over(own))
    return numbered.where(~F.col("site_id").isin(once) | (F.col("_nth") == 1)).drop("_nth")


def stored_postings(read: DataFrame, boards: dict[str, Board] = BOARDS) -> DataFrame:
    """`postings_of` pages that are stored, so that they can be read twice: only rows of boards with one posting for each title are shuffled, filters reach all others."""
    once = {s: b for s, b in boards.items() if b.distinct}
    single = F.coalesce(F.col("site_id").isin(list(once)), F.lit(False))
    others = {s: b for s, b in boards.items() if not b.distinct}
    return postings_of(read.where(~single), others).unionByName(postings_of(read.where(single), once))


def gather(pages: DataFrame, sites: DataFrame, keywords: list[str], as_of: datetime, answers: DataFrame | None = None, specs: DataFrame | None = None) -> DataFrame:
    """The snapshot of `run`."""
    return run(pages, sites, keywords, as_of, answers, specs)[0]


def run(pages: DataFrame, sites: DataFrame, keywords: list[str], as_of: datetime, answers: DataFrame | None = None, specs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The snapshot: postings of all boards, filtered and each once, with `site_ord` and `site_name`; and the pages as read.

    `pages` that have `rows` already, as those of the page source, are not parsed again. With `specs` (`site_id`, `spec`) boards
    are what these rows say, not the declared ones. `answers` (`page`, `body`) are those of the board that answers in JSON. A site with an error among its
    pages, given or met in reading, gives no postings, as a failed run of it would.
    """
    if specs is not None:
        given = F.nullif("error", F.lit("")) if "error" in pages.columns else F.lit(None).cast("string")
        rows = checkpoint(spec_rows(pages, specs))
        read = checkpoint(pages.select("site_id", "page", given.alias("error")).unionByName(rows.where("error is not null").select("site_id", "page", "error")))
    elif "rows" in pages.columns:
        read = checkpoint(pages.select("site_id", F.coalesce("page", F.lit(1)).alias("page"), "rows", F.nullif("error", F.lit("")).alias("error")))
    else:
        read = checkpoint(read_pages(pages))
    failed = read.where("error is not null").select("site_id").distinct()
    found = spec_postings(rows.join(failed, "site_id", "left_anti"), PAGE_ROWS) if specs is not None else stored_postings(read.join(failed, "site_id", "left_anti"))
    if answers is not None:
        site, organization, base = JSON_SITE
        more = json_postings(answers, organization, base).withColumns({"site_id": F.lit(site), "status": F.lit(None).cast("string")})
        found = found.unionByName(more.withColumn("post_ord", F.col("post_ord").cast("long")).select(POSTING_COLUMNS))
    kept = relevant_postings(found, keywords, as_of)
    placed = kept.join(sites.select("site_id", "site_ord", "site_name"), "site_id")
    # From page 4,096 on a page's numbers are beyond what one number of site and posting can hold.
    return dedup_fuzzy(dedup_crawl(placed), bounded=False), read


def results(snapshot: DataFrame, pages: DataFrame, sites: DataFrame, crawled_at: str) -> DataFrame:
    """The snapshot as nested results, a row for each site, with the error among its `pages` (captured or as read) if it failed."""
    errors = pages.groupBy("site_id").agg(F.max("error").alias("error"))
    listed = sites.join(errors, "site_id", "left").withColumn("crawled_at", F.lit(crawled_at))
    return nested_results(snapshot, listed)
