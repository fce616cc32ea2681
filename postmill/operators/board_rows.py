"""Extraction as a table function, told by rows: a board is added by a row of a table, not by code.

`board_rows(html, url, spec)` is used in SQL with LATERAL: it gives the rows of a page as its board's spec, a JSON text, says.
With a fourth argument, a constant list of fields, it has only these columns. What the spec says beyond rows (dates, links,
organizations) is read by columns of `spec_postings`.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from postmill.functions.text import normalize_date, optional_date, or_default, trim, truncate
from postmill.operators.extract import Board, Pick, keep_absolute, only_absolute, prefixed, resolved, strip_dot, tree_of, tree_rows

FIELDS = ("title", "date", "org", "deadline", "status", "link")
_PICKS = ("title", "date", "needs", "org", "deadline", "status", "link")


def board_spec(board: Board) -> str:
    """A board as a JSON text; what is as by default is left out."""
    plain = Board("", (), (), "")

    def said(b: Board) -> dict:
        out = {k: v for k, v in asdict(b).items() if v != getattr(plain, k) or k in ("rows", "title", "date", "organization")}
        return out | ({"other": said(b.other)} if b.other else {})

    return json.dumps(said(board), ensure_ascii=False)


def _pick(d: dict) -> Pick:
    return Pick(**d)


def _board(d: dict) -> Board:
    made = {k: tuple(_pick(p) for p in v) if k in _PICKS else tuple(v) if k in ("skip", "children") else v for k, v in d.items()}
    if "only" in d:
        made["only"] = tuple((_pick(p), want, part) for p, want, part in d["only"])
    if d.get("other"):
        made["other"] = _board(d["other"])
    return Board(**made)


@lru_cache(maxsize=1024)
def board_of(spec: str) -> Board:
    """The board that a spec describes; an error for one that describes none."""
    return _board(json.loads(spec))


def spec_table(spark: SparkSession, boards: dict[str, Board]) -> DataFrame:
    """`site_id` and `spec` of declared boards."""
    return spark.createDataFrame([(site, board_spec(b)) for site, b in boards.items()], "site_id string, spec string")


class BoardRows:
    """`post_ord`, the wanted fields, and `error`: a row for each row of a page, or one with an error if it can't be read."""

    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument, spec: AnalyzeArgument, fields: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, given in (("html", html), ("url", url), ("spec", spec)):
            if given.dataType.typeName() not in ("string", "void"):
                raise ValueError(f"{name} of board_rows has to be a text")
        wanted = FIELDS if fields is None else tuple(x.strip() for x in (fields.value or "").split(","))
        if not set(wanted) <= set(FIELDS):
            raise ValueError(f"fields of board_rows are {', '.join(FIELDS)}")
        schema = StructType().add("post_ord", IntegerType())
        for f in wanted:
            schema = schema.add(f, StringType())
        return AnalyzeResult(schema.add("error", StringType()))

    def eval(self, html: str | None, url: str | None, spec: str | None, fields: str | None = None):
        wanted = FIELDS if fields is None else tuple(x.strip() for x in fields.split(","))
        if html is None or spec is None:
            return
        try:
            board = board_of(spec)
            if board.error_path and board.error_path in (url or ""):
                return
            for n, row in enumerate(tree_rows(board, tree_of(board, html))):
                yield (n, *(row[f] for f in wanted), None)
        except Exception as e:  # whatever a page or a spec leads to
            yield (None, *(None for _ in wanted), f"{type(e).__name__}: {e}")


def register(spark: SparkSession) -> None:
    spark.udtf.register("board_rows", F.udtf(BoardRows))


#: What columns read of a spec.
_SPEC = "organization string, url string, base string, call string, raw_dates boolean, raw_title boolean, bracket_org string, distinct boolean"


def spec_rows(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """`site_id`, `page`, `spec` and the raw values of each row of `pages` (`site_id`, `page`, `url`, `html`), by the specs of their sites (`site_id`, `spec`).

    Specs, a row for each board, are broadcast, and pages are dealt by their numbers: no site is read by one task.
    """
    spark = pages.sparkSession
    register(spark)
    # Few bytes but much work for each page: as many tasks as the session shuffles to, whatever the size.
    dealt = pages.select("site_id", "page", "url", "html").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "site_id", "page")
    return spark.sql(
        "SELECT p.site_id, coalesce(p.page, 1) AS page, s.spec, r.* FROM {pages} p JOIN {specs} s ON p.site_id = s.site_id, LATERAL board_rows(p.html, p.url, s.spec) r",
        pages=dealt, specs=F.broadcast(specs.select("site_id", "spec")),
    )


def _link(kind: Column, base: Column, call: Column) -> Column:
    """The address behind a row's link, by the kind that its spec names."""
    link = F.col("link")
    number = F.nullif(F.call_function("regexp_extract", F.coalesce(link, F.lit("")), F.concat(call, F.lit(r"\('(?:1',')?(\d+)'\)")), F.lit(1)), F.lit(""))
    return (
        F.when(kind == "prefix", prefixed(link, base)).when(kind == "absolute", keep_absolute(link, base)).when(kind == "slash", keep_absolute(link, base, True))
        .when(kind == "http", only_absolute(link)).when(kind == "cut", prefixed(F.substring_index(link, ";", 1), base)).when(kind == "dot", F.when(link != "", F.concat(base, strip_dot(link))))
        .when(kind == "call", F.replace(base, F.lit("{id}"), number)).when(kind == "resolve", resolved(link, base))
    )


def spec_postings(rows: DataFrame, page_rows: int) -> DataFrame:
    """Postings of `spec_rows`; places of a page's rows begin at the page's number times `page_rows`. Rows of errors have none."""
    said = F.from_json("spec", _SPEC)
    known = rows.where("error is null").withColumn("b", said)
    text = lambda f: F.coalesce(F.col(f"b.{f}"), F.lit(""))
    flag = lambda f: F.coalesce(F.col(f"b.{f}"), F.lit(False))
    own = text("organization")
    bracket = lambda p: F.regexp_extract(F.coalesce("title", F.lit("")), p, 1)
    organization = (
        F.when(text("bracket_org") == "start", or_default(bracket(r"^\[([^\]]+)\]"), own)).when(text("bracket_org") == "anywhere", or_default(bracket(r"\[([^\]]+)\]"), own)).otherwise(or_default("org", own))
    )
    made = known.select(
        "site_id", (F.col("page").cast("long") * page_rows + F.col("post_ord")).alias("post_ord"), F.when(flag("raw_title"), trim("title")).otherwise(truncate("title")).alias("title"),
        organization.alias("organization"), F.when(flag("raw_dates"), F.col("date")).otherwise(normalize_date("date")).alias("reg_date"),
        F.when(flag("raw_dates"), F.nullif("deadline", F.lit(""))).otherwise(optional_date("deadline")).alias("deadline_date"),
        _link(F.coalesce("b.url", F.lit("none")), text("base"), text("call")).alias("url"), F.nullif("status", F.lit("")).alias("status"), flag("distinct").alias("_once"),
    )
    # Equal titles meet only where one of them stays.
    nth = F.row_number().over(Window.partitionBy("site_id", "title", F.when(~F.col("_once"), F.col("post_ord"))).orderBy("post_ord"))
    return made.withColumn("_nth", nth).where("not _once or _nth = 1").drop("_nth", "_once")
