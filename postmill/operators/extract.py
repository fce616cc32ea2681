"""From captured pages to postings: what each board's rows look like, and columns made of them.

A board is described by a `Board`: which elements are rows, and where a row has its title, dates,
organization and link. Pages are read in Arrow batches, one posting struct for each row; everything after
that (cutting titles, dates, links) is columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import bracketed_organization, called_id, normalize_date, optional_date, or_default, trim, truncate
from postmill.operators import html as H
from postmill.operators.html import WHITE

# Fixed value: what marks a cell as a date.
DATE_CELL = r"\d{4}[.-]\d{1,2}[.-]\d{1,2}"
WHOLE_DATE = r"\d{4}-\d{2}-\d{2}"


@dataclass(frozen=True)
class Pick:
    """Where a row has a value.

    `cell` is the number of a cell, -1 for the last one (the row itself if none); `css` the first match in it, or
    the `nth`; `attr` an attribute in place of text; `own` the element's direct text, else all of it; `head` its
    first child's text; `without` elements whose text doesn't count; `found` the `match`th piece that
    a pattern finds. `date_cell` takes the first cell that holds a date.
    """

    cell: int | None = None
    css: str = ""
    nth: int = 0
    attr: str = ""
    own: bool = False
    head: bool = False
    without: str = ""
    found: str = ""
    match: int = 0
    date_cell: bool = False

    def node(self, row: H.Node, cells: list[H.Node]) -> H.Node | None:
        at: H.Node | None = row
        if self.date_cell:
            at = next((c for c in cells if re.search(DATE_CELL, c.text(), re.ASCII)), None)
        elif self.cell is not None:
            at = cells[self.cell] if -len(cells) <= self.cell < len(cells) else None
        if at is not None and self.css:
            every = H.select(at, self.css)
            at = every[self.nth] if -len(every) <= self.nth < len(every) else None
        return at

    def value(self, row: H.Node, cells: list[H.Node]) -> str:
        at = self.node(row, cells)
        if at is None:
            return ""
        if self.attr:
            text = at.attrs.get(self.attr, "")
        elif self.head:
            # A first child of blanks counts: it isn't empty before it is trimmed.
            child = at.children[0] if at.children else ""
            text = (child if isinstance(child, str) else child.text()) or at.text()
        else:
            text = (self.own and at.own_text()) or at.text(self.without)
        if self.found:
            pieces = re.findall(self.found, text, re.ASCII)
            text = pieces[self.match] if self.match < len(pieces) else ""
        return text.strip(WHITE)


@dataclass(frozen=True)
class Board:
    """How a board's page holds postings.

    `rows` and, if nothing matches it, `other` (a whole other board) say what a row is; `least` cells, elements
    that must be there (`needs`), elements with a given text or a pattern in it (`only`), first-cell texts to skip,
    and whether a title is needed decide which rows count. Several picks stand for the first that isn't empty.
    """

    rows: str
    title: tuple[Pick, ...]
    date: tuple[Pick, ...]
    organization: str
    cells: str = "td"
    least: int = 0
    needs: tuple[Pick, ...] = ()
    only: tuple[tuple[Pick, str, bool], ...] = ()
    skip: tuple[str, ...] = ()
    drop_first: bool = False
    titled: bool = False
    job_words: bool = False
    org: tuple[Pick, ...] = ()
    deadline: tuple[Pick, ...] = ()
    status: tuple[Pick, ...] = ()
    link: tuple[Pick, ...] = ()
    label: str = ""  # rows of a labelled list: the date stands beside this label
    children: tuple[str, ...] = ()  # rows whose direct children are a kind (this first one wanted) and a date
    url: str = "none"  # none, prefix, absolute, http, cut, dot, resolve or call
    base: str = ""
    call: str = ""
    raw_dates: bool = False
    raw_title: bool = False
    title_mark: str = ""  # a mark at the title's end that doesn't belong to it
    bracket_org: str = ""  # start or anywhere
    distinct: bool = False  # one posting for each title
    error_path: str = ""
    closed_refs: bool = False  # only references that end in a semicolon are read; browsers read some that break off
    other: Board | None = field(default=None)


def _first(picks: tuple[Pick, ...], row: H.Node, cells: list[H.Node]) -> str:
    return next((v for p in picks if (v := p.value(row, cells))), "")


#: An ampersand that begins no closed reference.
_OPEN_REF = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


def tree_of(board: Board, page: str, tick: Callable[[], None] = lambda: None) -> H.Node:
    """A page's tree, its references read as its board says."""
    return H.parse(_OPEN_REF.sub("&amp;", page) if board.closed_refs else page, tick)


def rows_of(board: Board, page: str, url: str = "") -> list[dict]:
    """The raw values of a page's rows."""
    if board.error_path and board.error_path in url:
        return []
    return list(tree_rows(board, tree_of(board, page)))


def tree_rows(board: Board, tree: H.Node, tick: Callable[[], None] = lambda: None) -> Iterator[dict]:
    """The same of a parsed page, row by row; `tick` is called before each."""
    rows = H.select(tree, board.rows)
    if not rows and board.other:
        yield from tree_rows(board.other, tree, tick)
        return
    for row in rows[1:] if board.drop_first else rows:
        tick()
        cells = H.select(row, board.cells)
        if len(cells) < board.least or any(p.node(row, cells) is None for p in board.needs):
            continue
        if board.skip and cells and cells[0].text().strip(WHITE) in board.skip:
            continue
        if not all(re.search(want, v, re.ASCII) if part else v == want for p, want, part in board.only for v in [p.value(row, cells)]):
            continue
        title = _first(board.title, row, cells)
        if board.title_mark:
            # The mark goes before blanks at the ends do: behind blanks it isn't at the end.
            at = next((n for p in board.title if (n := p.node(row, cells))), None)
            title = re.sub(rf"{board.title_mark}\Z", "", at.text()).strip(WHITE) if at else ""
        if board.titled and not title:
            continue
        if board.job_words and not any(w in title for w in ("채용", "모집", "공고")):
            continue
        date = _first(board.date, row, cells)
        if board.label:
            for item in H.select(row, "ul.list-info li"):
                if board.label in (getattr(H.first(item, "strong"), "text", str)() or ""):
                    span = H.first(item, "span")
                    date = span.text().strip(WHITE) if span else ""
        if board.children:
            parts = [c.text().strip(WHITE) for c in row.children if isinstance(c, H.Node) and c.name != "a"]
            kinds = [x for x in parts if x in board.children]
            date = next((x for x in reversed(parts) if re.fullmatch(WHOLE_DATE, x, re.ASCII)), "")
            if not kinds or kinds[-1] != board.children[0]:
                continue
        yield {
            "title": title, "date": date, "org": _first(board.org, row, cells), "deadline": _first(board.deadline, row, cells),
            "status": _first(board.status, row, cells), "link": _first(board.link, row, cells),
        }


# Columns of links

def prefixed(link: Column | str, base: Column | str) -> Column:
    """The link behind a fixed beginning; null for none."""
    c = F.col(link) if isinstance(link, str) else link
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(base), c))


def keep_absolute(link: Column | str, base: Column | str, slash: bool = False) -> Column:
    """Links that begin with `http` as they are, others behind `base` (and a slash that they may lack)."""
    c = F.col(link) if isinstance(link, str) else link
    gap = F.when(F.startswith(c, F.lit("/")), "").otherwise("/") if slash else F.lit("")
    return F.when(F.startswith(c, F.lit("http")), c).otherwise(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(base), gap, c)))


def only_absolute(link: Column | str) -> Column:
    c = F.col(link) if isinstance(link, str) else link
    return F.when(F.startswith(c, F.lit("http")), c)


def cut_at(link: Column | str, mark: str) -> Column:
    return F.substring_index(link, mark, 1)


def strip_dot(link: Column | str) -> Column:
    return F.regexp_replace(link, r"^\./", "")


def resolved(link: Column | str, base: Column | str) -> Column:
    """The link as a browser resolves it on a page at `base`."""

    @F.arrow_udf("string")
    def join(links: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([urljoin(b, x) if x else None for x, b in zip(links.to_pylist(), bases.to_pylist(), strict=True)], pa.string())

    return join(link, F.lit(base))


def link_url(board: Board, link: str = "link", base: Column | None = None) -> Column:
    """The address behind a board's link; `base` is a column that holds the board's own, if rows of many boards lie together."""
    base = F.lit(board.base) if base is None else base
    if board.url == "none":
        return F.lit(None).cast("string")
    if board.url == "call":
        return F.replace(base, F.lit("{id}"), called_id(link, board.call))
    kinds = {
        "prefix": lambda: prefixed(link, base), "absolute": lambda: keep_absolute(link, base), "slash": lambda: keep_absolute(link, base, True),
        "http": lambda: only_absolute(link), "cut": lambda: prefixed(cut_at(link, ";"), base),
        "dot": lambda: F.when(F.col(link) != "", F.concat(base, strip_dot(link))), "resolve": lambda: resolved(link, base),
    }
    return kinds[board.url]()


_ROW = "array<struct<title:string,date:string,org:string,deadline:string,status:string,link:string>>"


def page_rows(pages: DataFrame, board: Board) -> DataFrame:
    """`pages` (`url`, `html` and more) with `post_ord` and the raw values of each row; pages without rows go."""

    @F.arrow_udf(_ROW)
    def read(urls: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for url, page in urls:
            made = [rows_of(board, p or "", u or "") for u, p in zip(url.to_pylist(), page.to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([(k, pa.string()) for k in ("title", "date", "org", "deadline", "status", "link")]))
            yield pa.array(made, kind)

    kept = [c for c in pages.columns if c != "html"]
    found = pages.select(*kept, read("url", "html").alias("_rows"))
    return found.select(*kept, F.posexplode("_rows").alias("post_ord", "_row")).select(*kept, "post_ord", "_row.*")


def board_postings(pages: DataFrame, board: Board) -> DataFrame:
    """Postings of captured pages of one board: the pages' columns but their text, and posting columns."""
    rows = page_rows(pages, board)
    kept = [c for c in pages.columns if c != "html"]
    date = F.col("date") if board.raw_dates else normalize_date("date")
    deadline = F.nullif("deadline", F.lit("")) if board.raw_dates else optional_date("deadline")
    org = or_default("org", F.lit(board.organization))
    if board.bracket_org:
        org = bracketed_organization("title", board.organization, board.bracket_org == "anywhere")
    out = rows.select(
        *kept, "post_ord", (trim("title") if board.raw_title else truncate("title")).alias("title"), org.alias("organization"), date.alias("reg_date"),
        deadline.alias("deadline_date"), link_url(board).alias("_url"), F.nullif("status", F.lit("")).alias("status"),
    )
    if board.distinct:
        own = Window.partitionBy(*kept, "title").orderBy("post_ord")
        out = out.withColumn("_nth", F.row_number().over(own)).where("_nth = 1").drop("_nth")
    return out.withColumnRenamed("_url", "posting_url" if "url" in kept else "url")


JSON_ITEMS = "array<struct<seq:long,title:string,instNm:string,bgnDt:string,endDt:string,dtlUrl:string>>"


def json_postings(answers: DataFrame, organization: str, base: str) -> DataFrame:
    """Postings of captured JSON answers (`page`, `body`): a list under `list` or `resultList`, or bare.

    Pages in order up to the first one that is empty or has fewer than 16 items; one posting for each title.
    Items without title don't count; a missing link is made of the item's number.
    """
    parsed = F.from_json("body", f"struct<list:{JSON_ITEMS},resultList:{JSON_ITEMS}>")
    items = answers.select("page", F.coalesce(parsed["list"], parsed["resultList"], F.from_json("body", JSON_ITEMS)).alias("items"))
    size = F.coalesce(F.size("items"), F.lit(0))
    last = items.where((size < 16) & (F.col("page") <= 5)).agg(F.coalesce(F.min("page"), F.lit(5)).alias("last")).first()["last"]
    read = items.where(F.col("page") <= min(5, last))
    rows = read.select("page", F.posexplode("items").alias("n", "i")).where("coalesce(i.title, '') <> ''")
    made = rows.select(
        (F.col("page") * 16 + F.col("n")).alias("post_ord"), truncate("i.title").alias("title"), or_default("i.instNm", F.lit(organization)).alias("organization"),
        F.when(F.coalesce("i.bgnDt", F.lit("")) != "", normalize_date("i.bgnDt")).otherwise("").alias("reg_date"), optional_date("i.endDt").alias("deadline_date"),
        or_default("i.dtlUrl", F.concat(F.lit(base), F.col("i.seq").cast("string"))).alias("url"),
    )
    own = Window.partitionBy("title").orderBy("post_ord")
    return made.withColumn("_nth", F.row_number().over(own)).where("_nth = 1").drop("_nth")
