import pytest
from pyspark.sql import functions as F

from postmill.operators.board_rows import board_of, board_spec, register, spec_postings, spec_rows, spec_table
from postmill.plans.gather import PAGE_ROWS, page_postings
from postmill.sources.boards import BOARDS
from tests.test_extract import CASES, a, body, tr

SCHEMA = "site_id string, page int, url string, html string"


@pytest.mark.parametrize("site", sorted(BOARDS))
def test_a_spec_says_all_of_a_board(site):
    assert board_of(board_spec(BOARDS[site])) == BOARDS[site]


def test_postings_equal_those_of_declared_boards(spark):
    pages = spark.createDataFrame([(s, 1, "https://b/list", c[0]) for s, c in CASES.items()] + [("unknown", 1, "u", "<table>"), ("cha", 2, "u", None), ("gojobs", 2, None, CASES["gojobs"][0]), ("yongsan", 3, "https://b/error/1", CASES["yongsan"][0])], SCHEMA)
    key = lambda r: tuple(map(str, r))
    want = page_postings(pages)
    got = spec_postings(spec_rows(pages, spec_table(spark, BOARDS)), PAGE_ROWS)
    assert got.columns == want.columns
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_a_board_is_added_by_a_row(spark):
    specs = spark.createDataFrame(
        [
            ("news", '{"rows": "ul.news > li", "cells": "span", "least": 2, "title": [{"css": "a"}], "date": [{"cell": 1}], "organization": "새 박물관", "link": [{"css": "a", "attr": "href"}], "url": "prefix", "base": "https://new"}'),
            ("calls", '{"rows": "table tr", "title": [{"cell": 0, "css": "a"}], "date": [{"cell": 1, "found": "\\\\d{4}-\\\\d{2}-\\\\d{2}"}], "organization": "", "org": [{"cell": 2}], "needs": [{"cell": 0, "css": "a"}], "link": [{"cell": 0, "css": "a", "attr": "href"}], "url": "call", "call": "open", "base": "https://c/{id}", "distinct": true}'),
            ("broken", '{"rows": 5}'),
        ],
        "site_id string, spec string",
    )
    pages = spark.createDataFrame(
        [
            ("news", 1, None, '<ul class="news"><li><span><a href="/1">학예사 모집</a></span><span>2026.3.2</span></li><li><span>x</span></li></ul>'),
            ("calls", 1, None, "<table>" + tr(a("t", "javascript:open('7')"), "on 2026-03-03", "o") + tr(a("t", "javascript:open('8')"), "2026-03-03", "o") + tr("no", "", "") + "</table>"),
            ("broken", 1, None, body()), ("unlisted", 1, None, body()), ("news", 2, None, None),
        ],
        SCHEMA,
    )
    rows = spec_rows(pages, specs)
    assert [(r["site_id"], r["error"].split(":")[0]) for r in rows.where("error is not null").collect()] == [("broken", "TypeError")]
    got = spec_postings(rows, PAGE_ROWS).drop("post_ord").collect()
    assert sorted(map(tuple, got)) == [("calls", "t", "o", "2026-03-03", None, "https://c/7", None), ("news", "학예사 모집", "새 박물관", "2026-03-02", None, "https://new/1", None)]


def test_fields_decide_the_columns(spark):
    register(spark)
    spec = board_spec(BOARDS["kaah"])
    page = CASES["kaah"][0]
    got = spark.sql("SELECT * FROM board_rows(:page, null, :spec, 'title, link')", args={"page": page, "spec": spec})
    assert got.columns == ["post_ord", "title", "link", "error"] and [tuple(r) for r in got.collect()] == [(0, "t", "https://o/1", None), (1, "u", "/2", None)]
    for bad in ("SELECT * FROM board_rows(:page, null, :spec, 'colour')", "SELECT * FROM board_rows(1, null, :spec)"):
        with pytest.raises(Exception, match="board_rows"):
            spark.sql(bad, args={"page": page, "spec": spec}).collect()


def test_pages_of_a_site_are_read_by_many_tasks(spark):
    """Pages of one site don't meet where specs are joined, but for boards that want equal titles once they do after reading."""
    pages = spark.range(40).selectExpr("'kaah' AS site_id", "CAST(id AS INT) AS page", "'u' AS url", f"'{CASES['kaah'][0]}' AS html")
    rows = spec_rows(pages, spec_table(spark, {"kaah": BOARDS["kaah"]}))
    tasks = rows.withColumn("task", F.spark_partition_id())
    assert tasks.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks.groupBy("page").agg(F.countDistinct("task").alias("n")).where("n > 1").isEmpty()
    assert rows.count() == 40 * spec_rows(pages.limit(1), spec_table(spark, {"kaah": BOARDS["kaah"]})).count()
