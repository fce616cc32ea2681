from datetime import datetime

from postmill.operators.extract import board_postings
from postmill.plans.gather import gather, page_postings, results
from postmill.sources.boards import BOARDS, site_table
from tests.test_extract import CASES

SCHEMA = "site_id string, page int, url string, html string, error string"


def test_one_pass_equals_board_by_board(spark):
    pages = spark.createDataFrame([(s, 1, "https://b/list", c[0], None) for s, c in CASES.items()] + [("unknown", 1, "u", "<table>", None), ("cha", 2, "u", None, None)], SCHEMA)
    got = {}
    for r in page_postings(pages).orderBy("site_id", "post_ord").collect():
        got.setdefault(r["site_id"], []).append((r["title"], r["organization"], r["reg_date"], r["deadline_date"], r["url"], r["status"]))
    assert got == {s: c[1] for s, c in CASES.items()}
    one = board_postings(pages.where("site_id = 'kaah'"), BOARDS["kaah"]).count()
    assert one == len(got["kaah"])


def test_a_run(spark):
    row = lambda title, date, href="/v": f"<tr><td>1</td><td><a href='{href}'>{title}</a></td><td>x</td><td>{date}</td><td>{date}</td></tr>"
    board = lambda *rows: "<table><tbody>" + "".join(rows) + "</tbody></table>"
    fresh = "2026-03-20"
    pages = [
        ("kaah", 1, "u", board(row("국립민속박물관 학예연구사 기간제근로자 채용", fresh), row("도박 안내", fresh), row("오래된 채용", "2026-01-01")), None),
        ("gmuseum", 1, "u", board(row("[국립민속박물관] 학예연구사(기간제근로자) 3명 모집", fresh)), None),
        ("hsmuseum", 1, "u", None, "timeout"),
        ("anseong", 1, "u", board(row("국립민속박물관 학예연구사 기간제근로자 채용.", fresh)), None),
        ("baekje", 1, "u", board(row("다른 공고", fresh)), None),
    ]
    pages = spark.createDataFrame(pages, SCHEMA)
    answers = spark.createDataFrame([(1, '[{"seq": 5, "title": "경기도 소속 새로운 자리", "bgnDt": "2026.03.21"}]')], "page int, body string")
    sites = site_table(spark)
    snapshot = gather(pages, sites, ["도박"], datetime(2026, 3, 31, 12), answers)
    assert sorted((r["site_id"], r["title"]) for r in snapshot.collect()) == [("baekje", "다른 공고"), ("gmuseum", "[국립민속박물관] 학예연구사(기간제근로자) 3명 모집"), ("job-gg", "경기도 소속 새로운 자리")]
    nested = {r["site"]["id"]: r for r in results(snapshot, pages, sites, "2026-03-31T12:00:00Z").collect()}
    assert len(nested) == 42 and nested["hsmuseum"]["error"] == "timeout" and len(nested["baekje"]["postings"]) == 1 and nested["kaah"]["postings"] == []


def test_pages_beyond_4096(spark):
    """The first of alike postings stays by the order of sites and pages, however far a page's number is."""
    page = lambda title: f"<table><tbody><tr><td>1</td><td><a href='/v'>{title}</a></td><td>x</td><td>2026-03-20</td><td>2026-03-20</td></tr></tbody></table>"
    first, second = (r["site_id"] for r in site_table(spark).where("site_id in ('kaah', 'anseong')").orderBy("site_ord").collect())
    pages = [(first, 2_000_000, "u", page("국립민속박물관 학예연구사 채용"), None), (first, 4096, "u", page("다른 자리 채용"), None), (second, 1, "u", page("국립민속박물관 학예연구사 모집"), None), (second, 9000, "u", page("새로운 공고"), None)]
    snapshot = gather(spark.createDataFrame(pages, SCHEMA), site_table(spark), [], datetime(2026, 3, 31, 12))
    want = [(first, "국립민속박물관 학예연구사 채용"), (first, "다른 자리 채용"), (second, "새로운 공고")]
    assert sorted((r["site_id"], r["title"]) for r in snapshot.collect()) == sorted(want)


def test_a_broken_page_is_an_error_of_its_site(spark, monkeypatch):
    from postmill.plans import gather as plan

    read = plan.rows_of

    def breaks(board, page, url=""):
        if "boom" in page:
            raise ValueError("boom")
        return read(board, page, url)

    monkeypatch.setattr(plan, "rows_of", breaks)
    pages = spark.createDataFrame([("kaah", 1, "u", CASES["kaah"][0], None), ("kaah", 2, "u", "boom", None), ("gmuseum", 1, "u", None, None)], SCHEMA)
    snapshot, found = plan.run(pages, site_table(spark), [], datetime(2026, 3, 31, 12))
    assert snapshot.count() == 0
    nested = {r["site"]["id"]: r["error"] for r in results(snapshot, found, site_table(spark), "t").collect()}
    assert nested["kaah"] == "ValueError: boom" and nested["gmuseum"] is None


def test_boards_without_texts_of_their_own(spark):
    from postmill.plans.gather import of_board

    rows = spark.createDataFrame([("a",), ("b",), (None,)], "site_id string")
    board = BOARDS["anseong"]
    assert [r[0] for r in rows.select(of_board({}, lambda b: b.base)).collect()] == [None] * 3
    assert [r[0] for r in rows.select(of_board({"a": board, "c": board}, lambda b: b.organization)).collect()] == [board.organization, None, None]


def test_only_boards_with_one_posting_a_title_are_shuffled(spark):
    from postmill.plans.gather import postings_of, read_pages, stored_postings

    pages = [(s, n, "https://b/list", c[0], None) for s, c in CASES.items() for n in (1, 2)] + [("unknown", 1, "u", "<table>", None)]
    read = read_pages(spark.createDataFrame(pages, SCHEMA)).localCheckpoint()
    rows = lambda found: sorted(map(str, found.collect()))
    got = stored_postings(read)
    assert rows(got) == rows(postings_of(read)) and got.where("site_id = 'gojobs'").count() == len(CASES["gojobs"][1])
    most = stored_postings(read, {s: b for s, b in BOARDS.items() if not b.distinct}).where("reg_date > '2026'")
    assert "Exchange" not in most._jdf.queryExecution().executedPlan().toString()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and plan.index("Window ") > plan.index("Generate")
