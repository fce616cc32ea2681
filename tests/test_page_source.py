import itertools
import os

import pytest
from pyspark.sql import functions as F

from postmill.operators.extract import rows_of
from postmill.plans.gather import postings_of
from postmill.sources.boards import BOARDS, PAGERS
from postmill.sources.captured import captured_pages, until_last_page
from postmill.sources.page_source import PageReader, SitePages, asked_pages, board_pages, file_system, register
from tests.test_extract import CASES, a, body, tr


def put(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def pager(n):
    return f"<table id='apmTbl'><tbody>{tr(n, a(f'직무 {n}'), '기관', '2026-03-01', '')}</tbody></table><a onclick=\"fn_egov_link_page({n + 1})\">next</a>"


def reader(path, **options):
    return PageReader({"path": path} | options)


def rows(r, site):
    folder = f"{file_system(r.path)[1]}/{site}"
    return list(r.rows(SitePages(site, folder)))


def test_pages_equal_the_two_steps(spark, tmp_path):
    files = {f"gojobs/{n}.html": pager(n) if n not in (4, 9) else pager(n).replace("next", "x").replace("fn_egov", "no") for n in range(1, 12)}
    files |= {f"{s}/1.html": CASES[s][0] for s in ("kaah", "seoul", "gcm", "yongsan")} | {"kaah/2.html": CASES["kaah"][0], "kaah/1.url": " https://k/1 \n", "hsmuseum/error.txt": "timeout\n", "unknown/1.html": "<p>"}
    path = put(tmp_path, files)
    got = board_pages(spark, path)
    old = until_last_page(captured_pages(spark, path), PAGERS)
    key = lambda r: tuple(str(x) for x in r)
    columns = ["site_id", "page", "url", "html", "error"]
    assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, old.select(columns).collect()))
    assert sorted(r["page"] for r in got.where("site_id = 'gojobs'").collect()) == [1, 2, 3, 4]
    for r in got.collect():
        assert (r["rows"] or []) == [] if r["html"] is None or r["site_id"] not in BOARDS else [x.asDict() for x in r["rows"]] == rows_of(BOARDS[r["site_id"]], r["html"], r["url"] or "")
    made = {(r["site_id"], r["title"]) for r in postings_of(got.where("error is null").select("site_id", "page", "rows")).collect()}
    assert {("gojobs", "직무 4"), ("gcm", "t"), ("kaah", "u")} <= made and ("gojobs", "직무 5") not in made


def test_filters_reach_the_source(spark, tmp_path, capfd):
    path = put(tmp_path, {f"{s}/{n}.html": CASES[s][0] for s in ("kaah", "seoul", "gcm") for n in range(1, 6)})
    some = asked_pages(spark, path, "site_id in ('kaah', 'gcm') and page between 2 and 3").select("site_id", "page")
    capfd.readouterr()
    some.explain("formatted")
    plan = capfd.readouterr().out
    assert "PushedFilters" in plan and "site_id" in plan.split("PushedFilters")[1].split("\n")[0] and "Filter (" not in plan
    assert some.rdd.getNumPartitions() == 2
    assert sorted(tuple(r) for r in some.collect()) == [("gcm", 2), ("gcm", 3), ("kaah", 2), ("kaah", 3)]
    # What isn't asked for isn't opened.
    for n in (1, 4, 5):
        os.chmod(f"{path}/kaah/{n}.html", 0)
        os.rename(f"{path}/kaah/{n}.html", f"{path}/kaah/{n}.html.gone")
        os.mkdir(f"{path}/kaah/{n}.html")
    assert asked_pages(spark, path, "site_id = 'kaah' and page = 3").count() == 1
    assert asked_pages(spark, path, "site_id = 'kaah' and page > 7").count() == 0
    gone = asked_pages(spark, path, "site_id = 'nowhere'").select("site_id", "error").collect()
    assert [tuple(r) for r in gone] == [("nowhere", "no captured pages")]


def test_spark_keeps_what_the_source_does_not_take(spark, tmp_path):
    path = put(tmp_path, {"kaah/1.html": CASES["kaah"][0], "kaah/1.url": "https://x", "kaah/2.html": CASES["kaah"][0]})
    assert asked_pages(spark, path, "url like '%x' and page < 3 and site_id = 'kaah' and page >= 1").count() == 1
    assert asked_pages(spark, path, "site_id = 'kaah' or page = 1").count() == 2
    assert asked_pages(spark, path, "level1 is not null").count() == 0
    apart = asked_pages(spark, path, "site_id = 'kaah' and page = 1").unionByName(asked_pages(spark, path, "page = 2")).unionByName(asked_pages(spark, path, "site_id = 'gone'"))
    assert sorted((r["site_id"], str(r["page"])) for r in apart.collect()) == [("gone", "None"), ("kaah", "1"), ("kaah", "2")]
    plain = board_pages(spark, path)
    assert plain.where("page = 1").unionByName(plain.where("page = 2")).unionByName(plain).count() == 4
    assert asked_pages(spark, path, "page is not null and site_id is not null").count() == 2


def test_levels_as_far_as_they_were_captured(spark, tmp_path):
    page = lambda t: f'<table class="boardtable_list"><tbody><tr><td>1</td><td class="ta_l"><a class="Boardtit">{t}</a></td><td>o</td><td></td><td></td><td>모집중</td><td>2026-03-01</td></tr></tbody></table>'
    path = put(tmp_path, {"ncs/1.html": page("all"), "ncs/08/1.html": page("first"), "ncs/08/01/04/01/1.html": page("fourth"), "kaah/1.html": CASES["kaah"][0]})

    def asked(**levels):
        where = " and ".join(["site_id = 'ncs'", *(f"{k} = '{v}'" for k, v in levels.items())])
        return [(r["applied"], r["rows"][0]["title"], r["level1"], r["level4"]) for r in asked_pages(spark, path, where).collect()]

    assert asked() == [("", "all", None, None)]
    assert asked(level1="08", level2="01", level3="04", level4="01") == [("08/01/04/01", "fourth", "08", "01")]
    assert asked(level1="08", level2="01") == [("08", "first", "08", None)]  # of the second level only deeper lists were captured
    assert asked(level1="08", level2="77") == [("08", "first", "08", None)]
    assert asked(level1="99", level2="01") == [("", "all", "99", None)]
    assert asked(level2="01") == [("", "all", None, None)]  # not without the first
    assert {(r["site_id"], r["applied"]) for r in board_pages(spark, path, levels="08/01/04/01").collect()} == {("ncs", "08/01/04/01"), ("kaah", "")}


def test_variants_of_a_page(tmp_path):
    files = {"museum-or-kr/1.html": "page", "museum-or-kr/1.frame-2.html": "board", "museum-or-kr/1.frame-2.url": "https://x/?kboard=1", "museum-or-kr/1.frame-1.html": "advert", "museum-or-kr/1.frame-1.url": "https://a"}
    files |= {"museum-or-kr/2.html": "only page", "museum-or-kr/2.frame-1.html": "advert", "nyj/1.html": "scripts", "nyj/1.noscript.html": "bare", "nyj/2.html": "scripts", "kaah/1.html": "page", "kaah/1.noscript.html": "bare", "kaah/1.frame-1.html": "frame"}
    r = reader(put(tmp_path, files))
    read = {s: [(x["page"], x["html"], x["variant"]) for x in rows(r, s)] for s in ("museum-or-kr", "nyj", "kaah")}
    assert read == {"museum-or-kr": [(1, "board", "frame-2"), (2, "only page", "")], "nyj": [(1, "bare", "noscript"), (2, "scripts", "")], "kaah": [(1, "page", "")]}
    assert [x["url"] for x in rows(r, "museum-or-kr")] == ["https://x/?kboard=1", None]


def test_attempts(tmp_path):
    files = {"kaah/1.html": "x", "kaah/1.try-1.error": "reset", "kaah/2.try-1.error": "reset", "kaah/2.try-2.error": "reset", "kaah/2.try-3.error": " refused ", "kaah/3.html": "never read", "seoul/1.html": "x", "seoul/1.try-1.error": "a", "seoul/1.try-2.error": "b"}
    r = reader(put(tmp_path, files))
    assert [(x["page"], x["attempts"], x.get("error")) for x in rows(r, "kaah")] == [(1, 2, None), (2, 3, "refused")]
    r.asked.first = 2  # a failed page is an answer to a question about it
    assert [(x["page"], x.get("error")) for x in rows(r, "kaah")] == [(2, "refused")]
    r.asked.first = None
    assert [(x["page"], x["attempts"], x.get("error")) for x in rows(r, "seoul")] == [(1, 3, None)]


def test_time_is_up_within_a_page(tmp_path):
    long = "<table><tbody>" + "".join(tr(1, a(f"t{i}"), 3, 4, "2026-03-01") for i in range(5000)) + "</tbody></table>"
    path = put(tmp_path, {"kaah/1.html": CASES["kaah"][0], "kaah/2.html": long, "kaah/3.html": CASES["kaah"][0]})
    ticks = itertools.count()
    r = PageReader({"path": path, "siteSecs": "90"}, clock=lambda: next(ticks))  # a second passes at each look
    got = rows(r, "kaah")
    assert [(x.get("page"), x.get("error")) for x in got] == [(1, None), (None, "the site took more than 90 seconds")]
    assert next(ticks) < 100  # not long after
    slow = PageReader({"path": path}, clock=lambda: 0.0)
    assert [x["page"] for x in rows(slow, "kaah")] == [1, 2, 3] and len(rows(slow, "kaah")[1]["rows"]) == 5000


def test_time_is_up_in_a_job(spark, tmp_path):
    path = put(tmp_path, {f"{s}/1.html": CASES[s][0] for s in ("kaah", "seoul")})
    got = board_pages(spark, path, siteSecs="-1").select("site_id", "page", "error").collect()
    assert sorted(tuple(r) for r in got) == [(s, None, "the site took more than -1 seconds") for s in ("kaah", "seoul")]


def test_what_breaks_is_a_row(tmp_path):
    class Broken(dict):
        def get(self, site, default=None):
            raise RuntimeError("boom")

    path = put(tmp_path, {"kaah/1.html": "x"})
    r = PageReader({"path": path}, boards=Broken())
    assert [(x.get("page"), x.get("error")) for x in rows(r, "kaah")] == [(None, "RuntimeError: boom")]


def test_written_pages_read_back(spark, tmp_path):
    register(spark)
    given = spark.createDataFrame([("kaah", 1, CASES["kaah"][0], "https://k", None, None, None), ("ncs", 1, "all", None, None, None, None), ("ncs", 1, "some", None, None, "08", None), ("nyj", 2, "bare", None, None, None, "noscript"), ("khs", None, None, None, "timeout", None, None)], "site_id string, page int, html string, url string, error string, applied string, variant string")
    given.repartition(3).write.format("board_pages").mode("append").save(str(tmp_path / "made"))
    got = board_pages(spark, f"file:{tmp_path}/made", levels="08")
    assert sorted((r["site_id"], str(r["page"]), str(r["html"])[:4], str(r["error"]), r["applied"]) for r in got.collect()) == [("kaah", "1", CASES["kaah"][0][:4], "None", ""), ("khs", "None", "None", "timeout", ""), ("ncs", "1", "some", "None", "08"), ("nyj", "2", "bare", "None", "")]
    assert board_pages(spark, str(tmp_path / "made"), html="false").where(F.col("html").isNotNull()).count() == 0


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)nothere"):
        board_pages(spark, str(tmp_path / "nothere")).count()
    assert board_pages(spark, str(tmp_path)).count() == 0
    (tmp_path / "kaah").mkdir()
    assert board_pages(spark, str(tmp_path)).count() == 0


def test_a_site_is_cut_neither_by_its_size_nor_by_its_runs(spark, tmp_path, monkeypatch):
    """Reading takes a second a look: a site of many pages is read whole, in runs; one that fails ends there in all of them."""
    from postmill.sources import page_source

    monkeypatch.setattr(page_source, "RUN", 4)
    files = {f"{s}/{n}.html": CASES["kaah"][0] for s in ("kaah", "khs", "gojobs") for n in range(1, 31)}
    path = put(tmp_path, files | {f"khs/22.try-{k}.error": f"reset {k}" for k in (1, 2, 3)})
    ticks = itertools.count()
    r = PageReader({"path": path}, clock=lambda: next(ticks))
    parts = r.partitions()
    assert {s: sum(p.site == s for p in parts) for s in ("kaah", "khs", "gojobs")} == {"kaah": 8, "khs": 6, "gojobs": 1}
    got = [x for p in parts for x in r.rows(p)]
    assert [x["page"] for x in got if x["site_id"] == "kaah"] == list(range(1, 31))
    assert [(x["page"], x.get("error")) for x in got if x["site_id"] == "khs"] == [(n, None) for n in range(1, 22)] + [(22, "reset 3")]
    assert board_pages(spark, path).where("site_id = 'kaah' and error is null").count() == 30
    assert asked_pages(spark, path, "site_id = 'khs' and page > 25").count() == 5
