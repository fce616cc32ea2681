import json
from datetime import datetime
from pathlib import Path

import pytest

from postmill.operators.board_rows import spec_table
from postmill.plans.whole_run import summary, whole_run
from postmill.sources.boards import BOARDS, site_table
from postmill.sources.snapshots import change_hidden, read_hidden
from postmill.sources.versions import Versions
from tests.test_extract import a, body, tr
from tests.test_page_source import put

NOW = datetime(2026, 3, 31, 12)


def kaah(*titles, date="2026-03-20"):
    return body(*(tr(1, a(t), 3, 4, date) for t in titles))


def array(path):
    (part,) = Path(path).glob("part-*")
    return json.loads(part.read_text())


def test_runs_follow_each_other(spark, tmp_path):
    first = put(tmp_path / "one", {"kaah/1.html": kaah("국립민속박물관 학예연구사 채용", "도박 안내", "다른 공고"), "gmuseum/1.html": body(tr(1, a("경기 채용"), "기관", "2026-03-21")), "khs/error.txt": "timeout"})
    out = str(tmp_path / "out")
    answers = spark.createDataFrame([(1, '[{"seq": 5, "title": "새로운 자리", "bgnDt": "2026.03.21"}]')], "page int, body string")
    one = whole_run(spark, first, out, ["도박"], NOW, answers=answers)
    results = {r["site"]["id"]: r for r in array(f"{one.path}/results.json")}
    assert len(results) == 42 and [p["title"] for p in results["kaah"]["postings"]] == ["국립민속박물관 학예연구사 채용", "다른 공고"]
    assert results["khs"]["error"] == "timeout" and results["nfm"]["error"] == "no captured pages" and "error" not in results["gmuseum"] and "error" not in results["job-gg"]
    assert [r["site"]["id"] for r in array(f"{one.path}/results.json")] == [r["site_id"] for r in site_table(spark).orderBy("site_ord").collect()]
    assert sorted(p["title"] for p in array(f"{one.path}/new-postings.json")) == ["경기 채용", "국립민속박물관 학예연구사 채용", "다른 공고", "새로운 자리"]
    verdicts = {v["siteId"]: v for v in array(f"{one.path}/verify-results.json")}
    assert (verdicts["kaah"]["status"], verdicts["kaah"]["matchedTitles"], verdicts["kaah"]["actualCount"]) == ("pass", 2, 2) and verdicts["khs"]["status"] == "skip"

    second = put(tmp_path / "two", {"kaah/1.html": kaah("다른 공고", "또 하나 공고"), "gmuseum/1.html": body(tr(1, a("경기 채용"), "기관", "2026-03-21"))})
    two = whole_run(spark, second, out, ["도박"], NOW)
    assert (one.version, two.version) == (1, 2)
    assert [(p["siteId"], p["siteName"], p["title"]) for p in array(f"{two.path}/new-postings.json")] == [("kaah", "한국문화유산협회", "또 하나 공고")]
    assert summary(spark, two) == {"ok_sites": 2, "failed_sites": 40, "postings": 3, "new": 1, "pass": 2, "warn": 0, "fail": 0, "skip": 40}
    assert one.results(spark).count() == 42  # what was committed before stays


def test_a_run_that_breaks_leaves_the_one_before(spark, tmp_path, monkeypatch):
    from postmill.plans import whole_run as plan

    path, out = put(tmp_path / "in", {"kaah/1.html": kaah("하나 공고")}), str(tmp_path / "out")
    whole_run(spark, path, out, [], NOW, site="kaah")
    put(tmp_path / "in", {"kaah/1.html": kaah("둘째 공고")})
    monkeypatch.setattr(plan, "write_verdicts", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        whole_run(spark, path, out, [], NOW, site="kaah")
    assert Versions(spark, out).latest() == 1
    monkeypatch.undo()
    again = whole_run(spark, path, out, [], NOW, site="kaah")
    assert again.version == 2 and [p["title"] for p in array(f"{again.path}/new-postings.json")] == ["둘째 공고"]
    assert Versions(spark, out).latest(before=2) == 1


def test_one_board_and_boards_by_rows(spark, tmp_path):
    path = put(tmp_path / "in", {"kaah/1.html": kaah("하나 공고"), "gmuseum/1.html": body(tr(1, a("경기 채용"), "기관", "2026-03-21"))})
    with pytest.raises(ValueError, match="museum-go-kr"):
        whole_run(spark, path, str(tmp_path / "none"), [], NOW, site="nowhere")
    specs = spec_table(spark, {s: BOARDS[s] for s in ("kaah", "gmuseum")})
    sites = site_table(spark).where("site_id in ('kaah', 'gmuseum')")
    by_rows = whole_run(spark, path, str(tmp_path / "rows"), [], NOW, specs=specs, sites=sites)
    declared = whole_run(spark, path, str(tmp_path / "declared"), [], NOW, sites=sites)
    for name in ("results", "new-postings", "verify-results"):
        assert array(f"{by_rows.path}/{name}.json") == array(f"{declared.path}/{name}.json") != []


def test_the_command(spark, tmp_path, capsys):
    from postmill.__main__ import main

    path = put(tmp_path / "in", {"kaah/1.html": kaah("하나 공고", "도박 공고")})
    (tmp_path / "words.txt").write_text("도박\n", encoding="utf-8")
    assert main([path, str(tmp_path / "out"), "--keywords", str(tmp_path / "words.txt"), "--site", "kaah", "--as-of", "2026-03-31T12:00:00"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"ok_sites": 1, "failed_sites": 0, "postings": 1, "new": 1, "pass": 1, "warn": 0, "fail": 0, "skip": 0, "version": 1}
    assert main([path, str(tmp_path / "out"), "--site", "nowhere"]) == 1 and "kaah" in capsys.readouterr().out


def test_a_hidden_set_that_is_not_committed_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "hidden")
    change = lambda title: spark.createDataFrame([("A", title, True, 1)], "site_id string, title string, hide boolean, seq int")
    assert read_hidden(spark, path).count() == 0
    change_hidden(spark, path, change("x"))
    commits = Versions.commits
    with monkeypatch.context() as m:
        m.setattr(Versions, "folder", lambda self, n, name: 1 / 0 if n > 1 else f"{path}/v={n}/{name}")
        from postmill.sources import versions

        m.setattr(versions.F, "current_timestamp", lambda: 1 / 0)  # after the write, before the commit
        with pytest.raises(ZeroDivisionError):
            change_hidden(spark, path, change("y"))
    assert (tmp_path / "hidden" / "v=2").exists() and commits(Versions(spark, path)).count() == 1
    assert [r["title"] for r in read_hidden(spark, path).collect()] == ["x"]
    assert sorted(r["title"] for r in change_hidden(spark, path, change("z")).collect()) == ["x", "z"]
    assert sorted(r["title"] for r in read_hidden(spark, path).collect()) == ["x", "z"]
