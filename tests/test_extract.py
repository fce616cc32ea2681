import json
from pathlib import Path

import pytest

from postmill.operators.audit import audit
from postmill.operators.extract import board_postings, json_postings, rows_of
from postmill.operators.html import first, parse, select
from postmill.operators.snapshots import without_hidden
from postmill.sources.boards import BOARDS, JSON_SITE, PAGERS, SITES, find_site, site_table
from postmill.sources.captured import SCHEMA, captured_pages, until_last_page
from postmill.sources.snapshots import MissingSnapshot, change_hidden, flat_postings, posting_json, read_hidden, read_keywords, read_new_postings, read_results, snapshot_before, snapshot_on, write_new_postings, write_results, write_snapshot, write_verdicts
from postmill.streaming.diffs import stream_new_postings


def tr(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def body(*rows):
    return "<table><tbody>" + "".join(rows) + "</tbody></table>"


def a(text, href="/v?id=1"):
    return f'<a href="{href}">{text}</a>'


def test_selectors():
    t = parse('<div id="m" class="x y"><ul><li class="header">h<li><b>one</b> &amp; two<ul><li>in</ul></li></ul><p>p<p>q<br>r</div><a href="/site/1">z</a>')
    texts = lambda s: [n.text() for n in select(t, s)]
    assert texts("ul > li") == ["h", "one & twoin", "in"] and texts("li:not(.header)") == ["one & twoin", "in"]
    assert texts("#m.x p") == ["p", "qr"] and texts("div b, a") == ["one", "z"] and texts('a[href*="site"]') == ["z"] and texts("li li") == ["in"]
    assert first(t, "table") is None and texts(".y > ul > li > b") == ["one"]
    assert len(select(parse("<table><tr><td>a<td>b<tr><td>c</table>"), "table tbody tr td")) == 3


CASES = {
    "anseong": (body(tr(1, a("학예사 채용"), "", "", "2026.03.01"), tr(2, a("행사 안내"), "", "", "2026.03.01"), tr(1, 2)), [("학예사 채용", "안성맞춤박물관", "2026-03-01", None, None, None)]),
    "artic": (f'<table class="boardCategory"><tbody>{tr(1, a("t"), "x", " 2026.3.1 ")}{tr(1, "no link", "")}</tbody></table>', [("t", "이천시립박물관", "2026-03-01", None, "https://www.artic.or.kr/v?id=1", None), ("", "이천시립박물관", "", None, None, None)]),
    "baekje": (body(tr(1, "none", 2, 3), tr(1, a("t", "i.jsp"), 2, "26.03.01")), [("t", "한성백제박물관", "2026-03-01", None, "https://baekjemuseum.seoul.go.kr/module/i.jsp", None)]),
    "bcmuseum": ('<ul class="board-list-area"><li><a class="list-tit" href="?id=3">t</a><ul class="list-info"><li><strong>작성자</strong><span>x</span></li><li><strong>작성일</strong><span>2026-03-01</span></li></ul></li></ul>', [("t", "부천시박물관", "2026-03-01", None, "https://www.bcmuseum.or.kr/ko/boards/notice/?id=3", None)]),
    "cha": (f'<table class="tbl"><tbody><tr><td>1</td><td><a class="b_tit" href="/v;js=1">t</a></td><td></td><td data-column="등록일">2026.03.01</td><td data-column="마감일"></td></tr></tbody></table>', [("t", "국가유산청", "2026-03-01", None, "https://www.cha.go.kr/v", None)]),
    "craftmuseum": ("<a><p>t</p><div>x</div><div>2026.03.01</div></a><a><p>u</p><div>x</div><div>soon</div></a>", [("t", "서울공예박물관", "2026-03-01", None, None, None)]),
    "ddc": (body(tr("공지", a("n"), "2026-01-01"), tr(2, a("t", "./x.do?k=1"), 3, "2026-03-01")), [("t", "동두천자유수호평화박물관", "2026-03-01", None, "https://www.ddc.go.kr/museum/x.do?k=1", None)]),
    "gcm": ('<div class="list-type1"><div class="part-list-title"><a href="https://g/1">t</a></div><div class="part-date">2026.03.01</div></div><div class="list-type1"></div>', [("t", "경기도어린이박물관", "2026-03-01", None, "https://g/1", None)]),
    "musenet": ('<div class="table02"><div class="tbody"><div class="tr"><a href="/rel">x</a><div class="td"><span>1</span></div><div class="td"><span>t</span></div><div class="td"><span>2026.03.01</span></div></div></div></div>', [("t", "경기도박물관", "2026-03-01", None, None, None)]),
    "gogung": (f'<table class="board-list"><tbody><tr><td>1</td><td>{a("t", "view.do?x=1")}</td><td class="mobile-hide">k</td><td class="mobile-hide">2026-03-01</td></tr></tbody></table>', [("t", "국립고궁박물관", "2026-03-01", None, "https://www.gogung.go.kr/gogung/bbs/BMSR00022/view.do?x=1", None)]),
    "gojobs": (f'<table id="apmTbl"><tbody>{tr(1, a("t"), "기관", "2026-03-01", "2026-03-09")}{tr(2, a("t"), "다른", "2026-03-02", "")}</tbody></table>', [("t", "기관", "2026-03-01", "2026-03-09", None, None)]),
    "hangeul": ("<ul><li><a><h3>t</h3></a><div>2026.03.01.</div></li><li>x</li></ul>", [("t", "국립한글박물관", "2026-03-01", None, None, None)]),
    "history-seoul": ("<main><ul><li><span>1</span><span>채용</span><a>t</a><span>2026-03-01</span></li><li><span>일반</span><a>u</a></li></ul></main>", [("t", "서울역사편찬원", "2026-03-01", None, None, None)]),
    "hnart": (body(tr(1, "c", '<a href="./v.do"> t <em>핫</em> u </a>', "", "", "<time>2026-03-01</time> x")), [("tu", "하남문화재단", "2026-03-01", None, "https://www.hnart.or.kr/artcenter/v.do", None)]),
    "kaah": (body(tr(1, a("t", "https://o/1"), 3, 4, "2026-03-01"), tr(1, a("u", "/2"), 3, 4, "")), [("t", "한국문화유산협회", "2026-03-01", None, "https://o/1", None), ("u", "한국문화유산협회", "", None, "https://www.kaah.kr/2", None)]),
    "kdp-aks": (body(tr(1, a("&lt;채용&gt;[연구원] t", "javascript:goDetail('59')"), "2026-03-01"), tr(1, a(""), "")), [("<채용>[연구원] t", "연구원", "2026-03-01", None, "https://kdp.aks.ac.kr/board/boardKorView?BRD_GRU_SN=6&BRD_SN=59&itemId=%EC%B1%84%EC%9A%A9%EA%B3%B5%EA%B3%A0", None)]),
    "khs": (body(tr(1, a("채용N", "/v;s=1"), 3, "2026-03-01", "2026-03-09"), tr(1, a("WIN "), 3, "", "")), [("채용", "국가유산청", "2026-03-01", "2026-03-09", "https://www.khs.go.kr/v", None), ("WIN", "국가유산청", "", None, "https://www.khs.go.kr/v?id=1", None)]),
    "museum-go-kr": ('<div class="board-list-tbody"><ul><li>1</li><li>과</li><li><a href="?v=1">t</a></li><li>2026-03-01 ~ 2026-03-09</li><li>접수중</li></ul></div>', [("t", "과", "2026-03-01", "2026-03-09", "https://www.museum.go.kr/MUSEUM/contents/M0701030000.do?v=1", "접수중")]),
    "museum-or-kr": (body(tr("공지", "x", 3, 4), tr(2, f'{a("", "v/1")}<div class="kboard-default-cut-strings">[관] t <span>new</span></div>', 3, "2026.03.01")), [("[관] t", "관", "2026-03-01", None, "https://museum.or.kr/v/1", None)]),
    "ncs": (f'<table class="boardtable_list"><tbody><tr><td>1</td><td class="ta_l"><a class="Boardtit" title="full">cut</a></td><td>기관</td><td></td><td></td><td>모집중</td><td>2026-03-01<br>~ 2026-03-09</td></tr>{tr(1, 2, 3, 4, 5, "마감", 7)}</tbody></table>', [("full", "기관", "2026-03-01", "2026-03-09", None, "모집중")]),
    "nmkpg": ('''<div class="bbsList"><ul><li class="header">h</li><li><span class="tag">채용</span><span class="tit"><a class="bbsLink" onclick="searchView('1','77')">t</a></span><span class="date">2026-03-01</span></li><li><span class="tag">일반</span></li></ul></div>''', [("t", "국립대한민국임시정부기념관", "2026-03-01", None, "https://www.nmkpg.go.kr/main/board/1/board_view.do?bcstIdx1=77", None)]),
    "nyj": (body(tr(1, 2, a("t", "./x"), 4, "2026-03-01")), [("t", "남양주시", "2026-03-01", None, "https://nyj.go.kr/www/x", None)]),
    "seosomun": ('<div class="list wrap_tbl"><div class="tbody"><div class="tr"><span class="td tit"><a href="/r"><span class="blind">제목</span>t<em>N</em></a></span><span class="td datetime"><span class="blind">일</span>2026-03-01</span></div></div></div>', [("t", "서소문성지 역사박물관", "2026-03-01", None, "https://www.seosomun.org/r", None)]),
    "seoul": (body(tr(1, a("t", "javascript:fnTbbsView('458')"), "", "2026-03-01", "")), [("t", "서울특별시", "2026-03-01", None, "https://www.seoul.go.kr/news/news_employ.do?bbsNo=166&nttNo=458", None)]),
    "warmemo": ("<table>" + tr("h", "h", "h", "h") + tr(1, a("t", "v"), "진행", "2026-03-01") + "</table>", [("t", "전쟁기념관", "2026-03-01", None, "https://www.warmemo.or.kr:8443/Home/H40000/H40200/H40202/v", "진행")]),
    "yongsan": (body(tr(1, a("긴 " * 60), " 2026.3.1 ")), [(("긴 " * 60).strip(), "용산역사박물관", "2026.3.1", None, None, None)]),
}


@pytest.mark.parametrize("site", sorted(CASES))
def test_boards(spark, site):
    page, want = CASES[site]
    pages = spark.createDataFrame([(site, "https://b/list", page), (site, None, None)], "site_id string, url string, html string")
    got = board_postings(pages, BOARDS[site]).orderBy("post_ord").collect()
    assert [(r["title"], r["organization"], r["reg_date"], r["deadline_date"], r["posting_url"], r["status"]) for r in got] == want


def test_error_page_gives_nothing():
    assert rows_of(BOARDS["yongsan"], CASES["yongsan"][0], "https://b/error/404") == []
    for board in BOARDS.values():
        assert rows_of(board, "") == rows_of(board, "<p>nothing</p>") == []


def test_sites(spark):
    table = site_table(spark)
    assert table.count() == len(SITES) == 42 and find_site(table, "cha").first()["site_ord"] == 23
    with pytest.raises(ValueError, match="museum-go-kr, gogung"):
        find_site(table, "nowhere")


def test_json_board(spark):
    item = lambda n, **k: {"seq": n, "title": f"t{n}", "instNm": "", "bgnDt": "2026.03.01", "endDt": ""} | k
    answers = [(1, json.dumps({"list": [item(k) for k in range(16)]})), (2, json.dumps([item(3), item(20, dtlUrl="u", instNm="i", endDt="26.3.9"), item(21, title="")])), (3, json.dumps({"resultList": [item(99)]}))]
    got = json_postings(spark.createDataFrame(answers, "page int, body string"), *JSON_SITE[1:]).orderBy("post_ord").collect()
    assert [r["title"] for r in got] == [f"t{k}" for k in range(16)] + ["t20"]
    assert tuple(got[-1])[2:] == ("i", "2026-03-01", "2026-03-09", "u") and got[0]["url"] == JSON_SITE[2] + "0" and got[0]["organization"] == "경기도"
    assert json_postings(spark.createDataFrame([(1, "bad")], "page int, body string"), *JSON_SITE[1:]).count() == 0


def test_captured_pages(spark, tmp_path):
    (tmp_path / "anseong").mkdir()
    (tmp_path / "anseong" / "2.html").write_text("second")
    (tmp_path / "anseong" / "1.html").write_text(CASES["anseong"][0])
    (tmp_path / "anseong" / "1.url").write_text("https://b/1\n")
    (tmp_path / "cha").mkdir()
    (tmp_path / "cha" / "error.txt").write_text("timeout")
    rows = captured_pages(spark, str(tmp_path))
    assert sorted((r["site_id"], r["page"], r["url"], r["error"]) for r in rows.where("page is not null").collect()) == [("anseong", 1, "https://b/1", None), ("anseong", 2, None, None)]
    assert [r["error"] for r in rows.where("site_id = 'cha'").collect()] == ["timeout"]
    few = captured_pages(spark, str(tmp_path), ["anseong", "gone"], 1).collect()
    assert [r["error"] for r in captured_pages(spark, str(tmp_path), ["gone"]).collect()] == ["no captured pages"]
    assert len(few) == 2 and any(r["site_id"] == "gone" and r["error"] for r in few)
    assert board_postings(rows.where("site_id = 'anseong'"), BOARDS["anseong"]).count() == 1


def test_pages_up_to_the_last(spark):
    link = lambda n: f"<a onclick='fn_egov_link_page({n})'>{n}</a>"
    pages = [("gojobs", p, "u", link(p + 1) if p not in (3,) else link(1), None) for p in range(1, 6)] + [("kaah", p, "u", "", None) for p in (1, 2)]
    got = until_last_page(spark.createDataFrame(pages, SCHEMA), PAGERS).select("site_id", "page").collect()
    assert sorted(map(tuple, got)) == [("gojobs", 1), ("gojobs", 2), ("gojobs", 3), ("kaah", 1), ("kaah", 2)]
    assert until_last_page(spark.createDataFrame(pages[:2], SCHEMA), PAGERS, 1).count() == 1


RESULT = [{"site": {"id": "A", "name": "n", "url": "u"}, "postings": [{"title": "x", "organization": "o", "regDate": "2026-03-01", "deadlineDate": None, "url": None}, {"title": "y", "organization": "o", "regDate": "", "deadlineDate": None, "url": "l", "status": "s"}], "crawledAt": "2026-03-31T00:00:00Z"}, {"site": {"id": "B", "name": "m", "url": "v"}, "postings": [], "crawledAt": "t", "error": "e"}]


def test_results_files(spark, tmp_path):
    (tmp_path / "results.json").write_text(json.dumps(RESULT))
    results = read_results(spark, str(tmp_path / "results.json"))
    flat = flat_postings(results, spark.createDataFrame([("A", 1)], "site_id string, site_ord int"))
    assert sorted((r["site_id"], r["post_ord"], r["title"]) for r in flat.collect()) == [("A", 0, "x"), ("A", 1, "y")]
    assert read_results(spark, str(tmp_path / "none.json"), required=False).count() == 0
    with pytest.raises(MissingSnapshot):
        read_results(spark, str(tmp_path / "none.json"))
    made = [json.loads(r[0]) for r in flat.orderBy("post_ord").select(posting_json()).collect()]
    assert made == RESULT[0]["postings"]
    write_results(results, str(tmp_path / "out"))
    again = read_results(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, results.collect()))
    (written,) = Path(tmp_path / "out").glob("part-*")
    assert json.loads(written.read_text()) == RESULT
    results.write.json(str(tmp_path / "lines"))
    assert read_results(spark, str(tmp_path / "lines")).count() == 2
    backwards = spark.createDataFrame([("B", 1), ("A", 2)], "site_id string, site_ord int")
    assert {(r["site_id"], r["site_ord"]) for r in flat_postings(results, backwards).collect()} == {("A", 2)}
    write_new_postings(flat, str(tmp_path / "new"))
    (written,) = Path(tmp_path / "new").glob("part-*")
    assert json.loads(written.read_text()) == [p | {"siteId": "A", "siteName": "n"} for p in RESULT[0]["postings"]]
    assert sorted(r["title"] for r in read_new_postings(spark, str(tmp_path / "new")).collect()) == ["x", "y"] and read_new_postings(spark, str(tmp_path / "gone")).count() == 0
    write_new_postings(flat.limit(0), str(tmp_path / "new"))
    assert read_new_postings(spark, str(tmp_path / "new")).count() == 0
    (tmp_path / "words.txt").write_text(" 도박 \n\n미술\n", encoding="utf-8")
    assert sorted(read_keywords(spark, str(tmp_path / "words.txt"))) == ["도박", "미술"]


def test_verdict_file_and_hidden_set(spark, tmp_path):
    posts = spark.createDataFrame([("A", 0, "하나 채용"), ("A", 1, "둘")], "site_id string, post_ord int, title string")
    pages = spark.createDataFrame([("A", "하나 채용 공고", None, None), ("B", "", "e", None)], "site_id string, page_text string, crawl_error string, check_error string")
    sites = spark.createDataFrame([("B", 1, "b"), ("A", 2, "a")], "site_id string, site_ord int, site_name string")
    write_verdicts(audit(posts, pages), sites, str(tmp_path / "verify"))
    (written,) = Path(tmp_path / "verify").glob("part-*")
    assert json.loads(written.read_text()) == [
        {"siteId": "B", "siteName": "b", "status": "skip", "crawledCount": 0, "actualCount": 0, "matchedTitles": 0, "unmatchedTitles": [], "message": "크롤링 에러로 스킵: e"},
        {"siteId": "A", "siteName": "a", "status": "warn", "crawledCount": 2, "actualCount": 1, "matchedTitles": 1, "unmatchedTitles": ["둘"], "message": "2건 중 1건만 매칭 (50%)"},
    ]
    path = str(tmp_path / "hidden")
    change = lambda *rows: spark.createDataFrame(rows, "site_id string, title string, hide boolean, seq int")
    assert change_hidden(spark, path, change(("A", "x", True, 1), ("A", "y", True, 2), ("A", "y", False, 3), ("A", None, True, 4))).count() == 2
    assert sorted(r["title"] for r in read_hidden(spark, path).collect()) == ["", "x"]
    assert [r["title"] for r in without_hidden(posts.selectExpr("site_id", "nullif(title, '둘') AS title"), read_hidden(spark, path)).collect()] == ["하나 채용"]
    assert change_hidden(spark, path, None).count() == 0 and read_hidden(spark, path).count() == 0


def test_dated_snapshots(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = lambda *t: spark.createDataFrame([("A", x) for x in t], "site_id string, title string")
    write_snapshot(rows("x"), path, "2026-03-01")
    write_snapshot(rows("x", "y"), path, "2026-03-02")
    write_snapshot(rows("y"), path, "2026-03-02")
    assert [r["title"] for r in snapshot_on(spark, path, "2026-03-02").collect()] == ["y"]
    assert [r["title"] for r in snapshot_before(spark, path, "2026-03-02").collect()] == ["x"]
    assert snapshot_before(spark, path, "2026-03-01").count() == 0


def test_stream_of_snapshots(spark, tmp_path):
    schema = "site_id string, title string"
    source, seen, out = (str(tmp_path / x) for x in ("in", "seen", "out"))
    rows = lambda *t: spark.createDataFrame([("A", x) for x in t], schema)
    for batch in (("x", "y"), ("y", "z"), ("x", "z", "w")):
        rows(*batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_new_postings(stream, seen, out, str(tmp_path / "check")).awaitTermination()
    got = sorted((r["batch"], r["title"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, "x"), (0, "y"), (1, "z"), (2, "w")]


def test_text_comes_in_pieces(monkeypatch):
    from postmill.operators import html as H

    page = CASES["hnart"][0] + '<p>a &lt; b &amp; 다</p><p class="x">c < d  e</p>'
    whole = [n.text() for n in select(parse(page), "td, p")]
    for step in (1, 2, 3, 7):
        monkeypatch.setattr(H, "STEP", step)
        assert [n.text() for n in select(parse(page), "td, p")] == whole
        assert first(parse(page), ".x").own_text() == "c < d  e"


def test_selectors_start_from_any_element():
    t = parse('<div class="a"><p class="x">1<b id="k">2</b></p></div><div class="a b"><p>3</p><section><p class="x y">4</p></section></div><p class="x">5</p>')
    second = select(t, "div.a")[1]
    assert [n.text() for n in select(second, "p, .x")] == ["3", "4"] and [n.text() for n in select(second, "section > .y")] == ["4"]
    assert [n.text() for n in select(t, "#k, b, .x")] == ["12", "2", "4", "5"] and select(second, "div") == [] and len(select(t, ":not(p)")) == 4


def test_digits_are_ascii():
    board = BOARDS["artic"]
    page = f'<table class="boardCategory"><tbody>{tr("٢٠٢٦-٠٣-٠١", a("t"), "2026-03-02")}</tbody></table>'
    assert [r["date"] for r in rows_of(board, page)] == ["2026-03-02"]


def test_references_that_break_off(spark, tmp_path):
    """A title cut within a reference: `extract_title` and its SQL leave what isn't closed, a board reads it as browsers do."""
    from postmill.operators.extract import Board, Pick
    from postmill.plans.queries import ORACLE_SQL, QUERIES
    from tests.oracle import same

    page = "<head><title>a &lt;b&gt; &amp;&amp;amp c&amp</title></head>"
    board = Board("head", (Pick(css="title"),), (), "page")
    assert [r["title"] for r in rows_of(board, page)] == ["a <b> &&amp c&"]
    spark.createDataFrame([(1, "u", page), (2, "u", "<head><title>&am</title></head>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert same(spark, QUERIES["extract_title"], ORACLE_SQL["extract_title"], str(tmp_path)) == 2


def test_plain_pages_need_no_parser_and_give_the_same_tree():
    import random

    from postmill.operators import html as H

    def parsed(page):
        tree = H._Tree()
        builder = H._Builder(tree)
        builder.feed(page)
        builder.close()
        return tree.indexed()

    def told(node):
        return node.name, node.attrs, node.order, node.end, [c if isinstance(c, str) else told(c) for c in node.children]

    chance = random.Random(1)
    pieces = "<table> <tbody> <tr> <td> <th> </td> </tr> </table> <ul> <li> </li> </ul> <p> </p> <br> <h3> </b> &amp; &copy &#65; x > <b>".split() + [' <a href="/v?a=1&amp;b=&quot;2" class="x y">', '<div id="k" class="x" class="z">', " ", "\r\n가"]
    pages = [c[0] for c in CASES.values()] + ["".join(chance.choices(pieces, k=25)) for _ in range(300)]
    plain = [(p, t) for p in pages if (t := H._plain(p)) is not None]
    assert len(plain) > 300
    for page, tree in plain:
        tree = tree.indexed()
        assert told(tree) == told(parsed(page)) and {k: [n.order for n in v] for k, v in tree.index.items()} == {k: [n.order for n in v] for k, v in parsed(page).index.items()}
    for page in ("<P>", "<a href=x>", "<a  b='c'>", "<br/>", "<!--x-->", "a < b", "<title>a<b></title>", "<p", '<a href="?a=1&b=2">', "</p >"):
        assert H._plain(page) is None
