"""The boards: their order, names, addresses, and how their pages hold postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.operators.extract import WHOLE_DATE, Board, Pick

P = Pick
A1, A2 = (P(1, "a"),), (P(2, "a"),)
L1, L2 = (P(1, "a", attr="href"),), (P(2, "a", attr="href"),)
TR = "table tbody tr"
DATED = (P(date_cell=True),)


def cell(n: int, css: str = "") -> tuple[Pick, ...]:
    return (P(n, css),)


# The boards in the order that decides which of equal postings is first.
# id, name, address
SITES = (
    ("museum-go-kr", "국립중앙박물관", "https://www.museum.go.kr/MUSEUM/contents/M0701030000.do?catCustomType=post&catId=54"),
    ("gogung", "국립고궁박물관", "https://www.gogung.go.kr/gogung/bbs/BMSR00022/list.do?gubunCd=B22_003&menuNo=800090"),
    ("nrich", "국립문화유산연구원", "https://www.nrich.go.kr/kor/boardList.do?menuIdx=285&bbscd=40"),
    ("nfm", "국립민속박물관", "https://www.nfm.go.kr/user/bbs/home/2/1409/bbsDataList.do"),
    ("ncs", "NCS 공정채용", "https://www.ncs.go.kr/blind/bl04/RecrtNotifList.do"),
    ("much", "대한민국역사박물관", "https://www.much.go.kr/MUCH/contents/M07090200000.do"),
    ("gmuseum", "경기도박물관협회", "https://gmuseum.kr/board/jobList"),
    ("hangeul", "국립한글박물관", "https://www.hangeul.go.kr/news/newsList.do?bbs_id=30&curr_menu_cd=0106010600"),
    ("gojobs", "나라일터", "https://www.gojobs.go.kr/apmList.do"),
    ("kaah", "한국문화유산협회", "https://www.kaah.kr/reqopen"),
    ("khs", "국가유산청", "https://www.khs.go.kr/multiBbz/selectMultiBbzList.do?mn=NS_01_06&bbzId=newexam"),
    ("museum-seoul", "서울역사박물관", "https://museum.seoul.go.kr/www/board/NR_boardList.do?bbsCd=1017&sso=ok"),
    ("baekje", "한성백제박물관", "https://baekjemuseum.seoul.go.kr/module/index.jsp?mpid=SBM0501020000"),
    ("craftmuseum", "서울공예박물관", "https://craftmuseum.seoul.go.kr/introduce/recruit_list/1"),
    ("yongsan", "용산역사박물관", "https://museum.yongsan.go.kr/articles/index?boardCode=notice&category=C1002-1"),
    ("ep-museum", "은평역사한옥박물관", "https://museum.ep.go.kr/board/board.asp?bbs_code=Fboard_1&gotopage=1&keyfield=title&keyword=%C3%A4%BF%EB"),
    ("namu-sdm", "서대문자연사박물관", "https://namu.sdm.go.kr/web/main/bbs/newsevent_news_recruitmen/list"),
    ("warmemo", "전쟁기념관", "https://www.warmemo.or.kr:8443/Home/H40000/H40200/H40202/boardList"),
    ("nmkpg", "국립대한민국임시정부기념관", "https://www.nmkpg.go.kr/main/board/1/board_list.do"),
    ("kimkoo", "백범김구기념관", "https://www.kimkoomuseum.org/inf/inf_1_list.asp?BoardDiv=Notice"),
    ("seosomun", "서소문성지 역사박물관", "https://www.seosomun.org/retrieveBoard.do?mCode=159"),
    ("jfac", "종로문화재단", "https://www.jfac.or.kr/site/main/archive/post/category/%EC%B1%84%EC%9A%A9%EC%A0%95%EB%B3%B4"),
    ("cha", "국가유산청(cha)", "https://www.cha.go.kr/multiBbz/selectMultiBbzList.do?bbzId=newexam&mn=NS_01_06"),
    ("musenet", "경기도박물관", "https://musenet.ggcf.kr/boards/notice/articles?category=03&page=1"),
    ("gcm", "경기도어린이박물관", "https://gcm.ggcf.kr/boards/news/articles?category=03"),
    ("ngcm", "경기북부어린이박물관", "https://ngcm.ggcf.kr/boards/news/articles?category=03"),
    ("jgpm", "전곡선사박물관", "https://jgpm.ggcf.kr/boards/news/articles?category=03"),
    ("silhak", "실학박물관", "https://silhak.ggcf.kr/boards/news/articles?category=03"),
    ("gjicp", "경기도자미술관", "https://gjicp.ggcf.kr/boards/news/articles?category=03"),
    ("bcmuseum", "부천시박물관", "https://www.bcmuseum.or.kr/ko/boards/notice/?sc=03&pageIndex=1&searchKeyword="),
    ("nyj", "남양주시", "https://nyj.go.kr/www/selectBbsNttList.do?key=2497&bbsNo=67&pageUnit=10&searchCnd=SJ&searchKrwd=%EB%82%A8%EC%96%91%EC%A3%BC%EC%8B%9C%EB%A6%BD"),
    ("hnart", "하남역사박물관", "https://www.hnart.or.kr/artcenter/selectBbsNttList.do?key=219&bbsNo=1&integrDeptCode=&searchKrwd=&searchCtgry=%EC%B1%84%EC%9A%A9%EA%B3%B5%EA%B3%A0"),
    ("hsmuseum", "화성시역사박물관", "https://hsmuseum.hscity.go.kr/hsMuseum/comunity/comu1.jsp"),
    ("anseong", "안성맞춤박물관", "https://www.anseong.go.kr/tourPortal/museum/bbs/list.do?ptIdx=16&mId=0600000000"),
    ("artic", "이천시립박물관", "https://www.artic.or.kr/icmus/board/list?boardManagementNo=26&menuLevel=2&menuNo=53&searchType=total&searchWord=%EC%B1%84%EC%9A%A9"),
    ("ddc", "동두천자유수호평화박물관", "https://www.ddc.go.kr/museum/selectBbsNttList.do?bbsNo=96&key=878"),
    ("history-seoul", "서울역사편찬원", "https://history.seoul.go.kr/bbsctt/list.do?key=2210200044"),
    ("job-gg", "경기도일자리포털", "https://job.gg.go.kr/pblcEmpmn/list.do"),
    ("museum-or-kr", "한국박물관협회", "https://museum.or.kr/job2/"),
    ("seoul", "서울특별시", "https://www.seoul.go.kr/news/news_employ.do"),
    ("korea-kr", "정책브리핑", "https://www.korea.kr/archive/recruitInfoList.do"),
    ("kdp-aks", "한국학중앙연구원", "https://kdp.aks.ac.kr/board/boardKorList?BRD_GRU_SN=6&pageUnit=20&ctgDtlCd=&itemId=%EC%B1%84%EC%9A%A9%EA%B3%B5%EA%B3%A0&qw=&q=&pageUnit=20"),
)

# The board whose answers are JSON, its default organization, and what a posting's number is put behind.
JSON_SITE = ("job-gg", "경기도", "https://job.gg.go.kr/pblcEmpmn/publicJobDetail.do?seq=")


def _foundation(name: str) -> Board:
    """Boards of one platform: a table on one of them, cards on the others."""
    card = Board(".list-type1", (P(css=".part-list-title a"),), (P(css=".part-date"),), name, titled=True, link=(P(css=".part-list-title a", attr="href"),), url="http")
    return Board(".table02 .tbody .tr", (P(css=".td span", nth=1),), (P(css=".td span", nth=2),), name, cells=".td span", least=3, link=(P(css="a", attr="href"),), url="http", other=card)


# What leads to a board's next page, where it has several.
PAGERS = {"gojobs": 'a[onclick*="fn_egov_link_page({next})"]'}

# Where each board's pages have what.
BOARDS = {
    "museum-go-kr": Board(".board-list-tbody > ul", A2, (P(3, found=WHOLE_DATE),), "국립중앙박물관", cells="li", least=5, org=cell(1), deadline=(P(3, found=WHOLE_DATE, match=1),), status=cell(4), link=L2, url="prefix", base="https://www.museum.go.kr/MUSEUM/contents/M0701030000.do", raw_dates=True),
    "gogung": Board("table.board-list tbody tr", A1, (P(css="td.mobile-hide", nth=1),), "국립고궁박물관", least=4, link=L1, url="resolve", base="https://www.gogung.go.kr/gogung/bbs/BMSR00022/"),
    "nrich": Board("ul.list-body li", (P(css="div.col2 a.cont-link"),), (P(css="div.col5 .cont-txt"),), "국립문화유산연구원", titled=True, org=(P(css="div.col3 .cont-txt"),), link=(P(css="div.col2 a.cont-link", attr="href"),), url="resolve", base="https://www.nrich.go.kr/kor/"),
    "nfm": Board(TR, (P(css="td.tit a.list_bbsDataTitle"),), (P(css="td.tit .board_info .info"),), "국립민속박물관", needs=(P(css="td.tit a.list_bbsDataTitle"),), link=(P(css="td.tit a.list_bbsDataTitle", attr="href"),), url="prefix", base="https://www.nfm.go.kr"),
    "ncs": Board("table.boardtable_list tbody tr", (P(css="td.ta_l a.Boardtit", attr="title"), P(css="td.ta_l a.Boardtit")), (P(6, found=WHOLE_DATE),), "", least=7, only=((P(5), "모집중", True),), org=cell(2), deadline=(P(6, found=WHOLE_DATE, match=1),), status=cell(5), raw_dates=True),
    "much": Board(TR, (P(css="td.noti_tit a"),), cell(4), "대한민국역사박물관", least=5, deadline=cell(3)),
    "gmuseum": Board(TR, A1, cell(3), "경기도박물관협회", least=4, org=cell(2), link=L1, url="prefix", base="https://gmuseum.kr"),
    "hangeul": Board("ul li", (P(css="a h3"),), (P(css="div"),), "국립한글박물관", needs=(P(css="a h3"),), titled=True),
    "gojobs": Board("table#apmTbl tbody tr", A1, cell(3), "", least=5, org=cell(2), deadline=cell(4), distinct=True),
    "kaah": Board(TR, A1, cell(4), "한국문화유산협회", least=5, link=L1, url="absolute", base="https://www.kaah.kr"),
    "khs": Board(TR, A1, cell(3), "국가유산청", least=5, deadline=cell(4), link=L1, url="cut", base="https://www.khs.go.kr", title_mark="N"),
    "museum-seoul": Board(TR, (P(css="td.al a"),), (P(css="td.m_list_f", nth=1),), "서울역사박물관", least=4),
    "baekje": Board(TR, A1, cell(3), "한성백제박물관", least=4, needs=A1, link=L1, url="prefix", base="https://baekjemuseum.seoul.go.kr/module/"),
    "craftmuseum": Board("a", (P(css="p"),), (P(css="div", nth=-1),), "서울공예박물관", cells="div", least=2, needs=(P(css="p"), P(css="div")), only=((P(css="div", nth=-1), r"\d{4}", True),), titled=True),
    "yongsan": Board(TR, (P(css="td a"),), DATED, "용산역사박물관", least=3, raw_dates=True, raw_title=True, error_path="/error/"),
    "ep-museum": Board(TR, (P(css="td a"),), DATED, "은평역사한옥박물관", least=3, link=(P(css="td a", attr="href"),), url="prefix", base="https://museum.ep.go.kr"),
    "namu-sdm": Board(TR, A1, cell(2), "서대문자연사박물관", least=3, link=L1, url="prefix", base="https://namu.sdm.go.kr"),
    "warmemo": Board("table tr", A1, cell(3), "전쟁기념관", least=4, drop_first=True, status=cell(2), link=L1, url="prefix", base="https://www.warmemo.or.kr:8443/Home/H40000/H40200/H40202/"),
    "nmkpg": Board(".bbsList ul li:not(.header)", (P(css="span.tit a.bbsLink"),), (P(css="span.date"),), "국립대한민국임시정부기념관", only=((P(css="span.tag"), "채용", False),), link=(P(css="span.tit a.bbsLink", attr="onclick"),), url="call", call="searchView", base="https://www.nmkpg.go.kr/main/board/1/board_view.do?bcstIdx1={id}"),
    "kimkoo": Board(TR, (P(css="td a"),), DATED, "백범김구기념관", least=3, job_words=True, link=(P(css="td a", attr="href"),), url="prefix", base="https://www.kimkoomuseum.org/inf/"),
    "seosomun": Board(".list.wrap_tbl .tbody .tr", (P(css="span.td.tit a, .td.col2 a", without=".blind, em"),), (P(css="span.td.datetime, .td.col3", without=".blind"),), "서소문성지 역사박물관", titled=True, link=(P(css="span.td.tit a, .td.col2 a", attr="href"),), url="prefix", base="https://www.seosomun.org"),
    "jfac": Board(TR, (P(css='a[href*="/site/main/archive/post/"]'),), cell(3), "종로문화재단", least=4, link=(P(css='a[href*="/site/main/archive/post/"]', attr="href"),), url="prefix", base="https://www.jfac.or.kr"),
    "cha": Board("table.tbl tbody tr", (P(css="a.b_tit"),), (P(css='td[data-column="등록일"]'), P(3)), "국가유산청", least=5, deadline=(P(css='td[data-column="마감일"]'), P(4)), link=(P(css="a.b_tit", attr="href"),), url="cut", base="https://www.cha.go.kr"),
    "musenet": _foundation("경기도박물관"),
    "gcm": _foundation("경기도어린이박물관"),
    "ngcm": _foundation("경기북부어린이박물관"),
    "jgpm": _foundation("전곡선사박물관"),
    "silhak": _foundation("실학박물관"),
    "gjicp": _foundation("경기도자미술관"),
    "bcmuseum": Board("ul.board-list-area > li", (P(css="a.list-tit"),), (), "부천시박물관", titled=True, label="작성일", link=(P(css="a.list-tit", attr="href"),), url="prefix", base="https://www.bcmuseum.or.kr/ko/boards/notice/"),
    "nyj": Board(TR, A2, cell(4), "남양주시", least=5, link=L2, url="dot", base="https://nyj.go.kr/www/"),
    "hnart": Board(TR, (P(2, "a", own=True),), (P(5, "time"), P(5)), "하남문화재단", least=5, needs=A2, titled=True, link=L2, url="dot", base="https://www.hnart.or.kr/artcenter/"),
    "hsmuseum": Board("table.boardList tbody tr", A1, cell(3), "화성시역사박물관", least=4, link=L1, url="prefix", base="https://hsmuseum.hscity.go.kr/hsMuseum/comunity/"),
    "anseong": Board(TR, A1, cell(4), "안성맞춤박물관", least=5, job_words=True),
    "artic": Board("table.boardCategory tbody tr", A1, DATED, "이천시립박물관", least=3, link=L1, url="prefix", base="https://www.artic.or.kr"),
    "ddc": Board(TR, A1, cell(-1), "동두천자유수호평화박물관", least=3, skip=("공지",), titled=True, link=L1, url="dot", base="https://www.ddc.go.kr/museum/"),
    "history-seoul": Board("main li, article li, #sub-contents li, .board-list li", (P(css="a"),), (), "서울역사편찬원", needs=(P(css="a"),), titled=True, children=("채용", "일반")),
    "museum-or-kr": Board(TR, (P(1, ".kboard-default-cut-strings", head=True),), cell(3), "한국박물관협회", least=4, skip=("공지사항", "공지"), link=L1, url="slash", base="https://museum.or.kr", bracket_org="start"),
    "seoul": Board(TR, A1, cell(3), "서울특별시", least=5, org=cell(2), deadline=cell(4), link=L1, url="call", call="fnTbbsView", base="https://www.seoul.go.kr/news/news_employ.do?bbsNo=166&nttNo={id}"),
    "korea-kr": Board(TR, (P(0, "a"),), cell(2), "정책브리핑", least=4, org=cell(1), deadline=cell(3), link=(P(0, "a", attr="href"),), url="prefix", base="https://www.korea.kr"),
    "kdp-aks": Board(TR, A1, cell(2), "한국학중앙연구원", least=3, needs=A1, titled=True, link=L1, url="call", call="goDetail", base="https://kdp.aks.ac.kr/board/boardKorView?BRD_GRU_SN=6&BRD_SN={id}&itemId=%EC%B1%84%EC%9A%A9%EA%B3%B5%EA%B3%A0", bracket_org="anywhere"),
}

#: Boards without a board entry: their answers are JSON.
assert {s[0] for s in SITES} == BOARDS.keys() | {JSON_SITE[0]}


def site_table(spark: SparkSession) -> DataFrame:
    """The boards with their order: one row each."""
    return spark.createDataFrame([(s[0], k + 1, s[1], s[2]) for k, s in enumerate(SITES)], "site_id string, site_ord int, site_name string, site_url string")


def find_site(sites: DataFrame, site_id: str) -> DataFrame:
    """The row of one board; an error naming all boards if there is none."""
    found = sites.where(sites["site_id"] == site_id)
    if found.isEmpty():
        known = ", ".join(r["site_id"] for r in sites.orderBy("site_ord").select("site_id").collect())
        raise ValueError(f"no board is called {site_id!r}; there are {known}")
    return found
