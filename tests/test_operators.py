import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill.operators.audit import audit, audit_summary, shown_unmatched
from postmill.operators.dedup import dedup_crawl, dedup_view, distinct_titles
from postmill.operators.filters import mentions, minimal, relevant_postings
from postmill.operators.snapshots import mark_new, nested_results, new_postings, preview, toggle_hidden
from postmill.operators.view import Choice, chosen, figures, latest_crawl, listed, ordered, ranked, site_counts

SCHEMA = "site_id string, site_ord int, post_ord long, title string, organization string, reg_date string, url string, site_name string, deadline_date string, status string"


def postings(spark, rows):
    """Rows of (site, title, url, reg_date), in order."""
    ords = {s: k for k, s in enumerate(dict.fromkeys(r[0] for r in rows))}
    return spark.createDataFrame([(s, ords[s], k, t, "org", d, u, f"Board {s}", None, None) for k, (s, t, u, d) in enumerate(rows)], SCHEMA)


def fold(rows):
    """The sequential pass of the crawl: rows (site, title, url) by site, kept ones by index."""
    key = lambda t: re.sub(r"[\s()\[\]·\-_,.…]", "", t or "").lower()
    owner: dict = {}
    first = {}
    for k, (s, t, u, _) in enumerate(rows):
        first.setdefault((s, key(t)), k)
    for s, t, u, _ in rows:
        if key(t) not in owner or (not rows[first[owner[key(t)], key(t)]][2] and u):
            owner[key(t)] = s
    return {first[s, k] for k, s in owner.items()}


@pytest.mark.parametrize("seed", range(3))
def test_crawl_removal_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(f"s{k // 12}", rng.choice(["A b", "ab", "a.b…", "c", "", None, "d"]), rng.choice([None, "", "u"]), "") for k in range(72)]
    assert {r["post_ord"] for r in dedup_crawl(postings(spark, rows)).collect()} == fold(rows)


def test_crawl_removal_cases(spark):
    kept = lambda *rows: [r["post_ord"] for r in dedup_crawl(postings(spark, [(s, "t", u, "") for s, u in rows])).collect()]
    assert kept(("A", "u"), ("B", "u")) == [0]
    assert kept(("A", None), ("B", "u")) == [1]
    assert kept(("A", None), ("A", "u")) == [0]
    assert kept(("A", None), ("A", "u"), ("B", "u")) == [2]


def test_view_removal(spark):
    rows = [("A", "t", None, "2026-03-05"), ("A", "T", "u", "2026-03-01"), ("B", "t.", "u", "2026-03-01")]
    got = dedup_view(postings(spark, rows), "at").collect()
    assert [(r["post_ord"], r["at"]["post_ord"]) for r in got] == [(1, 0)]
    assert [r["post_ord"] for r in distinct_titles(postings(spark, [("A", "t", None, ""), ("A", "t", "u", ""), ("B", "t", None, "")])).orderBy("post_ord").collect()] == [0, 2]


def test_noise(spark):
    assert minimal(["도박", "도박장", "ir", "ir", ""]) == ["ir", "도박"]
    df = spark.createDataFrame([("경기도박물관",), ("국립한글박물관",), ("ir a.b",), ("x IR y",), (None,)], "o string")
    assert [r[0] for r in df.select(mentions("o", ["도박", "IR", "a+b", "a.c"])).collect()] == [True, False, False, True, False]
    assert df.where(mentions("o", [])).count() == 0
    rows = postings(spark, [("A", "good", None, "2026-03-20"), ("A", "도박 bad", None, "2026-03-20"), ("A", "old", None, "2026-01-20")])
    as_of = datetime(2026, 3, 31, 12)
    assert [r["title"] for r in relevant_postings(rows, ["도박"], as_of).collect()] == ["good"]
    assert relevant_postings(rows.withColumn("organization", F.lit("경기도박물관")), ["도박"], as_of).count() == 0
    assert relevant_postings(rows.withColumn("organization", F.lit("경기도박물관")), ["도박"], as_of, ("경기도박물관",)).count() == 1


def test_snapshots(spark):
    before = postings(spark, [("A", "x", None, "")])
    now = postings(spark, [("A", "x", None, ""), ("A", "y", None, ""), ("A", "y", None, ""), ("B", "x", None, "")])
    new = new_postings(now, before)
    assert sorted((r["site_id"], r["title"]) for r in new.collect()) == [("A", "y"), ("A", "y"), ("B", "x")]
    assert sorted((r["post_ord"], r["is_new"]) for r in mark_new(now, new).collect()) == [(0, False), (1, True), (2, True), (3, True)]
    assert {(r["site_id"], tuple(r["titles"]), r["more"]) for r in preview(now, 2).collect()} == {("A", ("x", "y"), 1), ("B", ("x",), 0)}
    changes = spark.createDataFrame([("A", "x", False, 1), ("B", "q", True, 1), ("C", "c", True, 1), ("C", "c", False, 2)], "site_id string, title string, hide boolean, seq int")
    assert [tuple(r) for r in toggle_hidden(before, changes).collect()] == [("B", "q")]
    sites = spark.createDataFrame([("B", 0), ("C", 1), ("A", 2)], "site_id string, site_ord int").selectExpr("*", "'n' site_name", "'u' site_url", "'t' crawled_at", "cast(null as string) error")
    got = nested_results(now, sites).collect()
    assert [(r["site"]["id"], [p["title"] for p in r["postings"]]) for r in got] == [("B", ["x"]), ("C", []), ("A", ["x", "y", "y"])]


def test_listing(spark):
    as_of = datetime(2026, 3, 31, 12)
    rows = [("A", "old", None, "2026-03-01"), ("A", "One", None, "2026-03-10"), ("B", "one", "u", "2026-03-09"), ("B", "two%", None, "2026-03-30"), ("B", "three", None, ""), ("C", "four", None, "2026-03-30")]
    p = postings(spark, rows).withColumn("error", F.when(F.col("site_id") == "C", "failed"))
    listing = listed(p, as_of)
    assert [r["title"] for r in ordered(listing).collect()] == ["two%", "one"]
    assert sorted((r["rank"], r["title"]) for r in ranked(listing).collect()) == [(1, "two%"), (2, "one")]
    assert [tuple(r) for r in site_counts(listing).collect()] == [("B", 2)]
    assert tuple(figures(listing).first()) == (1, 2)
    pick = lambda **c: sorted(r["title"] for r in chosen(listing, Choice(**c), as_of, postings(spark, [("B", "one", None, "")])).collect())
    assert pick() == ["two%"] and pick(show_hidden=True) == ["one", "two%"]
    assert pick(show_hidden=True, search=" ONE ") == ["one"] and pick(search="%") == ["two%"] and pick(search="board b") == ["two%"]
    assert pick(only_new=True) == ["two%"] and pick(show_hidden=True, period_days=7) == ["two%"] and pick(site="A") == []
    assert Choice(site="A").toggled("A").site is None and Choice(site="A").toggled("B").site == "B"
    times = spark.createDataFrame([("2026-03-01T00:00:00Z",), ("bad",), (None,)], "crawled_at string")
    assert str(latest_crawl(times).first()[0])[:10] in ("2026-03-01", "2026-02-28")
    assert latest_crawl(times.limit(0)).count() == 1


@pytest.mark.parametrize(("n", "m", "lines", "status"), [(0, 0, 0, "pass"), (0, 0, 2, "warn"), (10, 10, 5, "pass"), (10, 7, 0, "pass"), (10, 3, 0, "warn"), (10, 2, 0, "fail")])
def test_verdicts(spark, n, m, lines, status):
    p = postings(spark, [("A", f"title {'abcdefghij'[k]}", None, "") for k in range(n)] or [("B", "x", None, "")])
    page = "\n".join([f"title {'abcdefghij'[k]}" for k in range(m)] + ["채용 공고 안내"] * lines + ["채용"])
    pages = spark.createDataFrame([("A", page, None, None)], "site_id string, page_text string, crawl_error string, check_error string")
    r = audit(p.where("site_id = 'A'"), pages).first()
    assert (r["status"], r["crawled"], r["matched"], r["actual"], len(r["unmatched"])) == (status, n, m, lines, n - m)
    assert r["percent"] == (round(100 * m / n) if n else None)


def test_verdicts_of_errors(spark):
    p = postings(spark, [("A", "x", None, ""), ("B", "x", None, ""), ("C", "", None, ""), ("C", "z", None, "")])
    pages = spark.createDataFrame([("A", "x", "timeout", None), ("B", "x", None, "closed"), ("C", None, None, None)], "site_id string, page_text string, crawl_error string, check_error string")
    v = audit(p, pages)
    got = {r["site_id"]: r for r in v.collect()}
    assert [got[s]["status"] for s in "ABC"] == ["skip", "fail", "fail"] and [got[s]["crawled"] for s in "ABC"] == [0, 1, 2]
    assert audit_summary(v).first().asDict() == {"pass": 0, "warn": 0, "fail": 2, "skip": 1}
    assert [tuple(r) for r in shown_unmatched(p, pages).orderBy("nth").collect()] == [("C", 0, ""), ("C", 1, "z")]


def test_keywords_of_a_table_equal_those_of_a_list(spark):
    import random

    from postmill.operators.filters import mentions, without_keywords

    rng = random.Random(3)
    texts = ["".join(rng.choice("abc가나 .(") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + [None, "", "a", "ab"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, title string")
    for words in (["ab", "abc", "가나", ".(", "a.c", "bca", "cab가"], ["c"], ["가나다라마바사"], [], ["", None, "aa", "aa"]):
        table = spark.createDataFrame([(w,) for w in words], "word string")
        want = {r["k"] for r in rows.where(~mentions("title", [w for w in words if w])).collect()}
        assert {r["k"] for r in without_keywords(rows, "title", table).collect()} == want


def test_grams_of_texts_are_never_broadcast(spark):
    import re

    from pyspark.sql import functions as F

    from postmill.operators.filters import without_keywords

    # Few texts in bytes, fewer than keywords, but of many grams.
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 256), 8), F.lit("x")).alias("title"))
    words = spark.range(5000).select(F.concat(F.lit("z"), F.sha2(F.col("id").cast("string"), 256)).alias("word")).union(rows.where("k = 7").select(F.left("title", F.lit(70))))
    for more in ({}, {"held": 0}):
        kept = without_keywords(rows, "title", words, **more)
        assert {r["k"] for r in kept.collect()} == set(range(200)) - {7}
        plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        for sent in plan.split("BroadcastExchange")[1:]:
            assert "Generate" not in re.split(r"ShuffleQueryStage|\bExchange\b", sent)[0]


def test_titles_are_found_by_automata(spark, monkeypatch):
    import random

    from postmill.operators import audit as A

    monkeypatch.setattr(A, "MOST_CORES", 50)
    rng = random.Random(4)
    text = "".join(rng.choice("가나다ab \n\U0001f600") for _ in range(400))
    titles = [text[i : i + n] for i in range(0, 380, 7) for n in (1, 2, 3, 5, 9, 20, 40)] + ["없는 제목", "가" * 30, "", None, text[3:30] + "..."]
    posts = spark.createDataFrame([("A", i, t) for i, t in enumerate(titles)] + [("B", 0, text[:20]), ("C", 0, "x")], "site_id string, post_ord int, title string")
    pages = spark.createDataFrame([("A", text), ("B", "other"), ("C", None)], "site_id string, page_text string")
    cores = {r["post_ord"]: r["c"] for r in posts.where("site_id = 'A'").select("post_ord", A.title_core("title").alias("c")).collect()}
    got = {(r["site_id"], r["post_ord"]): r["hit"] for r in A.judged(posts, pages).collect()}
    assert {k: got["A", k] for k in cores} == {k: c != "" and c in text for k, c in cores.items()}
    assert not got["B", 0] and not got["C", 0] and len(got) == len(titles) + 2
    assert A.judged(posts.limit(0), pages).count() == 0
