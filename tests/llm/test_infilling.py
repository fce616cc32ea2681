import hashlib
import random

import pytest
from pyspark.sql import functions as F

from postmill.llm.infilling import infilled, infilling_report, restored
from tests.llm.fixtures import awkward, docs


def brute(i, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


MARKS = ["\x1e", "\x1d", "\x1d0", "\x1d1", "\x1e\x1d\x1e", "<P", "<S><", "a<P>b", "x\\y$1", "\r\n\x85 ", "é\U0001f468‍\U0001f469", "\x1d" * 7 + "1", "\U0001f600"]


def texts():
    rng = random.Random(1)
    mixed = ["".join(rng.choice(["\x1e", "\x1d", "0", "1", "<", "P", "S", "M", ">", "é", "\U0001f600", "\n", "$"]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    return awkward(1) + MARKS + mixed


def test_equals_the_definition(spark):
    given = texts()
    got = {r["doc_id"]: r for r in infilled(docs(spark, given)).withColumn("back", restored()).collect()}
    for i, t in enumerate(given):
        r = got[i]
        assert (r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) == brute(i, t)
        assert r["back"] == (t or "")
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_report_holds_digests(spark):
    given = texts()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in infilling_report(docs(spark, given)).collect():
        n, form, p, m, _, out = brute(r["doc_id"], given[r["doc_id"]])
        want = (n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(given[r["doc_id"]] or ""))
        assert tuple(r)[1:] == want


def test_other_columns_stay_and_made_ones_are_replaced(spark):
    rows = docs(spark, ["some text here", None], ids=[None, 3]).withColumns({"form": F.lit("old"), "n": F.lit(-1), "mark": F.lit("m"), "a.b": F.lit(5)})
    got = infilled(rows)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "window", "key", "m", "mark", "a.b", "n", "form", "prefix", "middle", "suffix", "output"]
    assert {(r["doc_id"], r["n"], r["mark"], r["a.b"]) for r in got.collect()} == {(None, 14, "m", 5), (3, 0, "m", 5)}
    assert {(r["doc_id"], *brute(r["doc_id"], r["text"])) for r in got.collect()} == {(r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) for r in got.collect()}


@pytest.mark.parametrize("plain,first,forms", [(0, 0, {"psm"}), (0, 100, {"spm"}), (100, 50, {"plain"})])
def test_shares_are_parameters(spark, plain, first, forms):
    rows = docs(spark, [f"text {i}" for i in range(40)])
    assert {r["form"] for r in infilled(rows, plain_share=plain, suffix_first_share=first).collect()} == forms


def test_empty_tables_and_repeats(spark):
    assert infilled(docs(spark, [])).count() == 0
    twice = infilled(docs(spark, ["same words"] * 3, ids=[5, 5, 6])).select("doc_id", "output").collect()
    assert len(twice) == 3 and twice[0] == twice[1]


def test_no_shuffle_and_no_python(spark):
    plan = infilling_report(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
