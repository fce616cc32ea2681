import random
import re
from collections import Counter

import pytest

from postmill.llm import substrings
from postmill.llm.substrings import digest, removal_report, without_repeats
from tests.llm.fixtures import awkward, docs, prose


def brute(texts, window=35):
    lists = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    often = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = {j for i in range(len(w) - window + 1) if often[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), digest([x for i, x in enumerate(w) if i not in gone])))
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (34, 35, 36, 60, 200)]
    texts = awkward(seed) + [" ".join([prose(rng, rng.randrange(50)), rng.choice(shared), prose(rng, rng.randrange(50))]) for _ in range(80)]
    texts += [prose(rng, 300) for _ in range(30)] + ["x " * 36, "a b c " * 30, "a b c " * 12, texts[-1] + " more words", texts[-2], texts[-3].replace(" ", " \n\t ")]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("parts", [1, 6])
def test_equals_brute_force(spark, seed, parts):
    texts = corpus(seed)
    got = {r[0]: tuple(r)[1:] for r in removal_report(docs(spark, texts).repartition(parts)).collect()}
    want = dict(enumerate(brute(texts)))
    assert [i for i in want if got[i] != want[i]] == []
    assert sum(w[1] for w in want.values()) > 1000


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MIN_BITS", 4)
    monkeypatch.setattr(substrings, "MAX_BITS", 4)
    texts = corpus(3)
    got = {r[0]: tuple(r)[1:] for r in removal_report(docs(spark, texts).repartition(3)).collect()}
    assert got == dict(enumerate(brute(texts)))


@pytest.mark.parametrize("hashes", ["words", "windows"])
def test_equal_hashes_of_different_words_are_told_apart(spark, monkeypatch, hashes):
    """Hashes of few values: everything meets, and only words decide."""
    import numpy as np

    if hashes == "words":
        monkeypatch.setattr(substrings.xxhash, "xxh3_64_intdigest", lambda w: len(w))
        rng = random.Random(9)
        texts = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(30)]
        words, at = np.array([ord(c) for t in texts for c in t.split()]), np.arange(0, 1700)
        order, group = substrings._groups((np.zeros(1700, np.uint64),), words, at, 3)
        want = Counter(tuple(words[i : i + 3].tolist()) for i in at)
        got = Counter(group.tolist())
        assert sorted(got.values()) == sorted(want.values()) and all(len({tuple(words[at[o] : at[o] + 3].tolist()) for o in order[group == g]}) == 1 for g in list(got)[:50])
    else:
        rng = random.Random(10)
        texts = [*corpus(4), *(prose(rng, 50) for _ in range(10))]
        monkeypatch.setattr(substrings, "COMMON", 2)  # every window is dealt by itself
        got = {r[0]: tuple(r)[1:] for r in removal_report(docs(spark, texts).repartition(3)).collect()}
        assert got == dict(enumerate(brute(texts)))


def test_a_common_anchor_is_dealt_by_window(spark, monkeypatch):
    rng = random.Random(11)
    passage = prose(rng, 60)
    texts = [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(400)]
    table = docs(spark, texts).selectExpr("doc_id AS doc", "doc_id AS content", "text").repartition(8)
    most = []
    for common in (10**6, 256):
        monkeypatch.setattr(substrings, "COMMON", common)
        sketch = spark.sparkContext.broadcast(substrings.merged_sketch(table, 35, 20))
        routed = substrings._candidates(table, 35, sketch, 20).where("kind <> 2")
        most.append(routed.groupBy("route").count().agg({"count": "max"}).first()[0])
    assert most[0] > 300 and most[1] < 50
    got = {r[0]: tuple(r)[1:] for r in removal_report(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(5)
    a, b = prose(rng, 40), prose(rng, 40)
    got = sorted(without_repeats(docs(spark, [a, a, b, b + " end"], ids=[7, 7, None, None])).collect(), key=str)
    assert [r["n_removed"] for r in got] == [40, 40, 40, 40]
    assert [r["kept"] for r in got].count("end") == 1
    assert removal_report(docs(spark, [])).count() == 0
