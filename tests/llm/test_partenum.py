import random
import re

import numpy as np
import pytest

from postmill.llm import partenum
from postmill.llm.jaccard import shingles
from postmill.llm.partenum import least_distances, most_distance, parity, signatures, similar_texts, tags
from tests.llm.fixtures import awkward, docs, prose


def brute_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def brute(texts):
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed, groups=40):
    """Texts of all lengths and copies at distances on both sides of the threshold, chains of copies among them."""
    rng = random.Random(seed)
    texts = awkward(seed) + ["a b c d e f g h i", "a b c d e f g h i j", "x a b c d e f g h i", "one two three", "One two THREE", "one two"]
    for g in range(groups):
        base = prose(rng, rng.choice([5, 8, 9, 10, 12, 20, 33, 60, 150, 400, 1500]), 5000).split()
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"changed{g}"
            if rng.random() < 0.4:
                words = words[: max(1, int(len(words) * rng.uniform(0.8, 1)))]
            if rng.random() < 0.3:
                base = words  # the next is a copy of this one
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed,tile", [(1, 2048), (2, 3)])
def test_components_equal_all_pairs(spark, seed, tile):
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_texts(docs(spark, texts).repartition(3), tile=tile).collect()}
    assert got == brute(texts)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for size in [6, 7, 8, 9, 10, 11, 12, 13, 17, 18, 30, 47, 48, 49, 100, 333, 1000, 5000]:
        for _ in range(30):
            base = rng.integers(0, 1 << 63, size + 400, dtype=np.uint64) * np.uint64(2)
            a = np.unique(base[:size])
            # As different as a link allows: elements are swapped, or the other set is smaller or larger.
            swapped = size * 15 // 200
            b = np.unique(np.r_[a[swapped:], base[size : size + swapped]]) if rng.random() < 0.5 else np.unique(a[: -(-85 * size // 100)])
            a, b = (x[np.sort(rng.permutation(len(x)))] for x in (a, b))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                assert set(signatures(a).tolist()) & set(signatures(b).tolist())
                assert least_distances(*(np.frombuffer(parity(x), np.uint64) for x in (a, b))) <= most_distance(len(a), len(b))


def test_bands_meet():
    for size in range(6, 4000):
        for other in {size, size * 100 // 85}:
            assert {n for n, _ in tags(size)} & {n for n, _ in tags(other)}
        assert all(high >= size for _, high in tags(size))


def test_many_empty_cells_keep_their_signatures():
    crowded = np.arange(40, dtype=np.uint64)  # all in one cell
    other = np.arange(37, dtype=np.uint64)
    assert set(signatures(crowded).tolist()) & set(signatures(other).tolist())


def test_large_buckets_pass_in_steps(spark, monkeypatch):
    monkeypatch.setattr(partenum, "TILE", 4)
    rng = random.Random(7)
    base = prose(rng, 300, 5000).split()
    texts = []
    for i in range(30):
        words = list(base)
        words[rng.randrange(300)] = f"new{i}"
        texts.append(" ".join(words))
    got = similar_texts(docs(spark, texts), tile=4).collect()
    assert {r["component_id"] for r in got} == {0} and brute(texts)[29][1] == 0


def test_rows_without_words_ids_or_peers(spark):
    some = "one two three four five six seven eight nine ten"
    got = similar_texts(docs(spark, [None, "", " \t", some, some, some, "solo"], ids=[4, 2, None, 9, None, 7, 7])).collect()
    assert sorted(map(str, [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got])) == sorted(map(str, [(4, 0, 4), (2, 0, 2), (None, 0, None), (9, 7, 7), (None, 7, 7), (7, 7, 7), (7, 1, 7)]))
    assert similar_texts(docs(spark, [])).count() == 0


def test_shingle_hashes_count_distinct_shingles():
    assert len(shingles(b"a b c d a b c d a b c d", 4)) == 4


def test_copies_of_one_text_that_are_not_near_each_other(spark):
    """Most are near the base alone; all are joined through it, whichever comes first, and few pairs are told."""
    import pyarrow as pa

    from postmill.llm.partenum import _across, node

    rng = random.Random(9)
    base = prose(rng, 400, 50_000).split()
    texts = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(5, 395, 5), 8):
            words[k] = f"new{i}.{k}"
        texts.append(" ".join(words))
    texts.insert(30, " ".join(base))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_texts(docs(spark, texts)).collect()}
    assert got == brute(texts) and {c for _, c in got.values()} == {0}
    sets = [shingles(t.encode(), 4) for t in texts]
    fps = [node(x) for x in sets]
    rows = pa.RecordBatch.from_pydict({"key": [1] * 61, "fp": fps, "comp": fps, "size": [len(x) for x in sets], "side": [-1] * 61, "parity": [parity(x) for x in sets]})
    assert sum(b.num_rows for b in _across(iter([rows]), False)) <= 60 <= sum(b.num_rows for b in _across(iter([rows]), True))


@pytest.mark.parametrize("off", [{1}, {1, 2}])
def test_links_of_later_comparisons_are_enough(spark, monkeypatch, off):
    """As if no pair of the first comparisons had been a link: what they try isn't counted as tried either."""
    verified, left, calls = partenum.verified, partenum._pairs_left, []

    def some(pairs, nodes, docs):
        calls.append(1)
        found = verified(pairs, nodes, docs)
        return found.limit(0) if len(calls) in off else found

    monkeypatch.setattr(partenum, "verified", some)
    monkeypatch.setattr(partenum, "_pairs_left", lambda members, comps, nodes, tried, whole, tile: left(members, comps, nodes, tried.limit(0), whole, tile))
    texts = corpus(3, 25)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_texts(docs(spark, texts)).collect()}
    assert got == brute(texts) and len(calls) == 3


def test_words_are_hashed_once_each(monkeypatch):
    """Runs of words are named by the hashes of their words: no run is joined and hashed as a text."""
    from postmill.llm import jaccard

    told = []
    digest = jaccard.xxhash.xxh64_intdigest
    monkeypatch.setattr(jaccard.xxhash, "xxh64_intdigest", lambda x, *seed: told.append(x) or digest(x, *seed))
    found = shingles(b"A b c d e f a B", 4)
    assert told == [b"a", b"b", b"c", b"d", b"e", b"f", b"a", b"b"] and len(found) == 5
    assert set(found[np.isin(found, shingles(b"b c d e f", 4))]) == set(shingles(b"b c d e f", 4)) and len(shingles(b"b c d e f", 4)) == 2
