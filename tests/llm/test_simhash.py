import random
import re

import numpy as np
import pytest
import xxhash

from postmill.llm import simhash
from postmill.llm.components import connected_components
from postmill.llm.simhash import DISTANCE, fingerprint, links, near_duplicates
from tests.llm.fixtures import awkward, docs, prose


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(prints):
    """By all pairs."""
    root = dict.fromkeys(prints)
    root = {i: i for i in root}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= DISTANCE:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    texts = awkward(seed)
    for _ in range(25):
        base = prose(rng, rng.randrange(30, 400)).split()
        for _ in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = "Changed"
            texts.append(" ".join(words))
    return texts


def test_fingerprints_equal_the_definition():
    for t in corpus(1):
        assert fingerprint(None if t is None else t.encode()) == brute_print(t)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: r for r in near_duplicates(docs(spark, texts).repartition(3)).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == components(prints)


@pytest.mark.parametrize("tile", [3, 2048])
def test_tiles_lose_no_link(spark, tile):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = set()
    for c in centre.tolist():
        for _ in range(60):  # chains of close fingerprints that share most keys
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                c ^= 1 << b
            fps.add(c)
    fps = sorted(fps)
    signed = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    roots = {r["node"]: r["root"] for r in connected_components(links(spark.createDataFrame(signed, "fp long"), tile)).collect()}
    want = components({s[0]: x for s, x in zip(signed, fps, strict=True)})
    assert {k: roots.get(k, k) for k in want} == want


def test_keys_meet_every_close_pair(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), DISTANCE):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    met = spark.createDataFrame(pairs, "a long, b long").select(simhash._keys("a").alias("x"), simhash._keys("b").alias("y"))
    assert met.where("arrays_overlap(x, y)").count() == 300


def test_rows_without_words_ids_or_peers(spark):
    got = near_duplicates(docs(spark, [None, "", " ", "solo text here now", "same"], ids=[4, 2, None, 7, 7])).collect()
    assert sorted((r["component_id"], r["fingerprint"]) for r in got if r["fingerprint"] == "0" * 16) == [(2, "0" * 16)] * 3
    assert near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 200), (301, 300)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {300: 300, 301: 300}


def test_deduplicate_goes_by_fingerprints(spark, monkeypatch):
    """Copies are found by SimHash blocks alone when no MinHash band finds any, and exact sets decide."""
    import random

    import numpy as np

    from postmill.llm import jaccard
    from postmill.llm.simhash import deduplicate
    from tests.llm.fixtures import docs, prose

    monkeypatch.setattr(jaccard, "bands", lambda found: np.empty(0, np.int64))
    rng = random.Random(3)
    one, other = prose(rng, 400), prose(rng, 400)
    table = docs(spark, [one, one + " more", other, one.upper()], ids=[4, 3, 2, 1])
    assert sorted(r["doc_id"] for r in deduplicate(table).collect()) == [1, 2]
