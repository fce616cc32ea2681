import random

import pytest

from postmill.llm.jaccard import near_copies
from postmill.llm.simhash import deduplicate, fingerprint
from tests.llm.fixtures import awkward, docs, prose


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts):
    """By all pairs."""
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in range(len(texts))}


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        text = prose(rng, rng.randrange(60, 300), 2000)
        texts += [text, edited(rng, text, 1), edited(rng, text, 2), edited(rng, text, 12)]
    chain = prose(rng, 200, 2000)
    for _ in range(30):  # neighbours are alike, ends are not
        chain = edited(rng, chain, 2)
        texts.append(chain)
    return texts


def test_edited_copies_are_dropped(spark):
    rng = random.Random(3)
    texts = [prose(rng, 60, 2000) for _ in range(40)]
    copies = [edited(rng, t, 1) for t in texts]
    far = sum((fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count() > 4 for a, b in zip(texts, copies, strict=True))
    assert far > 10  # the fingerprints of op4 do not link these
    kept = deduplicate(docs(spark, texts + copies).repartition(3))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


@pytest.mark.parametrize("tile", [3, 2048])
def test_components_equal_all_pairs(spark, tile):
    texts = corpus() + [t for t in awkward() if t is None or len(t) < 5000]
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs(spark, texts).repartition(3), tile=tile).collect()}
    want = components([t and "".join(c.lower() if c.isascii() else c for c in t) for t in texts])
    none = [i for i, t in enumerate(texts) if not grams(t)]
    assert got == want | {i: none[0] for i in none}


def test_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet").limit(400).checkpoint()
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    want = {rows[root][0] for root in components([t for _, t in rows]).values()}
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, table, sf).collect()} == want
