import random
import re

import pytest

from postmill.llm import decontaminate
from postmill.llm.decontaminate import contamination, items_digest, remove_contaminated, remove_spans
from tests.llm.fixtures import awkward, docs, prose


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for item, content in items:
        w = words_of(content)
        size = min(13, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), len(found), items_digest(list(found)), bool(hit) and 20 * len(hit) >= len(words)


def case(seed):
    rng = random.Random(seed)
    items = [(k, prose(rng, rng.choice([3, 12, 13, 14, 40]))) for k in range(20)] + [(20, None), (21, "!!"), (22, "Straße ÜBER"), (None, prose(rng, 20)), (3, prose(rng, 15)), (30, prose(random.Random(0), 20))]
    texts = awkward(seed)
    for _ in range(60):
        parts = [prose(rng, rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            i = rng.randrange(len(w) + 1)
            parts += [rng.choice([" ".join(w), " ".join(w[i:]), ", ".join(w).upper()]), prose(rng, rng.randrange(40))]
        texts.append(" ".join(parts))
    return texts + ["straße ÜBER, straße Über straße über"], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts, items = case(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in contamination(docs(spark, texts).repartition(3), bench).collect()}
    named = [(i, t) for i, t in items if i is not None]
    for k, t in enumerate(texts):
        n_words, n_hit, n_items, digest, bad = brute(t, items)
        _, _, n_items, digest, _ = brute(t, named)  # an item without id makes hits, but isn't listed
        assert got[k] == (n_words, n_hit, n_items, digest, bad)
    assert any(g[4] for g in got.values()) and any(g[1] and not g[4] for g in got.values())


def test_a_large_test_set_that_is_joined_gives_the_same(spark):
    texts, items = case(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs(spark, texts + texts[-3:], ids=[None, *range(1, len(texts)), *range(len(texts) - 3, len(texts))]).repartition(3)
    for f in (contamination, remove_contaminated, remove_spans):
        whole, joined = (sorted(map(str, f(table, bench, limit=n).collect())) for n in (10**6, 40))
        assert whole == joined and f(table.limit(0), bench, limit=40).count() == 0
    assert remove_spans(table, bench, limit=40).columns == table.columns


def test_removals_of_rows_without_id_or_test_set(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    table = docs(spark, ["One two, three four", "one two three four", None, "", "a b"], ids=[None, None, None, 3, 3])
    assert sorted(str(r["text"]) for r in remove_contaminated(table, bench).collect()) == ["", "None", "a b"]
    assert sorted(str(r["text"]) for r in remove_spans(table, bench).collect()) == ["", "", "", "None", "a b"]
    assert remove_contaminated(table, bench.limit(0)).count() == 5 and remove_spans(table, bench.limit(0)).count() == 5
    assert remove_contaminated(table.limit(0), bench).count() == 0


def test_removals(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string")
    passage = "One two, three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = "word " * 400
    texts = [f"a {passage}! b", long + passage, "clean", None, ""]
    table = docs(spark, texts)
    kept = remove_contaminated(table, bench)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in remove_spans(table, bench).collect()}
    assert cut == {0: "a ! b", 1: long, 2: "clean", 3: None, 4: ""}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = contamination(docs(spark, ["a", None]), none).collect()
    assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == [(0, 0, False), (1, 0, False)]
    assert contamination(docs(spark, []), none).count() == 0
    assert decontaminate.WINDOW == 13
