import random

import corpus_pipeline
from postmill.llm.common import written
from postmill.llm.decontaminate import contamination
from postmill.llm.queries import ORACLE_SQL, QUERIES
from postmill.llm.simhash import deduplicate
from tests.llm.fixtures import awkward, docs, prose
from tests.llm.test_jaccard import components

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [table]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == table.columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    known = [i for i in ids[0] if i in labels]
    good, poor = ([i for i in known if labels[i][0] == q] for q in (1, 0))
    assert sum(i in ids[1] for i in good) > 0.95 * len(good) and sum(i in ids[1] for i in poor) < 0.1 * len(poor)

    # One document of each group of five-word shingles at 0.8, by brute force over all pairs.
    rows = sorted((r["doc_id"], r["text"]) for r in kept[1].collect())
    group = components([text for _, text in rows])
    assert ids[2] == {rows[i][0] for i, first in group.items() if i == first} and kept[2].count() == len(ids[2])

    hit = {r["doc_id"] for r in contamination(kept[2], benchmark).collect() if r["contaminated"]}
    assert hit and ids[3] == ids[2] - hit
    assert sum(i in ids[4] for i in ids[3] if labels.get(i) == (1, 0)) > 0.9 * sum(labels.get(i) == (1, 0) for i in ids[3])

    last = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in kept[4].collect())
    sizes = [sum(r["shard"] == s for r in last) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_empty_and_awkward_documents(spark, tmp_path):
    """All stages over a table without rows, and over one of rows without text, id or peers."""
    from shutil import copy

    for name, table in (("none", docs(spark, [])), ("odd", docs(spark, awkward() * 2, ids=[None, *range(len(awkward()) * 2 - 1)]))):
        (tmp_path / name).mkdir()
        for t in ("benchmark", "labels"):
            copy(f"{SF}/{t}.parquet", tmp_path / name)
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(rows) == 0) == (name == "none") and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_deduplicate_awkward_rows(spark):
    rng = random.Random(1)
    text = prose(rng, 200)
    table = docs(spark, [text, text, text + " more", prose(rng, 200), None, "", text], ids=[5, 5, 3, None, None, 9, None])
    got = deduplicate(table)
    assert got.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["3", "9", "None"]
    assert deduplicate(table.limit(0)).count() == 0
    assert deduplicate(docs(spark, awkward())).count() < len(awkward())


def test_names_follow_the_contract():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(ORACLE_SQL) <= set(QUERIES)
