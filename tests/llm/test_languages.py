import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import languages as lang_module
from postmill.llm.languages import Model, letters, languages, parser, suffix_automaton
from tests.llm.fixtures import awkward, docs

SYLLABLES = {"aa": ["tha", "ond", "er", "ing", "wor"], "bb": ["eau", "ment", "que", "ier", "oi"], "cc": ["lich", "ung", "sch", "pf", "tz"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def greedy_phrases(sample, seq):
    """Literal parse: the longest beginning that occurs in the sample, or one symbol."""
    count, i = 0, 0
    joined = ",".join(map(str, sample))
    occurs = lambda part: f",{','.join(map(str, part))}," in f",{joined},"
    while i < len(seq):
        j = i + 1
        while j < len(seq) and occurs(seq[i : j + 1]):
            j += 1
        count, i = count + 1, j
    return count


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(1)
    s = [rng.randrange(3) for _ in range(40)]
    table = suffix_automaton(s, 4)
    for _ in range(500):
        part = [rng.randrange(4) for _ in range(rng.randrange(1, 6))]
        state = 0
        for c in part:
            state = table[state, c] if state >= 0 else -1
        assert (state >= 0) == (f",{','.join(map(str, part))}," in f",{','.join(map(str, s))},")


def test_phrases_equal_the_literal_parse():
    rng = random.Random(2)
    model = Model({lang: [text(rng, lang, 60)] for lang in SYLLABLES})
    samples = {}
    rng = random.Random(2)
    for lang in SYLLABLES:
        samples[lang] = model.symbols[np.append(letters(text(rng, lang, 60).encode()), 0)].tolist()
    parts = [model.symbols[letters(text(rng, lang, n).encode())] for lang in SYLLABLES for n in (1, 5, 30)] + [model.symbols[letters("zzz qqq ment".encode())]]
    got = model.phrases(parts)
    for i, p in enumerate(parts):
        for j, lang in enumerate(model.langs):
            assert got[i, j] == greedy_phrases(samples[lang], p.tolist())


@pytest.mark.parametrize("piece", [1, 7, 256])
def test_long_texts_are_one_parse(monkeypatch, piece):
    """Texts of up to 30,000 letters against a parse from letter to letter, among them runs that never fall in step."""
    monkeypatch.setattr(lang_module, "PIECE", piece)
    rng = random.Random(7)
    model = Model({"aa": [text(rng, "aa", 60)], "bb": [text(rng, "bb", 80), "a" * 10]})
    n = 30_000 if piece == 256 else 2_000
    made = [text(rng, "bb", n // 6), "a" * n, "ab" * (n // 2), text(rng, "aa", 300) + "a" * 700 + text(rng, "bb", 300), "", "z" * 600]
    parts = [model.symbols[letters(t.encode())] for t in made]
    got = model.phrases(parts)
    for i, part in enumerate(parts):
        for j, lang in enumerate(model.langs):
            table, state, count = model.tables[lang], np.array([model.tables[lang].lost]), 0
            for c in part.tolist():
                state, begins = table.step(state, np.array([c]))
                count += int(begins[0])
            assert got[i, j] == count


def test_held_out_accuracy_and_odd_texts(spark):
    rng = random.Random(3)
    langs = [rng.choice(sorted(SYLLABLES)) for _ in range(400)]
    texts = [text(rng, lang, rng.randrange(3, 80)) for lang in langs]
    odd = [*awkward(), "12 34 !!", "中文"]
    table = docs(spark, texts + odd, langs=langs + [None] * len(odd))
    got = {r["doc_id"]: r for r in languages(table.repartition(3)).collect()}
    assert len(got) == 400 + len(odd)
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in range(400)]) > 0.98
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        t = (texts + odd)[i]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))


def test_labels_of_held_out_rows_change_nothing(spark):
    rng = random.Random(4)
    langs = [rng.choice(sorted(SYLLABLES)) for _ in range(120)]
    texts = [text(rng, lang, 20) for lang in langs]
    other = ["zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang for i, lang in enumerate(langs)]
    assert sorted(languages(docs(spark, texts, langs=langs)).collect()) == sorted(languages(docs(spark, texts, langs=other)).collect())


def test_nothing_to_learn(spark):
    got = languages(docs(spark, ["abc", None], ids=[None, 2], langs=[None, None])).collect()
    assert {r["lang_pred"] for r in got} == {"und"} and {r["score"] for r in got} == {0.0}
    assert languages(docs(spark, [])).count() == 0


@pytest.mark.parametrize("sample", [[0], [1, 1, 1]])
def test_parser_of_tiny_samples(sample):
    assert parser(suffix_automaton(sample, 2)).shape == ((len(sample) + 2) * 2,)


def script_texts(rng, n):
    """Two rare languages of large alphabets beside a common one that has 120 letters."""
    words = {lang: ["".join(chr(first + 3 * i + k) for k in range(3)) for i in range(100)] for lang, first in (("aa", 0xAC00), ("xx", 0x4E00), ("yy", 0x5E00))}
    words["aa"] = words["aa"][:40]
    langs = [rng.choices(["aa", "xx", "yy"], [8, 1, 1])[0] for _ in range(n)]
    return langs, ["".join(rng.choices(words[lang], k=120 if lang == "aa" else 15)) for lang in langs]


def test_rare_scripts_keep_their_letters(spark):
    langs, texts = script_texts(random.Random(6), 500)
    got = {r["doc_id"]: r["lang_pred"] for r in languages(docs(spark, texts, langs=langs)).collect()}
    assert np.mean([got[i] == lang for i, lang in enumerate(langs) if lang != "aa"]) > 0.98


def test_groups_of_languages_equal_one(spark):
    rng = random.Random(8)
    langs = [rng.choice(sorted(SYLLABLES)) for _ in range(150)]
    texts = [text(rng, lang, 20) for lang in langs]
    table = docs(spark, [*texts, None, "12", texts[0]], ids=[*range(150), None, 150, 0], langs=[*langs, None, None, None])
    key = lambda r: (str(r["doc_id"]), r["lang_pred"])
    one, two = (sorted(languages(table, group=g).collect(), key=key) for g in (3, 2))
    assert [key(r) for r in one] == [key(r) for r in two] and len(two) == 153
    assert [r["score"] for r in two] == pytest.approx([r["score"] for r in one])


def test_more_than_64_languages_are_learnt(spark):
    langs = [f"l{i % 70:02}" for i in range(1120)]
    texts = ["".join(chr(0x4E00 + 20 * (i % 70) + (i * 7 + k * k) % 20) for k in range(30)) for i in range(1120)]
    got = languages(docs(spark, texts, langs=langs)).collect()
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got]) > 0.98


def test_a_shared_beginning_hides_nothing(spark):
    rng = random.Random(9)
    langs = [rng.choice(sorted(SYLLABLES)) for _ in range(200)]
    header = "licence " * 400 + "1234 " * 600
    table = docs(spark, [header + text(rng, lang, 900) for lang in langs], langs=langs)
    bare = docs(spark, [text(rng, lang, 40) for lang in langs], ids=range(1000, 1200)).withColumn("lang", F.lit(None).cast("string"))
    got = {r["doc_id"]: r["lang_pred"] for r in languages(table.union(bare)).collect()}
    assert np.mean([got[1000 + i] == lang for i, lang in enumerate(langs)]) > 0.98
