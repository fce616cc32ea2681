"""Small tables that hold what every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, window string, key long, m long"


def rows(texts, ids=None, langs=None):
    """Rows of documents with extra columns whose names clash with inner ones."""
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    return [(i, t, lang, "src0", None if t is None else len(t), "x", 1, None) for i, t, lang in zip(ids, texts, langs, strict=True)]


def docs(spark, texts, ids=None, langs=None):
    return spark.createDataFrame(rows(texts, ids, langs), SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=1):
    """Null, empty, blank, one word, very long, odd characters, and repeated texts."""
    rng = random.Random(seed)
    long = prose(rng, 30_000)
    some = prose(rng, 120)
    return [None, "", " \t\n\x0b ", "Word", "ÀÉ ñandú 中文 \U0001f600 x", "a b c d", long, some, some, some + " tail", "A B C D E F G H " * 40, "line one\nline one\n\nline two", prose(rng, 60)]
