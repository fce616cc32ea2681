import re

import pytest

from postmill.llm.licenses import ALLOWED, BASE, EXCEPTION_IDS, LICENSE_IDS, Identifiers, evaluate, license_report, license_scan, postfix, scan
from tests.llm.fixtures import awkward, docs


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT", ["mit"]),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]),
        ("(MIT OR Apache-2.0) AND X", ["mit", "apache-2.0", "or", "x", "and"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0 or MIT", ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or"]),
        ("a and b or c and d", ["a", "b", "and", "c", "d", "and", "or"]),
        ("MIT and then prose", ["mit", "then", "and"]),
        ("MIT */ rest", ["mit"]),
        ("((MIT))", ["mit"]),
        ("MIT) rest", ["mit"]),
        ("(MIT", ["mit", "?", "and"]),
        ("MIT AND", ["mit", "?", "and"]),
        ("(MIT OR", ["mit", "?", "or", "?", "and"]),
        ("OR MIT", ["?", "mit", "or"]),
        ("(MIT OR\n * Apache-2.0)", ["mit", "apache-2.0", "or"]),
        ("MIT OR\r\n# Apache-2.0 AND\n#\tISC", ["mit", "apache-2.0", "isc", "and", "or"]),
        ("MIT\nOR Apache-2.0", ["mit"]),
        ("(MIT\n*/ x", ["mit", "?", "and"]),
        ("", []),
        ("()", ["?"]),
    ],
)
def test_shunting_yard(text, want):
    assert postfix(text) == want


def test_evaluation():
    verdict = lambda t: evaluate(postfix(t)).allowed
    assert verdict("MIT") and verdict("GPL-3.0 OR MIT") and verdict("GPL-3.0 AND MIT") is False and verdict("GPL-2.0 WITH MIT") is None
    assert verdict("MIT OR x") and verdict("x OR MIT") and verdict("MIT AND x") is None and verdict("GPL-3.0 AND x") is False and verdict("GPL-3.0 OR x") is None
    got = evaluate(postfix("GPL-2.0-or-later WITH x OR MIT+"))
    assert got.names == {"gpl-2.0", "mit"} and got.unknown == {"x"} and got.allowed


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for i in range(len(words)) for phrase, label in BASE.items() if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    "Released under the MIT License. Mit-license MIT license mit licenses",
    "GNU General Public License, version 3. general public license", "the apache\nlicense, Version 2.0 and more", "permit license", "mit  License", "mit " * 50 + "license",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode", "SPDX-License-Identifier: GPL-3.0-only", "Licensed under CC BY-NC 4.0.", "licence", "É mit license É",
    "SPDX-License-Identifier: OR OR", ("filler " * 20_000) + "mit license",
]


def test_base_equals_brute_force(spark):
    texts = TEXTS + awkward()
    got = {r["doc_id"]: r for r in license_report(docs(spark, texts).repartition(2)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"] or "SPDX" in (t or ""))
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))


def test_expressions_and_verdicts(spark):
    got = {r["doc_id"]: r for r in license_scan(docs(spark, TEXTS)).collect()}
    assert got[6]["expressions"] == ["mit apache-2.0 or"] and got[6]["allowed"] and got[6]["names"] == ["apache-2.0", "mit"]
    assert got[7]["allowed"] is False and got[8]["names"] == ["cc-by-nc-4.0"] and got[8]["allowed"] is False
    assert got[9]["allowed"] is None and got[11]["expressions"] == ["? ? or ? or"] and got[11]["allowed"] is False
    assert license_report(docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("line", "names", "allowed"),
    [
        ("MITRE-CVE", [], False), ("see file for details", [], False), ("MIT see file", ["mit"], True), ("MIT-0", ["mit-0"], True), ("Apache-2.0+ OR GPL-2.0-or-later", ["apache-2.0", "gpl-2.0"], True),
        ("LicenseRef-Own AND MIT", ["licenseref-own", "mit"], False), ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2.0"], False), ("Apache-2.0 WITH LLVM-exception", ["apache-2.0"], True),
        ("LGPL-3.0-only WITH LGPL-3.0-linking-exception", ["lgpl-3.0"], True), ("GPL-2.0 WITH the rest", ["gpl-2.0"], False), ("(MIT AND see) file", ["mit"], False), ("mit AND (isc OR x)", ["isc", "mit"], True),
        # What can't be read whole is never allowed.
        ("MIT AND Elastic-2.0", ["mit"], False), ("MIT AND NAIST-2003", ["mit"], False), ("MIT AND (GPL-2.0-only OR Elastic-2.0)", ["gpl-2.0", "mit"], False), ("MIT WITH foo-exception", ["mit"], False),
        ("Elastic-2.0", [], False), ("MIT-CMU", [], False), ("BSD-2-Clause-Views", [], False), ("MIT OR Elastic-2.0", ["mit"], True), ("MIT AND", ["mit"], False), ("(MIT OR ISC", ["isc", "mit"], False),
        ("(MIT OR\n * GPL-3.0-only)", ["gpl-3.0", "mit"], True), ("(MIT AND\n// GPL-3.0-only)", ["gpl-3.0", "mit"], False), ("MIT\n * AND more", ["mit"], True), ("", [], None),
    ],
)
def test_only_whole_identifiers_are_licenses(line, names, allowed):
    got = scan(f"/* SPDX-License-Identifier: {line} */\n".encode())
    assert got["names"] == names and got["allowed"] is allowed and (got["score"] > 0) == (allowed is not None)


def test_the_list_of_identifiers_is_a_parameter(spark):
    text = "SPDX-License-Identifier: MIT AND Elastic-2.0"
    assert scan(text.encode())["unknown"] == ["elastic-2.0"]
    ids = Identifiers(LICENSE_IDS | {"elastic-2.0"})
    got = license_scan(docs(spark, [text]), allowed=(*ALLOWED, "elastic-2.0"), ids=ids).first()
    assert got["names"] == ["elastic-2.0", "mit"] and got["unknown"] == [] and got["allowed"]
    assert not license_scan(docs(spark, [text]), ids=ids).first()["allowed"]


def test_exceptions_are_kept_and_denials_weigh_little():
    assert scan(b"SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0")["exceptions"] == ["classpath-exception-2.0"]
    denied, plain = scan(b"There is no MIT license here"), scan(b"under the MIT license")
    assert denied["names"] == plain["names"] == ["mit"] and denied["score"] < 0.2 < plain["score"]
    assert all(x == x.lower() for x in LICENSE_IDS | EXCEPTION_IDS) and not LICENSE_IDS & EXCEPTION_IDS and Identifiers().known("bsd-2-clause") and not Identifiers().known("mit", True) and "mit" in ALLOWED


def test_phrases_equal_the_query_in_sql(spark, tmp_path):
    from postmill.llm.queries import ORACLE_SQL, QUERIES
    from tests.oracle import same

    texts = [t for t in TEXTS if "SPDX" not in t] + [t for t in awkward() if t is None or "\x0b" not in t] + ["not the MIT license", "no one says mit license", "BSD license, CC0 1.0 and all rights reserved"]
    docs(spark, texts, ids=[None, *range(1, len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    assert same(spark, QUERIES["op2_licenses"], ORACLE_SQL["op2_licenses"], str(tmp_path)) == len(texts)
