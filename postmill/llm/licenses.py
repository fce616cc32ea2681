"""License scans: notice phrases by Aho-Corasick, SPDX expressions by shunting-yard.

One automaton holds all notice phrases and the identifier tag as words between spaces, and
runs once over each text's words. Where it meets a tag, the expression after it is read from
the raw text, over several lines where it goes on, turned into postfix order by a shunting-yard parser, and evaluated with
three values. Only whole identifiers of the SPDX list (a parameter) and `LicenseRef-` names are licenses. Any other operand
is unknown: what hangs on it is never allowed, and neither is an expression that breaks off. A phrase shortly after a
word of denial counts as found, but as weak evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import item_words, over_texts

# Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notices and their labels, as words.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "apache license version 2 0": "apache-2.0",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "free and unencumbered software released into the public domain": "unlicense",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "cc0 1 0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "all-rights-reserved",
}

# The more common SPDX identifiers of licenses in lower case, without "-only", "-or-later" and "+", and of exceptions.
# The whole list, which grows with each release, is given as a parameter; what it lacks is unknown, and so not allowed.
LICENSE_IDS = frozenset("""
0bsd aal adsl afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-1.0 apsl-2.0
artistic-1.0 artistic-1.0-perl artistic-2.0 beerware bittorrent-1.1 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent
bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsd-source-code bsl-1.0 busl-1.1 bzip2-1.0.6 cal-1.0 cc-by-1.0 cc-by-2.0
cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0
cc-by-nd-4.0 cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc-pddc cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.0 cecill-2.1
cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.0 eupl-1.1 eupl-1.2 fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3
gpl-1.0 gpl-2.0 gpl-3.0 hpnd icu ijg intel ipl-1.0 isc json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libpng-2.0 libtiff lppl-1.3c
mit mit-0 mit-modern-variant mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa nist-pd npl-1.1 ntp
odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openldap-2.8 openssl osl-1.0 osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0
qpl-1.0 ruby sgi-b-2.0 sleepycat sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.1
""".split())  # fmt: skip
EXCEPTION_IDS = frozenset("""
autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 ecos-exception-2.0
font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 lgpl-3.0-linking-exception libtool-exception linux-syscall-note
llvm-exception ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 swift-exception u-boot-exception-2.0
universal-foss-exception-1.0 wxwindows-exception-3.1
""".split())  # fmt: skip

#: Labels, and licenses with an exception, that a policy accepts unless others are given.
ALLOWED = (
    "mit", "mit-0", "apache", "apache-1.1", "apache-2.0", "bsd", "bsd-1-clause", "bsd-2-clause", "bsd-3-clause", "isc", "bsl-1.0", "unlicense", "cc0", "cc0-1.0", "cc-by-4.0",
    "mpl", "mpl-2.0", "zlib", "0bsd", "lgpl-3.0 with lgpl-3.0-linking-exception", "apache-2.0 with llvm-exception",
)

#: How sure a kind of evidence makes us that a text is under a license.
WEIGHTS = {"tag": 0.95, "notice": 0.8, "base": 0.6, "unread": 0.3, "denied": 0.1}
# Words that deny a phrase after them, at most so many words before it.
DENIALS, NEAR = frozenset("no not never neither nor without isn aren wasn except".split()), 3

_TAG = "spdx license identifier"
_TAG_MARK = re.compile(rb"SPDX-License-Identifier[ \t]*:", re.IGNORECASE)
_TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.\-:+]*)")
#: From one line to the next: what begins a line of a comment is passed over.
_NEXT_LINE = re.compile(rb"[ \t]*(?:\\[ \t]*)?\r?\n[ \t]*(?:(?:\*(?!/)|//+|#+|--+|;+|%+|\.\.|<!--|REM\b|dnl\b)[ \t]*)?")
_RANK = {"or": 1, "and": 2, "with": 3}


def base_id(term: str) -> str:
    """A license's identifier without what says which later versions it covers."""
    return term.rstrip("+").removesuffix("-or-later").removesuffix("-only")


@dataclass(frozen=True)
class Identifiers:
    """The identifiers of licenses and exceptions that are known, in lower case."""

    licenses: frozenset[str] = LICENSE_IDS
    exceptions: frozenset[str] = EXCEPTION_IDS

    def known(self, term: str, exception: bool = False) -> bool:
        if exception:
            return term in self.exceptions
        return base_id(term) in self.licenses or term.startswith(("licenseref-", "documentref-"))


def tokens_of(text: bytes, at: int = 0) -> Iterator[str]:
    """Tokens of the expression that begins at a place: to the end of the line, and beyond while it can't be at its end."""
    depth, open_ = 0, False
    while True:
        m = _TOKEN.match(text, at)
        if not m and (depth or open_) and (line := _NEXT_LINE.match(text, at)):
            m = _TOKEN.match(text, line.end())
        if not m:
            return
        token, at = m[1].decode(), m.end()
        depth += (token == "(") - (token == ")")
        open_ = token.lower() in _RANK
        yield token


#: Stands for an operand that isn't there.
MISSING = "?"


def postfix(tokens: Iterable[str] | str) -> list[str]:
    """Operands and operators of a license expression in postfix order, in lower case; empty if there is none.

    It ends where no operator follows an operand, or at a bracket that closes none, as prose may come then. What an operator or an
    open bracket still waits for is the operand MISSING. WITH binds closest, then AND, then OR, all from the left.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens_of(tokens.encode()) if isinstance(tokens, str) else tokens:
        low = token.lower()
        if token == "(":
            if not operand_next:
                break
            stack.append(token)
        elif token == ")":
            if "(" not in stack:
                break
            if operand_next:
                out.append(MISSING)
                operand_next = False
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _RANK:
            if operand_next:
                out.append(MISSING)
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(low.rstrip(".:"))
            operand_next = False
    if operand_next and (out or stack):
        out.append(MISSING)
    broken = False
    while stack:
        if (top := stack.pop()) == "(":
            broken = True
        else:
            out.append(top)
    return [*out, MISSING, "and"] if broken else out


@dataclass(frozen=True)
class Verdict:
    """Licenses, exceptions and unknown operands of an expression, and whether it can be met with allowed licenses: None if that isn't known."""

    names: frozenset[str]
    exceptions: frozenset[str]
    unknown: frozenset[str]
    allowed: bool | None


def evaluate(terms: list[str], allowed: tuple[str, ...] = ALLOWED, ids: Identifiers = Identifiers()) -> Verdict:
    """The verdict on a postfix expression.

    OR is met by either side, AND by both, as far as it is known. WITH adds an exception, which only loosens a license: both
    together are allowed if the license is, or if `allowed` has them as one name. An exception that isn't known may be none, so
    with it nothing is known.
    """
    stack: list[tuple[Verdict, str]] = []
    none: frozenset[str] = frozenset()
    for nth, term in enumerate(terms):
        if term not in _RANK:
            exception = ids.known(term, True) and nth + 1 < len(terms) and terms[nth + 1] == "with"
            if exception:
                stack.append((Verdict(none, frozenset([term]), none, None), term))
            elif ids.known(term):
                stack.append((Verdict(frozenset([base_id(term)]), none, none, base_id(term) in allowed), term))
            else:
                stack.append((Verdict(none, none, frozenset([term]), None), term))
            continue
        (b, exception), (a, _) = stack.pop(), stack.pop()
        if term == "with":
            # A license's own name can't stand for an exception.
            unknown = a.unknown | b.unknown | (frozenset([exception]) if b.names else none)
            known = not b.unknown and not b.names
            ok = (a.allowed or any(f"{x} with {exception}" in allowed for x in a.names)) if known and a.allowed is not None else None
            stack.append((Verdict(a.names, a.exceptions | b.exceptions, unknown, ok), ""))
            continue
        sides = (a.allowed, b.allowed)
        decides = term == "or"
        ok = decides if decides in sides else None if None in sides else not decides
        stack.append((Verdict(a.names | b.names, a.exceptions | b.exceptions, a.unknown | b.unknown, ok), ""))
    return stack[0][0]


@cache
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("base", BASE), ("tag", {_TAG: ""})):
        for phrase, label in phrases.items():
            machine.add_word(f" {phrase} ", (kind, label, len(phrase), phrase.count(" ") + 1))
    machine.make_automaton()
    return machine


def scan(text: bytes | None, allowed: tuple[str, ...] = ALLOWED, ids: Identifiers = Identifiers()) -> dict:
    """What one text says of licenses: its words, the spans of phrases, expressions, labels, score."""
    words = item_words(text)
    line = b" ".join([b"", *words, b""]).decode(errors="replace")
    spans, kinds, verdicts, expressions, exceptions = [], set(), [], [], set()
    labels: set[str] = set()
    unknown: set[str] = set()
    seen = counted = 0
    tagged = False
    for end, (kind, label, size, n) in _automaton().iter(line):
        # Matches come by their last character; the word index follows by counting spaces on the way.
        counted += line.count(" ", seen, end)
        seen = end
        if kind == "tag":
            tagged = True
            continue
        start = counted - n
        spans.append((start, n, label, kind))
        labels.add(label)
        denied = any(w.decode(errors="replace") in DENIALS for w in words[max(0, start - NEAR) : start])
        kinds.add("denied" if denied else kind)
        verdicts.append(label in allowed)
    for mark in _TAG_MARK.finditer(text) if tagged else ():
        if terms := postfix(tokens_of(text, mark.end())):
            verdict = evaluate(terms, allowed, ids)
            labels |= verdict.names
            exceptions |= verdict.exceptions
            unknown |= verdict.unknown
            verdicts.append(verdict.allowed is True)
            expressions.append(" ".join(terms))
            kinds.add("tag" if verdict.names else "unread")
    doubt = 1.0
    for kind in sorted(kinds):
        doubt *= 1 - WEIGHTS[kind]
    return {
        "n_words": len(words), "spans": [dict(zip(("start", "n", "label", "kind"), s, strict=True)) for s in sorted(spans)],
        "expressions": expressions, "exceptions": sorted(exceptions), "unknown": sorted(unknown), "names": sorted(labels), "allowed": all(verdicts) if verdicts else None, "score": 1 - doubt,
    }


_SCHEMA = "n_words long, spans array<struct<start:long,n:long,label:string,kind:string>>, expressions array<string>, exceptions array<string>, unknown array<string>, names array<string>, allowed boolean, score double"
_SPAN = pa.struct([("start", pa.int64()), ("n", pa.int64()), ("label", pa.string()), ("kind", pa.string())])
_TYPES = {"n_words": pa.int64(), "spans": pa.list_(_SPAN), "expressions": pa.list_(pa.string()), "exceptions": pa.list_(pa.string()), "unknown": pa.list_(pa.string()), "names": pa.list_(pa.string()), "allowed": pa.bool_(), "score": pa.float64()}


def license_scan(docs: DataFrame, id_col: str = "doc_id", allowed: tuple[str, ...] = ALLOWED, ids: Identifiers = Identifiers()) -> DataFrame:
    """For each row of `docs`: `id_col`, `n_words`, `spans` (start and length in words, label and kind
    of each phrase), `expressions` (postfix), `exceptions` and `unknown` operands (named in them), `names` (labels), `allowed` (whether every
    statement is known to be met with allowed licenses; null without any), `score` (0 to 1, by the kinds of evidence).

    Null and empty texts have no words, no spans, a null verdict and score 0. Repeated rows each give
    a row, an empty table none; other columns are ignored.
    """

    def step(batch: list[bytes | None]) -> dict:
        rows = [scan(t, allowed, ids) for t in batch]
        return {c: pa.array([r[c] for r in rows], kind) for c, kind in _TYPES.items()}

    return over_texts(docs, [id_col], _SCHEMA, step)


def license_report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The scan as one row of digests for each row of `docs`: places of base phrases and label lists.

    Null and empty texts have no words, no places (null), empty label lists and score 0; repeated rows each give a
    row, null ids too; an empty table none; other columns are ignored.
    """
    base = F.filter("spans", lambda s: s["kind"] == "base")
    starts = F.transform(base, lambda s: s["start"])
    labels = F.array_sort(F.array_distinct(F.transform(base, lambda s: s["label"])))
    return license_scan(docs, id_col).select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"), F.array_join("names", ",").alias("labels"), "score", "allowed",
    )


# Tags as they are put behind texts to be scanned, what they name and what isn't known of it, and whether they can be met.
TAGS = (
    ("MIT", "mit", "", True), ("(MIT OR Apache-2.0)", "apache-2.0,mit", "", True), ("GPL-3.0-only AND MIT", "gpl-3.0,mit", "", False), ("MIT AND Elastic-2.0", "mit", "elastic-2.0", False),
    ("Elastic-2.0 OR ISC", "isc", "elastic-2.0", True), ("MIT WITH foo-exception", "mit", "foo-exception", False), ("Apache-2.0 WITH LLVM-exception see NOTICE", "apache-2.0", "", True), ("(MIT AND", "mit", "?", False),
    ("see the file COPYING", "", "see", False), ("GPL-2.0-or-later OR\n// (BSD-3-Clause AND\n// LicenseRef-own)", "bsd-3-clause,gpl-2.0,licenseref-own", "", False),
)


def tagged_scan(docs: DataFrame) -> DataFrame:
    """The scan of texts that each have one of TAGS behind them, by their ids: `unknown`, `tag_names` (without labels of phrases) and `allowed`."""
    tags = F.array(*(F.lit(f"\n// SPDX-License-Identifier: {t[0]}\n") for t in TAGS))
    text = F.concat(F.coalesce("text", F.lit("")), F.element_at(tags, (F.col("doc_id") % len(TAGS) + 1).cast("int")))
    said = license_scan(docs.select("doc_id", text.alias("text")))
    # The operands of the last expression, which is the tag put there.
    last = F.split(F.element_at("expressions", -1), " ")
    named = F.filter(last, lambda x: ~x.isin(*_RANK, "?") & ~F.array_contains(said["unknown"], x) & ~F.array_contains("exceptions", x))
    bare = F.transform(named, lambda x: F.regexp_replace(x, r"(\+|-only|-or-later)\z", ""))
    return said.select("doc_id", F.array_join(said["unknown"], ",").alias("unknown"), F.array_join(F.array_sort(bare), ",").alias("tag_names"), "allowed")
