"""Numbers that describe the style of a text, and bounded samples of rows to fit classifiers on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STYLE = (
    "log_words", "word_length", "distinct_words", "same_as_before", "capitals", "digits", "symbols", "exclamations",
    "stops", "other_marks", "beyond_ascii", "lines", "same_lines", "blanks",
)

_CAPITALS, _DIGITS = slice(0x41, 0x5B), slice(0x30, 0x3A)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)
_MARKS = np.frombuffer(b"\"'()-/=@[\\]^_`{}~+", np.uint8)
_BLANKS = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def style(text: bytes | None) -> np.ndarray:
    """The style of one whole text; zeros if it is null or empty."""
    out = np.zeros(len(STYLE), np.float32)
    if not text:
        return out
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = max(1, len(words)), len(text)
    letters = max(1, size - bytes_of[_BLANKS].sum())
    lines = [x for x in text.split(b"\n") if x]
    out[:] = (
        np.log1p(len(words)), letters / n / 10, len(set(words)) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        bytes_of[_CAPITALS].sum() / letters, bytes_of[_DIGITS].sum() / letters, bytes_of[_SYMBOLS].sum() / letters, bytes_of[0x21] / letters,
        bytes_of[_STOPS].sum() / letters, bytes_of[_MARKS].sum() / letters, bytes_of[0x80:].sum() / letters, len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)), 1 - letters / size,
    )
    out[3:] = np.sqrt(out[3:])  # spreads small shares
    return out


def bounded_sample(rows: DataFrame, id_col: str, limit: int, seed: int = 0) -> DataFrame:
    """At most `limit` of the rows that have an id: those whose id has the least hash.

    A hash threshold first leaves about four times as many, so that little is sorted at any size.
    """
    rows = rows.where(F.col(id_col).isNotNull())
    total = rows.count()
    draw = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 40))
    if total > 4 * limit:
        rows = rows.where(draw < int((1 << 40) * 4 * limit / total))
    return rows.orderBy(draw, id_col).limit(limit)


def fold(id_col: str, parts: int) -> F.Column:
    """The CRC-32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts
