"""Fill-in-middle transformation by escaped marker injection, in columns alone.

A delimiter is appended to every unit of a text: the delimiter and the escape character are escaped first, so that
what is injected can't stand in the text; `regexp_replace` appends it, the number of units is its count, and the parts
between two ranks are cut by `substring_index`. Parts are unescaped and put together with the sentinels of the form.
Rows are independent: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, about so many stay plain, and of a hundred of the others so many have the suffix first.
PLAIN_SHARE, SUFFIX_FIRST_SHARE = 10, 20
#: The injected delimiter, the escape character, and what stands for each in an escaped text.
MARK, ESCAPE, ESCAPED_ESCAPE, ESCAPED_MARK = "\x1e", "\x1d", "\x1d0", "\x1d1"
#: A unit of an escaped text: a code point, escaped or not.
UNIT = f"(?s)({ESCAPE}.|[^{ESCAPE}])"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(MARK), F.lit(ESCAPED_MARK))


def unescaped(marked: Column) -> Column:
    """The text of a piece of a marked text."""
    bare = F.replace(marked, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPED_MARK), F.lit(MARK)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with the mark behind each of its units."""
    return F.regexp_replace(escaped(text), UNIT, f"$1{MARK}")


def units(marked_text: Column) -> Column:
    return (F.length(marked_text) - F.length(F.replace(marked_text, F.lit(MARK), F.lit("")))).cast("long")


def up_to(marked_text: Column, rank: Column) -> Column:
    """The first `rank` units with marks between them; the units behind the last `-rank` marks if it is negative."""
    return F.call_function("substring_index", marked_text, F.lit(MARK), rank.cast("int"))


def behind(marked_text: Column, rank: Column, n: Column) -> Column:
    """The units after the first `rank` of `n`; a marked text ends with a mark, so its last piece is empty."""
    return up_to(marked_text, rank - n - 1)


def draws(id_col: str, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers that a document's id decides: groups of eight digits of the SHA-256 of `1:` and the id.

    A null id draws like an empty text.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_share: int = PLAIN_SHARE, suffix_first_share: int = SUFFIX_FIRST_SHARE) -> DataFrame:
    """`docs` with `n` (code points), `form` (plain, psm or spm), `prefix`, `middle`, `suffix` (null if plain) and `output`.

    Columns of these names are replaced, all others stay, whatever they are called. A null text counts as empty;
    empty texts, and those that hold a sentinel, are plain: their output is the text itself. Repeated rows and rows of
    one id are cut at the same draws; an empty table gives an empty one. A text is held whole with a byte for each code
    point besides (some 1 GB is the most that a column can hold); no part of it is left out.
    """
    made = ("n", "form", "prefix", "middle", "suffix", "output")
    others = [c for c in docs.columns if c not in made]
    # Inner columns are longer than any name of the table.
    text, key, mark, form, a, b, n = (f"{x}{'_' * max(map(len, docs.columns))}_" for x in ("text", "key", "mark", "form", "a", "b", "n"))
    c = F.col
    rows = docs.select(*(c(f"`{x}`") for x in others), F.coalesce(c(f"`{text_col}`"), F.lit("")).alias(text), c(f"`{id_col}`").alias(key))
    h1, h2, h3, h4 = draws(key)
    whole = (c(text) == "") | c(text).contains(PREFIX) | c(text).contains(SUFFIX) | c(text).contains(MIDDLE) | (h3 % 100 >= 100 - plain_share)
    rows = rows.withColumns({form: F.when(whole, "plain").when(h4 % 100 < suffix_first_share, "spm").otherwise("psm"), mark: marked(c(text))})
    rows = rows.withColumn(n, units(c(mark)))
    rows = rows.withColumns({a: F.least(h1 % (c(n) + 1), h2 % (c(n) + 1)), b: F.greatest(h1 % (c(n) + 1), h2 % (c(n) + 1))})
    cut = c(form) != "plain"
    parts = rows.withColumns({
        "prefix": F.when(cut, unescaped(up_to(c(mark), c(a)))),
        "middle": F.when(cut, unescaped(up_to(behind(c(mark), c(a), c(n)), c(b) - c(a)))),
        "suffix": F.when(cut, unescaped(behind(c(mark), c(b), c(n)))),
    })
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(c(form) == "psm", psm).when(c(form) == "spm", spm).otherwise(c(text))
    return parts.select(*(c(f"`{x}`") for x in others), c(n).alias("n"), c(form).alias("form"), "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made of, by its form alone.

    A text that was cut holds no sentinel, and no sentinel overlaps another, so each stands where it was put.
    """
    o, f = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    rest = F.substring(o, F.lit(len(PREFIX) + 1), F.length(o))
    behind_first = lambda mark: F.substring_index(rest, mark, -1)
    psm = F.concat(F.substring_index(rest, SUFFIX, 1), F.substring_index(rest, MIDDLE, -1), F.substring_index(behind_first(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(behind_first(PREFIX), MIDDLE, 1), F.substring_index(rest, MIDDLE, -1), F.substring_index(rest, PREFIX, 1))
    return F.when(f == "psm", psm).when(f == "spm", spm).otherwise(o)


def infilling_report(docs: DataFrame) -> DataFrame:
    """What `infilled` made of each document, as lengths and digests: the result of the registered query."""
    made = infilled(docs.select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(restored(), "UTF-8"), 256).alias("restored_sha256"),
    )
