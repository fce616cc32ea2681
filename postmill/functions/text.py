"""Text and date functions of postings, as columns.

Whitespace is what ECMAScript calls so (it includes NBSP, U+3000 and U+FEFF), in every function
here; Spark's own `trim` and `\\s` know ASCII only. A null counts as an empty text unless said
otherwise. Lengths are those of ECMAScript too: units of UTF-16, of which a character beyond the basic plane has two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: whitespace of ECMAScript as a character class, for Java and RE2 alike.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# Characters that keys leave out; the listing's key keeps the ellipsis.
KEY_MARKS = r"[()\[\]「」『』【】·\-_,.]"
CRAWL_KEY_MARKS = r"[()\[\]「」『』【】·\-_,.…]"
# What separates tokens of a title, parts of dates and counts in it, and words to skip.
TOKEN_MARKS = r"[()\[\]<>「」『』【】〔〕·\-_,.…:：!！?？《》]"
TOKEN_CUTS = (r"\d{4}년?", r"\d+월\d*일?", rf"\d+{WS}*(?:월|일|차|기|명|분)")
STOPWORDS = (
    "채용공고 채용 공고 모집공고 모집 안내 시험 공개 경쟁 시행 관련 관련공고 알림 공지 접수 추가 "
    "재공고 수정공고 변경공고 정정공고 취소공고 긴급공고 일반 특별 외부 내부 신입 경력 직원 직원채용 "
    "인재 인재채용 인원 선발 선발공고 계획 계획공고 20 21 22 23 24 25 26"
).split()
# Units of a title, and of the beginning by which it is found.
TITLE_LENGTH = 80
CORE_LENGTH = 20
# Fixed value: characters that are two units.
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(c: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once a row: a column written twice is computed twice, and its code doubles."""
    return F.get(F.transform(F.array(c), made), F.lit(0))


def trim(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), rf"^{WS}+|{WS}+\z", "")


def squeeze(c: Column | str) -> Column:
    """Runs of whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(_text(c), f"{WS}+", " "))


def units(c: Column) -> Column:
    """The length of a text in units of UTF-16."""
    return F.length(c) + F.regexp_count(c, F.lit(ASTRAL))


def first_units(c: Column, count: int) -> Column:
    """The first units of a text; half a character that is left at the end becomes U+FFFD, as when it is written as UTF-8."""
    coded = F.encode(c, "UTF-16BE")
    split = F.hex(F.substring(coded, 2 * count - 1, 1)).between("D8", "DB")
    piece = lambda n: F.decode(F.substring(coded, 1, 2 * n), "UTF-16BE")
    return F.when(~c.rlike(ASTRAL), F.left(c, F.lit(count))).when(split, F.concat(piece(count - 1), F.lit("\ufffd"))).otherwise(piece(count))


def truncate(c: Column | str, length: int = TITLE_LENGTH) -> Column:
    """The squeezed text, cut with three dots if it is longer than `length` units.

    Of a long text, only the beginning with `length` + 1 characters other than whitespace is squeezed: what follows it
    can't show. A text has no more units than bytes, so short ones aren't looked at further.
    """
    solid = WS.replace("[", "[^", 1)
    begin = F.regexp_extract(_text(c), f"^{WS}*((?:{solid}{WS}*){{0,{length + 1}}})", 1)
    text = squeeze(F.when(F.octet_length(_text(c)) > 8 * length, begin).otherwise(_text(c)))
    return once(text, lambda t: F.when(F.octet_length(t) <= length, t).when(units(t) > length, F.concat(first_units(t, length), F.lit("..."))).otherwise(t))


def or_default(*choices: Column | str) -> Column:
    """The first choice that is neither null nor empty, the last one failing that."""
    columns = [F.col(c) if isinstance(c, str) else c for c in choices]
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns[:-1]), columns[-1])


def normalize_date(c: Column | str) -> Column:
    """`YYYY-MM-DD` of a text that begins with a date of points or dashes, blanks left out first.

    Two-digit years are of this century; months and days aren't checked. Other texts come back trimmed.
    Because blanks go first, an hour after a one-digit day joins the day (`2026.3.1 12:30` is the 11th).
    """
    bare = F.replace(F.regexp_replace(_text(c), WS, ""), F.lit("."), F.lit("-"))
    parts = F.split(F.regexp_extract(bare, r"^(?:\d{4}|\d{2})-\d{1,2}-\d{1,2}", 0), "-")
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    date = lambda p: F.concat(year(p[0]), F.lit("-"), F.lpad(p[1], 2, "0"), F.lit("-"), F.lpad(p[2], 2, "0"))
    return once(parts, lambda p: F.when(F.size(p) == 3, date(p)).otherwise(trim(c)))


def normalize_date_strict(c: Column | str) -> Column:
    """As `normalize_date`, but blanks end a date, slashes are read, and only real dates count; else null."""
    pattern = rf"^{WS}*(\d{{4}}|\d{{2}}){WS}*[./-]{WS}*(\d{{1,2}}){WS}*[./-]{WS}*(\d{{1,2}})(?!\d)"
    part = lambda i: F.regexp_extract(_text(c), pattern, i)
    year = F.when(F.length(part(1)) == 2, F.concat(F.lit("20"), part(1))).otherwise(part(1))
    return F.try_to_date(F.concat_ws("-", year, F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd").cast("string")


# Fixed value: a date in running text; alternatives are tried in this order, so a day of two digits
# that begins with 1 to 9 gives its first digit.
DATE_IN_TEXT = rf"(20\d{{2}}|\d{{2}})[-./년]{WS}*(0?[1-9]|1[0-2])[-./월]{WS}*(0?[1-9]|[12]\d|3[01])일?"
DATE_IN_TEXT_STRICT = rf"(20\d{{2}}|\d{{2}})[-./년]{WS}*(1[0-2]|0?[1-9])[-./월]{WS}*([12]\d|3[01]|0?[1-9])일?"


def extract_dates(c: Column | str, strict: bool = False) -> Column:
    """All dates in a text as `YYYY-MM-DD`; `strict` reads days of two digits whole."""
    pattern = F.lit(DATE_IN_TEXT_STRICT if strict else DATE_IN_TEXT)
    years, months, days = (F.regexp_extract_all(_text(c), pattern, F.lit(i)) for i in (1, 2, 3))
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.transform(F.arrays_zip(years.alias("y"), months.alias("m"), days.alias("d")), lambda z: F.concat_ws("-", year(z["y"]), F.lpad(z["m"], 2, "0"), F.lpad(z["d"], 2, "0")))


def optional_date(c: Column | str) -> Column:
    """The normalized date, or null for an empty text."""
    return F.when(_text(c) != "", normalize_date(c))


def crawl_key(title: Column | str) -> Column:
    """What two postings' titles share if they are the same posting, when boards are gathered."""
    return F.lower(F.regexp_replace(F.regexp_replace(_text(title), WS, ""), CRAWL_KEY_MARKS, ""))


def view_key(title: Column | str) -> Column:
    """The same when postings are listed: here the ellipsis counts."""
    return F.lower(F.regexp_replace(F.regexp_replace(_text(title), WS, ""), KEY_MARKS, ""))


def title_tokens(title: Column | str) -> Column:
    """Telling words of a title in order, repeats included: two units or more, no dates or stop words."""
    text = F.regexp_replace(_text(title), TOKEN_MARKS, " ")
    for cut in TOKEN_CUTS:
        text = F.regexp_replace(text, cut, " ")
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(squeeze(text), " "), lambda t: ((F.length(t) >= 2) | t.rlike(ASTRAL)) & ~F.array_contains(stop, t))


def title_core(title: Column | str) -> Column:
    """The beginning of a title by which it is found in a page's text."""
    return trim(first_units(F.regexp_replace(_text(title), r"\.\.\.\z", ""), CORE_LENGTH))


def dotted(date: Column | str) -> Column:
    return F.replace(_text(date), F.lit("-"), F.lit("."))


def minute(time: Column | str) -> Column:
    """`YYYY.MM.DD HH:mm` in the session's zone, or a dash for no time."""
    return F.coalesce(F.date_format(time, "yyyy.MM.dd HH:mm"), F.lit("-"))


def bracketed_organization(title: Column | str, default: Column | str, anywhere: bool = False) -> Column:
    """The text in the square brackets that a title begins with (or holds anywhere)."""
    return or_default(F.regexp_extract(_text(title), r"\[([^\]]+)\]" if anywhere else r"^\[([^\]]+)\]", 1), F.lit(default))


def called_id(link: Column | str, function: str) -> Column:
    """The number that a script link passes, as in `javascript:open('12')`; null if there is none."""
    return F.nullif(F.regexp_extract(_text(link), rf"{function}\('(?:1',')?(\d+)'\)", 1), F.lit(""))
