"""Merkle fixity audit of WARC records.

Each record's bytes are hashed with their place; ordered ranges of offsets are hashed from their records, and
ranges of ranges from these, up to a root for each file. Two replicas are compared from the roots
down, and only branches whose hashes differ are descended, so that where replicas agree no record is
looked at again. Everything is a grouping by file and range number: a level is a constant number of
offset bits, and no file's hashes meet in one task below the few top nodes.

A replica is indexed from its records as they would stand in WARC files (`warc_index`), or from WARC files that
are read back (`write_warc`, `read_warc`).
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from postmill.llm.common import checkpoint
from postmill.sources.page_source import file_system

#: Bits of an offset that a leaf covers (16 KB), and that each level above adds (16 children).
LEAF_BITS, LEVEL_BITS = 14, 4
#: Pages of a WARC file, by ranges of their ids, and files that pages without id are dealt to.
FILE_PAGES = 256
LOOSE_FILES = 1 << 16
#: Rows of a file beyond which, if ids repeat, its rows are dealt to several by their hashes; the first file's number plus multiples of SPLIT.
FILE_ROWS, SPLIT = 1 << 16, 1 << 40

_END = "\r\n\r\n"


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record of a page without its two line ends: header lines, an empty line, the payload."""
    payload = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(_END), payload,
    )


def _filed(pages: DataFrame, id_col: str, file_pages: int, body: bool) -> DataFrame:
    """`file`, `length`, `record` and `id_col` of each page, and `body` if asked for."""
    record = warc_record(F.col(id_col), F.col("url"), F.col("html"))
    whole = F.concat(record, F.lit(_END))
    text = F.concat_ws("\x1f", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    loose = -1 - F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("long") % LOOSE_FILES
    file = F.coalesce(F.floor(F.col(id_col) / file_pages), loose).cast("long")
    # The texts are hashed where they are read.
    return pages.select(id_col, file.alias("file"), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("record"), *([record.alias("body")] if body else []))


def _split_large(rows: DataFrame, file_rows: int) -> DataFrame:
    """Rows of files with more than `file_rows` (ids that repeat) dealt to several files."""
    sizes = checkpoint(rows.groupBy("file").count().where(F.col("count") > file_rows).select("file", F.ceil(F.col("count") / file_rows).alias("_n")))
    if sizes.isEmpty():
        return rows
    bucket = F.conv(F.substring("record", 1, 8), 16, 10).cast("long") % F.coalesce("_n", F.lit(1))
    return rows.join(sizes, "file", "left").withColumn("file", F.col("file") + bucket * SPLIT).drop("_n")


def warc_index(pages: DataFrame, id_col: str = "page_id", file_pages: int = FILE_PAGES, file_rows: int = FILE_ROWS) -> DataFrame:
    """`file`, `offset`, `length`, `record` (SHA-256 of the bytes), `id_col` and `nth` of each page, laid out by id in WARC files.

    A file holds a range of `file_pages` ids; pages without id are dealt to files with negative numbers by their URL
    and text; rows of one id lie in the order of their records' hashes, which `nth` numbers. A null URL or
    text counts as empty. An empty table gives an empty index.
    """
    # Only numbers and hashes move.
    rows = _split_large(checkpoint(_filed(pages, id_col, file_pages, False)), file_rows)
    own = Window.partitionBy("file").orderBy(F.col(id_col).asc_nulls_first(), "record")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy("file", id_col).orderBy("record"))
    return rows.select("file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "record", id_col, nth.alias("nth"))


class WarcWriter(DataSourceWriter):
    """Writes rows (`file`, `body`), sorted by file in a partition, as `file=<number>/part-0.warc.gz`: a gzip member for each record.

    A file is written under its final name by the one task that has its rows, so a task that is run again writes the same.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, root = file_system(self.path)
        for number, records in groupby(rows, key=lambda r: r["file"]):
            files.create_dir(f"{root}/file={number}", recursive=True)
            with files.open_output_stream(f"{root}/file={number}/part-0.warc.gz", compression=None) as out:
                for r in records:
                    out.write(gzip.compress(r["body"].encode() + _END.encode(), mtime=0))
        return WriterCommitMessage()


class WarcFiles(DataSource):
    """The sink of `write_warc`."""

    @classmethod
    def name(cls) -> str:
        return "warc_files"

    def schema(self) -> str:
        return "file long, body string"

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", file_pages: int = FILE_PAGES) -> None:
    """Writes `pages` as WARC files below `path`, one in each folder `file=<number>`, in the order of the index.

    Each record is a gzip member of its own, as the format wants, so that damage stays in its record. A file's rows meet
    in one task, which holds one record at a time.
    """
    rows = _filed(pages, id_col, file_pages, True).repartition("file").sortWithinPartitions("file", F.col(id_col).asc_nulls_first(), "record")
    pages.sparkSession.dataSource.register(WarcFiles)
    rows.select("file", "body").write.format(WarcFiles.name()).mode("append").save(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*\r\n")
_LENGTH, _ID = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.IGNORECASE), re.compile(rb"\r\nWARC-Record-ID: *<urn:page:(-?\d+)>\r\n", re.IGNORECASE)
#: Bytes read at a time, most bytes of a record's header, and most packed bytes that are kept to look for the next member after damage.
READ, MOST_HEADER, KEPT = 1 << 16, 1 << 16, 1 << 26
#: Packed bytes of a step towards damage.
STEP = 64
#: A record may be declared this long at most; a longer one is a broken header.
MOST_RECORD = 1 << 31

Record = tuple[int, int, str, int | None]


def _id_of(head: bytes) -> int | None:
    number = _ID.search(head)
    return int(number[1]) if number else None


class Records:
    """Offset, length, SHA-256 and page id of the records of unpacked bytes that come in pieces; one record is held at a time.

    Bytes that are no record (a broken header, a payload cut short) are one record without id up to the next header.
    """

    def __init__(self) -> None:
        self.at, self.held, self.need = 0, bytearray(), 0

    def _cut(self, size: int, number: int | None) -> Record:
        made = (self.at, size, hashlib.sha256(self.held[:size]).hexdigest(), number)
        del self.held[:size]
        self.at, self.need = self.at + size, 0
        return made

    def fed(self, piece: bytes, last: bool = False) -> Iterator[Record]:
        self.held += piece
        while self.held and (last or len(self.held) >= self.need):
            head = _HEAD.match(self.held)
            if not head and not last and len(self.held) < MOST_HEADER and b"\r\n\r\n" not in self.held:
                return
            size = _LENGTH.search(head[0]) if head else None
            end = head.end() + int(size[1]) + len(_END) if size else MOST_RECORD + 1
            if end <= MOST_RECORD and len(self.held) < end and not last:
                self.need = end
                return
            if end <= len(self.held) and self.held[end - len(_END) : end] == _END.encode():
                yield self._cut(end, _id_of(head[0]))
                continue
            following = self.held.find(b"WARC/1.", 1)
            if following < 0 and not last:
                self.need = len(self.held) + READ
                return
            yield self._cut(following if following > 0 else len(self.held), None)

    def damaged(self, packed: bytes, size: int, beginning: bytes) -> Record:
        """What was held is the beginning of a record of a damaged member, whose unpacked rest is `size` bytes: it counts as its packed bytes."""
        head = _HEAD.match(self.held or beginning)
        made = (self.at, size, hashlib.sha256(packed).hexdigest(), _id_of(head[0]) if head else None)
        self.at, self.held, self.need = self.at + size, bytearray(), 0
        return made


def records_of(data: bytes) -> Iterator[Record]:
    """The records of a WARC file's unpacked bytes."""
    return Records().fed(data, True)


def _header_end(data: bytes) -> int | None:
    """Where the header of a gzip member ends; None if there is none, or not all of it."""
    if len(data) < 10 or data[:3] != b"\x1f\x8b\x08" or data[3] & 0xE0:
        return None
    at, flags = 10, data[3]
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            at = data.find(b"\0", at) + 1
            if not at:
                return None
    at += 2 if flags & 2 else 0
    return at if at < len(data) else None


def _beginning(data: bytes, most: int = 7) -> bytes:
    """The first bytes that a member unpacks to; none if it has no header, or is damaged before."""
    try:
        return zlib.decompressobj(-15).decompress(data[end : end + most + READ], most) if (end := _header_end(data)) else b""
    except zlib.error:
        return b""


def _next_member(data: bytearray, start: int) -> int:
    """Where a member begins that unpacks to the beginning of a record; -1 if none does."""
    while (start := data.find(b"\x1f\x8b\x08", start)) >= 0:
        if _beginning(bytes(data[start : start + MOST_HEADER])) == b"WARC/1.":
            return start
        start += 1
    return -1


def packed_records(read: Callable[[int], bytes]) -> Iterator[Record]:
    """The records of a WARC file, packed or not, from a function that reads its next bytes.

    A member that can't be unpacked, or whose sum is wrong, is one record: by its id, if its header could be read, with the length that it says it
    had, and the hash of its packed bytes. What follows is found by its own beginning. Of a member of many records those before the
    damage are as they are, and the rest of it is one; if it unpacks, but its sum is wrong, its last record is told as damaged too.
    """
    found, raw = Records(), bytearray(read(READ))
    if b"WARC/1." in raw[:16]:  # not packed
        while raw:
            yield from found.fed(raw)
            raw = read(READ)
    while raw or (raw := bytearray(read(READ))):
        raw = yield from _member(found, raw, read)
    yield from found.fed(b"", True)


def _member(found: Records, used: bytearray, read: Callable[[int], bytes]) -> Iterator[Record]:
    """Records of the member that begins `used`; returns the bytes behind it."""
    begun, whole, total = found.at, True, 0
    waiting: Record | None = None  # the last one, until another begins behind it or the member's sum is right

    def told(piece: bytes) -> Iterator[Record]:
        nonlocal waiting
        records = [*((waiting,) * bool(waiting)), *found.fed(piece)]
        waiting = records.pop() if records and found.held[:7] != b"WARC/1." else None
        yield from records

    def more() -> bytes:
        nonlocal used, whole
        piece = read(READ)
        whole = whole and len(used) < KEPT  # of a longer member only the last bytes are kept
        if whole:
            used += piece
        elif piece:
            used = bytearray(piece)
        return piece

    while _header_end(used) is None and len(used) < MOST_HEADER and more():
        pass
    if end := _header_end(used):
        inflate, piece = zlib.decompressobj(-15), bytes(used[end:])
        try:
            while piece:
                before = inflate.copy()
                out = inflate.decompress(piece)
                total = zlib.crc32(out, total)
                if inflate.eof:
                    tail = inflate.unused_data
                    while len(tail) < 8 and (piece := more()):
                        tail += piece
                    if tail[:4] == total.to_bytes(4, "little"):
                        yield from told(out)
                        yield from (waiting,) * bool(waiting)
                        return bytearray(tail[8:])
                    yield from told(out)
                    break
                yield from told(out)
                piece = more()
        except zlib.error:
            # What comes before the damage, in small steps.
            with suppress(zlib.error):
                for k in range(0, len(piece), STEP):
                    yield from told(before.decompress(piece[k : k + STEP]))
    number = None
    if waiting and found.held[:7] == b"WARC/1.":
        yield waiting
    elif waiting:  # what follows is no record: the damage is in this one
        found.at, number = found.at - waiting[1], waiting[3]
    start = 1
    while (at := _next_member(used, start)) < 0:
        start = max(1, len(used) - MOST_HEADER)
        if not more():
            break
    member = bytes(used if at < 0 else used[:at])
    beginning = next((b for most in (MOST_HEADER, 4096, 512) if (b := _beginning(member, most))), b"") if found.at == begun and whole else b""
    said = int.from_bytes(member[-4:], "little") - (found.at - begun)
    size = said if len(member) > 18 and 0 < said <= 1032 * len(member) else len(found.held) + (waiting[1] if number is not None else 0)
    if size or found.at == begun:
        made = found.damaged(member, size, beginning)
        yield (*made[:3], made[3] if number is None else number)
    return used[at:] if at >= 0 else bytearray()


def read_warc(spark: SparkSession, path: str, id_col: str = "page_id") -> DataFrame:
    """The index of WARC files that `write_warc` laid out, from their bytes, which are read in pieces; damage is told record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"file": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "record": pa.string(), id_col: pa.int64()}
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist(), strict=True):
                files, name = file_system(at)
                with files.open_input_stream(name, compression=None) as f:
                    records = packed_records(f.read)
                    while some := list(islice(records, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array([x] * len(some) if k == "file" else x, kind) for (k, kind), x in zip(kinds.items(), (file, *zip(*some, strict=True)), strict=True)], list(kinds))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.select(F.col("file").cast("long").alias("file"), "path").mapInArrow(run, f"file long, offset long, length long, record string, `{id_col}` long")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("file", id_col).orderBy("record")))


def _hash_of(parts: str, order: str) -> Column:
    """The hash of the group's hashes in order."""
    sorted_parts = F.array_sort(F.collect_list(F.struct(order, parts)))
    return F.sha2(F.array_join(F.transform(sorted_parts, lambda x: x[parts]), ""), 256)


def merkle_levels(index: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (`file`, `node`, `hash`) of each level from the leaves up; the last is one root for each file.

    A node's number is its offset without the bits that it covers. A leaf's hash covers the offset,
    length and hash of each record that begins in it, so lost, moved and surplus records show.
    """
    entry = F.sha2(F.concat_ws(":", F.col("offset"), F.col("length"), F.col("record")), 256)
    level = index.select("file", "offset", F.shiftright("offset", LEAF_BITS).alias("node"), entry.alias("entry"))
    # Records that begin in a leaf: at most its bytes divided by a header's length, unless rows overlap.
    found = [checkpoint(level.groupBy("file", "node").agg(_hash_of("entry", "offset").alias("hash")))]
    for _ in range(levels - 1):
        above = found[-1].withColumn("up", F.shiftright("node", LEVEL_BITS))
        found.append(checkpoint(above.groupBy("file", "up").agg(_hash_of("hash", "node").alias("hash")).withColumnRenamed("up", "node")))
    return found


def levels_for(*replicas: DataFrame) -> int:
    """Levels until every file has one node."""
    last = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas) >> LEAF_BITS
    levels = 1
    while last:
        last >>= LEVEL_BITS
        levels += 1
    return levels


def mismatching_leaves(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """Leaves (`file`, `node`) whose hashes differ, found from the roots down along differing branches."""
    at: DataFrame | None = None
    for a, b in zip(reversed(first), reversed(second), strict=True):
        if at is not None:
            a, b = (x.withColumn("up", F.shiftright("node", LEVEL_BITS)).join(at.withColumnRenamed("node", "up"), ["file", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.join(b.withColumnRenamed("hash", "other"), ["file", "node"], "full")
        at = both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")
    return checkpoint(at)


def audit(first: DataFrame, second: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Every record of either replica's index with `status`: `same`, `moved` (the same bytes at another offset),
    `changed`, `missing` (from the second) or `surplus` (only there); `file`, `offset`, `length`, `record`,
    `other_offset`, `other_record` and `id_col`.

    Only records in mismatching leaves are compared, by file, id and number within the id (rows without id
    too); all others are the same by their leaf's hash. Empty replicas have no records.
    """
    levels = levels_for(first, second)
    leaves = mismatching_leaves(merkle_levels(first, levels), merkle_levels(second, levels))
    first, second = (x.withColumn("node", F.shiftright("offset", LEAF_BITS)) for x in (first, second))
    clean = first.join(leaves, ["file", "node"], "left_anti").select("file", "offset", "length", "record", F.col("offset").alias("other_offset"), F.col("record").alias("other_record"), id_col, F.lit("same").alias("status"))
    a = first.join(leaves, ["file", "node"], "left_semi").drop("node").withColumn("_i", F.struct(id_col))
    b = second.join(leaves, ["file", "node"], "left_semi").select("file", "nth", F.struct(id_col).alias("_i"), F.col("offset").alias("other_offset"), F.col("length").alias("other_length"), F.col("record").alias("other_record"))
    both = a.join(b, ["file", "_i", "nth"], "full")
    status = (
        F.when(F.col("record").isNull(), "surplus").when(F.col("other_record").isNull(), "missing").when(F.col("record") != F.col("other_record"), "changed")
        .when(F.col("offset") != F.col("other_offset"), "moved").otherwise("same")
    )
    found = both.select("file", "offset", F.coalesce("length", "other_length").alias("length"), "record", "other_offset", "other_record", F.col(f"_i.{id_col}").alias(id_col), status.alias("status"))
    return clean.unionByName(found)


def damaged_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """`pages` as a damaged store would give them back: some payloads altered, some records lost or doubled.

    It stands in for a second replica where there is only one; ids decide what happens.
    """
    i = F.coalesce(F.col(id_col), F.lit(0))
    html = F.when(i % 997 == 13, F.concat(F.lit("#"), F.expr("substr(coalesce(html, ''), 2)"))).otherwise(F.col("html"))
    times = F.when(i % 3001 == 11, 2).otherwise(1)
    kept = pages.where(i % 2111 != 7).select(id_col, "url", html.alias("html"), F.array_repeat(F.lit(0), times).alias("_times"))
    return kept.select(id_col, "url", "html", F.explode("_times").alias("_time")).drop("_time")


def page_audit(pages: DataFrame) -> DataFrame:
    """The audit of `pages` as WARC files against the bytes of a damaged replica."""
    return audit(checkpoint(warc_index(pages)), checkpoint(warc_index(damaged_pages(pages))))


_BODY = """'WARC/1.1' || crlf || 'WARC-Type: response' || crlf || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || crlf || 'WARC-Target-URI: ' || coalesce(url, '')
      || crlf || 'Content-Length: ' || strlen(coalesce(html, '')) || crlf || crlf || coalesce(html, '') || crlf || crlf"""


def _laid_sql(name: str, source: str) -> str:
    return f"""
{name}_sized AS (
  SELECT page_id, coalesce(CAST(floor(page_id / {FILE_PAGES}) AS BIGINT), -1 - CAST('0x' || left(md5(coalesce(url, '') || chr(31) || coalesce(html, '')), 4) AS BIGINT)) AS file,
    strlen(body)::BIGINT AS length, sha256(body) AS record
  FROM (SELECT *, {_BODY} AS body FROM ({source}), (SELECT chr(13) || chr(10) AS crlf))),
{name} AS (
  SELECT file, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
    length, record, page_id, row_number() OVER (PARTITION BY file, page_id ORDER BY record) AS nth
  FROM {name}_sized)"""


#: The same rows by plain comparison of the two replicas' records, without trees.
PAGE_AUDIT_SQL = f"""
WITH {_laid_sql("a", "SELECT page_id, url, html FROM pages")},
damaged AS (SELECT page_id, url, CASE WHEN coalesce(page_id, 0) % 997 = 13 THEN '#' || substr(coalesce(html, ''), 2) ELSE html END AS html, coalesce(page_id, 0) AS i FROM pages WHERE coalesce(page_id, 0) % 2111 <> 7),
{_laid_sql("b", "SELECT page_id, url, html FROM damaged UNION ALL SELECT page_id, url, html FROM damaged WHERE i % 3001 = 11")}
SELECT coalesce(a.file, b.file) AS file, a."offset" AS "offset", coalesce(a.length, b.length) AS length, a.record AS record, b."offset" AS other_offset, b.record AS other_record,
  coalesce(a.page_id, b.page_id) AS page_id,
  CASE WHEN a.record IS NULL THEN 'surplus' WHEN b.record IS NULL THEN 'missing' WHEN a.record <> b.record THEN 'changed' WHEN a."offset" <> b."offset" THEN 'moved' ELSE 'same' END AS status
FROM a FULL JOIN b ON a.file = b.file AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.nth = b.nth
"""
