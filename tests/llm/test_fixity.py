import gzip
import hashlib
import io
import random
import tracemalloc
import zlib
from pathlib import Path

import pytest

from postmill.llm import fixity
from postmill.llm.fixity import audit, damaged_pages, levels_for, merkle_levels, mismatching_leaves, packed_records, page_audit, read_warc, records_of, warc_index, write_warc
from postmill.llm.sql import ORACLE_SQL
from tests.oracle import same

#: Further columns have names that the operator uses itself.
SCHEMA = "page_id long, url string, html string, offset long, record string, nth int, file string, status string"


def pages(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"http://h{i % 5}/{i}", "x" * rng.randrange(5000)) for i in range(n)]
    rows += [(None, None, None), (None, "u", "y"), (3, None, "é"), (3, None, "é"), (9000, "u", ""), (-5, "u", "z" * 90_000)]
    return spark.createDataFrame([(*r, None, "r", 1, "f", "s") for r in rows], SCHEMA)


def listed(index):
    return sorted(((r["file"], r["offset"], r["length"], r["record"], r["page_id"]) for r in index.collect()), key=str)


def test_offsets_and_hashes_are_those_of_the_bytes(spark):
    got = sorted(warc_index(pages(spark, 50)).where("file = 0").collect(), key=lambda r: r["offset"])
    at = 0
    for r in got:
        assert r["offset"] == at
        at += r["length"]
    body = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Target-URI: \r\nContent-Length: 2\r\n\r\n\xc3\xa9\r\n\r\n"
    assert [r["length"] for r in got if r["record"] == hashlib.sha256(body).hexdigest()] == [len(body)] * 2


def test_files_read_back_have_the_index(spark, tmp_path):
    table = pages(spark, 600)
    write_warc(table, str(tmp_path / "warc"))
    assert listed(read_warc(spark, str(tmp_path / "warc"))) == listed(warc_index(table))


def test_damaged_bytes_are_located(spark, tmp_path):
    """Two replicas as files, one with bytes changed, a record cut out and a record's header broken."""
    table = pages(spark, 700)
    for name in ("a", "b"):
        write_warc(table, str(tmp_path / name))
    paths = {int(p.parent.name[5:]): p for p in Path(tmp_path / "b").glob("file=*/part-*")}
    data = bytearray(gzip.decompress(paths[1].read_bytes()))
    places = list(records_of(bytes(data)))
    at = places[40][0] + places[40][1] - 10
    data[at] ^= 1
    paths[1].write_bytes(gzip.compress(bytes(data)))
    data = gzip.decompress(paths[2].read_bytes())
    at, size, _, lost = list(records_of(data))[100]
    data = bytearray(data[:at] + data[at + size :])
    broken = list(records_of(bytes(data)))[150]
    data[broken[0] : broken[0] + 4] = b"XXXX"
    paths[2].write_bytes(gzip.compress(bytes(data)))
    first, second = (read_warc(spark, str(tmp_path / x)) for x in "ab")
    got = audit(first, second).collect()
    by = lambda s: sorted(r["page_id"] for r in got if r["status"] == s and r["page_id"] is not None)
    assert by("changed") == [places[40][3]] and by("missing") == sorted([lost, broken[3]])
    assert {r["file"] for r in got if r["status"] == "moved"} == {2} and [r["file"] for r in got if r["status"] == "surplus"] == [2]
    levels = levels_for(first, second)
    leaves = mismatching_leaves(merkle_levels(first, levels), merkle_levels(second, levels)).collect()
    assert sum(r["file"] == 1 for r in leaves) == 1 and {r["file"] for r in leaves} == {1, 2}


def reader(data):
    return io.BytesIO(data).read


def members(data):
    """Where each member of a packed file begins and ends."""
    at, out = 0, []
    while at < len(data):
        one = zlib.decompressobj(31)
        one.decompress(data[at:])
        out.append((at, len(data) - len(one.unused_data)))
        at = out[-1][1]
    return out


def packed(spark, tmp_path, n=60):
    write_warc(pages(spark, n), str(tmp_path / "one"))
    (path,) = Path(tmp_path / "one").glob("file=0/part-*")
    return path.read_bytes()


def test_records_are_members_of_their_own(spark, tmp_path):
    data = packed(spark, tmp_path)
    intact = list(records_of(gzip.decompress(data)))
    assert len(members(data)) == len(intact) == 62 and list(packed_records(reader(data))) == intact
    assert list(packed_records(reader(gzip.decompress(data)))) == intact  # not packed
    assert list(packed_records(reader(gzip.compress(gzip.decompress(data))))) == intact  # all in one member
    assert list(packed_records(reader(b""))) == []


@pytest.mark.parametrize("step", [1 << 16, 100])
def test_a_flipped_byte_changes_one_record(spark, tmp_path, monkeypatch, step):
    """Anywhere in a packed record: header, data, sum, length."""
    monkeypatch.setattr(fixity, "READ", step)
    data = packed(spark, tmp_path)
    intact = list(packed_records(reader(data)))
    rng = random.Random(2)
    spans = members(data)
    places = [(k, at) for k in (0, 17, 61) for b, e in [spans[k]] for at in [b, b + 2, b + 3, b + 8, b + 12, (b + e) // 2, e - 9, e - 8, e - 4, e - 1]] + [(k, rng.randrange(*spans[k])) for k in range(62)]
    for k, at in places:
        bad = bytearray(data)
        bad[at] ^= 1 << rng.randrange(8)
        got = list(packed_records(reader(bytes(bad))))
        same_ = [a == b for a, b in zip(got, intact, strict=False)]
        assert len(got) == 62 and all(x for j, x in enumerate(same_) if j != k), (k, at - spans[k][0])
        assert got[k][:2] == intact[k][:2] and got[k][3] in (intact[k][3], None)


def test_lost_and_strange_bytes(spark, tmp_path):
    data = packed(spark, tmp_path)
    intact, spans = list(packed_records(reader(data))), members(data)
    cut = data[: spans[30][1] - 20] + data[spans[31][0] :]  # a member's end is lost
    got = list(packed_records(reader(cut)))
    assert len(got) == 62 and [r[2:] for r in got[31:]] == [r[2:] for r in intact[31:]] and got[:30] == intact[:30] and got[30][3] in (intact[30][3], None)
    short = list(packed_records(reader(data[: spans[50][1] - 5])))
    assert short[:50] == intact[:50] and len(short) == 51
    noise = random.Random(3).randbytes(100_000)
    got = list(packed_records(reader(data[: spans[9][1]] + noise + data[spans[10][0] :])))
    assert got[:10] == intact[:10] and [r[2:] for r in got[11:]] == [r[2:] for r in intact[10:]]
    one = bytearray(gzip.compress(gzip.decompress(data)))
    one[len(one) * 3 // 4] ^= 4
    got = list(packed_records(reader(bytes(one))))
    assert len(got) > 20 and got[:20] == intact[:20] and got != intact and sum(r[1] for r in got) == sum(r[1] for r in intact)


def test_packed_damage_is_located(spark, tmp_path):
    table = pages(spark, 300)
    for name in ("a", "b"):
        write_warc(table, str(tmp_path / name))
    (path,) = Path(tmp_path / "b").glob("file=0/part-*")
    data = bytearray(path.read_bytes())
    b, e = members(bytes(data))[100]
    data[(b + e) // 2] ^= 1
    path.write_bytes(data)
    got = audit(read_warc(spark, str(tmp_path / "a")), read_warc(spark, str(tmp_path / "b"))).collect()
    assert [(r["file"], r["status"]) for r in got if r["status"] != "same"] == [(0, "changed")]


def test_a_large_file_is_read_in_bounded_memory():
    """Half a gigabyte of records, made as they are read."""
    body = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 4000000\r\n\r\n" + b"x" * 4_000_000 + b"\r\n\r\n"
    made = iter(gzip.compress(body % k, 1) for k in range(130))
    buffer = bytearray()

    def read(n):
        while len(buffer) < n and (more := next(made, None)):
            buffer.extend(more)
        out = bytes(buffer[:n])
        del buffer[:n]
        return out

    tracemalloc.start()
    got = [(r[1], r[3]) for r in packed_records(read)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [k for _, k in got] == list(range(130)) and most < 64 << 20


def test_audit_equals_plain_comparison(spark, monkeypatch, tmp_path):
    """The query in SQL over ids that are null, repeated, negative, lost, altered and doubled."""
    monkeypatch.setattr(fixity, "LEAF_BITS", 10)
    table = pages(spark, 3200)
    table.select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    assert levels_for(warc_index(table)) > 3
    same(spark, lambda s, d: page_audit(s.read.parquet(f"{d}/pages.parquet")), ORACLE_SQL["op3_fixity"], str(tmp_path))
    got = [r["status"] for r in page_audit(table).collect()]
    assert set(got) == {"same", "moved", "changed", "missing", "surplus"} and got.count("changed") == 4


def test_an_often_repeated_id_is_dealt_to_several_files(spark):
    table = spark.range(500).selectExpr("1 AS page_id", "'u' AS url", "concat('x', id % 100) AS html")
    index = warc_index(table, file_rows=50)
    assert index.select("file").distinct().count() > 5 and index.count() == 500
    assert {r["status"] for r in audit(index, index).collect()} == {"same"}


def test_one_root_for_a_file_and_equal_replicas(spark):
    index = warc_index(pages(spark, 300))
    top = merkle_levels(index, levels_for(index))[-1]
    assert top.count() == top.select("file").distinct().count() == 6  # two of 300 ids, one large id, one negative, two without
    assert {r["status"] for r in audit(index, index).collect()} == {"same"}


def test_empty_tables(spark):
    none = pages(spark, 0).limit(0)
    assert page_audit(none).count() == 0 and damaged_pages(none).count() == 0
    index = warc_index(pages(spark, 5))
    assert {r["status"] for r in audit(index, warc_index(none)).collect()} == {"missing"}
    assert {r["status"] for r in audit(warc_index(none), index).collect()} == {"surplus"}
