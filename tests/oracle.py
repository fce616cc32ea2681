"""Runs a query and its SQL side by side."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        if isinstance(v, (list, tuple)):
            return str([value(x) for x in v])
        return str(v)

    return sorted([tuple(value(r[i]) for i in order) for r in rows])


def same(spark, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    got = frame.collect()
    cursor = duck(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(frame.columns) == sorted(names)
    a, b = normal(got, frame.columns), normal(want, names)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b, strict=True) if x != y][:3] == [y for x, y in zip(a, b, strict=True) if x != y][:3]
    return len(a)
