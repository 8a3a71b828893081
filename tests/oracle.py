"""Runs a query and its SQL on the same files and compares rows without their order."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(f"{directory}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def same(df, connection, sql):
    found = connection.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    order = [found.columns.index(n) for n in names]
    expected = _plain(tuple(r[i] for i in order) for r in found.fetchall())
    assert _plain(tuple(r[n] for n in names) for r in df.collect()) == expected
