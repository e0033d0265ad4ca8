"""Listings from short descriptions, and comparison with DuckDB."""

from __future__ import annotations

import glob
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def listing(spark, *entries):
    """Entries ``(path, type, size, mtime)``; missing ones default to a folder / file of 1 byte, 2025-01-01."""
    rows = [("/", "", "", "/", "", "folder", None, "2025-01-01T00:00:00Z")]
    for path, *rest in entries:
        kind, size, mtime = (*rest, *(None,) * 3)[:3]
        kind = kind or "folder"
        parent, _, name = path.rpartition("/")
        rows.append((path, parent or "/", parent or "/", path, name, kind, None if kind == "folder" else 1 if size is None else size, mtime or "2025-01-01T00:00:00Z"))
    return spark.createDataFrame(rows, "service_id string, parent_service_id string, parent_path string, path string, name string, type string, size long, mtime string")


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{sf}/{t}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    value = value.item() if hasattr(value, "item") else value
    return int(value) if isinstance(value, float) and value == int(value) else value


def same(df, con, sql: str) -> None:
    """The rows of ``df`` and of ``sql`` are equal, in any order, by column name."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    at = {n: i for i, n in enumerate(names)}
    want = sorted(repr(tuple(plain(r[at[c]]) for c in columns)) for r in got.fetchall())
    have = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.toPandas().to_dict("records"))
    assert have == want
