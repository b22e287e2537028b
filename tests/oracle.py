"""Runs a query and its SQL over the same tables and compares their rows, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in r) for r in frame.itertuples(index=False, name=None))


def compare(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got, expected = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(expected) > 0
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    assert a == b
