"""The queries that SQL can express against that SQL in DuckDB, on edge-case and given tables."""

import duckdb
import pytest

from tidegauge.llm import registry

TABLES = ("documents", "labels", "pages", "benchmark")


def in_duck(folder, sql):
    import os

    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = c.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def ordered(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple("\x00" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("where", ["edge", "given", "empty"])
def test_sql(spark, edge, empty, name, where):
    folder = {"edge": edge, "empty": empty, "given": "/root/testdata/sf0.001"}[where]
    df = registry.queries()[name](spark, folder)
    columns, want = in_duck(folder, registry.oracle_sql()[name])
    assert sorted(columns) == sorted(df.columns)
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(want, columns)
