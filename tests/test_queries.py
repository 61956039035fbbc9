"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

LLM = ("p3_", "p4_", "p8_", "p9_", "p10_")


@pytest.fixture(scope="module")
def duck(root):
    con = duckdb.connect()
    for p in Path(root).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple("~" if r[i] is None or r[i] != r[i] else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(LLM)])
def test_query(spark, root, duck, name):
    df = entry.queries()[name](spark, root)
    mine = plain([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = duck.execute(sql)
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert mine == plain(cur.fetchall(), columns)


def test_entry(spark, root):
    df = entry.entry(spark)
    assert df.columns == ["step_id", "fact_id", "rank", "score", "hops", "lexical", "chain"] and df.count() > 0
