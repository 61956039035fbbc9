"""The queries on training text on the smallest tables, against DuckDB where they have SQL."""

from pathlib import Path

import duckdb
import pytest

from veritrail.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, root, name):
    df = QUERIES[name](spark, root)
    mine = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert mine
    if name in ORACLES:
        con = duckdb.connect()
        for p in Path(root).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cur = con.execute(ORACLES[name])
        columns = [c[0] for c in cur.description]
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        assert mine == sorted(tuple(str(r[i]) for i in order) for r in cur.fetchall())
