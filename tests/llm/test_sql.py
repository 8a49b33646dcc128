"""Queries of this subpackage against their SQL twins."""

from __future__ import annotations

import duckdb
import pytest

from strandweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf01, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf01}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf01)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    run = db.execute(queries.ORACLES[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in run.fetchall())
