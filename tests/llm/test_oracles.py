"""The registered queries that SQL can express, on the smallest tables."""

from __future__ import annotations

import pytest
from stockweave.llm import queries
from tests.conftest import SF
from tools.check import duck, rows


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_query_matches_oracle(spark, con, name):
    df = queries.all_queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(queries.all_oracles()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, cur.fetchall())


def test_one_query_per_operator():
    names = queries.all_queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
