"""Every query against its SQL in DuckDB, and its plan."""

import decimal
import math

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from patchscope import session
from patchscope.plans import all_queries

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def canonical(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def check_plan(df):
    """No cross join, and a single partition holds aggregates only, never rows."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("CartesianProduct" in x or "BroadcastNestedLoopJoin" in x for x in lines)
    for line, below in zip(lines, lines[1:]):
        assert "Exchange SinglePartition" not in line or "HashAggregate" in below


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name, monkeypatch):
    if name in all_queries()[0]:
        # what a query stores on its way is held to the same rules
        write = session._write
        monkeypatch.setattr(session, "_write", lambda df, store: check_plan(df) or write(df, store))
    df = QUERIES[name](spark, SMALL)
    check_plan(df)
    columns = sorted(df.columns)
    rows = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name not in ORACLES:
        return
    result = duck.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    assert rows == sorted(tuple(canonical(r[i]) for i in places) for r in result.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert {r["climate"] for r in entry.entry(spark).collect()} == {"current", "future"}
