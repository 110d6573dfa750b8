"""Every query with a SQL twin against it, and the package's contract with the driver."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from treeweave.llm import queries

NAMES = [f"op{n}_" for n in range(1, 14)]


def test_one_query_for_each_operator():
    assert [sum(q.startswith(n) for q in entry.queries()) for n in NAMES] == [1] * len(NAMES)
    assert "pipeline" in entry.queries()


def tidy(df):
    return sorted(tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    want = con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


NATIVE = ("op4_source_mix", "op8_license_scan", "op9_chat_format")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_run_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapInArrow"))
