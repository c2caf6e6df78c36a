"""Every registered query of the core against its SQL; those without SQL must run."""

import importlib

import pytest
from conftest import SF
from oracle import same

from spanforge.plans import CORE

MODULES = [importlib.import_module(f"spanforge.plans.{m}") for m in CORE]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    same(spark, duck, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
