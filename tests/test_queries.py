"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import pytest

import __spark_entry__ as entry_file
import check_oracles
from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES  # the entry file may add others


@pytest.fixture(scope="module")
def duck():
    return check_oracles.duck(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, capsys, name):
    df = QUERIES[name](spark, FOLDER)
    df.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan, "no row-at-a-time Python"
    assert check_oracles.compare(df, duck.execute(ORACLES[name]).to_arrow_table()) is None


def test_entry(spark):
    assert entry_file.entry(spark).count() == 1


def test_entry_has_every_query():
    assert set(QUERIES) <= set(entry_file.queries()) and set(ORACLES) <= set(entry_file.oracle_sql()) <= set(entry_file.queries())
