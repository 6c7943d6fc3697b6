import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    assert compare(spark, SF_DIR, QUERIES[name], ORACLES[name], duck) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).columns == ["lang", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1"]
