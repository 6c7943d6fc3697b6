import pytest
from oracle import compare

from veridect.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name]) is None
