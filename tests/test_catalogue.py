"""Each registered query of the engine against its SQL, and a brute force for what has none."""

import os

import pytest

from loomgraph.plans import catalogue
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    assert name in catalogue.ORACLES
    assert_same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF)


def test_entry_imports_without_the_training_data_operators(spark, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "_llm", lambda: [])
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)
    assert __spark_entry__.entry(spark).count() > 0
