import pytest
from compare import DATA, same

from quire.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
