"""The subpackage's queries on the smallest tables."""

import pytest

from quarry.llm import registry
from tests.test_entry import bag, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, duck, name):  # noqa: F811
    got = registry.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    assert bag(tuple(r) for r in got.select(*columns).collect()) == bag(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0
