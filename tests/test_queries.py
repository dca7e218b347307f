"""Every query of the engine against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from mosaiq.plans import registry

from .conftest import SF
from .oracle import compare

#: Queries without SQL, compared by rows only.
WITHOUT: set[str] = set()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    if name in WITHOUT:
        assert df.count() > 0
    else:
        assert compare(df, registry.oracle_sql()[name], SF) == ""


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) == set(registry.queries()) - WITHOUT
    assert set(entry.oracle_sql()) <= set(entry.queries())
