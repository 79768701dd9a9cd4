"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest

from tests.oracle import compare, duck
from trawl.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, sf_dir, con, name):
    got, want = compare(registry.queries()[name](spark, sf_dir), con, registry.oracles()[name])
    assert got == want
    assert got or name.startswith("search_fuzzy"), "an empty result proves nothing"


def test_vector_lists_find_what_the_exact_graph_finds(spark, sf_dir):
    row = registry.queries()["vector_ivf_recall"](spark, sf_dir).first()
    assert row["recall"] >= 0.9


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
