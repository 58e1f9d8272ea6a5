"""Every registered query of the library against its SQL twin on the smallest tables."""

import pytest
from oracle import database, same

from reprise import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    same(registry.queries()[name](spark, FOLDER), con, registry.oracle_sql()[name])


def test_positions_beyond_a_prefix(spark):
    """As many positions as the corpus has, each once."""
    folder = "/root/testdata/sf0.01"
    of = registry.queries()
    n = of["corpus_positions"](spark, folder).selectExpr("sum(n_tokens + 1) AS n").first().n
    got = of["pos_to_source"](spark, folder).selectExpr("count(*) AS n", "count(DISTINCT pos) AS kinds", "max(pos) AS last").first()
    assert n > 200_000 and tuple(got) == (n, n, n - 1)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
