"""Every registered query against its SQL, and what only differential tests can tell."""

from __future__ import annotations

import math

import pytest
from compare import assert_same

from strataform.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), sf_dir, SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_critic_weights_sum_to_one(spark, sf_dir):
    rows = QUERIES["critic_weights"](spark, sf_dir).collect()
    weight = next(c for c in rows[0].asDict() if "weight" in c)
    assert math.isclose(float(sum(r[weight] for r in rows)), 1.0, abs_tol=1e-6)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).schema == __spark_entry__.entry(spark).schema
