"""Every query with SQL gives the same rows as the SQL."""

import pytest

from postmill.plans import registry
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    registry.QUERIES[name](spark, sf).collect()


def test_entry_imports_without_session():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLE_SQL) <= set(entry.oracle_sql())


def test_skills_are_counted_in_all_postings(spark, sf):
    found = {r.skill: r.n for r in registry.QUERIES["matched_skills"](spark, sf).collect()}
    plain = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderkey % 7 <> 0")  # those whose words count, with a "roadmap" for each of the remainder
    assert found["roadmap"] == plain.selectExpr("sum(o_orderkey % 40)").first()[0]


def test_work_models_are_counted_in_all_postings(spark, sf):
    found = registry.QUERIES["matched_work_model"](spark, sf).collect()
    assert sum(r.n for r in found) == spark.read.parquet(f"{sf}/orders.parquet").count()
