"""What plans must not do as tables grow."""

from __future__ import annotations

from strataform.operators import workbooks
from strataform.plans import registry


def test_rows_of_a_year_do_not_meet(spark, sf_dir):
    plan = registry.queries()["shared_year_intersection"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_small_file_is_spread_over_tasks(spark, sf_dir):
    found = registry.queries()["geocode_attempt_rows"](spark, sf_dir)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_rings_of_a_city_are_added_up_one_by_one(spark, sf_dir):
    plan = registry.queries()["derived_city_union"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(ring" not in plan


def test_status_of_workbooks_makes_no_blocks(spark, sf_dir, monkeypatch):
    def made(*_):
        raise AssertionError("blocks, contracts or pairs are made for a file's status")

    for name in ("_blocks", "contracts", "quantities"):
        monkeypatch.setattr(workbooks, name, made)
    found = registry.queries()["workbook_status"](spark, sf_dir)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
