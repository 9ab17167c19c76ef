"""Every registered query of the engine against its oracle, and the driver's contract."""

import pytest
from conftest import SMALL

from weftflow.plans.oracles import ORACLES
from weftflow.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(same, name):
    same(QUERIES[name], ORACLES[name])


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["word", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_word_count_plan_combines_before_the_shuffle(spark):
    plan = QUERIES["wordcount"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan and "ReadSchema: struct<text:string>" in plan


def test_filters_reach_the_scan_and_nothing_is_shuffled(spark):
    plan = QUERIES["map_only_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["wordcount_batch", "wordcount_incremental"])
def test_shards_of_word_counts_are_not_sorted_in_the_memory_of_a_task(spark, name):
    assert "Sort" not in QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
