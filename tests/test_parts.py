"""A task's share of a shuffle is bounded by bytes, not by a fixed number of partitions."""

import re

import pytest

from emberline.session import FIRST_PARTS, parts_by_measure

FIRST, ADAPTIVE, PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"


@pytest.fixture
def few(spark):
    """A cluster that names few partitions and leaves adaptive execution on."""
    before = {k: spark.conf.get(k, None) for k in (FIRST, ADAPTIVE, PARTS)}
    spark.conf.unset(FIRST)
    spark.conf.set(ADAPTIVE, "true")
    spark.conf.set(PARTS, "4")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["n3_ignition_probability", "n4_blend", "a18_spread_scores", "a18_grid_search_spread"])
def test_shuffles_are_cut_finer_than_the_configured_number(spark, few, name):
    import __spark_entry__
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    cuts = {int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}
    assert cuts == {FIRST_PARTS}


def test_a_configured_first_number_stays(spark, few):
    spark.conf.set(FIRST, "7")
    parts_by_measure(spark)
    assert spark.conf.get(FIRST) == "7"
