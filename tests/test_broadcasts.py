"""Broadcast joins follow the size a shuffle measured, not the size of the file."""

import pytest
from pyspark.sql import functions as F

from emberline.session import broadcast_by_measure

STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def as_configured(spark):
    """The session as a driver with default settings starts it."""
    before = {k: spark.conf.get(k, None) for k in (STATIC, MEASURED)}
    spark.conf.set(STATIC, "10MB")
    spark.conf.unset(MEASURED)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_file_is_not_broadcast_by_its_size(spark, as_configured, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "small"))
    many = spark.read.parquet(str(tmp_path / "small")).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(4000))))
    joined = lambda: many.join(many.withColumnRenamed("d", "e"), "id")
    assert "BroadcastHashJoin" in plan_of(joined())  # four million rows, planned as those of the file
    broadcast_by_measure(spark)
    assert "BroadcastHashJoin" not in plan_of(joined())
    assert "BroadcastHashJoin" in plan_of(many.join(F.broadcast(spark.range(3)), "id"))
    broadcast_by_measure(spark)
    assert (spark.conf.get(STATIC), spark.conf.get(MEASURED)) == ("-1", "10MB")


@pytest.mark.parametrize("name", ["j14_score_join", "n4_blend", "j8_assemble_event"])
def test_queries_gather_no_exploded_table(spark, as_configured, name):
    import __spark_entry__
    assert "BroadcastExchange" not in plan_of(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", [
    "a11_reliability_bins", "a12_aggregate_metrics", "a13_bootstrap_ci", "a21_best_model_per_metric", "a22_all_intervals_overlap",
    "a23_comparison_table", "a23_per_event_table", "a24_case_direction", "a28_case_listing", "a8_iou_dice", "a9_brier", "f13_failing_cases",
    "j16_resolve_event_pk", "n6_isotonic_calibration", "n7_calibration_report", "s11_load_results", "s9_append_runs", "w7_rank_models"])
def test_queries_over_scores_join_them_by_shuffle(spark, as_configured, monkeypatch, name):
    import __spark_entry__
    from emberline.operators import evaluation
    plans, join = [], evaluation.score_join
    monkeypatch.setattr(evaluation, "score_join", lambda pred, truth: plans.append(join(pred, truth)) or plans[-1])
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert plans and all("BroadcastExchange" not in plan_of(p) for p in plans)
