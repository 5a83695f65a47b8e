"""One event holds nine tenths of all rows, and nothing may be broadcast but what a count allows."""

import pytest
from pyspark.sql import functions as F

from emberline.operators import evaluation as ev, reporting, skew
from emberline.sources import tables


@pytest.fixture
def cells(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(skew, "HOT_ROWS", 500)
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    # event 1: 4 days of 30 x 30 cells; events 2 to 11: 4 days of 10 cells
    at = spark.range(0, 4000, 1, 8).selectExpr(
        "if(id < 3600, 1, cast((id - 3600) / 40 as int) + 2) as event_id", "cast(if(id < 3600, id / 900, id % 40 / 10) as int) as day_idx",
        "cast(if(id < 3600, id % 900 / 30, 0) as int) as row", "cast(if(id < 3600, id % 30, id % 10) as int) as col")
    mask = F.when(F.col("event_id") == 2, 0.0).otherwise((F.col("day_idx") - 1 >= F.col("col") % 3).cast("double"))
    yield at.withColumns({"fire_mask": mask, "day": F.date_add(F.lit("2024-01-01").cast("date"), F.col("day_idx")), "wind_u": F.col("col") + 1.0, "wind_v": F.col("row") - 2.0 * F.col("day_idx"),
                          "elevation": F.col("row") * 10.0 + F.col("day_idx"), "slope_deg": F.col("col") * 1.0 + F.col("day_idx"), "fuel_type": F.lit(1.0),
                          "temperature": F.lit(290.0), "relative_humidity": F.lit(40.0)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def largest_share(df):
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_rows_of_a_hot_event_stay_spread(spark, cells):
    first = cells.groupBy("event_id").agg(F.min(F.when(F.col("fire_mask") >= 0.5, F.col("day_idx"))).alias("f"))
    want = cells.join(first, "event_id").filter("f is null or day_idx >= f").drop("f")
    trimmed = ev.trim_to_first_fire_day(cells)
    assert rows(trimmed) == rows(want) and want.count() < cells.count()
    without = ev.exclude_anchor_day(cells)
    assert rows(without) == rows(cells.filter("day_idx > 0"))
    truth = ev.truth_cells(cells)
    assert truth.count() == 1000
    for df in (trimmed, without):
        assert largest_share(df) < 0.4  # of 0.9 if the event's rows met in one task
    split = cells.select("event_id").distinct().withColumn("split", F.when(F.col("event_id") < 3, "test").otherwise("train"))
    assert rows(tables.load_split_cells(cells, split, "test")) == rows(want.filter("event_id < 3"))


def test_descriptors_of_a_hot_event_only_aggregate(spark, cells):
    found = reporting.event_descriptors(cells)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = [line for line in plan.splitlines() if "Join " in line]
    assert len(join) == 1 and plan.count("Aggregate [event_id") >= 4  # one row an event on either side
    one = found.filter("event_id = 1").first()
    sd = cells.filter("event_id = 1 and day_idx = 0").agg(F.stddev_pop("elevation")).first()[0]
    assert abs(one.elevation_std_m - sd) < 1e-9 and one.mean_slope_deg == 14.5 and one.true_cells_final == 900
    assert (one.n_days, one.height, one.width) == (4, 30, 30)


def test_final_day_without_a_join(spark, cells):
    scored = cells.select(F.lit("m").alias("model"), "event_id", "day_idx", "row", "col", F.col("fire_mask").alias("p"), (F.col("day_idx") / 3).alias("y"))
    found = reporting.case_direction(scored)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.event_id: (r.pred_cells, r.true_cells, r.direction) for r in found.collect()}
    assert got[1] == (900, 900, None) and got[2] == (0, 10, "under")


def test_number_of_broadcast_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    left = spark.range(1000).selectExpr("id % 20 as k", "id as i")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    assert "LeftAnti" not in skew.join_counted(left, right, "k", 10)._jdf.queryExecution().optimizedPlan().toString()  # all have 50 of 1000 rows
    heavy = left.unionByName(spark.range(2000).selectExpr("0L as k", "id + 1000 as i"))
    joined = skew.join_measured(heavy, right.select("k"), "k", 10)
    assert "LeftAnti" in joined._jdf.queryExecution().optimizedPlan().toString() and rows(joined) == rows(heavy)
