"""A data set whose events cannot be split without leakage is built all the same, and nothing trains on it unawares."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.plans import sources
from emberline.operators import splits
from emberline.plans.dataset import build_dataset
from emberline.sources.tables import load_split_cells

DAY = dt.date(2024, 1, 10)
PRINT = "event_id long, west double, south double, east double, north double, first_day date, last_day date"
prints = lambda spark, rows: spark.createDataFrame([(i, lon, -37.0, lon + 0.01, -36.99, DAY, DAY) for i, lon in rows], PRINT)


def test_events_of_one_group_have_no_split(spark):
    with pytest.warns(UserWarning, match="1 independent groups"):
        out = splits.split_dataset(prints(spark, [(1, -72.0), (2, -71.95), (3, -71.9), (4, -71.85)]))
    assert [tuple(r) for r in out.orderBy("event_id").collect()] == [(i, None, 1) for i in (1, 2, 3, 4)]
    cells = spark.createDataFrame([(1, DAY, 0, 0, 0, 1.0)], "event_id long, day date, day_idx int, row int, col int, fire_mask double")
    with pytest.raises(Exception, match="events without a split"):
        load_split_cells(cells, out, "train").count()


def test_two_events_train_and_three_groups_are_split(spark):
    assert [tuple(r) for r in splits.split_dataset(prints(spark, [(1, -72.0), (2, -71.95)])).orderBy("event_id").collect()] == [(1, "train", 1), (2, "train", 1)]
    apart = prints(spark, [(1, -73.0), (2, -72.5), (3, -72.0)])
    assert sorted(splits.split_dataset(apart).collect()) == sorted(splits.split_events_grouped(apart).collect())


def test_a_data_set_without_a_split_is_built(spark):
    rows = [(-37.0, -72.0 + 0.04 * i, dt.datetime(2024, 1, 10, 12), 1.0, "n", "N", "VIIRS") for i in range(3)]
    found = spark.createDataFrame(rows, "latitude double, longitude double, detected_at timestamp, frp double, confidence string, satellite string, instrument string")
    with pytest.warns(UserWarning, match="no split was made"):
        events, cells, split = build_dataset(found, sources(spark, "/root/testdata/sf0.001", "2024-01-05", 6))
    per = {r.event_id: r for r in cells.groupBy("event_id").agg(F.count_distinct("day").alias("days"), F.sum("fire_mask").alias("burning")).collect()}
    assert len(per) == events.count() == 3 and all(r.days == 6 for r in per.values())
    assert {r.event_id for r in split.filter("split is null").collect()} == set(per)
