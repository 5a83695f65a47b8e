"""Forecasts resample each place once, whatever the number of requests, and give what the cells of every request give by themselves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.dataset import requests
from checks.plans import sources
from emberline.operators import assembly, forecast, grids as g, spread
from emberline.plans import forecast as plan
from emberline.plans.dataset import from_parts
from emberline.session import DataError, durable
from emberline.sources import fixtures

D = "/root/testdata/sf0.001"
COLUMNS = ["event_id", "row", "col", "ring", "probability_by_day", "feature"]


def by_request(reqs, src, res):
    boxes, days, ignition = forecast.point_ignition_inputs(reqs, res)
    cells = durable(from_parts(boxes, days, g.to_local(ignition, boxes), src))
    start = cells.filter("day_idx = 0 and fire_mask >= 0.5").select("event_id", "row", "col", F.lit(True).alias("lit"))
    state = cells.join(start, ["event_id", "row", "col"], "left").withColumn("lit", F.coalesce("lit", F.lit(False)))
    return forecast.forecast_features(spread.ignition_probability(state, res, None, burning=F.col("lit")), boxes)


def some(spark, n=6):
    """Requests whose grids overlap, two of them at one place on different days, one over the end of January."""
    near = requests(spark, D).filter(f"request_id < {n}").withColumns({"lon": -72.0 + F.col("request_id") % 5 / 100, "lat": F.lit(-37.0)})
    return near.withColumn("day", F.when(F.col("request_id") == 1, F.lit(dt.date(2024, 1, 30))).otherwise(F.col("day")))


def test_places_give_what_every_request_gives_by_itself(spark):
    src = sources(spark, D, "2024-01-01", 45)
    own, apart = (sorted(map(tuple, df.select(COLUMNS).collect())) for df in (plan.forecast_requests(some(spark), src, 500.0), by_request(some(spark), src, 500.0)))
    assert own == apart and len({r[0] for r in own}) == 6
    assert any(0 < p < 1 for r in own for p in r[4])


def test_tables_do_not_grow_with_requests_at_one_place(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(plan, "durable", lambda df: sizes.append((out := durable(df)).count()) or out)
    src = sources(spark, D, "2024-01-01", 12)
    for n in (1, 20):
        reqs = spark.range(n).select(F.col("id").alias("request_id"), F.lit(-72.0).alias("lon"), F.lit(-37.0).alias("lat"),
                                     F.lit(dt.date(2024, 1, 2)).alias("day"), F.lit(2).alias("horizon"))
        assert plan.forecast_requests(reqs, src, 500.0).select("event_id").distinct().count() == n
    one, many = sizes[:len(sizes) // 2], sizes[len(sizes) // 2:]
    assert one[0] == 1 and many[0] == 20 and one[1:] == many[1:]  # only the requests themselves


def test_a_place_without_a_required_channel_names_its_requests(spark):
    src = sources(spark, D, "2024-01-01", 12)
    reqs = some(spark, 4).filter("request_id > 1")
    calm = src.weather.cells.withColumn("wind_u", F.lit(None).cast("double"))
    with pytest.raises(DataError, match="no weather"):
        plan.forecast_requests(reqs, src._replace(weather=src.weather._replace(cells=calm)), 500.0)
    holed = src._replace(fuel_type=src.fuel_type._replace(cells=src.fuel_type.cells.filter("col <> 31")))
    with pytest.raises(DataError, match="required channel has missing cells.*'event_id': [23].*'channel': 'fuel_type'"):
        plan.forecast_requests(reqs, holed, 500.0)


def test_a_raster_is_dealt_in_order(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 2000)
    parts = fixtures.cells(spark, "/root/testdata/sf0.01", 12).groupBy(F.spark_partition_id()).agg(
        F.min("cell_id").alias("a"), F.max("cell_id").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert len(parts) > 6 and all(x.b < y.a for x, y in zip(parts, parts[1:])) and max(p.n * 12 for p in parts) <= 2 * 2000
