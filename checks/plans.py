"""Whole plans over the driver's tables. No SQL counterpart: their parts are checked one by one."""

from pyspark.sql import functions as F

from checks.dataset import requests, state
from checks.detections import loaded
from checks.evaluation import split_of
from checks.registry import check
from emberline.operators import grids as g, spread
from emberline.plans.backtest import run_backtest
from emberline.plans.dataset import Layer, Sources, build_dataset
from emberline.plans.forecast import forecast_requests
from emberline.sources import fixtures


def sources(spark, d, first: str, days: int):
    """Layers over the study area from `cells`: static rasters, two NDVI months, weather for every day."""
    c = fixtures.cells(spark, d, days)
    rows = c.agg(F.max("row")).first()[0] + 1
    ref = g.Georef(-73.75, -36.4, 2.8 / 50, 3.0 / rows, True)
    layer = lambda v: Layer(c.select("row", "col", v.cast("double").alias("value")), ref)
    dated = c.withColumn("day", F.explode(F.expr(f"sequence(date '{first}', date_add(date '{first}', {days - 1}))")))
    at = F.datediff("day", F.lit("2024-01-01").cast("date"))
    num = lambda v: v.cast("double")
    k = F.col("cell_id")
    months = c.withColumn("month", F.explode(F.array(F.lit(1), F.lit(2))))
    ndvi = Layer(months.select(F.lit(2024).alias("year"), "month", "row", "col", (k % 90 / 100.0).alias("value")), ref)
    weather = Layer(dated.select(
        "day", "row", "col", num((k + at) % 9 - 4).alias("wind_u"), num((k * 3 + at) % 7 - 3).alias("wind_v"),
        num(285 + (k + at) % 15).alias("temperature"), num(20 + (k * 7 + at) % 60).alias("relative_humidity"),
        num((k + at) % 3 / 1000.0).alias("precipitation")), ref)
    return Sources(layer(F.col("elevation")), layer(k % 45), layer(k % 360), layer(F.lit(1) + k % 4), ndvi, weather)


@check("plan_forecast_requests", "event_id:i row:i col:i n_days:i highest:f")
def _(spark, d):
    out = forecast_requests(requests(spark, d), sources(spark, d, "2024-01-01", 12))
    return out.select("event_id", "row", "col", F.size("probability_by_day").alias("n_days"),
                      F.array_max("probability_by_day").alias("highest"))


@check("plan_build_dataset", "event_id:i split:s days:i cells:i burning:i elevation:f wind_u:f ndvi:f")
def _(spark, d):
    events, cells, split = build_dataset(loaded(spark, d), sources(spark, d, "2023-12-27", 40), min_detections=12)
    per = cells.groupBy("event_id").agg(
        F.count_distinct("day").alias("days"), F.count("*").alias("cells"), F.sum("fire_mask").alias("burning"),
        F.avg("elevation").alias("elevation"), F.avg("wind_u").alias("wind_u"), F.avg("ndvi").alias("ndvi"))
    return per.join(split, "event_id")


@check("plan_backtest", "model:s metric:s point:f lower:f upper:f")
def _(spark, d):
    cells = state(spark, d)
    split = cells.select("event_id").distinct().withColumn("split", split_of("event_id"))
    models = {"persistence": lambda c: c.withColumn("p", F.col("fire_mask")),
              "spread": lambda c: spread.ignition_probability(c)}
    return run_backtest(models, cells, split, "test").aggregate
