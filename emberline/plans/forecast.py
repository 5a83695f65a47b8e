"""A batch of forecast requests -> risk polygons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberline.operators import assembly, forecast, grids as g, spread, weather
from emberline.plans.dataset import Sources, place_channels
from emberline.session import durable, require_none


def forecast_requests(requests: DataFrame, src: Sources, res: float = 250.0, params: dict | None = None) -> DataFrame:
    """GeoJSON features of every request (request_id, lon, lat, day, horizon) with the one-step risk by day.

    Days without weather and required channels without data are errors, never filled in.
    """
    boxes, days, ignition = forecast.point_ignition_inputs(requests, res)
    boxes = durable(boxes)
    present = src.weather.cells.groupBy("day").agg(*[F.count(f).alias(f) for f in weather.FIELDS])
    have = present.unpivot("day", list(weather.FIELDS), "field", "n").filter("n > 0")
    wanted = days.select(F.explode("days").alias("day"))
    require_none(weather.missing_weather_days(wanted, have), "no weather")
    fixed, daily = map(durable, place_channels(boxes, days, src))
    _check_coverage(boxes, days, fixed, daily)
    ignition = g.to_local(ignition, boxes).join(days, "event_id").filter(F.col("day") == F.col("days")[0])
    near = forecast.around(ignition.select("event_id", "row", "col").distinct(), boxes).join(days, "event_id")
    risk = spread.ignition_probability(_unrolled(near, fixed, daily), res, params, burning=F.col("lit"))
    return forecast.cell_features(forecast.spread_over_grid(forecast.risk_series(risk), boxes, days))


def _unrolled(cells: DataFrame, fixed: DataFrame, daily: DataFrame) -> DataFrame:
    """`cells` (event_id, row, col, x, y, days) by day with the channels of their place."""
    at = cells.select("*", F.posexplode("days").alias("day_idx", "day")).drop("days")
    at = at.withColumns({"year": F.year("day"), "month": F.month("day")}).join(fixed, ["x", "y", "year", "month"], "left")
    return at.join(daily, ["x", "y", "day"], "left").drop("x", "y", "year", "month")


def _check_coverage(boxes: DataFrame, days: DataFrame, fixed: DataFrame, daily: DataFrame) -> None:
    """`check_channel_coverage` of the events; only those at a place that lacks a required channel are unrolled."""
    lacking = [df.filter(reduce(Column.__or__, [assembly.absent(c) for c in assembly.REQUIRED_CHANNELS if c in df.columns])).select("x", "y")
               for df in (fixed, daily)]
    lacking = lacking[0].unionByName(lacking[1]).distinct()
    if lacking.isEmpty():
        return
    cells = g.grid_cells(boxes.select("event_id", "grid").join(days, "event_id")).drop("grid")
    hit = cells.join(lacking, ["x", "y"], "left_semi").select("event_id").distinct()
    assembly.check_channel_coverage(_unrolled(cells.join(hit, "event_id"), fixed, daily))
