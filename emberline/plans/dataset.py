"""Landed detections and processed layers -> split event data sets."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from emberline.functions.geo import UTM19S
from emberline.functions.when import padded_days
from emberline.operators import clustering, grids as g, splits, vegetation, weather
from emberline.schemas import CHANNELS
from emberline.session import durable


class Layer(NamedTuple):
    """A source raster: cells (row, col, value and, for series, day or year and month) and its georeference."""
    cells: DataFrame
    ref: g.Georef


class Sources(NamedTuple):
    elevation: Layer
    slope_deg: Layer
    aspect_deg: Layer
    fuel_type: Layer
    ndvi: Layer                 # year, month, row, col, value
    weather: Layer              # day, row, col and one column per weather field


def with_static(cells: DataFrame, src: Sources) -> DataFrame:
    """Elevation and slope bilinear, aspect and fuel (circular, categorical) nearest; layers of one georeference join at once."""
    how = {"elevation": "values", "slope_deg": "values", "aspect_deg": "nearest", "fuel_type": "nearest"}
    for ref in dict.fromkeys(getattr(src, name).ref for name in how):
        names = [n for n in how if getattr(src, n).ref == ref]
        layers = [getattr(src, n).cells.select("row", "col", F.col("value").alias(n)) for n in names]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
        pick = lambda kind: tuple(n for n in names if how[n] == kind)
        cells = g.resample_bilinear(g.source_position(cells, ref), every, ref, values=pick("values"), nearest=pick("nearest"), placed=True)
    return cells


def with_ndvi(cells: DataFrame, layer: Layer) -> DataFrame:
    """A row per cell and month of `layers` with `ndvi` of the composite chosen for the month, missing without one."""
    at = cells.withColumn("m", F.explode("layers")).select("*", "m.*").drop("m", "layers")
    source = layer.cells.select(F.col("year").alias("layer_year"), F.col("month").alias("layer_month"), "row", "col", F.col("value").alias("ndvi"))
    return g.resample_bilinear(g.source_position(at, layer.ref), source, layer.ref, by=("layer_year", "layer_month"), values=("ndvi",), placed=True)


def with_weather(cells: DataFrame, layer: Layer) -> DataFrame:
    """Fields of the row's `day`: bilinear, gaps filled with the field's mean over its source that day."""
    out = g.resample_bilinear(g.source_position(cells, layer.ref), layer.cells, layer.ref, by=("day",), values=weather.FIELDS, placed=True)
    return weather.fill_from_source_mean(out, layer.cells, weather.FIELDS)


def with_months(days: DataFrame, layer: Layer) -> DataFrame:
    """(event_id, days, layers): of each month of the days the composite nearest to it, within three."""
    months = (days.select("event_id", F.explode("days").alias("day"))
              .select("event_id", F.year("day").alias("year"), F.month("day").alias("month")).distinct())
    chosen = vegetation.nearest_month_layer(months, layer.cells)
    layers = chosen.groupBy("event_id").agg(F.collect_list(F.struct("year", "month", "layer_year", "layer_month")).alias("layers"))
    return days.join(layers, "event_id")


def event_cells(detections: DataFrame, src: Sources, res: float = 250.0, before: int = 5, after: int = 0,
                fire_radius_m: float = g.FIRE_BUFFER_M, context_m: float = g.CONTEXT_BUFFER_M) -> DataFrame:
    """EVENT_CELL_DAY of every event of clustered detections, in one plan over all events."""
    summary = clustering.event_summary(detections)
    days = summary.select("event_id", padded_days("start_date", "end_date", before, after).alias("days"))
    boxes = durable(g.build_grid(g.event_bbox(detections, context_m), res).select("event_id", "grid"))
    fire = g.to_local(g.fill_fire_gaps(g.rasterize_detections(detections, res, fire_radius_m)), boxes)
    return from_parts(boxes, days, fire, src)


def from_parts(boxes: DataFrame, days: DataFrame, fire: DataFrame, src: Sources) -> DataFrame:
    """EVENT_CELL_DAY of events (event_id, grid), their days (event_id, days) and fire (event_id, day, row, col).

    One chain: a cell meets its fire days and the static layers once, then unrolls to months for the composites and to days for the
    weather. It is shuffled to each source and never joined with itself again.
    """
    at = ["event_id", "row", "col"]
    lit = fire.groupBy(*at).agg(F.collect_set("day").alias("lit"))
    cells = g.grid_cells(boxes.join(with_months(days, src.ndvi), "event_id")).drop("grid").join(lit, at, "left")
    monthly = with_ndvi(with_static(cells, src), src.ndvi)
    numbered = F.transform("days", lambda d, i: F.struct(i.alias("day_idx"), d.alias("day")))
    of_month = F.filter(numbered, lambda d: (F.year(d["day"]) == F.col("year")) & (F.month(d["day"]) == F.col("month")))
    daily = monthly.withColumn("d", F.explode(of_month)).select("*", "d.*").drop("d", "days")
    burning = F.coalesce(F.array_contains("lit", F.col("day")), F.lit(False))
    daily = daily.withColumn("fire_mask", F.when(burning, 1.0).otherwise(0.0)).drop("lit", "year", "month", "layer_year", "layer_month")
    return with_weather(daily, src.weather).select("event_id", "day", "day_idx", "row", "col", *CHANNELS)


def place_channels(boxes: DataFrame, days: DataFrame, src: Sources) -> tuple[DataFrame, DataFrame]:
    """(x, y, year, month, static channels, ndvi) and (x, y, day, weather fields) of the places where cells of events (event_id, grid) lie on their
    days (event_id, days).

    Grids are aligned, so cells of many events share a centre: each place is resampled once, and once a day for the weather. Equal grids
    count once, and places are told apart before anything is joined.
    """
    per_grid = (boxes.select("event_id", "grid").join(days, "event_id").select("grid", F.explode("days").alias("day")).distinct()
                .groupBy("grid").agg(F.collect_list("day").alias("days")))
    cells = g.grid_cells(per_grid)
    daily = cells.select("x", "y", F.explode("days").alias("day")).distinct()
    months_of = lambda days: F.explode(F.array_distinct(F.transform(days, lambda d: F.struct(F.year(d).alias("year"), F.month(d).alias("month"))))).alias("m")
    monthly = cells.select("x", "y", months_of("days"))
    months = days.select(months_of("days")).select("m.*").distinct()
    chosen = F.broadcast(vegetation.nearest_month_layer(months, src.ndvi.cells).drop("distance"))  # one row per month
    placed = with_static(monthly.select("x", "y", "m.*").distinct(), src).join(chosen, ["year", "month"])
    fixed = with_ndvi(placed.withColumn("layers", F.array(F.struct("layer_year", "layer_month"))).drop("layer_year", "layer_month"), src.ndvi)
    return (fixed.select("x", "y", "year", "month", *(c for c in CHANNELS if c in fixed.columns)),
            with_weather(daily, src.weather).select("x", "y", "day", *weather.FIELDS))


def build_dataset(detections: DataFrame, src: Sources, min_detections: int = 1, seed: int = 42,
                  res: float = 250.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(EVENT, EVENT_CELL_DAY, SPLIT) from loaded detections; events that cannot be split without leakage are built all the same (`split_dataset`)."""
    clustered = durable(clustering.cluster_detections(detections))
    events = clustering.select_events(clustering.event_summary(clustered), min_detections=min_detections)
    chosen = clustered.join(events.select("event_id"), "event_id", "left_semi")
    prints = events.select("event_id", "west", "south", "east", "north", F.col("start_date").alias("first_day"),
                           F.col("end_date").alias("last_day"))
    return events, event_cells(chosen, src, res), splits.split_dataset(prints, seed)


__all__ = ["Layer", "Sources", "build_dataset", "event_cells", "from_parts", "UTM19S"]
