"""Cells of a plan are shuffled to each source once and come out as when every channel is resampled by itself."""

from pyspark.sql import functions as F

from checks.dataset import requests
from checks.plans import sources
from emberline.functions.geo import UTM19S
from emberline.operators import assembly, forecast, grids as g, vegetation, weather
from emberline.plans.dataset import from_parts
from emberline.schemas import CHANNELS

D = "/root/testdata/sf0.001"


def inputs(spark):
    some = requests(spark, D).filter("request_id < 4")
    boxes, days, ignition = forecast.point_ignition_inputs(some, 1000.0)
    src = sources(spark, D, "2024-01-01", 12)
    return boxes, days, g.to_local(ignition, boxes), src._replace(weather=src.weather._replace(cells=src.weather.cells.filter("row % 5 > 0 and day < '2024-01-09'")))


def one_by_one(boxes, days, fire, src):
    cells = g.grid_cells(boxes).drop("grid")
    static = cells
    for name, how in (("elevation", g.resample_bilinear), ("slope_deg", g.resample_bilinear),
                      ("aspect_deg", g.resample_nearest), ("fuel_type", g.resample_nearest)):
        static = how(static, getattr(src, name).cells, getattr(src, name).ref).withColumnRenamed("value", name)
    daily = cells.join(days, "event_id").withColumn("day", F.explode("days"))
    daily = weather.fill_from_source_mean(g.resample_bilinear(daily, src.weather.cells, src.weather.ref, by=("day",), values=weather.FIELDS), src.weather.cells)
    months = days.select("event_id", F.explode("days").alias("day")).select("event_id", F.year("day").alias("year"), F.month("day").alias("month")).distinct()
    at = cells.join(vegetation.nearest_month_layer(months, src.ndvi.cells), "event_id")
    layer = src.ndvi.cells.withColumnsRenamed({"year": "layer_year", "month": "layer_month"})
    ndvi = g.resample_bilinear(at, layer, src.ndvi.ref, by=("layer_year", "layer_month")).withColumnRenamed("value", "ndvi")
    return assembly.assemble_event(boxes, days, static, daily, ndvi, fire)


def test_one_chain_gives_the_channels_of_one_by_one(spark):
    parts = inputs(spark)
    chain, apart = from_parts(*parts), one_by_one(*parts)
    a, b = ({(r.event_id, r.day, r.row, r.col): tuple(r) for r in df.collect()} for df in (chain, apart))
    assert a == b and len(a) > 1000 and chain.columns[-len(CHANNELS):] == list(CHANNELS)
    assert sum(r[-1] for r in a.values()) == 4  # the ignition cells


def test_cells_are_shuffled_to_each_source_once(spark):
    parts = inputs(spark)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    own = joins(parts[0]) + joins(parts[1]) + joins(parts[2])
    assert joins(from_parts(*parts)) <= own + 9  # months (3), days, fire, static, composite, weather and its means


def test_nearest_comes_with_the_bilinear_join(spark):
    ref = g.Georef(0.0, 400.0, 100.0, 100.0)
    source = spark.range(16).select((F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    targets = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(0.0, 400.0), (50.0, 350.0), (99.9, 300.1), (100.0, 300.0), (399.0, 1.0), (-1.0, 5.0), (250.0, 149.0)])], "k int, x double, y double")
    one = g.resample_bilinear(targets, source.withColumnRenamed("value", "v"), ref, UTM19S, values=(), nearest=("v",))
    apart = g.resample_nearest(targets, source, ref)
    assert {r.k: r.v for r in one.collect()} == {r.k: r.value for r in apart.collect()}
