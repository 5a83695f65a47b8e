"""Grids, fire days, resampling, terrain, weather and vegetation with hand-computed values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import meteo, surface
from emberline.operators import assembly, grids as g, spread, vegetation, weather
from emberline.session import DataError

DAY = dt.date(2024, 1, 1)


def test_study_grid_bounds(spark):
    box = spark.sql("select -73.7D as west, -39.3D as south, -71.0D as east, -36.5D as north")
    grid = g.build_grid(box).first().grid
    assert (grid.x0, grid.y0, grid.width, grid.height) == (78750.0, 5958750.0, 996, 1278)


def detections(spark, rows):
    return spark.createDataFrame(rows, "event_id long, latitude double, longitude double, detected_at timestamp")


def test_small_disc_between_centres_is_an_error(spark):
    from emberline.functions.geo import UTM19S
    corner = spark.createDataFrame([(300000.0, 5900000.0)], "x double, y double")  # a corner of four cells
    at = UTM19S.with_lonlat(corner).first()
    det = detections(spark, [(1, at.lat, at.lon, dt.datetime(2024, 1, 1, 12))])
    assert g.rasterize_detections(det).count() == 4  # the next centres are 395 m away
    with pytest.raises(DataError, match="no burning cell"):
        g.rasterize_detections(det, radius_m=100.0)


def test_gap_days_are_the_union_and_never_extrapolated(spark):
    fire = spark.createDataFrame([(1, DAY, 5, 5), (1, DAY + dt.timedelta(days=3), 9, 9)],
                                 "event_id long, day date, gx long, gy long")
    got = {}
    for r in g.fill_fire_gaps(fire).collect():
        got.setdefault(r.day, set()).add((r.gx, r.gy))
    assert got == {DAY: {(5, 5)}, DAY + dt.timedelta(days=1): {(5, 5), (9, 9)},
                   DAY + dt.timedelta(days=2): {(5, 5), (9, 9)}, DAY + dt.timedelta(days=3): {(9, 9)}}


def raster(spark, h, w, f, name="elevation"):
    return spark.createDataFrame([(r, c, f(r, c)) for r in range(h) for c in range(w)], f"row int, col int, {name} double")


def test_slope_and_aspect(spark):
    plane = g.slope_aspect(raster(spark, 4, 4, lambda r, c: 30.0 * c), 30.0, 30.0)
    r = plane.filter("row = 1 and col = 1").first()
    assert (round(r.slope_deg, 9), round(r.aspect_deg, 9)) == (45.0, 270.0)
    flat = g.slope_aspect(raster(spark, 3, 3, lambda r, c: 7.0), 30.0, 30.0).first()
    assert (flat.slope_deg, flat.aspect_deg) == (0.0, -1.0)
    with pytest.raises(DataError):
        g.slope_aspect(plane, 30.0, 30.0, projected=False)
    with pytest.raises(DataError):
        g.slope_aspect(plane, 30.0, 30.0, rotated=True)


def test_mosaic_needs_a_tile(spark):
    with pytest.raises(DataError):
        g.mosaic(spark.createDataFrame([], "tile_order int, row int, col int, value double"))


def test_bilinear_midpoint_and_missing_corner(spark):
    ref = g.Georef(0.0, 100.0, 10.0, 10.0)
    src = raster(spark, 2, 2, lambda r, c: 10.0 * r + c, "value")
    at = spark.createDataFrame([(10.0, 90.0), (5.0, 95.0)], "x double, y double")
    got = {(r.x, r.y): r.value for r in g.resample_bilinear(at, src, ref).collect()}
    assert got == {(10.0, 90.0): 5.5, (5.0, 95.0): 0.0}
    holed = src.withColumn("value", F.when(F.col("row") + F.col("col") < 2, F.col("value")))
    got = {(r.x, r.y): r.value for r in g.resample_bilinear(at, holed, ref).collect()}
    assert got[(10.0, 90.0)] is None and got[(5.0, 95.0)] == 0.0


# ---------------------------------------------------------------- weather
def hours(spark, temps, tp_next=24.0, last=True):
    rows = [(1, DAY, h, float(t), 270.0, 1.0, 0.0, float(h)) for h, t in enumerate(temps)]
    if last:
        rows.append((1, DAY + dt.timedelta(days=1), 0, 999.0, 270.0, 1.0, 0.0, tp_next))
    return spark.createDataFrame(rows, "cell_id long, day date, hour int, t2m double, d2m double, u10 double, v10 double, tp double")


def test_daily_mean_and_closing_midnight(spark):
    r = weather.daily_weather(hours(spark, range(280, 304)), DAY, DAY).first()
    assert (r.t2m, r.tp) == (291.5, 24.0)


def test_missing_midnight_and_unknown_variable(spark):
    with pytest.raises(Exception, match="no closing midnight"):
        weather.daily_weather(hours(spark, range(280, 304), last=False), DAY, DAY).collect()
    with pytest.raises(DataError, match="swvl1"):
        weather.daily_weather(hours(spark, [280]), variables=("t2m", "swvl1"))


def test_wind_and_humidity(spark):
    df = spark.sql("select 0D as u, -1D as v, 1D as w, 0D as z, 290D as t, 295D as hot")
    r = df.select(meteo.wind_from_direction("u", "v"), meteo.wind_from_direction("w", "z"),
                  meteo.relative_humidity("t", "t"), meteo.relative_humidity("t", "hot")).first()
    assert tuple(round(x, 9) for x in r) == (0.0, 270.0, 100.0, 100.0)


def test_source_missing_everywhere_stays_missing(spark):
    cells = spark.createDataFrame([(DAY, 1, None, None)], "day date, id int, temperature double, wind_u double")
    src = spark.createDataFrame([(DAY, 3.0, None), (DAY, 5.0, None)], "day date, temperature double, wind_u double")
    r = weather.fill_from_source_mean(cells, src, ("temperature", "wind_u")).first()
    assert (r.temperature, r.wind_u, r.imputed) == (4.0, None, 1)


# ---------------------------------------------------------------- vegetation
def test_masked_ndvi_and_guard(spark):
    df = spark.sql("select * from values (-5D, 300D), (10D, 20D), (100D, 300D) as t(red, nir)")
    got = [r[0] for r in df.select(surface.ndvi_masked("red", "nir")).collect()]
    assert got == [None, None, 0.5]
    with pytest.raises(Exception, match="NDVI out of range"):
        vegetation.ndvi_range_guard(spark.sql("select 1.5D as ndvi")).collect()


def test_fuel_classes(spark):
    got = {r.c: r.f for r in spark.range(0, 101).select(F.col("id").alias("c"), surface.fuel_from_landcover("id").alias("f")).collect()}
    assert (got[10], got[20], got[30], got[40], got[80], got[95], got[100], got[7]) == (3, 2, 1, 4, 92, 5, 93, 99)


def test_nearest_month(spark):
    have = spark.createDataFrame([(2025, 11), (2026, 2)], "year int, month int")
    target = lambda *t: spark.createDataFrame([t], "year int, month int")
    pick = lambda t, **k: tuple(vegetation.nearest_month_layer(t, have, **k).first())[2:]
    assert pick(target(2026, 1)) == (2026, 2, 1)
    assert pick(target(2026, 1), direction="backward") == (2025, 11, 2)
    assert pick(target(2026, 9)) == (None, None, None)
    tie = spark.createDataFrame([(2025, 12), (2026, 2)], "year int, month int")
    assert tuple(vegetation.nearest_month_layer(target(2026, 1), tie).first())[2:4] == (2025, 12)


def test_no_matching_composite_is_an_error(spark):
    stored = spark.createDataFrame([(1, 0.5)], "cell_id long, value double")
    cand = spark.createDataFrame([("x", 1, 0.7)], "candidate string, cell_id long, value double")
    with pytest.raises(DataError, match="reproduces"):
        vegetation.match_composite(stored, cand)


# ---------------------------------------------------------------- spread
@pytest.mark.parametrize("slope,u,v,want", [
    (0.1, 0.0, 0.0, 0.44754740929238107), (-0.1, 0.0, 0.0, 0.20109601381069178),
    (0.0, 5.0, 0.0, 0.8154845485377135), (0.0, -5.0, 0.0, 0.1103638323514327)])
def test_one_burning_neighbor(spark, slope, u, v, want):
    # the burning cell lies to the west: d_col = -1
    rows = [(1, 0, 0, 0, 0.0, u, v, 1.0, 1.0), (1, 0, 0, 1, slope * 250, u, v, 1.0, 0.0)]
    cells = spark.createDataFrame(rows, "event_id long, day_idx int, row int, col int, elevation double, wind_u double, "
                                        "wind_v double, fuel_type double, fire_mask double")
    got = {r.col: r.p for r in spread.ignition_probability(cells).collect()}
    assert got[0] == 1.0 and math.isclose(got[1], want, rel_tol=1e-12)


def samples(spark):
    rows = [(1, 0, c, float(c == 0), 0.0, 0.0, 0.0, 1.0, float(c < 2)) for c in range(4)]
    return spark.createDataFrame(rows, "sample_id long, row int, col int, burning double, elevation double, wind_u double, "
                                       "wind_v double, fuel_type double, observed double")


def test_search_keeps_the_first_of_equals_and_checks_names(spark):
    grid = {"base_spread_prob": [0.2, 0.6, 0.9]}
    best = spread.grid_search_spread(samples(spark), grid).first()
    assert best.base_spread_prob == 0.6 and best.score == 1.0
    with pytest.raises(ValueError, match="wind_wieght"):
        spread.grid_search_spread(samples(spark), {"wind_wieght": [1.0]})
    with pytest.raises(ValueError, match="metric"):
        spread.grid_search_spread(samples(spark), grid, "auc")


# ---------------------------------------------------------------- assembly
def ndws(spark, **change):
    base = dict(elevation=100.0, pdsi=0.0, NDVI=5000.0, pr=5.0, sph=0.005, th=270.0, tmmn=280.0, tmmx=300.0, vs=2.0, erc=1.0,
                population=0.0, PrevFireMask=-1.0, FireMask=1.0)
    base.update(change)
    rows = [(1, r, c, *base.values()) for r in range(2) for c in range(2)]
    return spark.createDataFrame(rows, "sample_id long, row int, col int, " + ", ".join(f"{k} double" for k in base))


def test_public_record(spark):
    r = assembly.ndws_to_channels(ndws(spark)).first()
    assert (r.precipitation, r.temperature, r.ndvi, r.fuel_type, r.fire_mask, r.label) == (0.005, 290.0, 0.5, 99.0, 0.0, 1.0)
    assert math.isclose(r.wind_u, 2.0) and abs(r.wind_v) < 1e-12
    with pytest.raises(DataError, match="vs"):
        assembly.ndws_to_channels(ndws(spark).drop("vs"))
    with pytest.raises(DataError, match="cover"):
        assembly.ndws_to_channels(ndws(spark).withColumn("th", F.when(F.col("col") == 0, F.col("th"))))


def test_required_channel_and_finite_guards(spark):
    cells = spark.createDataFrame([(1, 1.0, None), (1, None, 2.0)], "event_id long, elevation double, ndvi double")
    with pytest.raises(DataError, match="elevation"):
        assembly.check_channel_coverage(cells, channels=("elevation", "ndvi"))
    warn = assembly.check_channel_coverage(cells, required=(), channels=("elevation", "ndvi")).collect()
    assert {(w.channel, w.missing) for w in warn} == {("elevation", 1), ("ndvi", 1)}
    with pytest.raises(DataError, match="'ndvi': 1"):
        assembly.require_finite(cells, ["ndvi"])
    with pytest.raises(DataError):
        assembly.nan_to_zero(cells, [])


def test_serving_needs_elevation_and_weather(spark):
    cell = lambda layer: spark.createDataFrame([(layer, None, 0, 0, 1.0)], "layer string, day date, row int, col int, value double")
    with pytest.raises(DataError, match="elevation"):
        assembly.export_served_layers(cell("wind_u"))
    with pytest.raises(DataError, match="weather"):
        assembly.export_served_layers(cell("elevation"))
