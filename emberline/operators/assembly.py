"""Event data sets: assembly of channels, coverage, training pairs, public records, served layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.functions.meteo import rh_from_specific_humidity, wind_components
from emberline.functions.surface import UNKNOWN_FUEL
from emberline.operators.grids import block_average, grid_cells, slope_aspect
from emberline.operators.weather import FIELDS
from emberline.schemas import CHANNELS
from emberline.session import DataError, require_columns, require_none

STATIC = ("elevation", "slope_deg", "aspect_deg", "fuel_type")
# Channels the default spread model cannot do without.
REQUIRED_CHANNELS = ("elevation", "wind_u", "wind_v", "fuel_type")
# Features of a public next-day record.
NDWS_FEATURES = ("elevation", "pdsi", "NDVI", "pr", "sph", "th", "tmmn", "tmmx", "vs", "erc", "population",
                 "PrevFireMask", "FireMask")


def assemble_event(grids: DataFrame, days: DataFrame, static: DataFrame, weather: DataFrame, ndvi: DataFrame,
                   fire: DataFrame) -> DataFrame:
    """EVENT_CELL_DAY: every cell of every event on every day of its window, one column per channel.

    grids    event_id, grid             static   event_id, row, col, STATIC channels
    days     event_id, days (array)     weather  event_id, day, row, col, weather fields
    ndvi     event_id, year, month, row, col, ndvi       fire  event_id, day, row, col

    Static layers join once per cell, before the days are unrolled; days without a source are
    missing, cells without fire are 0.
    """
    at = ["event_id", "row", "col"]
    cells = grid_cells(grids.join(days, "event_id")).select(*at, "x", "y", "days")
    base = cells.join(static.select(*at, *STATIC), at, "left")
    unrolled = base.select("*", F.posexplode("days").alias("day_idx", "day")).drop("days")
    unrolled = unrolled.withColumns({"year": F.year("day"), "month": F.month("day")})
    out = (unrolled.join(weather.select(*at, "day", *FIELDS), [*at, "day"], "left")
           .join(ndvi.select(*at, "year", "month", "ndvi"), [*at, "year", "month"], "left")
           .join(fire.select(*at, "day").distinct().withColumn("burning", F.lit(1.0)), [*at, "day"], "left"))
    return out.withColumn("fire_mask", F.coalesce("burning", F.lit(0.0))).select(
        "event_id", "day", "day_idx", "row", "col", *CHANNELS)


def day_index(cells: DataFrame) -> DataFrame:
    """Add `day_idx`, the position of the day within its event, from the event's distinct days."""
    w = Window.partitionBy("event_id").orderBy("day")
    days = cells.select("event_id", "day").distinct().withColumn("day_idx", F.row_number().over(w) - 1)
    return cells.join(days, ["event_id", "day"])


def absent(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def coverage(cells: DataFrame, channels=tuple(c for c in CHANNELS if c != "fire_mask")) -> DataFrame:
    """(event_id, channel, missing, total): cells without a finite value."""
    present = [c for c in channels if c in cells.columns]
    per = cells.groupBy("event_id").agg(F.count("*").alias("total"), *[F.count_if(absent(c)).alias(c) for c in present])
    return per.unpivot(["event_id", "total"], present, "channel", "missing")


def check_channel_coverage(cells: DataFrame, required=REQUIRED_CHANNELS, channels=None) -> DataFrame:
    """Warnings: channels with missing cells. A required one is an error that names it."""
    cov = coverage(cells, channels) if channels else coverage(cells)
    short = cov.filter(F.col("missing") > 0)
    require_none(short.filter(F.col("channel").isin(*required)), "required channel has missing cells")
    return short


def require_finite(df: DataFrame, columns) -> DataFrame:
    """`df` unchanged; missing or non-finite values are an error with their count per column."""
    bad = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns])
    require_none(bad.filter(sum((F.col(c) for c in columns), F.lit(0)) > 0), "non-finite values")
    return df


def nan_to_zero(df: DataFrame, columns) -> DataFrame:
    """Missing values of the named columns become 0, a last resort for training inputs only."""
    if not columns:
        raise DataError("name the columns to fill")
    return df.withColumns({c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) for c in columns})


def training_pairs(cells: DataFrame, cumulative: bool = True) -> DataFrame:
    """State of a day with `label`, the fire of the next day of the same cell; the last day has no pair."""
    w = Window.partitionBy("event_id", "row", "col").orderBy("day_idx")
    fire = (F.coalesce("fire_mask", F.lit(0.0)) >= 0.5).cast("double")
    state = fire if not cumulative else F.max(fire).over(w.rowsBetween(Window.unboundedPreceding, 0))
    raw = F.coalesce("fire_mask", F.lit(0.0))
    out = cells.withColumn("fire_mask", state if cumulative else raw)
    return (out.withColumn("label", F.lead("fire_mask").over(w)).filter(F.col("label").isNotNull()))


def sample_cap(pairs: DataFrame, n: int, splits=("train",), seed: int = 42) -> DataFrame:
    """At most `n` (event, day) samples of each of `splits`, the first in seeded hash order; other splits stay whole.

    A documented bound of the labelled rows a model is fitted on. Val and test are scored whole unless named. Each
    cut is a top-n per task and one merge.
    """
    keys = ["split", "event_id", "day_idx"]
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys[1:]]), 256)
    out = pairs.filter(~F.coalesce(F.col("split").isin(*splits), F.lit(False)))
    for s in splits:
        part = pairs.filter(F.col("split") == s)
        top = part.select(*keys).distinct().orderBy(order, *keys[1:]).limit(n)
        out = out.unionByName(part.join(top, keys, "left_semi"))
    return out


def ndws_to_channels(cells: DataFrame, res: float = 1000.0) -> DataFrame:
    """Public record cells -> the event channels and `label`, the next-day mask.

    Records are square grids; one whose features do not all cover every cell is an error.
    """
    require_columns(cells, ("sample_id", "row", "col", *NDWS_FEATURES))
    short = cells.groupBy("sample_id").agg(
        ((F.max("row") + 1) * (F.max("col") + 1)).alias("expected"),
        *[F.count(f).alias(f) for f in NDWS_FEATURES])
    odd = F.lit(False)
    for f in NDWS_FEATURES:
        odd = odd | (F.col(f) != F.col("expected"))
    require_none(short.filter(odd), "record with features that do not cover its grid")
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    u, v = wind_components("vs", "th")
    terrain = slope_aspect(cells, res, res, keys=("sample_id",))
    mean_t = (F.col("tmmn") + F.col("tmmx")) / 2
    return terrain.withColumn("temperature", mean_t).select(
        "sample_id", "row", "col", "elevation", "slope_deg", "aspect_deg", u.alias("wind_u"), v.alias("wind_v"),
        "temperature", rh_from_specific_humidity("sph", "temperature").alias("relative_humidity"),
        (F.col("pr") / 1000).alias("precipitation"), clip(F.col("NDVI") / 10000, -1.0, 1.0).alias("ndvi"),
        F.lit(float(UNKNOWN_FUEL)).alias("fuel_type"), clip(F.col("PrevFireMask"), 0.0, 1.0).alias("fire_mask"),
        clip(F.col("FireMask"), 0.0, 1.0).alias("label"))


def export_served_layers(layers: DataFrame, k: int = 8) -> DataFrame:
    """The CELL rows a forecast reads: static layers as they are, weather fields averaged over k x k cells."""
    wanted = layers.filter(F.col("layer").isin("elevation", *FIELDS))
    kinds = {r.layer for r in wanted.select("layer").distinct().collect()}
    if "elevation" not in kinds:
        raise DataError("no elevation layer to serve")
    if not kinds & set(FIELDS):
        raise DataError("no weather layer to serve")
    fixed = layers.filter(F.col("layer").isin(*STATIC, "ndvi"))
    coarse = block_average(layers.filter(F.col("layer").isin(*FIELDS)), k, ("layer", "day"))
    return fixed.select("layer", "day", "row", "col", "value").unionByName(
        coarse.select("layer", "day", "row", "col", "value"))


# Constant layers of the demonstration data set.
DEMO_STATIC = {"elevation": 100.0, "slope_deg": 0.0, "aspect_deg": -1.0, "fuel_type": 1.0, "ndvi": 0.5}
DEMO_WEATHER = {"wind_u": 3.0, "wind_v": 0.0, "temperature": 25.0, "relative_humidity": 30.0, "precipitation": 0.0}


def demo_layers(days: DataFrame, size: int = 80) -> DataFrame:
    """Constant CELL layers of size x size cells: static ones once, weather for every row of `days`."""
    pair = lambda table: F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), F.lit(v).alias("value"))
                                             for k, v in table.items()]))
    static = days.limit(1).select(F.lit(None).cast("date").alias("day"), pair(DEMO_STATIC).alias("l"))
    both = static.unionByName(days.select("day", pair(DEMO_WEATHER).alias("l")))
    side = F.sequence(F.lit(0), F.lit(size - 1))
    return (both.withColumn("row", F.explode(side)).withColumn("col", F.explode(side))
            .select("l.layer", "day", "row", "col", "l.value"))
