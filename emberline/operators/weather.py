"""Hourly reanalysis -> daily fields, derived weather, coverage of days and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.functions.meteo import relative_humidity, wind_from_direction, wind_speed
from emberline.session import DataError

# Variables averaged over the day, and the accumulated one.
INSTANT = ("t2m", "d2m", "u10", "v10")
ACCUMULATED = ("tp",)
FIELDS = ("wind_u", "wind_v", "temperature", "relative_humidity", "precipitation")


def daily_weather(hourly: DataFrame, start=None, end=None, variables=INSTANT + ACCUMULATED) -> DataFrame:
    """WEATHER_DAILY per cell_id and day from samples (cell_id, day, hour, variables), days in [start, end].

    Instantaneous variables are means over the day's hours. An accumulated variable of day d is the
    sample of the next midnight, never a sum over hours; without that sample the job fails.
    Each midnight sample is counted for its own day and for the day it closes, so both kinds of
    variable come from one aggregation that is combined before the shuffle.
    """
    unknown = [v for v in variables if v not in INSTANT + ACCUMULATED]
    if unknown:
        raise DataError(f"no daily rule for variable(s) {', '.join(unknown)}")
    instant = [v for v in variables if v in INSTANT]
    total = [v for v in variables if v in ACCUMULATED]
    closes = F.struct(F.date_sub("day", 1).alias("d"), F.lit(True).alias("closing"))
    own = F.struct(F.col("day").alias("d"), F.lit(False).alias("closing"))
    rows = hourly.select("cell_id", *variables, F.explode(
        F.when(F.col("hour") == 0, F.array(own, closes)).otherwise(F.array(own))).alias("u"))
    rows = rows.select("cell_id", F.col("u.d").alias("day"), F.col("u.closing").alias("closing"), *variables)
    if start is not None:
        rows = rows.filter(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("day") <= F.lit(end).cast("date"))
    daily = rows.groupBy("cell_id", "day").agg(
        F.count_if(~F.col("closing")).alias("samples"), F.count_if("closing").alias("closings"),
        *[F.avg(F.when(~F.col("closing"), F.col(v))).alias(v) for v in instant],
        *[F.max(F.when(F.col("closing"), F.col(v))).alias(v) for v in total])
    lacking = F.raise_error(F.format_string("no closing midnight sample for cell %s on %s",
                                            F.col("cell_id").cast("string"), F.col("day").cast("string")))
    return daily.filter("samples > 0").select("cell_id", "day", *instant, *[
        F.when(F.col("closings") > 0, F.col(v)).otherwise(lacking).alias(v) for v in total])


def daily_mean(hourly: DataFrame, start=None, end=None, variables=INSTANT) -> DataFrame:
    bad = [v for v in variables if v not in INSTANT]
    if bad:
        raise DataError(f"not an instantaneous variable: {', '.join(bad)}")
    return daily_weather(hourly, start, end, tuple(variables))


def daily_carryover(hourly: DataFrame, start=None, end=None) -> DataFrame:
    return daily_weather(hourly, start, end, ACCUMULATED)


def derive_weather(daily: DataFrame) -> DataFrame:
    """Wind speed and direction, u, v, relative humidity, temperature and precipitation per cell and day.

    Components and temperatures are interpolated first; derive on the source grid only when both agree.
    """
    return daily.withColumns({
        "wind_speed": wind_speed("u10", "v10"), "wind_direction": wind_from_direction("u10", "v10"),
        "wind_u": F.col("u10"), "wind_v": F.col("v10"), "relative_humidity": relative_humidity("t2m", "d2m"),
        "temperature": F.col("t2m"), "precipitation": F.col("tp"),
    }).drop("u10", "v10", "t2m", "d2m", "tp")


def fill_from_source_mean(cells: DataFrame, source: DataFrame, fields=FIELDS, keys=("day",)) -> DataFrame:
    """Missing weather of a target cell <- mean of all valid source cells of that field and day.

    `imputed` counts the filled fields of a row; a field whose source is missing everywhere stays
    missing. The means are one row per day, whatever the size of the grids.
    """
    means = source.groupBy(*keys).agg(*[F.avg(f).alias(f"_{f}") for f in fields])
    filled = cells.join(F.broadcast(means), list(keys), "left")
    imputed = sum((F.when(F.col(f).isNull() & F.col(f"_{f}").isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return (filled.withColumn("imputed", imputed)
            .withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields]))


# ---------------------------------------------------------------- coverage
def resolve_sources(catalogue: DataFrame, fields=FIELDS) -> DataFrame:
    """One row per day with a 0/1 column per field that has a layer; a missing field does not drop the day."""
    return catalogue.groupBy("day").agg(*[F.max((F.col("field") == f).cast("int")).alias(f) for f in fields])


def missing_weather_days(requested: DataFrame, catalogue: DataFrame, fields=FIELDS) -> DataFrame:
    """(day, field): requested days times required fields, less what the catalogue holds."""
    wanted = requested.select("day").distinct().withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))
    return wanted.join(catalogue.select("day", "field").distinct(), ["day", "field"], "left_anti")


def complete_days(catalogue: DataFrame, fields=FIELDS) -> DataFrame:
    """Days on which every required field exists."""
    return (catalogue.filter(F.col("field").isin(*fields)).groupBy("day")
            .agg(F.count_distinct("field").alias("k")).filter(F.col("k") == len(fields)).select("day"))


def weather_range(catalogue: DataFrame, fields=FIELDS) -> DataFrame:
    return complete_days(catalogue, fields).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
