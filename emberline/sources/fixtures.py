"""Adapters that read the driver's tables as wildfire inputs. Every row of a table is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_A_TASK = 250_000


def _dealt(df: DataFrame, key: str, times: int, in_order: bool = False) -> DataFrame:
    """`df` in parts that unroll to about ROWS_A_TASK rows each.

    Spark cuts a file by its bytes and row groups; a compressed table of a few MB that becomes tens of millions of rows would
    be the work of two or three tasks, and each task's share would grow with the table. `in_order` keeps near keys in one part, as
    the files of a raster do, so that what is found of neighbours adds up before it is shuffled.
    """
    parts = -(-df.count() * times // ROWS_A_TASK)
    deal = df.repartitionByRange if in_order else df.repartition
    return deal(parts, key) if parts > 1 else df


def _times(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def detections_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing rows from `events`: a site per user, copies re-downloaded a day later, blank frp, short HHMM."""
    e = table(spark, sf_dir, "events")
    m = lambda c, k: F.pmod(F.col(c) if isinstance(c, str) else c, F.lit(k))
    site = m(F.col("user_id") * 1103, 2500)
    lat = (-39000000 + m(site, 50) * 50000 + m(F.col("event_id") * 7919, 41) * 700).cast("int") / F.lit(1e6)
    lon = (-73600000 + F.floor(site / 50) * 50000 + m(F.col("event_id") * 104729, 37) * 700).cast("int") / F.lit(1e6)
    text = lambda c, t: c.cast(t).cast("string")
    ts = F.col("ts").cast("timestamp_ntz")
    return (e.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(m("event_id", 7) == 0, 1).otherwise(0))))
            .select(
        text(lat, "decimal(9,6)").alias("latitude"), text(lon, "decimal(9,6)").alias("longitude"),
        F.date_format(ts, "yyyy-MM-dd").alias("acq_date"),
        (F.hour(ts) * 100 + F.minute(ts)).cast("string").alias("acq_time"),
        F.when(m("event_id", 3) == 0, "N20").otherwise("N").alias("satellite"),
        F.lit("VIIRS").alias("instrument"),
        F.when(m("event_id", 7) == 0, "h").when(m("event_id", 7) < 3, "l").otherwise("n").alias("confidence"),
        F.when(m("event_id", 11) == 0, "").otherwise(text(F.col("value"), "decimal(10,2)")).alias("frp"),
        F.when(F.col("copy") == 0, "2024-02-01").otherwise("2024-02-02").alias("download_date"),
        F.struct("copy", "event_id").alias("seq")))


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """49 hourly samples per customer: two days and the closing midnight."""
    c = _dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id")), "cell_id", 49)
    k, h = F.col("cell_id"), F.col("h")
    num = lambda v: v.cast("double")
    return c.withColumn("h", _times(49)).select(
        "cell_id", F.date_add(F.lit("2024-01-01").cast("date"), F.floor(h / 24).cast("int")).alias("day"),
        (h % 24).alias("hour"), num(280 + (k * 7 + h * 3) % 25).alias("t2m"),
        num(272 + (k * 5 + h * 2) % 15).alias("d2m"), num((k * 3 + h) % 13 - 6).alias("u10"),
        num((k + h * 5) % 11 - 5).alias("v10"),
        (F.when(h % 24 == 0, num(24 * (k % 9))).otherwise(num((h % 24) * (k % 9))) / 10000).alias("tp"))


def reflectance_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight scenes per customer over five weeks."""
    c = _dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id")), "cell_id", 8)
    k, s = F.col("cell_id"), F.col("scene")
    return c.withColumn("scene", _times(8)).select(
        "cell_id", "scene", F.date_add(F.lit("2024-01-01").cast("date"), s * 5).alias("scene_day"),
        ((s * 13) % 100).alias("cloud_cover"), ((k * 5 + s * 3) % 12).alias("scl"),
        ((k * 31 + s * 17) % 1500 - 50).cast("double").alias("red"),
        (200 + (k * 57 + s * 91) % 3200).cast("double").alias("nir"))


def cells(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """A raster 50 cells wide with elevation and land cover, one cell per part; `times` is how often the caller unrolls a cell."""
    p = _dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell_id"), "p_size"), "cell_id", times, in_order=True)
    row, col = F.floor(F.col("cell_id") / 50), F.col("cell_id") % 50
    classes = F.array(*[F.lit(v) for v in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100, 30, 0)])
    return p.select("cell_id", row.cast("int").alias("row"), col.cast("int").alias("col"),
                    (100 + (row * 13 + col * 7 + F.col("p_size") * 3) % 200).cast("double").alias("elevation"),
                    F.get(classes, (F.col("cell_id") % 13).cast("int")).alias("landcover"))


def event_cell_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of 10 x 50 cells over five days, day 0 without fire."""
    p = _dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size"), "k", 5)
    k, d = F.col("k"), F.col("day_idx")
    return p.withColumn("day_idx", _times(5)).select(
        F.floor(k / 500).alias("event_id"), "day_idx",
        F.date_add(F.lit("2024-01-01").cast("date"), d).alias("day"),
        F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"),
        ((k + d) % 11 - 5).cast("double").alias("wind_u"), ((k * 3 + d) % 9 - 4).cast("double").alias("wind_v"),
        ((k * 11) % 45).cast("double").alias("slope_deg"),
        (100 + F.floor(k / 50) % 20 * 13 + (k % 50) * 7 % 30 + F.col("p_size")).cast("double").alias("elevation"),
        (280 + (k * 7 + d * 3) % 25).cast("double").alias("temperature"),
        F.when((k + d) % 17 != 0, (20 + (k * 5 + d) % 60).cast("double")).alias("relative_humidity"),
        F.get(F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4, 5, 90, 91, 92, 93, 99)]),
              ((k * 3) % 10).cast("int")).alias("fuel_type"),
        F.when((d >= 1) & ((k * 37 + d * 11) % 97 < 6 + 4 * d), 1.0).otherwise(0.0).alias("fire_mask"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' daily probabilities for every cell of `event_cell_day`."""
    p = _dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k", 10)
    k, d = F.col("k"), F.col("day_idx")
    a, b = (k * 37 + d * 7) % 97, 96 - (k * 37 + d * 11 + 5) % 97
    return (p.withColumn("day_idx", _times(5)).withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"))))
            .select("model", F.floor(k / 500).alias("event_id"), "day_idx",
                    F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"),
                    (F.when(F.col("model") == "a", a).otherwise(b).cast("double") / 97).alias("p")))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event footprint per supplier; every hundred suppliers burn 20 days later."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("event_id"))
    k = F.col("event_id")
    x, y = (k * 37) % 50 * 4, (k * 23) % 50 * 4
    t = ((k * 7) % 12 + F.floor(k / 100) * 20).cast("int")
    deg = lambda base, v: (base + v).cast("double") / 100
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    return s.select("event_id", deg(-7350, x).alias("west"), deg(-3900, y).alias("south"),
                    deg(-7348, x).alias("east"), deg(-3898, y).alias("north"),
                    day(t).alias("first_day"), day(t + (k % 4).cast("int")).alias("last_day"))
