"""Landing, loading and serving of active-fire detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.functions.geo import in_bbox, valid_coordinates
from emberline.functions.when import parse_acq_time
from emberline.schemas import REQUIRED_FIRMS_COLUMNS, STUDY_AREA
from emberline.session import durable, require_columns
from emberline.sources.commits import commit, read_table

# The key of one observation, time parts exactly as delivered.
DEDUP_KEY = ("acq_date", "acq_time", "lat6", "lon6", "satellite")


def read_detections_csv(spark: SparkSession, path: str) -> DataFrame:
    """Area CSV as delivered -> DETECTION."""
    return to_detections(spark.read.csv(path, header=True))


def to_detections(raw: DataFrame) -> DataFrame:
    """All-text landing rows -> DETECTION; blank frp is missing, confidence stays text."""
    require_columns(raw, REQUIRED_FIRMS_COLUMNS)
    frp = F.nullif(F.trim("frp"), F.lit("")).cast("double") if "frp" in raw.columns else F.lit(None).cast("double")
    out = raw.select(
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"),
        parse_acq_time("acq_date", "acq_time").alias("detected_at"), frp.alias("frp"),
        "confidence", "satellite", "instrument")
    return out.withColumn("latitude", F.when(valid_coordinates("latitude", "longitude"), F.col("latitude"))
                          .otherwise(F.raise_error(F.format_string("coordinates out of range: %s, %s",
                                                                   "latitude", "longitude"))))


def land_raw(raw: DataFrame, query: DataFrame, base: str) -> None:
    """Append the untouched text response of one query and its log row.

    `query` is a one-row QUERY_LOG without row_count; both tables grow by append, partitioned by
    the download date, so a chunk that has landed survives the failure of a later one.
    """
    log = (query.withColumn("row_count", F.lit(raw.count()).cast("bigint"))
           .withColumn("download_date", F.to_date("downloaded_at")))
    date = query.select(F.to_date("downloaded_at").cast("string")).first()[0]
    (raw.select([F.col(c).cast("string") for c in raw.columns]).withColumn("download_date", F.lit(date))
     .write.mode("append").partitionBy("download_date").parquet(f"{base}/raw"))
    log.write.mode("append").partitionBy("download_date").parquet(f"{base}/query_log")


def read_landed(spark: SparkSession, base: str, schema: str | None = None) -> DataFrame:
    """Landed text rows with their delivery order (`seq`: path, then row within the file).

    `schema` (DDL, without the partition column) is needed to read a folder that does not exist yet as empty.
    """
    path = f"{base}/raw"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        cols = schema or ", ".join(f"{c} string" for c in (*REQUIRED_FIRMS_COLUMNS, "frp"))
        return spark.createDataFrame([], cols + ", download_date string, seq struct<path:string,row:bigint>")
    return (spark.read.option("mergeSchema", "false").parquet(path)
            .withColumn("download_date", F.col("download_date").cast("string"))
            .withColumn("seq", F.struct(F.col("_metadata.file_path").alias("path"),
                                        F.col("_metadata.row_index").alias("row"))))


def first_detection_wins(raw: DataFrame, order: str = "seq", start=None, end=None) -> DataFrame:
    """One row per observation key, the earliest in `order`.

    Written as an aggregation (`min_by` of the row) rather than a window: copies collapse before
    the shuffle, so an observation downloaded any number of times costs one row per task.
    The date range filters on the ISO text, which Parquet can prune.
    """
    if start is not None:
        raw = raw.filter(F.col("acq_date") >= str(start))
    if end is not None:
        raw = raw.filter(F.col("acq_date") <= str(end))
    keyed = (raw.withColumn("lat6", F.round(F.col("latitude").cast("double"), 6))
             .withColumn("lon6", F.round(F.col("longitude").cast("double"), 6)))
    rest = [c for c in raw.columns if c not in DEDUP_KEY and c != order]
    first = keyed.groupBy(*DEDUP_KEY).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return first.select("acq_date", "acq_time", "satellite", "r.*")


def load_detections(raw: DataFrame, start=None, end=None, order: str = "seq") -> DataFrame:
    """Landed rows -> DETECTION, inclusive date range, re-downloads removed first-wins."""
    return to_detections(first_detection_wins(raw, order, start, end))


def _month(date) -> Column:
    """202401 of an ISO date or its text; NULL of a text that is none."""
    return F.expr(f"try_cast(replace(substring(cast({date} as string), 1, 7), '-', '') as int)")


def append_curated(raw: DataFrame, path: str, stamp: str | None = None) -> int:
    """Publish landed rows (with `seq`) in folders of their acquisition month; a repeated `stamp` adds nothing.

    Months are packed into files by measured size, so one that holds a third of all rows is written by many tasks.
    """
    rows = raw.withColumn("acq_month", _month("acq_date")).hint("rebalance", "acq_month")
    return commit(raw.sparkSession, path, {"detections": rows}, stamp=stamp, partition_by={"detections": ["acq_month"]})


def read_curated(spark: SparkSession, path: str, start=None, end=None) -> DataFrame | None:
    """Curated rows as `load_detections` takes them, of the months from `start` to `end`; other months are not read."""
    rows = read_table(spark, path, "detections")
    if rows is None:
        return None
    bound = lambda day: int(str(day)[:7].replace("-", ""))
    if start is not None:
        rows = rows.filter(F.col("acq_month") >= bound(start))
    if end is not None:
        rows = rows.filter(F.col("acq_month") <= bound(end))
    return rows.drop("acq_month", "commit")


def load_days(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """DETECTION of all days inside any of `ranges` (start, end); the months of the ranges prune the scan while it runs.

    What is broadcast has one row per calendar day, however many ranges there are.
    """
    days = durable(ranges.select(F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("day")).distinct())
    # Spark prunes a scan at run time only by a side that has a comparison
    months = days.select(_month("day").alias("acq_month")).distinct().filter("acq_month > 0")
    rows = read_table(spark, path, "detections").join(F.broadcast(months), "acq_month", "left_semi")
    wanted = days.select(F.date_format("day", "yyyy-MM-dd").alias("acq_date"))
    return load_detections(rows.join(F.broadcast(wanted), "acq_date", "left_semi").drop("acq_month", "commit"))


def select_latest(detections: DataFrame, as_of, days: int, bbox=STUDY_AREA) -> DataFrame:
    """Detections of the `days` (1 to 5) UTC days up to `as_of` inside the study area."""
    if not 1 <= days <= 5:
        raise ValueError("days must be between 1 and 5")
    day = F.to_date("detected_at")
    return detections.filter(in_bbox("longitude", "latitude", bbox) & (day <= F.lit(as_of))
                             & (day > F.date_sub(F.lit(as_of).cast("date"), days)))


def active_fires(detections: DataFrame, as_of, days: int, bbox=STUDY_AREA) -> DataFrame:
    """GeoJSON point features of the latest detections, one text per row."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("detected_at"), "frp", "confidence",
                 "satellite", "instrument").alias("properties"))
    return select_latest(detections, as_of, days, bbox).select(
        "detected_at", "longitude", "latitude", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def require_in_study_area(points: DataFrame, bbox=STUDY_AREA) -> DataFrame:
    """Points (lon, lat) unchanged; one outside the box fails the job and names the box."""
    return points.withColumn("lon", F.when(in_bbox("lon", "lat", bbox), F.col("lon")).otherwise(
        F.raise_error(F.format_string("point %s, %s lies outside the study area " + str(bbox), "lon", "lat"))))


def ingest_summary(log: DataFrame) -> DataFrame:
    """Rows and queries per chunk and in total (chunk columns NULL), with the date to resume from."""
    per = log.groupBy("query_start", "query_end").agg(
        F.count("*").alias("n_queries"), F.sum("row_count").alias("n_detections"))
    total = per.agg(F.lit(None).cast("date").alias("query_start"), F.lit(None).cast("date").alias("query_end"),
                    F.sum("n_queries").alias("n_queries"), F.sum("n_detections").alias("n_detections"),
                    F.date_add(F.max("query_end"), 1).alias("resume_from"))
    return per.withColumn("resume_from", F.date_add("query_end", 1)).unionByName(total)
