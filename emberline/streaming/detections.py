"""Detections as a stream over the landing folder, an incremental form of repeated polling with overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.functions.when import parse_acq_time
from emberline.sources.detections import DEDUP_KEY, to_detections

RAW_SCHEMA = ("latitude string, longitude string, acq_date string, acq_time string, satellite string, "
              "instrument string, confidence string, frp string, download_date string")


def read_landing(spark: SparkSession, base: str, schema: str = RAW_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(f"{base}/raw")


def stream_detections(landed: DataFrame, horizon: str = "30 days") -> DataFrame:
    """DETECTION stream without re-downloads; a copy is recognised while it arrives less than `horizon` after the first.

    Keys expire by arrival, which is the clock of the micro-batch that reads a row (written to the progress log, so a repeated batch
    says the same). Arrival never runs behind the watermark: however old an acquisition is, it comes out. Of copies in one
    micro-batch any may be the one that stays. State holds one key per detection of the last horizons, no rows.
    """
    keyed = (landed.withColumn("lat6", F.round(F.col("latitude").cast("double"), 6))
             .withColumn("lon6", F.round(F.col("longitude").cast("double"), 6))
             .withColumn("arrived_at", F.current_timestamp())
             .withWatermark("arrived_at", horizon).dropDuplicatesWithinWatermark(list(DEDUP_KEY)))
    return to_detections(keyed)


DENSITY = "day date, south double, west double, n long, frp double"


def density_parts(detections: DataFrame, cell_deg: float = 0.1) -> DataFrame:
    """DENSITY rows to be added up: per Arrow batch, the detections of a UTC day and cell of `cell_deg` degrees.

    Sums need no state and wait for no watermark; a late detection is one more part of its day. `read_density` adds the parts.
    """
    at = lambda c: (F.floor(F.col(c) / cell_deg) * cell_deg)

    def run(batches):
        for batch in batches:
            part = pa.Table.from_batches([batch]).group_by(["day", "south", "west"]).aggregate([([], "count_all"), ("frp", "sum")])
            for out in part.select(["day", "south", "west", "count_all", "frp_sum"]).rename_columns(["day", "south", "west", "n", "frp"]).to_batches():
                yield out

    cells = detections.select(F.to_date("detected_at").alias("day"), at("latitude").alias("south"), at("longitude").alias("west"), "frp")
    return cells.mapInArrow(run, DENSITY)


def read_density(spark: SparkSession, path: str) -> DataFrame:
    """DENSITY rows, one per day and cell, of all parts that `run_available` has committed under `path`."""
    return (spark.read.schema(DENSITY).parquet(f"{path}/data").groupBy("day", "south", "west")
            .agg(F.sum("n").alias("n"), F.sum("frp").alias("frp")))


def run_available(stream: DataFrame, path: str) -> None:
    """Process everything that has landed, append it to Parquet under `path`, and stop.

    The progress lies next to the output, so the next call takes up where this one ended.
    """
    (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/progress")
     .trigger(availableNow=True).start(f"{path}/data").awaitTermination())
