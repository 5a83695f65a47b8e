"""Parquet and JSON tables: layers, event cells, events, runs, results."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.functions.geo import bbox_text, bbox_wkt
from emberline.operators.evaluation import METRICS, long_metrics, resolve_event_pk, trim_to_first_fire_day
from emberline.operators.skew import join_counted
from emberline.schemas import CELL
from emberline.session import DataError, durable
from emberline.sources.commits import Conflict, commit, live_stamps, manifests, read_table

# Nodata sentinels of processed layers.
NODATA = {"elevation": -32767.0, "slope_deg": -9999.0, "aspect_deg": -9999.0, "ndvi": -9999.0,
          "landcover": 0.0, "fuel_type": 99.0}


def nodata_to_null(cells: DataFrame) -> DataFrame:
    """CELL rows with the sentinel of their layer, and NaN, as NULL."""
    sentinel = F.create_map(*[F.lit(x) for kv in NODATA.items() for x in kv])[F.col("layer")]
    bad = F.isnan("value") | (F.coalesce(sentinel, F.lit(float("nan"))) == F.col("value"))
    return cells.withColumn("value", F.when(~bad, F.col("value")))


def require_one_elevation(cells: DataFrame) -> DataFrame:
    """`cells` unchanged when exactly one source holds the elevation layer."""
    n = cells.filter(F.col("layer") == "elevation").select("source").distinct().limit(2).count()
    if n != 1:
        raise DataError("no elevation layer" if n == 0 else "more than one elevation layer")
    return cells


def read_layer_cells(spark: SparkSession, path: str) -> DataFrame:
    """Processed layers (CELL and `source`) with missing values as NULL."""
    return nodata_to_null(require_one_elevation(spark.read.schema(CELL + ", source string").parquet(path)))


def _packed(cells: DataFrame) -> DataFrame:
    """Cells in files of a comfortable size: events are packed together or split as measured, and sorted so that statistics prune."""
    order = [c for c in ("event_id", "day_idx", "day") if c in cells.columns]
    return cells.hint("rebalance", "event_id").sortWithinPartitions(*order)


def _rows_per_event(written: dict[str, str]) -> DataFrame:
    spark = SparkSession.active()
    return spark.read.parquet(written["cells"]).groupBy("event_id").agg(F.count("*").alias("n"))


def write_event_cells(cells: DataFrame, path: str) -> None:
    """Replace the events present in `cells`, each as a whole, leave the others; visible once all is written.

    A commit holds files of many events, not a folder an event, and a table of its events and their rows. An event is read from the
    last commit that holds it; what that leaves behind goes with `compact_event_cells`.
    """
    commit(cells.sparkSession, path, {"cells": _packed(cells), "events": _rows_per_event})


def _live_cells(spark: SparkSession, path: str, log: list[dict]) -> DataFrame:
    at = log[-1]["version"]
    cells, events = read_table(spark, path, "cells", at), read_table(spark, path, "events", at)
    stamps = live_stamps(log, "events", at)
    if len(stamps) == 1:
        return cells.drop("commit")
    age = F.array_position(F.array(*[F.lit(s) for s in stamps]), F.col("commit"))
    last = events.groupBy("event_id").agg(F.max_by(F.struct("commit", "n"), age).alias("r")).select("event_id", "r.commit", "r.n")
    return join_counted(cells, durable(last), ["event_id", "commit"]).drop("commit", "n")


def read_event_cells(spark: SparkSession, path: str) -> DataFrame:
    """The published cells of all events."""
    log = manifests(spark, path)
    if not log:
        raise DataError(f"no event cells under {path}")
    return _live_cells(spark, path, log).withColumn("event_id", F.col("event_id").cast("bigint"))


def compact_event_cells(spark: SparkSession, path: str) -> int:
    """Publish all live cells as one commit; Conflict when another job publishes meanwhile."""
    log = manifests(spark, path)
    return commit(spark, path, {"cells": _packed(_live_cells(spark, path, log)), "events": _rows_per_event},
                  replace=("cells", "events"), expected=log[-1]["version"])


def load_split_cells(cells: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Cells of the events of one split, trimmed to their first fire day; events without a split are an error."""
    own = F.coalesce("split", F.raise_error(F.lit("events without a split")).cast("string"))
    return trim_to_first_fire_day(cells, split.filter(own == name))


def event_rows(events: DataFrame, source: str = "firms_cluster") -> DataFrame:
    """EVENT -> rows of the event table."""
    box = ("west", "south", "east", "north")
    return events.select(F.col("event_id").alias("firms_event_id"), bbox_text(*box).alias("bbox"),
                         "start_date", "end_date", F.lit(source).alias("source"), bbox_wkt(*box).alias("geom"))


def merge_events(current: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-update by firms_event_id; a known event keeps its id, a new one gets the hash-derived id."""
    ids = current.select("firms_event_id", "id")
    fresh = new.join(ids, "firms_event_id", "left").withColumn("id", F.coalesce("id", F.xxhash64("firms_event_id")))
    kept = current.join(new.select("firms_event_id"), "firms_event_id", "left_anti")
    return kept.unionByName(fresh)


def read_events(spark: SparkSession, path: str) -> DataFrame | None:
    """The event table as last published, None before the first."""
    found = read_table(spark, path, "events")
    return None if found is None else found.drop("commit")


def upsert_events(spark: SparkSession, events: DataFrame, path: str) -> None:
    """Publish the merged event table. If another job publishes meanwhile, the merge is repeated on its result."""
    new = durable(event_rows(events))
    while True:
        log = manifests(spark, path)
        seen = log[-1]["version"] if log else 0
        current = read_table(spark, path, "events", seen)
        merged = new.withColumn("id", F.xxhash64("firms_event_id")) if current is None else merge_events(current.drop("commit"), new)
        try:
            commit(spark, path, {"events": merged}, replace=("events",), expected=seen)
            return
        except Conflict:
            continue


def run_rows(per_event: DataFrame, events: DataFrame, model: str, split: str, config: str, stamp: str = "") -> tuple[DataFrame, DataFrame]:
    """(model_run, evaluation_result) rows of an EVENT_METRIC table; an unknown event is an error.

    `stamp` names the run: the same scores under another stamp are other runs.
    """
    known = resolve_event_pk(per_event.withColumn("model", F.lit(model)), events)
    keyed = known.withColumn("run_id", F.xxhash64("event_pk", "model", F.lit(split), F.lit(config), F.lit(stamp)))
    runs = keyed.select("run_id", F.col("event_pk").alias("event_id"), F.col("model").alias("model_name"),
                        F.lit(config).alias("config"))
    values = long_metrics(keyed.withColumn("event_id", F.col("run_id")).drop("split"))
    return runs, values.select(F.col("event_id").alias("run_id"), F.col("metric").alias("metric_name"), "value",
                               F.lit(split).alias("split"))


def append_runs(per_event: DataFrame, events: DataFrame, model: str, split: str, config: str, path: str, stamp: str | None = None) -> int:
    """Append one run and four results per event, visible together or not at all; nothing is written when any event is unknown.

    Every call is a run of its own, unless it repeats a published `stamp`. `read_runs` reads what is published.
    """
    spark, stamp = per_event.sparkSession, stamp or uuid.uuid4().hex
    runs, results = run_rows(durable(per_event), events, model, split, config, stamp)
    return commit(spark, path, {"model_run": runs, "evaluation_result": results}, stamp=stamp)


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(model_run, evaluation_result) of all published runs, None before the first."""
    log = manifests(spark, path)
    if not log:
        return None
    at = log[-1]["version"]
    return read_table(spark, path, "model_run", at), read_table(spark, path, "evaluation_result", at)


RESULT_SCHEMA = ("kind string, model_name string, split string, "
                 "per_event array<struct<event_id:bigint,iou:double,dice:double,brier:double,ece:double>>")


def write_results(per_event: DataFrame, split: str, path: str, per_file: int = 50_000) -> None:
    """EVENT_METRIC rows as result files that `load_results` reads: JSON objects of about `per_file` events of one model.

    Earlier files of the same models and split are replaced. A model of any number of events is cut into as many files as it needs.
    """
    files = per_event.groupBy("model").agg(F.ceil(F.count("*") / per_file).alias("files"))
    rows = per_event.join(files, "model").withColumn("part", F.pmod(F.xxhash64("event_id"), F.col("files")))
    docs = rows.groupBy("model", "part").agg(F.sort_array(F.collect_list(F.struct("event_id", *METRICS))).alias("per_event"))
    body = F.to_json(F.struct(F.lit("backtest").alias("kind"), F.col("model").alias("model_name"), F.lit(split).alias("split"), "per_event"))
    (docs.select(F.col("model").alias("of_model"), F.lit(split).alias("of_split"), body.alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1)
     .partitionBy("of_model", "of_split").text(path))


def load_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(EVENT_METRIC rows of the model results, other kinds) of a folder of JSON files; non-objects are skipped."""
    docs = spark.read.schema(RESULT_SCHEMA + ", _corrupt_record string").json(path, multiLine=True)
    docs = docs.filter(F.col("_corrupt_record").isNull())
    models = docs.filter(F.col("model_name").isNotNull() & F.col("per_event").isNotNull())
    rows = models.select(F.col("model_name").alias("model"), "split", F.explode("per_event").alias("e")).select(
        "model", "split", "e.*")
    return rows, docs.filter(F.col("kind").isNotNull()).select("kind")


def union_sorted(pieces: list[DataFrame], *order: str) -> DataFrame:
    """Monthly pieces as one table in time order."""
    return reduce(DataFrame.unionByName, pieces).orderBy(*order)
