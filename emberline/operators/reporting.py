"""Report tables: event descriptors, comparisons between models, diagnosis of failing cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.functions.surface import flammability
from emberline.operators.evaluation import HIGHER_IS_BETTER, METRICS
from emberline.operators.ranking import value_ranks
from emberline.operators.skew import join_measured

FAIL_IOU = 0.30
RANK_HIGH, RANK_LOW = 0.75, 0.25
# Descriptor -> theme of the hypothesis it supports.
DESCRIPTORS = {"true_cells_final": "size", "wind_dir_circ_std_deg": "wind", "mean_wind_speed": "windspeed",
               "elevation_std_m": "terrain", "mean_slope_deg": "terrain", "nonflammable_fraction": "fuel"}


def event_descriptors(cells: DataFrame) -> DataFrame:
    """EVENT_DESCRIPTOR per event. Wind statistics are over daily means; spatial ones over the first day.

    Cells are only aggregated, by day and then by event; spatial values are those of the earliest day's row.
    """
    day = cells.groupBy("event_id", "day_idx").agg(
        F.min("day").alias("day"), F.avg("wind_u").alias("u"), F.avg("wind_v").alias("v"),
        F.sum("temperature").alias("t_sum"), F.count("temperature").alias("t_n"),
        F.sum("relative_humidity").alias("h_sum"), F.count("relative_humidity").alias("h_n"),
        F.stddev_pop("elevation").alias("elevation_std_m"), F.avg("slope_deg").alias("mean_slope_deg"),
        F.avg(F.when(F.col("fuel_type").isNotNull(), (flammability("fuel_type") == 0).cast("double"))).alias("nonflammable_fraction"),
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    angle = F.atan2("v", "u")
    n = F.count("*")
    r = F.hypot(F.avg(F.cos(angle)), F.avg(F.sin(angle)))
    spread = F.degrees(F.sqrt(F.greatest(-2 * F.ln(F.greatest(r, F.lit(1e-12))), F.lit(0.0))))
    steady = (n == 1) | (F.count_if(F.col("u").isNull() | F.col("v").isNull()) > 0)
    spatial = ("elevation_std_m", "mean_slope_deg", "nonflammable_fraction")
    wide = day.groupBy("event_id").agg(
        n.alias("n_days"), F.min("day").alias("date_first"), F.max("day").alias("date_last"),
        (F.max("r1") - F.min("r0") + 1).alias("height"), (F.max("c1") - F.min("c0") + 1).alias("width"),
        F.avg(F.hypot("u", "v")).alias("mean_wind_speed"),
        F.when(steady, F.lit(0.0)).otherwise(spread).alias("wind_dir_circ_std_deg"),
        F.min_by(F.struct(*spatial), "day_idx").alias("s"),
        F.try_divide(F.sum("t_sum"), F.sum("t_n")).alias("mean_temperature"),
        F.try_divide(F.sum("h_sum"), F.sum("h_n")).alias("mean_relative_humidity"))
    burned = (cells.groupBy("event_id", "row", "col").agg(F.max("fire_mask").alias("f")).groupBy("event_id")
              .agg(F.count_if(F.col("f") >= 0.5).alias("true_cells_final")))
    return wide.select("*", *[F.col("s")[c].alias(c) for c in spatial]).drop("s").join(burned, "event_id")


def long_descriptors(desc: DataFrame) -> DataFrame:
    """(event_id, split, descriptor, value) of the descriptors used in the diagnosis; missing ones left out."""
    d = desc.select("event_id", "split", *[F.col(c).cast("double").alias(c) for c in DESCRIPTORS])
    return d.unpivot(["event_id", "split"], list(DESCRIPTORS), "descriptor", "value").filter(F.col("value").isNotNull())


def percentile_rank(cases: DataFrame, train: DataFrame) -> DataFrame:
    """Cases (…, descriptor, value) with `rank` = (train values below + half the ties) / train values."""
    both = (train.select("descriptor", "value", F.lit(1).alias("w"))
            .unionByName(cases.select("descriptor", "value", F.lit(0).alias("w"))))
    ranks = value_ranks(both, ["descriptor"], "value", F.col("w")).filter("total > 0").select(
        "descriptor", "value", ((F.col("below") + 0.5 * F.col("ties")) / F.col("total")).alias("rank"))
    return join_measured(cases, ranks, ["descriptor", "value"])


def failing_cases(per_event: DataFrame, limit: float = FAIL_IOU) -> DataFrame:
    return per_event.filter(F.col("iou") < limit)


def descriptor_analysis(cases: DataFrame, train: DataFrame) -> DataFrame:
    """Per case and descriptor: train range, rank, flag, and the theme of a supported hypothesis (NULL for none)."""
    span = train.groupBy("descriptor").agg(F.min("value").alias("train_min"), F.max("value").alias("train_max"))
    at = percentile_rank(cases, train).join(F.broadcast(span), "descriptor")  # one row per descriptor
    theme = F.create_map(*[F.lit(x) for kv in DESCRIPTORS.items() for x in kv])[F.col("descriptor")]
    outside = (F.col("value") < F.col("train_min")) | (F.col("value") > F.col("train_max"))
    flag = (F.when(outside, "outside").when(F.col("rank") >= RANK_HIGH, "high").when(F.col("rank") <= RANK_LOW, "low")
            .otherwise("inside"))
    backed = (outside | ((F.col("rank") >= RANK_HIGH) & (theme != "size"))
              | ((theme == "size") & (F.col("rank") <= RANK_LOW)))
    return at.withColumns({"flag": flag, "hypothesis": F.when(backed, theme)})


# ---------------------------------------------------------------- model comparison
def _better(metric: Column) -> Column:
    """1 where a higher value of the metric is better, else -1."""
    return F.when(metric.isin(*[m for m, up in HIGHER_IS_BETTER.items() if up]), 1).otherwise(-1)


def _order(models: list[str]) -> Column:
    known = F.create_map(*[F.lit(x) for i, m in enumerate(models) for x in (m, i)])
    return F.coalesce(known[F.col("model")], F.lit(len(models)))


def rank_models(agg: DataFrame, models: list[str]) -> DataFrame:
    """Rank of every model per metric, ties in the fixed model order (a metric has one row per model)."""
    w = Window.partitionBy("metric").orderBy((F.col("point") * _better(F.col("metric"))).desc(), _order(models), "model")
    return agg.withColumn("rank", F.row_number().over(w))


def best_model_per_metric(agg: DataFrame, models: list[str]) -> DataFrame:
    """Best model per metric, the models whose interval overlaps its own, and the verdict."""
    best = rank_models(agg, models).filter("rank = 1").select(
        "metric", F.col("model").alias("best"), "point", F.col("lower").alias("b_lo"), F.col("upper").alias("b_hi"))
    other = agg.select("metric", "model", "lower", "upper").join(F.broadcast(best), "metric")  # four rows
    overlap = (F.col("model") != F.col("best")) & (F.col("b_lo") <= F.col("upper")) & (F.col("lower") <= F.col("b_hi"))
    return other.groupBy("metric", "best", "point").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(overlap, F.col("model")))), ",").alias("overlapping"),
        F.when(F.count_if(overlap) > 0, "not distinguishable").otherwise("distinct").alias("verdict"))


def all_intervals_overlap(agg: DataFrame) -> DataFrame:
    return agg.groupBy("metric").agg((F.max("lower") <= F.min("upper")).alias("all_overlap"))


def comparison_table(agg: DataFrame, models: list[str]) -> DataFrame:
    """metric x model: point, lower and upper of every model in the fixed order."""
    wide = agg.groupBy("metric").pivot("model", models).agg(
        F.first("point").alias("point"), F.first("lower").alias("lower"), F.first("upper").alias("upper"))
    return wide.orderBy(F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric")))


def per_event_table(per_event: DataFrame, models: list[str]) -> DataFrame:
    return per_event.orderBy("event_id", _order(models))


def case_direction(scored: DataFrame) -> DataFrame:
    """Final-day predicted and true cells per model and event, their ratio, and under/over prediction."""
    daily = scored.groupBy("model", "event_id", "day_idx").agg(
        F.count_if(F.col("p") >= 0.5).alias("pred_cells"), F.count_if(F.col("y") != 0).alias("true_cells"))
    final = daily.groupBy("model", "event_id").agg(F.max_by(F.struct("pred_cells", "true_cells"), "day_idx").alias("s")).select("model", "event_id", "s.*")
    ratio = F.when(F.col("true_cells") > 0, F.col("pred_cells") / F.col("true_cells"))
    return final.withColumn("ratio", ratio).withColumn(
        "direction", F.when(F.col("ratio") < 0.5, "under").when(F.col("ratio") > 2, "over"))


def case_listing(per_event: DataFrame, models: list[str], reference: str) -> DataFrame:
    """Held-out events, test before val, judged good or bad by the reference model (else the first in order)."""
    first = F.struct((F.col("model") != reference).cast("int").alias("o"), _order(models).alias("k"))
    held = per_event.filter(F.col("split").isin("test", "val"))
    return (held.groupBy("split", "event_id").agg(F.min_by(F.struct("model", "iou"), first).alias("a"))
            .select("split", "event_id", F.col("a.model").alias("judge"), F.col("a.iou").alias("iou"),
                    F.when(F.col("a.iou") >= FAIL_IOU, "good").otherwise("bad").alias("quality"))
            .orderBy((F.col("split") != "test").cast("int"), "event_id"))


def data_date_range(desc: DataFrame) -> DataFrame:
    """First and last day and number of events per split, and overall (split NULL)."""
    cols = [F.min("date_first").alias("date_first"), F.max("date_last").alias("date_last")]
    per = desc.groupBy("split").agg(*cols, F.count("*").alias("n_events"))
    total = per.agg(*cols, F.sum("n_events").alias("n_events")).withColumn("split", F.lit(None).cast("string"))
    return per.unionByName(total)
