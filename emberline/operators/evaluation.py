"""Truth, scores, calibration bins and intervals of probability forecasts.

Truth of day d is cumulative: a cell counts as burned from its first burning day on. It is kept as
one row per cell (`burn_day`), so scoring needs one join on the cell and no window over days.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.functions.when import hash_int
from emberline.operators.ranking import hash_buckets, running_total
from emberline.operators.skew import join_counted
from emberline.session import DataError, durable, require_none

CELL = ["event_id", "row", "col"]
METRICS = ("iou", "dice", "brier", "ece")
THRESHOLD = 0.5
BINS = 10
HIGHER_IS_BETTER = {"iou": True, "dice": True, "brier": False, "ece": False}


def _upto(*keys: str, order: str = "day_idx"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def cumulative_burn(state: DataFrame) -> DataFrame:
    """Add `burned`: 1 from the first day the cell's fire mask reaches the threshold."""
    return state.withColumn("burned", F.max((F.col("fire_mask") >= THRESHOLD).cast("int")).over(_upto(*CELL)))


def monotone_probability(pred: DataFrame) -> DataFrame:
    """Add `p_mono`, the running maximum of p: a cumulative probability never falls."""
    p = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    return pred.withColumn("p_mono", F.max(p).over(_upto("model", *CELL)))


def first_fire_days(state: DataFrame) -> DataFrame:
    """(event_id, first_idx, last_idx, n): first day with a burning cell, NULL without any; last day; number of rows."""
    return state.groupBy("event_id").agg(
        F.min(F.when(F.col("fire_mask") >= THRESHOLD, F.col("day_idx"))).alias("first_idx"),
        F.max("day_idx").alias("last_idx"), F.count("*").alias("n"))


def trim_to_first_fire_day(state: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Drop leading days without fire; an event that never burns is returned unchanged.

    With `only` (event_id) just those events. Rows of a large event stay where they are, only its first day travels.
    """
    days = first_fire_days(state).select("event_id", "first_idx", "n")
    if only is not None:
        days = days.join(only.select("event_id"), "event_id", "left_semi")
    return (join_counted(state, durable(days), "event_id")
            .filter(F.col("first_idx").isNull() | (F.col("day_idx") >= F.col("first_idx"))).drop("first_idx", "n"))


def exclude_anchor_day(state: DataFrame) -> DataFrame:
    """Drop the first day of every event; an event with fewer than two days fails the job."""
    span = durable(state.groupBy("event_id").agg(F.min("day_idx").alias("anchor"), F.max("day_idx").alias("last"), F.count("*").alias("n")))
    require_none(span.filter(F.col("last") <= F.col("anchor")).select("event_id"), "event with fewer than two days")
    return join_counted(state, span.drop("last"), "event_id").filter(F.col("day_idx") > F.col("anchor")).drop("anchor", "n")


def truth_cells(state: DataFrame) -> DataFrame:
    """(event_id, row, col, burn_day, anchor, last_idx): when a cell first burned, and the event's scored days.

    The anchor is the first fire day (day 0 of the trimmed event), or the first day if nothing burns.
    """
    burn = durable(state.groupBy(*CELL).agg(
        F.min(F.when(F.col("fire_mask") >= THRESHOLD, F.col("day_idx"))).alias("burn_day"),
        F.min("day_idx").alias("from_idx"), F.max("day_idx").alias("to_idx")))
    days = burn.groupBy("event_id").agg(F.coalesce(F.min("burn_day"), F.min("from_idx")).alias("anchor"),
                                        F.max("to_idx").alias("last_idx"), F.count("*").alias("n"))
    return join_counted(burn.select(*CELL, "burn_day"), durable(days), "event_id").drop("n")


def score_join(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """PREDICTION rows of the scored days (after the anchor) with the 0/1 cumulative truth `y`."""
    y = F.coalesce((F.col("day_idx") >= F.col("burn_day")).cast("int"), F.lit(0)).cast("double")
    return (pred.join(truth, CELL).filter((F.col("day_idx") > F.col("anchor")) & (F.col("day_idx") <= F.col("last_idx")))
            .withColumn("y", y).select("model", "event_id", "day_idx", "row", "col", "p", "y"))


def prediction_faults(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(model, event_id, fault) of every prediction set that is not one p in [0, 1] per scored cell and day.

    Presence is checked from counts: a set is complete when it has no repeated key, no stranger and
    as many rows as the event has scored cells times days. Rows of other days count for nothing, so a
    set of nothing else has missing cells.
    """
    size = truth.groupBy("event_id").agg(
        (F.count("*") * (F.first("last_idx") - F.first("anchor"))).alias("expected"))
    keyed = pred.groupBy("model", *CELL, "day_idx").agg(
        F.count("*").alias("copies"), F.min("p").alias("lo"), F.max("p").alias("hi"),
        F.max((F.col("p").isNull() | F.isnan("p")).cast("int")).alias("missing"))
    joined = keyed.join(truth.withColumn("known", F.lit(1)), CELL, "left")
    scored = F.col("known").isNull() | ((F.col("day_idx") > F.col("anchor")) & (F.col("day_idx") <= F.col("last_idx")))
    of = lambda c: F.when(scored, F.col(c))
    sets = joined.groupBy("model", "event_id").agg(
        F.max(of("copies")).alias("copies"), F.min(of("lo")).alias("lo"), F.max(of("hi")).alias("hi"),
        F.max(of("missing")).alias("missing"), F.count_if(F.col("known").isNull()).alias("strangers"),
        F.count(of("known")).alias("present"))
    fault = (F.when(F.col("copies") > 1, "repeated cell").when(F.col("strangers") > 0, "cell outside the event")
             .when((F.col("missing") > 0) | (F.col("lo") < 0) | (F.col("hi") > 1), "probability outside [0, 1]")
             .when(F.col("present") < F.col("expected"), "missing cells"))
    return (sets.join(size, "event_id", "left").withColumn("fault", fault)
            .filter(F.col("fault").isNotNull()).select("model", "event_id", "fault"))


def validate_prediction(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """`pred` unchanged, after every set has passed; otherwise an error that names the event."""
    require_none(prediction_faults(pred, truth), "invalid prediction")
    n_events = truth.select("event_id").distinct().count()
    per_model = pred.select("model", "event_id").distinct().groupBy("model").agg(F.count("*").alias("events"))
    require_none(per_model.filter(F.col("events") != n_events), f"model without a prediction for each of {n_events} events")
    if n_events and per_model.isEmpty():
        raise DataError(f"no prediction for any of {n_events} events")
    return pred


def ratio_or_one(num: Column, den: Column) -> Column:
    """num/den, and 1 when both masks are empty."""
    return F.when(den == 0, F.lit(1.0)).otherwise(num / den)


def bin_of(p, bins: int = BINS) -> Column:
    """0-based equal-width bin, closed on the right; edges are i*(1/bins) as floating point gives them."""
    c = F.col(p) if isinstance(p, str) else p
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e < c))


def binned(scored: DataFrame, keys: list[str], p: str = "p", bins: int = BINS) -> DataFrame:
    """Sums per calibration bin from which every metric follows; one partial aggregation over the cells."""
    hit, true = F.col(p) >= THRESHOLD, F.col("y") != 0
    return scored.groupBy(*keys, bin_of(p, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(p).alias("sum_p"), F.sum("y").alias("sum_y"),
        F.sum(F.pow(F.col(p) - F.col("y"), 2)).alias("sq"), F.count_if(hit & true).alias("both"),
        F.count_if(hit).alias("hits"), F.count_if(true).alias("trues"))


def metrics_of(bins: DataFrame, keys: list[str]) -> DataFrame:
    """IoU, Dice, Brier and ECE per key from `binned` rows."""
    t = lambda c: F.sum(c)
    return bins.groupBy(*keys).agg(
        t("n").alias("n"),
        ratio_or_one(t("both"), t("hits") + t("trues") - t("both")).alias("iou"),
        ratio_or_one(2 * t("both"), t("hits") + t("trues")).alias("dice"),
        (t("sq") / t("n")).alias("brier"),
        (F.sum(F.abs(F.col("sum_p") - F.col("sum_y"))) / t("n")).alias("ece"))


def event_metrics(scored: DataFrame, p: str = "p") -> DataFrame:
    """EVENT_METRIC: the four metrics per model and event."""
    keys = ["model", "event_id"]
    return metrics_of(binned(scored, keys, p), keys)


def aggregate_metrics(per_event: DataFrame) -> DataFrame:
    """(model, metric, point): mean over events, never over cells."""
    return long_metrics(per_event).groupBy("model", "metric").agg(F.avg("value").alias("point"))


def long_metrics(per_event: DataFrame) -> DataFrame:
    keys = [c for c in ("model", "split", "event_id") if c in per_event.columns]
    return per_event.unpivot(keys, list(METRICS), "metric", "value")


def reliability_bins(scored: DataFrame, keys: list[str], p: str = "p", bins: int = BINS) -> DataFrame:
    """Every bin with lo, hi, count, mean_pred, mean_true; an empty bin is listed with NULL means."""
    agg = binned(scored, keys, p, bins).select(*keys, "bin", "n", "sum_p", "sum_y")
    width = 1.0 / bins
    frame = agg.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(agg, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("bin") * width).alias("lo"), ((F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("count"), (F.col("sum_p") / F.col("n")).alias("mean_pred"),
        (F.col("sum_y") / F.col("n")).alias("mean_true"))


def bootstrap_ci(per_event: DataFrame, draws: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """AGG_METRIC: point, lower, upper per model and metric from resampled event values.

    Draw k of replicate r takes the event at position hash(seed, r, k) mod n, the same for every
    metric of a model. Positions come from a two-level numbering by event hash, the draws from a
    hash, so a lost task repeats exactly. One event gives the point itself.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("event_id").cast("string")), 256)
    ranked = running_total(hash_buckets(per_event.withColumn("digest", digest), "digest"),
                           ["model"], ["digest"], F.lit(1), "pos").select(
        "model", "pos", F.col("total").alias("n"), *METRICS)
    draw = (ranked.select("model", F.col("pos").alias("k"), "n")
            .withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(draws))))
            .withColumn("pos", F.pmod(hash_int(F.lit(str(seed)), F.col("r").cast("string"), F.col("k").cast("string")),
                                      F.col("n"))))
    means = draw.select("model", "r", "pos").join(ranked, ["model", "pos"]).groupBy("model", "r").agg(
        *[F.avg(m).alias(m) for m in METRICS])
    tail = (1 - level) / 2
    ends = means.unpivot(["model", "r"], list(METRICS), "metric", "value").groupBy("model", "metric").agg(
        F.percentile("value", tail).alias("lower"), F.percentile("value", 1 - tail).alias("upper"))
    return aggregate_metrics(per_event).join(ends, ["model", "metric"])


def backtest(pred: DataFrame, state: DataFrame, draws: int = 1000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(EVENT_METRIC, AGG_METRIC) of validated predictions against the events' cumulative truth."""
    truth = truth_cells(state)
    require_none(truth.filter(F.col("last_idx") <= F.col("anchor")).select("event_id"), "event with fewer than two days")
    per_event = event_metrics(score_join(validate_prediction(pred, truth), truth))
    return per_event, bootstrap_ci(per_event, draws, seed=seed)


def burned_cells_by_day(pred: DataFrame) -> DataFrame:
    return pred.groupBy("model", "event_id", "day_idx").agg(F.count_if(F.col("p") >= THRESHOLD).alias("cells"))


def register_model(registry: dict, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Add a spread model: `fn` maps event cells to (event_id, day_idx, row, col, p)."""
    if name in registry:
        raise ValueError(f"model {name!r} is already registered")
    registry[name] = fn


def predict_all(registry: dict, state: DataFrame) -> DataFrame:
    """PREDICTION rows of every registered model."""
    if not registry:
        raise DataError("no model registered")
    out = None
    for name, fn in sorted(registry.items()):
        one = fn(state).select(F.lit(name).alias("model"), "event_id", "day_idx", "row", "col", "p")
        out = one if out is None else out.unionByName(one)
    return out


def resolve_event_pk(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Add `event_pk` from the event table (firms_event_id, id); an unknown event is an error, before any write."""
    known = events.select(F.col("firms_event_id").alias("event_id"), F.col("id").alias("event_pk"))
    require_none(rows.select("event_id").distinct().join(known, "event_id", "left_anti"), "unknown event")
    return rows.join(known, "event_id")
