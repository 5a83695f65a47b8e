"""Blending, stacking and calibration of probability forecasts."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.functions.surface import logit
from emberline.operators.evaluation import binned, metrics_of, reliability_bins
from emberline.operators.ranking import running_total, value_buckets
from emberline.operators.skew import join_counted
from emberline.session import DataError, durable, require_none

KEY = ["event_id", "day_idx", "row", "col"]
WEIGHTS = tuple(i / 10 for i in range(11))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of two forecasts side by side: KEY, pa, pb and the columns only `a` has (such as y)."""
    extra = [c for c in a.columns if c not in (*KEY, "p", "model")]
    return a.select(*KEY, F.col("p").alias("pa"), *extra).join(b.select(*KEY, F.col("p").alias("pb")), KEY)


def blended(weight: float):
    """Column (1-w)*pa + w*pb, clipped to [0, 1]."""
    if not 0 <= weight <= 1:
        raise ValueError(f"blend weight {weight} outside [0, 1]")
    return F.least(F.greatest((1 - weight) * F.col("pa") + weight * F.col("pb"), F.lit(0.0)), F.lit(1.0))


def blend(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    return paired(a, b).withColumn("p", blended(weight)).drop("pa", "pb").withColumn("model", F.lit("blend"))


def blend_scores(pairs: DataFrame) -> DataFrame:
    """(weight, brier): mean over events of the event's mean squared error, for all weights in one pass."""
    w = [F.avg(F.pow(blended(x) - F.col("y"), 2)).alias(f"w{i}") for i, x in enumerate(WEIGHTS)]
    per_event = pairs.groupBy("event_id").agg(*w)
    means = per_event.agg(*[F.avg(f"w{i}").alias(f"w{i}") for i in range(len(WEIGHTS))])
    return means.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("weight"), F.col(f"w{i}").alias("brier")) for i, x in enumerate(WEIGHTS)])).alias("s")
    ).select("s.*").filter(F.col("brier").isNotNull())


def select_blend_weight(pairs: DataFrame) -> float:
    """Weight of the second forecast with the least Brier on validation cells (KEY, pa, pb, y).

    Scores equal to twelve decimals are a tie, which the smallest weight wins.
    """
    chosen = F.min_by("weight", F.struct(F.round("brier", 12), F.col("weight")))
    weight = blend_scores(pairs).agg(chosen.alias("weight")).first().weight
    if weight is None:
        raise DataError("no validation cells to choose a blend weight from")
    return weight


def _features(pairs: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["la", "lb"], outputCol="features").transform(
        pairs.withColumns({"la": logit("pa"), "lb": logit("pb")}))


def fit_stacking(pairs: DataFrame):
    """Unpenalised logistic regression of y on both logits; a single class is an error."""
    if pairs.select("y").distinct().limit(3).count() < 2:
        raise DataError("stacking needs burned and unburned validation cells")
    return LogisticRegression(labelCol="y", regParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(
        _features(pairs))


def stack(model, pairs: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """Forecast of a fitted stacking model; cells of `anchor` (KEY, y) keep their known state."""
    out = model.transform(_features(pairs)).withColumn("p", vector_to_array("probability")[1])
    out = out.select(*KEY, *[c for c in ("y",) if c in pairs.columns], "p").withColumn("model", F.lit("stacking"))
    if anchor is not None:
        known = anchor.select(*KEY, F.col("y").alias("known"))
        out = out.join(known, KEY, "left").withColumn("p", F.coalesce("known", "p")).drop("known")
    return out


class Calibrator(NamedTuple):
    """A fitted calibration of one model version: blocks (lo, hi, mean, w) of p that share one value, in rising order."""
    lineage: str
    blocks: DataFrame


def _numbered(df: DataFrame, value: str, order: list[str], weight: Column) -> DataFrame:
    """Add `before`, the total of `weight` over all rows ahead in `order`, of which `value` comes first; no task sees all rows."""
    one = value_buckets(df.withColumn("_one", F.lit(1)), ["_one"], value)
    return running_total(one, ["_one"], order, weight).drop("_one", "total")


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one range with neighbours pooled until their means rise."""
    rows = rows.sort_values("lo")
    done: list[list[float]] = []
    for lo, hi, total, w in zip(rows["lo"], rows["hi"], rows["s"], rows["w"]):
        block = [lo, hi, total, w]
        while done and done[-1][2] * block[3] >= block[2] * done[-1][3]:
            left = done.pop()
            block = [left[0], block[1], left[2] + block[2], left[3] + block[3]]
        done.append(block)
    out = pd.DataFrame(done, columns=["lo", "hi", "s", "w"])
    return out.assign(range=rows["range"].iat[0])


def _swallowed(r: pd.DataFrame) -> list[tuple[int, int]]:
    """(range, pool) of ranges that a violated edge pools as a whole, from the first and last block and the totals of every range.

    Seen from the edge, a range is pooled whole if its farthest block still is when all nearer ones are: nearer ones violate more.
    """
    pool: dict[int, int] = {}
    first, last, total = (list(zip(r[f"{x}_s"], r[f"{x}_w"])) for x in ("first", "last", "total"))
    for i in range(len(r) - 1):
        if last[i][0] * first[i + 1][1] <= first[i + 1][0] * last[i][1]:
            continue
        for at, step, held, far, sign in ((i, -1, first[i + 1], first, 1), (i + 1, 1, last[i], last, -1)):
            s, w = held
            while 0 <= at < len(r) and at not in pool:
                (fs, fw), (ts, tw) = far[at], total[at]
                if sign * (fs * (w + tw - fw) - (s + ts - fs) * fw) < 0:
                    break
                pool[at] = 2 * i + (step > 0)
                s, w, at = s + ts, w + tw, at + step
    return [(int(r["range"].iat[k]), p) for k, p in pool.items()]


def fit_isotonic(scored: DataFrame, lineage: str, span: int = 65_536) -> Calibrator:
    """Isotonic fit of y on p by pooling adjacent violators in ranges of at most `span` blocks.

    Cells are first added up by distinct p, map-side. Each round pools every range on its own. Where the end of one range then lies
    above the start of the next, ranges that this edge pools as a whole are added up at once, however many, and the blocks are cut anew half a
    range further on, so that the edge falls inside a range. Pooling in any order gives the same fit, and each round leaves
    fewer blocks, so the rounds end with the exact one. The driver sees one row of sums a range, a `span`-th of the blocks at most.
    """
    require_none(scored.filter(F.col("p").isNull() | F.isnan("p")).select("p"), "non-finite probability")
    spark = scored.sparkSession
    blocks = durable(scored.groupBy(F.col("p").alias("lo")).agg(F.sum("y").cast("double").alias("s"), F.count("*").cast("double").alias("w"))
                     .withColumn("hi", F.col("lo")))
    shift = 0
    while True:
        place = _numbered(blocks, "lo", ["lo"], F.lit(1)).withColumn("range", F.floor((F.col("before") + shift) / span)).drop("before")
        pooled = durable(place.groupBy("range").applyInPandas(_pool, "range long, lo double, hi double, s double, w double"))
        end = F.struct("lo", "s", "w")
        edges = (pooled.groupBy("range").agg(F.min(end).alias("f"), F.max(end).alias("l"), F.sum("s").alias("total_s"), F.sum("w").alias("total_w"))
                 .select("range", *[F.col(f"{x[0]}.{c}").alias(f"{x}_{c}") for x in ("first", "last") for c in "sw"], "total_s", "total_w")
                 .toPandas().sort_values("range").reset_index(drop=True))
        left = edges["last_s"].to_numpy()[:-1] * edges["first_w"].to_numpy()[1:]
        if not (left > edges["first_s"].to_numpy()[1:] * edges["last_w"].to_numpy()[:-1]).any():
            return Calibrator(lineage, pooled.select("lo", "hi", (F.col("s") / F.col("w")).alias("mean"), "w"))
        whole = _swallowed(edges)
        if whole:
            known = F.broadcast(spark.createDataFrame(whole, "range long, pool long"))  # a row per range at most
            joined = pooled.join(known, "range", "left")
            sums = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("w").alias("w")]
            pooled = (joined.filter("pool is null").select("lo", "hi", "s", "w")
                      .unionByName(joined.filter("pool is not null").groupBy("pool").agg(*sums).drop("pool")))
        blocks, shift = pooled.select("lo", "hi", "s", "w"), span // 2 - shift


def save_calibrator(calibrator: Calibrator, path: str) -> None:
    """Write the blocks with the model version they belong to; an existing calibrator is not overwritten."""
    calibrator.blocks.withColumn("lineage", F.lit(calibrator.lineage)).write.parquet(path)


def load_calibrator(spark: SparkSession, path: str, lineage: str) -> Calibrator:
    """A stored calibrator of this model version; that of another is refused."""
    stored = spark.read.parquet(path)
    found = sorted(r.lineage for r in stored.select("lineage").distinct().limit(2).collect())
    if found != [lineage]:
        raise DataError(f"calibrator of model version {', '.join(found)} does not belong to {lineage}")
    return Calibrator(lineage, stored.drop("lineage"))


def calibrate(scored: DataFrame, calibrator: Calibrator, lineage: str) -> DataFrame:
    """Add `q`, the calibrated p: a block's value inside it, on the line between two blocks in the gap, the outermost value beyond.

    A calibrator of another model version is refused. Each distinct p is looked up once, by its place among the blocks; a p of a
    third of all rows and a block of a third of all p are joined like any other.
    """
    if calibrator.lineage != lineage:
        raise DataError(f"calibrator of model version {calibrator.lineage} does not belong to {lineage}")
    require_none(scored.filter(F.col("p").isNull() | F.isnan("p")).select("p"), "non-finite probability")
    levels = scored.groupBy("p").agg(F.count("*").alias("n"))
    marks = (levels.withColumns({"kind": F.lit(1), "hi": F.lit(None).cast("double"), "mean": F.lit(None).cast("double")})
             .unionByName(calibrator.blocks.select(F.col("lo").alias("p"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("kind"), "hi", "mean")))
    placed = durable(_numbered(marks, "p", ["p", "kind"], 1 - F.col("kind")))
    blocks = placed.filter("kind = 0").select((F.col("before") + 1).alias("i"), "hi", "mean", F.col("p").alias("lo"))
    asked = placed.filter("kind = 1").select("p", F.col("n").alias("rows"), F.greatest("before", F.lit(1)).alias("i"))
    after = blocks.select((F.col("i") - 1).alias("i"), F.col("lo").alias("next"), F.col("mean").alias("next_mean"))
    known = durable(blocks.join(after, "i", "left").join(asked.groupBy("i").agg(F.count("*").alias("n")), "i"))
    share = (F.col("p") - F.col("hi")) / (F.col("next") - F.col("hi"))
    q = F.when((F.col("p") <= F.col("hi")) | F.col("next").isNull(), F.col("mean")).otherwise(F.col("mean") + share * (F.col("next_mean") - F.col("mean")))
    table = join_counted(asked, known, "i").select("p", F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)).alias("q"), F.col("rows").alias("n"))
    return join_counted(scored, durable(table), "p").drop("n")


def calibration_report(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per key (such as split): n, raw and calibrated Brier and ECE of rows with p, q, y."""
    raw = metrics_of(binned(scored, keys, "p"), keys).select(
        *keys, "n", F.col("brier").alias("brier_raw"), F.col("ece").alias("ece_raw"))
    cal = metrics_of(binned(scored, keys, "q"), keys).select(
        *keys, F.col("brier").alias("brier_cal"), F.col("ece").alias("ece_cal"))
    return raw.join(cal, keys)


def calibration_bins(scored: DataFrame, keys: list[str]) -> DataFrame:
    raw = reliability_bins(scored, keys, "p").withColumn("kind", F.lit("raw"))
    return raw.unionByName(reliability_bins(scored, keys, "q").withColumn("kind", F.lit("calibrated")))
