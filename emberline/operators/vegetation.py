"""Scenes -> monthly composites, nearest-month joins, composite matching and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.functions.surface import CLOUD_CLASSES
from emberline.functions.when import month_distance
from emberline.operators.ranking import exact_median
from emberline.session import DataError, require_none


def cloud_mask(obs: DataFrame) -> DataFrame:
    """Clear observations: scene class neither cloud nor shadow."""
    return obs.filter(~F.col("scl").isin(*CLOUD_CLASSES))


def scene_filter(obs: DataFrame, year: int, month: int, max_cloud: int = 85) -> DataFrame:
    """Scenes of [1st of the month, 1st of the next) with at most `max_cloud` per cent cloud."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return obs.filter((F.col("scene_day") >= first) & (F.col("scene_day") < F.add_months(first, 1))
                      & (F.col("cloud_cover") <= max_cloud))


def monthly_composite(obs: DataFrame, year: int, month: int, bands=("red", "nir")) -> DataFrame:
    """Per-cell median of the clear observations of a month (a cell has a few dozen scenes at most)."""
    clear = cloud_mask(scene_filter(obs, year, month))
    return clear.groupBy("cell_id").agg(*[F.median(b).alias(b) for b in bands])


def monthly_composites(obs: DataFrame, bands=("red", "nir"), max_cloud: int = 85) -> DataFrame:
    """(year, month, cell_id, bands): the composites of all months that `obs` holds, in one job.

    A scene belongs to the month of its day. One aggregate by month and cell: a month of most scenes is spread over its cells.
    """
    clear = cloud_mask(obs.filter(F.col("cloud_cover") <= max_cloud))
    return clear.groupBy(F.year("scene_day").alias("year"), F.month("scene_day").alias("month"), "cell_id").agg(
        *[F.median(b).alias(b) for b in bands])


def ndvi_range_guard(cells: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """`cells` unchanged; a value of `ndvi` outside [-1, 1] fails the write before anything is published."""
    ok = F.col("ndvi").isNull() | F.col("ndvi").between(-1 - tolerance, 1 + tolerance)
    return cells.withColumn("ndvi", F.when(ok, F.col("ndvi")).otherwise(F.raise_error(F.concat(
        F.lit("NDVI out of range: "), F.col("ndvi").cast("string")))))


def nearest_month_layer(targets: DataFrame, layers: DataFrame, max_distance: int = 3,
                        direction: str = "nearest") -> DataFrame:
    """Targets (year, month, ...) with the nearest available month (layer_year, layer_month); NULL beyond the limit.

    A tie goes to the older month. `direction="backward"` never looks past the target month.
    Targets visit the few months in reach and meet the layers by equality.
    """
    if direction not in ("nearest", "backward"):
        raise ValueError("direction must be 'nearest' or 'backward'")
    index = lambda y, m: F.col(y) * 12 + F.col(m) - 1
    top = max_distance if direction == "nearest" else 0
    months = targets.select("year", "month").distinct().withColumn("at", F.explode(F.sequence(
        index("year", "month") - max_distance, index("year", "month") + top)))
    have = layers.select(F.col("year").alias("layer_year"), F.col("month").alias("layer_month")).distinct()
    have = have.withColumn("at", index("layer_year", "layer_month"))
    distance = month_distance("layer_year", "layer_month", "year", "month")
    best = months.join(have, "at").groupBy("year", "month").agg(
        F.min_by(F.struct("layer_year", "layer_month", distance.alias("distance")), F.struct(distance, "at")).alias("b"))
    return targets.join(best, ["year", "month"], "left").select(*targets.columns, "b.layer_year", "b.layer_month", "b.distance")


def composite_differences(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate, max_diff, n): greatest absolute difference over cells valid on both sides."""
    return (candidates.join(stored.withColumnRenamed("value", "stored"), "cell_id")
            .filter(F.col("value").isNotNull() & F.col("stored").isNotNull()).groupBy("candidate")
            .agg(F.max(F.abs(F.col("value") - F.col("stored"))).alias("max_diff"), F.count("*").alias("n")))


def match_composite(stored: DataFrame, candidates: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """The candidate that reproduces the stored layer best; none within tolerance is an error."""
    best = composite_differences(stored, candidates).agg(
        F.min_by("candidate", F.struct("max_diff", "candidate")).alias("candidate"), F.min("max_diff").alias("max_diff"))
    require_none(best.filter(F.col("max_diff").isNull() | (F.col("max_diff") > tolerance)),
                 "no composite reproduces the stored layer")
    return best


def ndvi_audit(cells: DataFrame, keys=("event_id",)) -> DataFrame:
    """Per key: median and range of the old and new NDVI, mean new NDVI of burned and unburned cells.

    `cells` has keys, old_ndvi, new_ndvi and burned (0/1). Medians are exact and never gather a key.
    """
    keys = list(keys)
    if "burned" not in cells.columns:
        raise DataError("burned column required")
    hot = F.col("burned") == 1
    stats = cells.groupBy(*keys).agg(
        F.max("old_ndvi").alias("old_max"), F.min("new_ndvi").alias("new_min"), F.max("new_ndvi").alias("new_max"),
        F.avg(F.when(hot, F.col("new_ndvi"))).alias("new_mean_burned"),
        F.avg(F.when(~hot, F.col("new_ndvi"))).alias("new_mean_unburned"))
    for side in ("old", "new"):
        m = exact_median(cells, keys, f"{side}_ndvi").withColumnRenamed("median", f"{side}_median")
        stats = stats.join(m, keys, "left")
    return stats
