"""One-step spread risk on event cells and its parameter search."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.surface import flammability
from emberline.operators.grids import moore_neighbors

# Default parameters of the spread rule.
DEFAULTS = {"base_spread_prob": 0.3, "slope_coefficient": 4.0, "wind_coefficient": 0.2}


def _one_way(n: Column, res: float, par) -> Column:
    """Probability that burning neighbour `n` (d_row, d_col, elevation) ignites the cell of the row."""
    norm = F.sqrt((n["d_row"] * n["d_row"] + n["d_col"] * n["d_col"]).cast("double"))
    slope = (F.col("elevation") - n["elevation"]) / (norm * res)
    along = (F.col("wind_u") * -n["d_col"] + F.col("wind_v") * n["d_row"]) / norm
    p = (par("base_spread_prob") * F.exp(par("slope_coefficient") * slope)
         * F.exp(par("wind_coefficient") * along) * F.col("flam"))
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def _with_burning_neighbors(cells: DataFrame, keys: list[str], burning: Column) -> DataFrame:
    """Add `near`, the burning Moore neighbours of each cell (at most 8), and `flam`.

    Only burning cells send rows, eight each; nothing wraps at the grid's edge because a cell
    outside the grid has no row to meet.
    """
    sent = moore_neighbors(cells.filter(burning), keys, ["elevation"])
    near = sent.groupBy(*keys, "row", "col").agg(F.collect_list(F.struct("d_row", "d_col", "elevation")).alias("near"))
    return cells.join(near, [*keys, "row", "col"], "left").withColumn("flam", flammability("fuel_type"))


def _ignition(res: float, par, burning: Column) -> Column:
    spared = F.aggregate("near", F.lit(1.0), lambda acc, n: acc * (1 - _one_way(n, res, par)))
    return F.when(burning, F.lit(1.0)).otherwise(1 - F.coalesce(spared, F.lit(1.0)))


def ignition_probability(cells: DataFrame, res: float = 250.0, params: dict | None = None,
                         keys=("event_id", "day_idx"), burning: Column | None = None) -> DataFrame:
    """Add `p`, the chance that a cell burns one step later; a burning cell has 1.

    `cells` has keys, row, col, elevation, wind_u, wind_v, fuel_type and, by default, fire_mask.
    """
    p = {**DEFAULTS, **(params or {})}
    burning = F.col("fire_mask") >= 0.5 if burning is None else burning
    return (_with_burning_neighbors(cells, list(keys), burning)
            .withColumn("p", _ignition(res, lambda k: F.lit(float(p[k])), burning)).drop("near", "flam"))


def parameter_grid(grid: dict[str, list[float]]) -> list[dict]:
    unknown = sorted(set(grid) - set(DEFAULTS))
    if unknown:
        raise ValueError(f"unknown parameter(s): {', '.join(unknown)}")
    combos = [{**DEFAULTS, **dict(zip(grid, c))} for c in itertools.product(*grid.values())]
    if not combos:
        raise ValueError("the grid has no combination")
    return combos


def spread_scores(samples: DataFrame, grid: dict[str, list[float]], metric: str = "iou", res: float = 250.0) -> DataFrame:
    """(combo, parameters, score): mean one-step score over samples of every parameter combination.

    `samples` has sample_id, row, col, burning, elevation, wind_u, wind_v, fuel_type, observed (0/1).
    Neighbours are gathered once; the combinations are an array literal on the gathered row.
    """
    if metric not in ("iou", "brier"):
        raise ValueError(f"metric must be 'iou' or 'brier', not {metric!r}")
    combos = parameter_grid(grid)
    burning = F.col("burning") == 1
    rows = _with_burning_neighbors(samples, ["sample_id"], burning)
    combo = F.explode(F.array(*[F.struct(F.lit(i).alias("combo"), *[F.lit(float(v)).alias(k) for k, v in c.items()])
                                for i, c in enumerate(combos)]))
    rows = rows.withColumn("c", combo).withColumn("p", _ignition(res, lambda k: F.col("c")[k], burning))
    hit, seen = F.col("p") >= 0.5, F.col("observed") == 1
    union = F.count_if(hit | seen)
    one = (F.when(union == 0, F.lit(1.0)).otherwise(F.count_if(hit & seen) / union) if metric == "iou"
           else -F.avg(F.pow(F.col("p") - F.col("observed"), 2)))
    per_sample = rows.groupBy("c", "sample_id").agg(one.alias("score"))
    return per_sample.groupBy("c").agg(F.avg("score").alias("score")).select("c.*", "score")


def grid_search_spread(samples: DataFrame, grid: dict[str, list[float]], metric: str = "iou", res: float = 250.0) -> DataFrame:
    """The best combination; equal scores (to 12 decimals) go to the one listed first."""
    scores = spread_scores(samples, grid, metric, res)
    return scores.orderBy(F.round("score", 12).desc(), "combo").limit(1)
