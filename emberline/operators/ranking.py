"""Running totals, ranks and quantiles over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_buckets(df: DataFrame, keys: list[str], value: str, buckets: int = 256) -> DataFrame:
    """Add `bucket`, monotone in `value` within `keys`, from approximate quantiles of the group.

    Only the balance of the buckets depends on the approximation. The edges are one short array
    per group, so the join carries no large side.
    """
    qs = [i / buckets for i in range(1, buckets)]
    edges = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, qs, 10_000)).alias("edges"))
    return (df.join(edges, keys).withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col(value))))
            .drop("edges"))


def hash_buckets(df: DataFrame, digest: str) -> DataFrame:
    """Add `bucket`, monotone in a hex digest and evenly filled."""
    return df.withColumn("bucket", F.substring(digest, 1, 3))


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: Column, out: str = "before") -> DataFrame:
    """Add the exact total of `weight` over all rows ahead of a row in (`bucket`, `order`), and the group's `total`.

    Two levels: a window inside each bucket and a window over the bucket totals, of which a group
    has at most a few thousand. No task sees a whole group.
    """
    df = df.withColumn("_w", weight)
    per = df.groupBy(*keys, "bucket").agg(F.sum("_w").alias("_b"))
    over = Window.partitionBy(*keys).orderBy("bucket")
    per = per.select(*keys, "bucket", (F.sum("_b").over(over) - F.col("_b")).alias("_ahead"),
                     F.sum("_b").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("_in", F.sum("_w").over(inside) - F.col("_w")).join(per, [*keys, "bucket"])
            .withColumn(out, F.col("_ahead") + F.col("_in")).drop("_w", "_in", "_ahead", "bucket"))


def value_ranks(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys, value, ties, below, total) per distinct value: rows equal to it, below it, in the group."""
    counted = (df.filter(F.col(value).isNotNull())
               .groupBy(*keys, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("ties")))
    return running_total(value_buckets(counted, keys, value), keys, [value], F.col("ties"), "below")


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median) by linear interpolation, without gathering a group."""
    r = value_ranks(df, keys, value)
    lo, hi = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("ties"))
    return r.filter(holds(lo) | holds(hi)).groupBy(*keys).agg(
        ((F.max(F.when(holds(lo), F.col(value))) + F.max(F.when(holds(hi), F.col(value)))) / 2).alias("median"))
