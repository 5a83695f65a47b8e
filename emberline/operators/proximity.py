"""Which groups of items are near each other, without listing the pairs of items.

Items are boxes (a detection is a box of no extent). The caller puts items into groups whose
members are all mutually near, so a group of any size is one vertex. Whether two groups touch is
decided from the bounds of their members. Only pairs the bounds leave open are looked into: small
ones item by item, large ones by cutting the groups into finer parts and asking again.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from emberline.session import durable


def bounds_of(items: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Per key: lowest and highest value of every dimension and the number of items (combined map-side)."""
    return items.groupBy(*keys).agg(
        *[f(d).alias(f"{d}_{n}") for d in dims for f, n in ((F.min, "lo"), (F.max, "hi"))],
        F.count("*").alias("n"))


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select([F.col(c).alias(p + c) for c in df.columns])


def near_groups(
    items: DataFrame, candidates: Callable[[DataFrame], DataFrame], dims: list[str], surely: Column, never: Column, near: Column,
    part: Callable[[int], Column], budget: int = 4096, levels: int = 16,
) -> DataFrame:
    """Pairs (a, b) of groups with at least one near pair of items, each once.

    items    distinct items: group `g`, the columns of `dims`, and whatever `near` reads
    candidates   group bounds -> pairs (a, b) that may be near, each once, with both bounds as `a_...`, `b_...`
    surely   true when all items of two parts are near, from bounds `a_<dim>_lo`, `b_<dim>_hi`, ...
    never    true when no item of two parts can be near, from the same bounds
    near     the exact test of two items, columns prefixed `a_` and `b_`
    part     level -> key that cuts a group into parts, finer with the level
    """
    def meet(asked, a, b):
        on = lambda p: reduce(Column.__and__, [F.col(p) == F.col(f"{p}_g")] + [
            F.col(f"p{p}") == F.col(f"{p}_part") for _ in keys[1:]])
        return asked.join(a, on("a")).join(b, on("b"))

    keys = ["g"]  # whole groups first, then parts of groups
    ids = ["a", "b"]
    met = candidates(bounds_of(items, keys, dims))
    found: list[DataFrame] = []
    for level in range(1, levels + 1):
        judged = durable(
            met.filter(~never).select(*ids, surely.alias("sure"), (F.col("a_n") * F.col("b_n")).alias("work")))
        found.append(judged.filter("sure").select("a", "b"))
        undecided = judged.filter("not sure")
        if level > 1:  # a pair of parts is moot once other parts have linked their groups
            undecided = undecided.join(reduce(DataFrame.unionByName, found).distinct(), ["a", "b"], "left_anti")
        few = undecided.filter(F.col("work") <= budget)
        found.append(meet(few, prefixed(items, "a_"), prefixed(items, "b_")).filter(near).select("a", "b").distinct())
        if judged.filter(~F.col("sure") & (F.col("work") > budget)).isEmpty():
            break
        if level == levels:
            raise RuntimeError("items could not be separated; check the part function")
        many = durable(undecided.filter(F.col("work") > budget).select(*ids))
        involved = many.select(F.col("a").alias("g")).union(many.select(F.col("b").alias("g"))).distinct()
        children = durable(items.join(involved, "g", "left_semi").withColumn("cut", part(level)))
        kids = children.select(*keys, "cut").distinct()
        side = lambda p: kids.select(F.col("g").alias(p), *[F.col("part").alias(f"p{p}") for _ in keys[1:]],
                                     F.col("cut").alias(f"c{p}"))
        over = lambda p: [p] + [f"p{p}" for _ in keys[1:]]
        asked = (many.join(side("a"), over("a")).join(side("b"), over("b"))
                 .select("a", "b", F.col("ca").alias("pa"), F.col("cb").alias("pb")))
        items = children.drop("part").withColumnRenamed("cut", "part")
        keys, ids = ["g", "part"], asked.columns
        parts = bounds_of(items, keys, dims)
        met = meet(asked, prefixed(parts, "a_"), prefixed(parts, "b_"))
    # a pair of whole groups is judged once: by bounds, by items, or in parts. Only parts can say the same pair again.
    whole, parted = found[:2], found[2:]
    if parted:
        whole.append(reduce(DataFrame.unionByName, parted).distinct())
    return reduce(DataFrame.unionByName, whole)
