"""Connected components by repeated contraction of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberline.session import durable


def _chosen(edges: DataFrame) -> DataFrame:
    """Per vertex with an edge: the lowest-ranked of itself and its neighbours (rank = hash, then id)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    return (both.groupBy("a").agg(F.min(rank("b")).alias("m"))
            .select(F.col("a").alias("v"), F.least(rank("a"), F.col("m"))["v"].alias("r")))


def _moves(edges: DataFrame) -> DataFrame:
    """(v, r): where a vertex goes in one round, the choice of its choice."""
    m = _chosen(edges)
    onward = m.select(F.col("v").alias("r"), F.col("r").alias("rr"))
    return m.join(onward, "r").select("v", F.col("rr").alias("r"))


def connected_components(vertices: DataFrame, edges: DataFrame, unique: bool = False) -> DataFrame:
    """(v, root) for every vertex of `vertices` (column v); edges (a, b) are undirected. `unique` says that none is given twice, in either direction.

    Each round every vertex moves two steps towards lower-ranked neighbours and the edge table is
    rewritten onto the survivors, without loops and copies; the rank is a hash, so a chain of any
    length shrinks by a constant factor a round. The rounds run to a fixed point. Labels are then
    handed back from the last round to the first: each hand-back joins on a survivor, which stands
    for no more vertices than lay two steps around it in that round, so the label of a component
    that holds a third of all vertices is never a join key of a third of all rows.
    """
    rounds = []
    live = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = durable(live if unique else live.distinct())
    while not live.isEmpty():
        m = durable(_moves(live))
        rounds.append(m)
        moved = (live.join(m.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a")
                 .join(m.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
                 .filter(F.col("ra") != F.col("rb")))
        live = durable(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    labels = None
    for m in reversed(rounds):
        if labels is None:
            labels = m.select("v", F.col("r").alias("root"))
        else:
            up = labels.select(F.col("v").alias("r"), F.col("root").alias("top"))
            labels = m.join(up, "r", "left").select("v", F.coalesce("top", "r").alias("root"))
    if labels is None:
        return vertices.select("v", F.col("v").alias("root"))
    return vertices.select("v").join(labels, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
