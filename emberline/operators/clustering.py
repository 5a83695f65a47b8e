"""Detections -> fire events: bricks, links between bricks, components, stable ids, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.functions.geo import EARTH_RADIUS_M, chord_m, haversine_m, sphere_xyz
from emberline.operators.components import connected_components
from emberline.operators.proximity import near_groups, prefixed
from emberline.operators.skew import join_counted
from emberline.session import durable

NEAR_M = 750.0
NEAR_DAYS = 2
_MARGIN_M = 1e-3


def _side(near_m: float) -> float:
    """Edge of a cube whose diagonal is just under the near distance."""
    return (chord_m(near_m) - 2 * _MARGIN_M) / math.sqrt(3)


def with_bricks(detections: DataFrame, near_m: float = NEAR_M, near_days: float = NEAR_DAYS) -> DataFrame:
    """Add `brick`, the cube in space and slot in time of a detection.

    Any two detections of a brick are within both limits, so a brick is one vertex however many
    detections it holds. Cubes lie in Cartesian space: no seam at the date line, no pole.
    """
    side, span = _side(near_m), int(near_days * 86400)
    x, y, z = sphere_xyz("latitude", "longitude")
    t = F.unix_seconds("detected_at")
    return detections.withColumn("brick", F.struct(
        F.floor(x / side).alias("i"), F.floor(y / side).alias("j"), F.floor(z / side).alias("k"),
        F.floor(t / span).alias("s")))


def brick_items(bricked: DataFrame) -> DataFrame:
    """Distinct positions and times per brick, as items for the proximity test."""
    x, y, z = sphere_xyz("latitude", "longitude")
    return (bricked.select(F.col("brick").alias("g"), "latitude", "longitude",
                           F.unix_seconds("detected_at").alias("t")).distinct()
            .withColumns({"x": x, "y": y, "z": z}))


def _candidates(parts: DataFrame, side: float, reach: float) -> DataFrame:
    """Pairs of bricks that can hold a near pair: touching blocks of 2x2x2 cubes, same or next time slot.

    Within a slot only the forward half of the neighbourhood is visited, and only blocks within
    reach that the Earth's surface crosses, so a brick sends about fifteen rows. They carry the
    brick's bounds.
    """
    half = lambda c: F.shiftright(F.col(c), 1)
    home = prefixed(parts, "b_").select("*", *[half(f"b_g.{d}").alias(d.upper()) for d in "ijk"], F.col("b_g.s").alias("S"))
    around = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    ways = [(*w, 0) for w in around if w >= (0, 0, 0)] + [(*w, 1) for w in around]
    way = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(w, "ijks")]) for w in ways]))
    probe = prefixed(parts, "a_").withColumn("w", way)
    probe = probe.select("*", *[(half(f"a_g.{d}") + F.col(f"w.{d}")).alias(d.upper()) for d in "ijk"],
                         (F.col("a_g.s") + F.col("w.s")).alias("S")).drop("w")
    centre = lambda c: (F.col(c) + 0.5) * (2 * side)
    radius = F.sqrt(centre("I") * centre("I") + centre("J") * centre("J") + centre("K") * centre("K"))
    probe = probe.filter(F.abs(radius - EARTH_RADIUS_M) <= side * math.sqrt(3) + 1)
    away = F.lit(0.0)
    for block, d in (("I", "x"), ("J", "y"), ("K", "z")):
        low = F.col(block) * (2 * side)
        away = away + F.pow(F.greatest(F.lit(0.0), low - F.col(f"a_{d}_hi"), F.col(f"a_{d}_lo") - low - 2 * side), 2)
    probe = probe.filter(F.sqrt(away) <= reach + 1)
    twice = F.col("a_g.s") == F.col("b_g.s")  # bricks of one block and slot meet in both directions
    for d in "ijk":
        twice = twice & (half(f"a_g.{d}") == half(f"b_g.{d}"))
    # the planner sees the bricks, not the rows they send, and would broadcast them
    return (probe.hint("merge").join(home, ["I", "J", "K", "S"]).filter(~twice | (F.col("a_g") < F.col("b_g")))
            .withColumns({"a": F.col("a_g"), "b": F.col("b_g")}))


def detection_links(bricked: DataFrame, near_m: float = NEAR_M, near_days: float = NEAR_DAYS) -> DataFrame:
    """Pairs (a, b) of bricks with a detection each within `near_m` and `near_days`, both inclusive.

    This is the space-time self-join of the detections in the only form that stays linear when a
    place holds a third of all of them: near pairs inside a brick are implied, pairs across bricks
    are reduced to one row per pair of bricks.
    """
    items = durable(brick_items(bricked))
    limit, span, side = chord_m(near_m), int(near_days * 86400), _side(near_m)
    low, high = F.lit(0.0), F.lit(0.0)
    for d in "xyz":
        low = low + F.pow(F.greatest(F.lit(0.0), F.col(f"a_{d}_lo") - F.col(f"b_{d}_hi"),
                                     F.col(f"b_{d}_lo") - F.col(f"a_{d}_hi")), 2)
        high = high + F.pow(F.greatest(F.col(f"a_{d}_hi") - F.col(f"b_{d}_lo"),
                                       F.col(f"b_{d}_hi") - F.col(f"a_{d}_lo")), 2)
    t_low = F.greatest(F.col("a_t_lo") - F.col("b_t_hi"), F.col("b_t_lo") - F.col("a_t_hi"))
    t_high = F.greatest(F.col("a_t_hi") - F.col("b_t_lo"), F.col("b_t_hi") - F.col("a_t_lo"))
    near = ((haversine_m("a_latitude", "a_longitude", "b_latitude", "b_longitude") <= near_m)
            & (F.abs(F.col("a_t") - F.col("b_t")) <= span))

    def part(level):
        f = 4 ** level
        return F.array(*[F.floor(F.col(d) * (f / side)).cast("bigint") for d in "xyz"],
                       F.floor(F.col("t") * (f / span)).cast("bigint"))
    links = near_groups(
        items, lambda parts: _candidates(parts, side, limit), ["x", "y", "z", "t"],
        surely=(F.sqrt(high) <= limit - _MARGIN_M) & (t_high <= span),
        never=(F.sqrt(low) > limit + _MARGIN_M) | (t_low > span), near=near, part=part)
    same = F.col("a.s") == F.col("b.s")
    return links.select(F.when(same, F.least("a", "b")).otherwise(F.col("a")).alias("a"),
                        F.when(same, F.greatest("a", "b")).otherwise(F.col("b")).alias("b"))


def brick_components(bricked: DataFrame, near_m: float = NEAR_M, near_days: float = NEAR_DAYS) -> DataFrame:
    """(brick, root, n): bricks of one fire share the root; chaining over any length is intended. n counts detections."""
    vertices = durable(bricked.groupBy(F.col("brick").alias("v")).agg(F.count("*").alias("n")))
    roots = connected_components(vertices, detection_links(bricked, near_m, near_days), unique=True)
    return roots.join(vertices, "v").withColumnRenamed("v", "brick")


# ---------------------------------------------------------------- stable event ids
def detection_key() -> Column:
    """Text of a detection inside the event digest: ISO time with offset, six decimals."""
    return F.concat_ws("|", F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
                       F.format_string("%.6f", "latitude"), F.format_string("%.6f", "longitude"))


_PIECE = 1 << 60


def set_digest() -> list[Column]:
    """Aggregates n, da, db of a set of detections: its size and the sums of two 60-bit pieces of every key's SHA-256.

    They can be added up in any order and over any parts, so partial sums are combined map-side and no task sees a
    whole event; only equal multisets of keys agree in all three, up to chance in 2^120.
    """
    digest = F.sha2(detection_key(), 256)
    piece = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(28,0)")
    return [F.count("*").alias("n"), F.sum(piece(1)).alias("da"), F.sum(piece(16)).alias("db")]


def add_digests() -> list[Column]:
    """The aggregates of `set_digest` over parts that have it already."""
    return [F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("da", "db")]]


def reduced(digests: DataFrame) -> DataFrame:
    """Sums taken modulo 2^60, so that adding them up never overflows."""
    return digests.withColumns({c: (F.col(c) % F.lit(_PIECE)).cast("decimal(28,0)") for c in ("da", "db")})


def ids_of_digests(digests: DataFrame) -> DataFrame:
    """Add `event_id` to rows with n, da, db: 60 bits of the SHA-256 of `n|da|db`.

    Where different digests meet in one id, the first by text keeps it and the others are hashed again with their
    place among them, so every event has an id of its own at any number of events; a digest always has the same id.
    """
    sixty = lambda text: F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    text = F.concat_ws("|", F.col("n").cast("string"), *[(F.col(c) % F.lit(_PIECE)).cast("decimal(19,0)").cast("string") for c in ("da", "db")])
    place = F.dense_rank().over(Window.partitionBy("_id").orderBy("_text"))
    named = digests.withColumn("_text", text).withColumn("_id", sixty(F.col("_text"))).withColumn("_place", place)
    again = sixty(F.concat_ws("|", "_text", F.col("_place").cast("string")))
    return named.withColumn("event_id", F.when(F.col("_place") == 1, F.col("_id")).otherwise(again)).drop("_text", "_id", "_place")


def stable_ids(detections: DataFrame, group: str) -> DataFrame:
    """(group, event_id): an id that depends on the group's detections alone, not on their order, number or partitioning."""
    return ids_of_digests(detections.groupBy(group).agg(*set_digest())).select(group, "event_id")


def cluster_detections(detections: DataFrame, near_m: float = NEAR_M, near_days: float = NEAR_DAYS) -> DataFrame:
    """Detections with their `event_id`; a detection near no other is an event of its own.

    Ids are found on bricks: their digests add up to those of events. The detections themselves are written once and joined once.
    """
    bricked = durable(with_bricks(detections, near_m, near_days))
    digests = durable(reduced(bricked.groupBy(F.col("brick").alias("v")).agg(*set_digest())))
    roots = durable(connected_components(digests, detection_links(bricked, near_m, near_days), unique=True))
    events = roots.join(digests, "v").groupBy("root").agg(*add_digests(), F.count("*").alias("bricks"))
    named = durable(ids_of_digests(events).select("root", "event_id", F.col("bricks").alias("n")))
    per_brick = durable(join_counted(roots, named, "root").select("v", "event_id").join(digests.select("v", "n"), "v").withColumnRenamed("v", "brick"))
    return join_counted(bricked, per_brick, "brick").drop("brick", "n")


def event_summary(clustered: DataFrame) -> DataFrame:
    """EVENT: first and last UTC day, number of detections and bounding box per event."""
    day = F.to_date("detected_at")
    return clustered.groupBy("event_id").agg(
        F.min(day).alias("start_date"), F.max(day).alias("end_date"), F.count("*").alias("n_detections"),
        F.min("longitude").alias("west"), F.min("latitude").alias("south"),
        F.max("longitude").alias("east"), F.max("latitude").alias("north"))


def select_events(events: DataFrame, ids: DataFrame | None = None, min_detections: int | None = None) -> DataFrame:
    """Events of an id table (column event_id), or with at least `min_detections` detections, or both."""
    if ids is not None:
        events = events.join(ids.select("event_id").distinct(), "event_id", "left_semi")
    if min_detections is not None:
        events = events.filter(F.col("n_detections") >= min_detections)
    return events
