"""Train, validation and test splits without leakage in space and time."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberline.functions.geo import KM_PER_DEG_LAT, KM_PER_DEG_LON, UTM19S, footprint_gap_days, footprint_gap_km
from emberline.operators.components import connected_components
from emberline.operators.proximity import near_groups, prefixed
from emberline.operators.ranking import hash_buckets, running_total
from emberline.operators.skew import join_counted
from emberline.session import DataError, durable, require_none

MAX_GAP_KM = 10.0
MAX_GAP_DAYS = 3
BOX = ["west", "south", "east", "north", "first_day", "last_day"]
_DAY0 = "1970-01-01"


class NoSplit(DataError):
    """Events that no split without leakage exists for."""


def footprint_from_cells(state: DataFrame, grid: dict, utm=UTM19S) -> DataFrame:
    """FOOTPRINT of burning cell centres; an event that never burns is an error."""
    x = grid["x0"] + grid["res"] * (F.col("col") + 0.5)
    y = grid["y0"] - grid["res"] * (F.col("row") + 0.5)
    fire = state.filter(F.col("fire_mask") >= 0.5)
    require_none(state.select("event_id").distinct().join(fire.select("event_id").distinct(), "event_id", "left_anti"),
                 "event without a burning cell")
    cells = fire.groupBy("event_id", "row", "col").agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    return utm.with_lonlat(cells, x, y).groupBy("event_id").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
        F.min("d0").alias("first_day"), F.max("d1").alias("last_day"))


# ---------------------------------------------------------------- coupling of footprints
def with_bricks(footprints: DataFrame, km: float = MAX_GAP_KM, days: int = MAX_GAP_DAYS) -> DataFrame:
    """Add `brick`: footprints whose south-west corners and first days are so close that all are coupled."""
    return footprints.withColumn("brick", F.struct(
        F.floor(F.col("south") * (2 * KM_PER_DEG_LAT / km)).alias("i"),
        F.floor(F.col("west") * (2 * KM_PER_DEG_LON / km)).alias("j"),
        F.floor(_day("first_day") / (days + 1)).alias("s")))


def _day(c) -> Column:
    return F.datediff(c, F.lit(_DAY0).cast("date"))


def _c(name: str) -> Column:
    return F.col(name)


def _gap(a_min: str, b_max: str, b_min: str, a_max: str) -> Column:
    return F.greatest(F.lit(0.0), _c(a_min) - _c(b_max), _c(b_min) - _c(a_max))


def _gap_bounds() -> dict[str, Column]:
    """Least and greatest gap (km, days) over members of two parts, from `a_`/`b_` bounds of BOX."""
    lo, hi = {}, {}
    for d, low, high in (("x", "west", "east"), ("y", "south", "north"), ("t", "first_day", "last_day")):
        lo[d] = _gap(f"a_{low}_lo", f"b_{high}_hi", f"b_{low}_lo", f"a_{high}_hi")
        hi[d] = _gap(f"a_{low}_hi", f"b_{high}_lo", f"b_{low}_hi", f"a_{high}_lo")
    mean = lambda e: (_c(f"a_south_{e}") + _c(f"a_north_{e}") + _c(f"b_south_{e}") + _c(f"b_north_{e}")) / 4
    south, north = mean("lo"), mean("hi")
    cos_min = F.cos(F.radians(F.greatest(F.abs(south), F.abs(north))))
    cos_max = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(
        F.cos(F.radians(F.least(F.abs(south), F.abs(north)))))
    return {"lo_km": F.hypot(lo["x"] * KM_PER_DEG_LON * cos_min, lo["y"] * KM_PER_DEG_LAT),
            "hi_km": F.hypot(hi["x"] * KM_PER_DEG_LON * cos_max, hi["y"] * KM_PER_DEG_LAT),
            "lo_days": lo["t"], "hi_days": hi["t"]}


def _as_items(df: DataFrame, group: Column) -> DataFrame:
    """Distinct boxes per group, days as numbers; the date columns stay for the exact test."""
    return df.select(group.alias("g"), "west", "south", "east", "north",
                     _day("first_day").alias("first_day"), _day("last_day").alias("last_day")).distinct()


def _near(km: float, days: int) -> Column:
    gap_days = F.greatest(F.lit(0), F.greatest("a_first_day", "b_first_day") - F.least("a_last_day", "b_last_day"))
    return (footprint_gap_km("a_", "b_") <= km) & (gap_days <= days)


def _lon_reach(km: float, dlat: float) -> Column:
    """Degrees of longitude within `km`, with 5 degrees of latitude in hand for boxes that reach further out."""
    edge = F.greatest(F.abs(_c("south_lo") - dlat), F.abs(_c("north_hi") + dlat)) + 5
    return F.least(km / KM_PER_DEG_LON / F.cos(F.radians(F.least(edge, F.lit(89.0)))), F.lit(360.0))


def _cover(parts: DataFrame, km: float, days: int, grow: bool) -> DataFrame:
    """One row per cell of about `km` x `km` x 8 days that a part's bounds touch, grown by the limits on request."""
    dlat = km / KM_PER_DEG_LAT if grow else 0.0
    dlon = _lon_reach(km, dlat) if grow else F.lit(0.0)
    step_y, step_x, span = km / KM_PER_DEG_LAT, km / KM_PER_DEG_LON, 8
    pad = days if grow else 0
    cells = lambda lo, hi, step: F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step)))
    return (parts.withColumn("I", cells(_c("south_lo") - dlat, _c("north_hi") + dlat, step_y))
            .withColumn("J", cells(_c("west_lo") - dlon, _c("east_hi") + dlon, step_x))
            .withColumn("S", cells(_c("first_day_lo") - pad, _c("last_day_hi") + pad, span)))


def _links(items: DataFrame, pair_filter: Column, km: float, days: int) -> DataFrame:
    def candidates(parts):
        a, b = prefixed(_cover(parts, km, days, True), "a_"), prefixed(_cover(parts, km, days, False), "b_")
        on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in "IJS"]
        return (a.hint("merge").join(b, on).withColumns({"a": F.col("a_g"), "b": F.col("b_g")})
                .filter(pair_filter).dropDuplicates(["a", "b"]))
    bounds = _gap_bounds()

    def part(level):
        f = 4 ** level
        quant = lambda c, unit: F.floor(F.col(c) * (f / unit)).cast("bigint")
        return F.array(quant("west", 0.1), quant("south", 0.1), quant("east", 0.1), quant("north", 0.1),
                       quant("first_day", 8.0), quant("last_day", 8.0))
    return near_groups(items, candidates, BOX, surely=(bounds["hi_km"] <= km - 1e-6) & (bounds["hi_days"] <= days),
                       never=(bounds["lo_km"] > km + 1e-6) | (bounds["lo_days"] > days), near=_near(km, days), part=part)


def coupled_bricks(bricked: DataFrame, km: float = MAX_GAP_KM, days: int = MAX_GAP_DAYS) -> DataFrame:
    """Pairs (a, b) of bricks with coupled footprints; members of one brick are coupled by construction."""
    return _links(durable(_as_items(bricked, F.col("brick"))), F.col("a") < F.col("b"), km, days)


def group_events(footprints: DataFrame, km: float = MAX_GAP_KM, days: int = MAX_GAP_DAYS) -> DataFrame:
    """(event_id, group_id): chains of coupled events; the group is named by its least event id."""
    bricked = durable(with_bricks(footprints, km, days))
    per_brick = bricked.groupBy(F.col("brick").alias("v")).agg(F.min("event_id").alias("least"))
    roots = connected_components(per_brick, coupled_bricks(bricked, km, days))
    named = roots.join(per_brick, "v")
    ids = named.groupBy("root").agg(F.min("least").alias("group_id"))
    return (bricked.join(named.join(ids, "root").select(F.col("v").alias("brick"), "group_id"), "brick")
            .select("event_id", "group_id"))


def split_leakage(footprints: DataFrame, split: DataFrame, km: float = MAX_GAP_KM, days: int = MAX_GAP_DAYS) -> DataFrame:
    """(event_id, split, other_split): events coupled with an event of another split.

    Each distinct footprint is asked against whole bricks of the other splits, so the result and
    the work grow with the events, not with the pairs of events.
    """
    tagged = durable(with_bricks(footprints, km, days).join(split.select("event_id", "split"), "event_id"))
    own = tagged.groupBy("split", *BOX).agg(F.min("event_id").alias("rep"))
    g = lambda kind, id_, i, j, s: F.struct(F.lit(kind).alias("kind"), F.col("split"), id_.alias("id"),
                                            i.alias("i"), j.alias("j"), s.alias("s"))
    nil = F.lit(0).cast("bigint")
    single = _as_items(own, g("event", F.col("rep"), nil, nil, nil))
    crowd = _as_items(tagged, g("brick", nil, F.col("brick.i"), F.col("brick.j"), F.col("brick.s")))
    across = ((F.col("a.kind") == "event") & (F.col("b.kind") == "brick") & (F.col("a.split") != F.col("b.split")))
    hits = _links(durable(single.unionByName(crowd)), across, km, days)
    leaks = hits.select(F.col("a.id").alias("rep"), F.col("b.split").alias("other_split")).distinct()
    return (tagged.join(own, ["split", *BOX]).join(leaks, "rep").select("event_id", "split", "other_split"))


def leaking_pairs(footprints: DataFrame, split: DataFrame, km: float = MAX_GAP_KM, days: int = MAX_GAP_DAYS) -> DataFrame:
    """Every coupled pair across splits with its gaps, for the audit of a split that leaks little.

    The result is the pairs themselves. Only events that `split_leakage` found take part.
    """
    leaks = split_leakage(footprints, split, km, days)
    involved = durable(footprints.join(leaks, "event_id"))
    cover = lambda df, grow: _cover(df.withColumns(
        {f"{c}_{e}": (_day(c) if c.endswith("day") else F.col(c)) for c in BOX for e in ("lo", "hi")}), km, days, grow)
    cols = ["event_id", *BOX]
    a = cover(involved, True).select([F.col(c).alias("a_" + c) for c in cols] + [
        F.col("split").alias("split_a"), F.col("other_split").alias("split_b"), "I", "J", "S"])
    b = cover(involved.dropDuplicates(["event_id"]), False).select(
        [F.col(c).alias("b_" + c) for c in cols] + [F.col("split").alias("split_b"), "I", "J", "S"])
    gap_km, gap_days = footprint_gap_km("a_", "b_"), footprint_gap_days("a_", "b_")
    return (a.hint("merge").join(b, ["I", "J", "S", "split_b"]).filter(F.col("a_event_id") < F.col("b_event_id"))
            .filter((gap_km <= km) & (gap_days <= days))
            .select("a_event_id", "split_a", "b_event_id", "split_b", gap_km.alias("gap_km"), gap_days.alias("gap_days"))
            .distinct())


def nearest_cross_split(footprints: DataFrame, split: DataFrame, start_km: float = 20.0, small: int = 16) -> DataFrame:
    """For each val/test event the event of another split with the least (gap_km, gap_days, event id).

    The search radius doubles until the nearest found lies within it. In each round events walk down a tree of space-time parts,
    each with the bounds of its footprints, their number and their least id: see `_descend`. Equal footprints count once.
    """
    tagged = durable(footprints.join(split.select("event_id", "split"), "event_id")
                     .withColumns({"first_day": _day("first_day"), "last_day": _day("last_day")}))
    pool = tagged.groupBy("split", *BOX).agg(F.min("event_id").alias("id"))
    others = durable(pool.withColumn("for_split", F.explode(F.array(F.lit("val"), F.lit("test"))))
                     .filter(F.col("for_split") != F.col("split")))
    asking = durable(pool.filter(F.col("split").isin("val", "test")))
    span = pool.agg(F.min("first_day").alias("first"), F.max("last_day").alias("last")).first()
    levels = 1
    while span.first is not None and 4 ** levels <= span.last - span.first:
        levels += 1
    answers, radius = [], start_km
    far = 20_100.0 * 2
    while True:
        found = durable(_descend(asking, others, radius, small, (span.first or 0, levels)).filter((F.col("m.gap_km") <= radius) | F.lit(radius >= far)))
        answers.append(found)
        asking = durable(asking.join(found.select(F.col("a_id").alias("id")), "id", "left_anti"))
        if radius >= far or asking.isEmpty():
            break
        radius *= 2
    done = reduce(DataFrame.unionByName, answers)
    reps = done.join(pool.select(F.col("id").alias("a_id"), "split", *BOX), "a_id")
    return tagged.join(reps, ["split", *BOX]).select("event_id", "split", "m.nearest_event_id", "m.nearest_split",
                                                     "m.gap_km", "m.gap_days")


def _parts(others: DataFrame, radius: float, near: int, when: int, time: tuple[int, int]) -> DataFrame:
    """Footprints with their part at `near` spatial and `when` temporal cuts, each four times finer, and the part above it.

    A part is cut in space until its distance is certain, and then in time. `time` is the first day of all and the number of
    cuts that lead from the whole period to single days: uncut parts hold all of it, so their number grows with the places alone.
    """
    first, levels = time

    def key(near, when):
        unit, days = radius / 4 ** near, 4 ** (levels - when)
        at = lambda c, scale: F.floor(F.col(c) * (scale / unit))
        return F.array(at("west", KM_PER_DEG_LON), at("south", KM_PER_DEG_LAT), at("east", KM_PER_DEG_LON), at("north", KM_PER_DEG_LAT),
                       *[F.floor((F.col(c) - first) / days).cast("bigint") for c in ("first_day", "last_day")])
    above = key(near, when - 1) if when else key(max(near - 1, 0), 0)
    return others.withColumns({"near": F.lit(near), "when": F.lit(when), "part": key(near, when), "above": above})


def _descend(asking: DataFrame, others: DataFrame, radius: float, small: int, time: tuple[int, int]) -> DataFrame:
    """(a_id, m): per footprint the least (gap_km, gap_days, id, split) among those whose cells within `radius` it meets.

    A part stands for (least gap, least days, least id) its members may have. The distance of a part is exact if all members have the same box or
    all touch the footprint; parts of one distance are then told apart by days alone. If all members have the same days as well, the
    least id answers for the part unopened, however many lie on one place. A part whose best case is no better than what another
    part is sure to give is dropped, ids included; of the others, small ones are opened, large ones give way to their children.
    """
    bounds = [f(d).alias(f"b_{d}_{n}") for d in BOX for f, n in ((F.min, "lo"), (F.max, "hi"))]
    of_part = [*bounds, F.count("*").alias("size"), F.min(F.struct("id", "split")).alias("least")]
    g = _gap_bounds()
    zero = lambda c: F.struct(c[0].alias("gap_km"), c[1].alias("gap_days"), c[2].alias("nearest_event_id"), c[3].alias("nearest_split"))
    ask = asking.withColumns({f"{d}_{e}": F.col(d) for d in BOX for e in ("lo", "hi")})
    a = _spatial(ask, radius, True).select("I", "J", F.col("split").alias("for_split"), F.col("id").alias("a_id"),
                                           *[F.col(f"{d}_{e}").alias(f"a_{d}_{e}") for d in BOX for e in ("lo", "hi")])
    a_cols = [f"a_{d}_{e}" for d in BOX for e in ("lo", "hi")]
    keyed = _parts(others, radius, 0, 0, time)
    top = keyed.groupBy("for_split", "part", "near", "when").agg(*of_part)
    renamed = top.select("for_split", "part", "near", "when", "size", "least", *[F.col(f"b_{d}_{e}").alias(f"{d}_{e}") for d in BOX for e in ("lo", "hi")])
    b = _spatial(renamed, radius, False).select("I", "J", "for_split", "part", "near", "when", "size", "least",
                                                *[F.col(f"{d}_{e}").alias(f"b_{d}_{e}") for d in BOX for e in ("lo", "hi")])
    met = a.hint("merge").join(b, ["I", "J", "for_split"]).drop("I", "J").dropDuplicates(["a_id", "for_split", "part"])
    sure, answers, state = None, [], ["for_split", "near", "when", "part"]
    while True:
        boxes = met.withColumns({f"{p}_{d}": F.col(f"{p}_{d}_lo") for p in "ab" for d in BOX[:4]})
        one_place = reduce(Column.__and__, [F.col(f"b_{d}_lo") == F.col(f"b_{d}_hi") for d in BOX[:4]])
        exact = one_place | (g["hi_km"] == 0)
        km = F.when(one_place, footprint_gap_km("a_", "b_")).otherwise(F.lit(0.0))
        closed = exact & (g["lo_days"] == g["hi_days"])
        judged = durable(boxes.select(
            "a_id", *state, "size", *a_cols, closed.alias("closed"), (g["hi_km"] - g["lo_km"] <= 1e-9).alias("certain"),
            zero((F.when(exact, km).otherwise(F.greatest(g["lo_km"] - 1e-9, F.lit(0.0))), g["lo_days"], F.col("least.id"), F.col("least.split"))).alias("best"),
            zero((F.when(exact, km).otherwise(g["hi_km"] + 1e-9), g["hi_days"], F.when(closed, F.col("least.id")).otherwise(F.lit(2 ** 63 - 1)),
                  F.when(closed, F.col("least.split")))).alias("worst")))
        here = judged.select("a_id", "worst") if sure is None else judged.select("a_id", "worst").unionByName(sure)
        sure = durable(here.groupBy("a_id").agg(F.min("worst").alias("worst")))
        limit = sure.withColumnRenamed("worst", "limit")
        answers.append(sure.filter("worst.nearest_split is not null").select("a_id", F.col("worst").alias("m")))
        rest = durable(judged.filter("not closed").join(limit, "a_id").filter(F.col("best") < F.col("limit")).select("a_id", *state, "size", "certain", *a_cols))
        few = (F.col("size") <= small) | (F.col("certain") & (F.col("when") == time[1]))  # the latter: one distance and one pair of days
        qa = rest.filter(few).select("a_id", *state, *[F.col(f"a_{d}_lo").alias(f"a_{d}") for d in BOX])
        ob = keyed.select(*state, F.col("id").alias("b_id"), F.col("split").alias("b_split"), *[F.col(d).alias(f"b_{d}") for d in BOX])
        gap_days = F.greatest(F.lit(0), F.greatest("a_first_day", "b_first_day") - F.least("a_last_day", "b_last_day"))
        opened = (qa.join(ob, state)
                  .groupBy("a_id").agg(F.min(zero((footprint_gap_km("a_", "b_"), gap_days, F.col("b_id"), F.col("b_split")))).alias("worst")))
        opened = durable(opened)
        answers.append(opened.select("a_id", F.col("worst").alias("m")))
        later = F.when(F.col("certain"), F.lit(1)).otherwise(F.lit(0))
        many = rest.filter(~few).withColumns({"above": F.col("part"), "near": F.col("near") + 1 - later, "when": F.col("when") + later})
        levels = [(r.near, r.when) for r in many.select("near", "when").distinct().collect()]  # one per cut at most
        if not levels:
            break
        sure = sure.unionByName(opened)
        keyed = reduce(DataFrame.unionByName, [_parts(others, radius, *x, time) for x in levels])
        children = keyed.groupBy(*state, "above").agg(*of_part)
        met = many.drop("size", "part", "certain").join(children, ["for_split", "near", "when", "above"])
    return reduce(DataFrame.unionByName, answers).groupBy("a_id").agg(F.min("m").alias("m"))


def _spatial(parts: DataFrame, km: float, grow: bool) -> DataFrame:
    """Cells of about `km` x `km` that bounds touch, grown by `km` on request."""
    dlat = km / KM_PER_DEG_LAT if grow else 0.0
    dlon = _lon_reach(km, dlat) if grow else F.lit(0.0)
    cells = lambda lo, hi, step: F.explode(F.sequence(F.floor(lo / step), F.floor(hi / step)))
    return (parts.withColumn("I", cells(_c("south_lo") - dlat, _c("north_hi") + dlat, km / KM_PER_DEG_LAT))
            .withColumn("J", cells(_c("west_lo") - dlon, _c("east_hi") + dlon, km / KM_PER_DEG_LON)))


# ---------------------------------------------------------------- splits
def split_sizes(n: int, train_frac: float = 0.7, val_frac: float = 0.15) -> tuple[int, int, int]:
    """(train, val, test) counts of `n` events; fewer than three events all train.

    One event at least trains. Shares that leave none give way to that, the larger one first: val is half of what
    both may hold, moved no further than both wanted shares allow.
    """
    if n < 3:
        return n, 0, 0
    val, test = max(1, round(n * val_frac)), max(1, round(n * (1 - train_frac - val_frac)))
    held = min(val + test, n - 1)
    val = max(held - test, min(val, held // 2))
    return n - held, val, held - val


def _shuffle_digest(seed: int, name: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(name).cast("string")), 256)


def _positions(df: DataFrame, weight: Column, out: str) -> DataFrame:
    return running_total(hash_buckets(df.withColumn("_one", F.lit(1)), "digest"), ["_one"], ["digest"], weight, out)


def split_events(ids: DataFrame, seed: int = 42, train_frac: float = 0.7, val_frac: float = 0.15) -> DataFrame:
    """SPLIT by a seeded hash order of the event ids; depends on the set of ids and the seed only."""
    ids = ids.select("event_id").distinct()
    train, val, _ = split_sizes(ids.count(), train_frac, val_frac)
    pos = _positions(ids.withColumn("digest", _shuffle_digest(seed, "event_id")), F.lit(1), "pos")
    return pos.select("event_id", F.when(F.col("pos") < train, "train").when(F.col("pos") < train + val, "val")
                      .otherwise("test").alias("split"))


def split_events_grouped(footprints: DataFrame, seed: int = 42, train_frac: float = 0.7, val_frac: float = 0.15,
                         km: float = MAX_GAP_KM, days: int = MAX_GAP_DAYS) -> DataFrame:
    """SPLIT (event_id, split, group_id) that never cuts a group of coupled events.

    Groups stand in seeded hash order. Test takes, one by one, the first group that fits what it still lacks, and if none
    does the smallest (the first of equals); then val does the same; the rest trains. At least one group stays for each of
    those that come after; fewer than three groups is an error.
    """
    return split_groups(durable(group_events(footprints, km, days)), seed, train_frac, val_frac)


def split_groups(grouped: DataFrame, seed: int = 42, train_frac: float = 0.7, val_frac: float = 0.15) -> DataFrame:
    """`split_events_grouped` of events whose groups (event_id, group_id) are known."""
    sizes = durable(grouped.groupBy("group_id").agg(F.count("*").alias("size")).withColumn("digest", _shuffle_digest(seed, "group_id")))
    totals = sizes.agg(F.count("*").alias("groups"), F.sum("size").alias("n")).first()
    if totals.groups < 3:
        raise NoSplit(f"{totals.groups} independent groups of events; train, val and test need three")
    test = durable(_first_fit(sizes, max(1, round(totals.n * (1 - train_frac - val_frac))), totals.groups - 2))
    rest = durable(sizes.join(test, "group_id", "left_anti"))
    val = durable(_first_fit(rest, max(1, round(totals.n * val_frac)), rest.count() - 1))
    held = test.withColumn("split", F.lit("test")).unionByName(val.withColumn("split", F.lit("val")))
    named = sizes.select("group_id", F.col("size").alias("n")).join(held, "group_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))
    return join_counted(grouped, durable(named), "group_id").select("event_id", "split", "group_id")


def split_dataset(footprints: DataFrame, seed: int = 42) -> DataFrame:
    """SPLIT (event_id, split, group_id) of a data set that is kept whether or not it can be split.

    Fewer than three events all train. Where more events form fewer than three groups, no split is free of leaks and none is made:
    `split` is NULL, a warning says so, and `load_split_cells` refuses it.
    """
    grouped = durable(group_events(footprints))
    if grouped.count() < 3:
        return grouped.select("event_id", F.lit("train").alias("split"), "group_id")
    try:
        return split_groups(grouped, seed)
    except NoSplit as error:
        warnings.warn(f"no split was made: {error}", stacklevel=2)
        return grouped.select("event_id", F.lit(None).cast("string").alias("split"), "group_id")


def _first_fit(groups: DataFrame, need: int, most: int) -> DataFrame:
    """(group_id) chosen from (group_id, size, digest): walking in order of the digest, every group that fits what `need` still lacks, at most
    `most`; if something is lacking in the end, the smallest other group too.

    A group that did not fit never fits later, so one walk does. It goes in rounds: of those that fit the present need, a
    prefix with a running total within it is taken at once; the next one ends the round, and the walk goes on behind the prefix
    with a smaller need. No task sees all groups.
    """
    chosen, after = [], ""
    while need > 0 and most > 0:
        fit = groups.filter((F.col("digest") > after) & (F.col("size") <= need))
        taken = durable(_positions(fit, F.col("size"), "before").filter(F.col("before") + F.col("size") <= need))
        if taken.count() > most:
            taken = durable(_positions(taken.select(*groups.columns), F.lit(1), "pos").filter(F.col("pos") < most))
        got = taken.agg(F.count("*").alias("k"), F.sum("size").alias("size"), F.max("digest").alias("last")).first()
        if not got.k:
            break
        chosen.append(taken.select("group_id"))
        need, most, after = need - got["size"], most - got.k, got["last"]
    out = reduce(DataFrame.unionByName, chosen) if chosen else groups.select("group_id").limit(0)
    if need > 0 and most > 0:
        least = groups.join(out, "group_id", "left_anti").orderBy("size", "digest").limit(1)
        out = out.unionByName(least.select("group_id"))
    return out


def split_shards(paths: DataFrame, seed: int = 42, train_frac: float = 0.85) -> DataFrame:
    """(path, split): whole files to train or val; fewer than two files all train."""
    paths = paths.select("path").distinct()
    n = paths.count()
    train = n if n < 2 else n - min(max(1, round(n * (1 - train_frac))), n - 1)
    pos = _positions(paths.withColumn("digest", _shuffle_digest(seed, "path")), F.lit(1), "pos")
    return pos.select("path", F.when(F.col("pos") < train, "train").otherwise("val").alias("split"))


def resplit(footprints: DataFrame, previous: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(event_id, new and previous split) and the leaks of the previous split."""
    new = split_events_grouped(footprints, seed)
    both = new.join(previous.select("event_id", F.col("split").alias("previous_split")), "event_id", "left")
    return both, split_leakage(footprints, previous)


def split_audit(footprints: DataFrame, split: DataFrame) -> DataFrame:
    """One row per val/test event: nearest event of another split, whether it leaks, groups and leaks overall."""
    leaks = split_leakage(footprints, split)
    groups = group_events(footprints)
    n = groups.agg(F.countDistinct("group_id").alias("n_groups")).first()[0]
    leaking = durable(leaks.select("event_id").distinct())
    return (nearest_cross_split(footprints, split)
            .join(leaking.withColumn("leaks", F.lit(1)), "event_id", "left")
            .withColumns({"leaks": F.coalesce("leaks", F.lit(0)), "n_groups": F.lit(n),
                          "n_leaking": F.lit(leaking.count())}))
