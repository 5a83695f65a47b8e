"""Mixing sources to target weights: how often to take each document, by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.llm.common import free_name, row_key, stored

WEIGHTS, CAP, BLOCK, SPARE = (5, 2, 1), 3, 512, 16


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, number, docs, source_size, target): weights go round the sources by code point, null last.

    Targets share the total size by weight; one above `cap` times its source's size stops there and the
    excess is shared again, until none is above. Sources are numbered in ranges, so their number is not
    bound by one task.
    """
    last = F.col("source").isNull()
    per = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    ranged = stored(per.repartitionByRange(F.col("source").isNull(), F.col("source"))
                    .withColumn("part", F.spark_partition_id()), "sources")
    before, starts = 0, {}
    for r in sorted(ranged.groupBy("part").count().collect()):  # one row per partition
        starts[r["part"]] = before
        before += r["count"]
    offset = F.lit(0) if not starts else F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("part"))
    number = offset + F.row_number().over(Window.partitionBy("part").orderBy(last, "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = stored(ranged.withColumn("number", number.cast("long")).withColumn("w", w).drop("part"), "sources")
    top = cap * F.col("source_size")
    level = 0.0
    while True:  # every round stops at least one more source
        stops = F.col("w") * level >= top
        r = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(stops, top)).alias("stopped"),
                       F.sum(F.when(~stops, F.col("w"))).alias("open")).first()
        if not r["all"] or not r["open"]:
            break
        higher = (r["all"] - (r["stopped"] or 0)) / r["open"]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    target = F.least(F.col("w") * level, top.cast("double"))
    return ranked.select("source", "number", "docs", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move fractional probabilities to 0 or 1 along directions that keep both their sum and their sum weighted by size.

    Three fractional units always leave such a direction; at most two stay fractional. With `land` those are
    rounded to the choice nearest in size, then in number.
    """
    p, live, eps = p.astype(float).copy(), [], 1e-9
    p[p < eps], p[p > 1 - eps] = 0.0, 1.0
    waiting = list(np.flatnonzero((p > 0) & (p < 1)))[::-1]
    while True:
        while waiting and len(live) < 3:
            live.append(waiting.pop())
        s = size[live]
        if len(live) == 3:
            u = np.array([s[1] - s[2], s[2] - s[0], s[0] - s[1]], dtype=float)
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
        elif len(live) == 2 and s[0] == s[1]:
            u = np.array([1.0, -1.0])
        else:
            break
        u /= np.abs(u).max()
        q = p[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
            down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
        q = q + up * u if rng.random() * (up + down) < down else q - down * u
        q[q < eps], q[q > 1 - eps] = 0.0, 1.0
        p[live] = q
        live = [i for i, x in zip(live, q) if 0 < x < 1]
    if land and live:
        options = [[(m >> j) & 1 for j in range(len(live))] for m in range(1 << len(live))]
        p[live] = min(options, key=lambda o: (abs(np.dot(o - p[live], size[live])), abs(sum(o - p[live]))))
    return p


def exchange(p: np.ndarray, was: np.ndarray, size: np.ndarray, rounds: int = 64) -> np.ndarray:
    """Landed choices `p` with up to `rounds` exchanges that bring the words taken nearer to those of `was`: one document in or out, or one for another."""
    p = p.copy()
    for _ in range(rounds):
        off = float(np.dot(p - was, size))
        step = np.where(p == 0, size, np.where(p == 1, -size, 0)).astype(float)  # what a change of mind adds
        ins, outs = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
        best = min(((abs(off + step[i]), i, i) for i in (*ins, *outs)), default=(abs(off), 0, 0))
        if len(ins) and len(outs):
            order = ins[np.argsort(step[ins], kind="stable")]
            at = np.searchsorted(step[order], -(off + step[outs]))
            for j in (np.clip(at - 1, 0, len(order) - 1), np.clip(at, 0, len(order) - 1)):
                left = np.abs(off + step[outs] + step[order[j]])
                o = int(np.argmin(left))
                best = min(best, (float(left[o]), int(order[j[o]]), int(outs[o])))
        if best[0] >= abs(off) - 1e-9:
            break
        for i in {best[1], best[2]}:
            p[i] = 1 - p[i]
    return p


def mixing_plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(key, doc_id, size, source_size, target, copies, taken), one row per row of `docs` (doc_id, text, source, ...).

    A document is taken floor(e) or floor(e) + 1 times, e being its source's target over its source's size.
    The choice is a balanced sample: blocks of a source fly through the null space of the constraints
    (number, words), what stays fractional (two a block at most) flies again in blocks one level up, with up to twice SPARE
    settled documents of each block, and only the last two of a source are rounded. A few exchanges among the documents of the last block then
    bring its words back to what was wanted of it. A source of any size is many blocks.

    `key` is equal for equal rows. Null text has size 0, null source is a source; repeated rows are documents of
    their own. All draws are seeded by source, level and block, so reruns agree. An empty table gives no rows.
    """
    sized = docs.select(row_key("doc_id", "text", "source").alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = stored(sized, "sized")
    sources = source_targets(sized, weights, cap)
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    live = (sized.join(sources, sized["source"].eqNullSafe(sources["source"]), "inner").drop("source")
            .withColumn("e", e).withColumn("base", F.floor(F.col("e") + 1e-12))
            .withColumn("p", F.greatest(F.col("e") - F.col("base"), F.lit(0.0))).drop("e").withColumn("up", F.lit(True)))
    settled, level = [], 0

    def fly(key, group):
        group = group.sort_values(["key", "doc_id"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(group["level"].iat[0]), int(key[0]), int(key[1])])
        was, size, last = group["p"].to_numpy(), group["size"].to_numpy(), bool(group["blocks"].iat[0] == 1)
        now = flight(was, size, rng, last)
        group["p"] = exchange(now, was, size) if last else now
        # a few settled documents of assorted sizes go up with what stays fractional, so that the landing has something to exchange
        group["up"] = (now > 0) & (now < 1)
        if not last:
            by_size = np.argsort(size, kind="stable")
            words = np.cumsum(size[by_size])
            even = np.linspace(0, len(size) - 1, SPARE).astype(int)  # evenly by rank, and by words, so that large ones are among them
            heavy = np.searchsorted(words, np.linspace(0, words[-1], SPARE)).clip(max=len(size) - 1)
            group.loc[by_size[np.union1d(even, heavy)], "up"] = True
        return group

    while True:
        blocks = F.ceil(F.col("docs") / block).cast("long")
        dealt = (live.withColumn("level", F.lit(level)).withColumn("blocks", F.greatest(blocks, F.lit(1)))
                 .withColumn("block", F.pmod(F.xxhash64("key", "level"), F.col("blocks"))))
        flown = stored(dealt.groupBy("number", "block").applyInPandas(fly, dealt.schema), "flown").drop("level", "blocks", "block")
        done = ~F.col("up")
        settled.append(flown.filter(done))
        rest = flown.filter(~done)
        counts = rest.groupBy("number").agg(F.count("*").alias("docs"))
        if counts.isEmpty():
            break
        live = rest.drop("docs").join(counts, "number").select(*live.columns)
        level += 1
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    copies = (F.col("base") + F.col("p")).cast("long")
    return whole.select("key", "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = 0) -> DataFrame:
    """The documents that the mix takes, with all their columns, `copies` (how often) and `taken` (words); columns of these two names are replaced."""
    plan = mixing_plan(docs, weights, cap, seed=seed)
    docs = docs.drop("copies", "taken")
    key, nth = free_name(docs, "key"), free_name(docs, "nth")
    count = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.lit(0)))
    plan = plan.withColumn("n", count("key")).filter(F.col("copies") > 0).select(F.col("key").alias(key), F.col("n").alias(nth), "copies", "taken")
    docs = docs.withColumn(key, row_key("doc_id", "text", "source")).withColumn(nth, count(key))
    return docs.join(plan, [key, nth]).drop(key, nth)
