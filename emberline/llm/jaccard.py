"""N-gram Jaccard join by a token-group matrix: similar texts in groups, each group's token union, overlap bounds, opened groups."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.llm.common import drop_tables, free_name, hashed_texts, mix, parts, row_key, shingles, stored, tables_written
from emberline.operators.components import connected_components

_BOUNDS = (64, 128, 256, 512, 1024, 2048, 4096)  # sizes at which the share of sampled shingles falls
_LEADERS, _BAND, _SIGMAS = 3, math.log(1.01), 6
_OVER = 4  # sets that may have partners show four times the sample that would do, so that their rarest tokens are few of many
_SIXTEENTHS = np.arange(16, dtype=np.uint64) << np.uint64(60)  # 16 minima make 8 keys


def _share(n: int, missed: float) -> float:
    """Share of hash space of which a set of n or more shingles keeps more than it may miss, by six standard deviations."""
    low, high = missed, 1.0
    for _ in range(50):
        r = (low + high) / 2
        low, high = (low, r) if r * n - _SIGMAS * math.sqrt(n * r * (1 - r)) >= missed * n + 1 else (r, high)
    return high


def _sketched(docs: DataFrame, k: int, percent: int, over: int = 1) -> DataFrame:
    """Per row: set size n, 128-bit digest, keys by which copies meet, and its smallest shingle hashes.

    Sets of fewer than 64 shingles keep all (class 0), larger ones those below a limit by size class. A pair is compared in the class
    of its smaller set, so a set also holds the sample of the class c0 its smallest partner has (s0 hashes, s1 in its own class c1).
    `tokens` has these, and at least one more than the set may miss. The first `m` tokens count towards those that no other set
    holds, the first `e` are shown to the others. `over` multiplies the limits.
    """
    t = percent / 100
    whole = (1 << 64) - 1
    limits = [whole] + [min(whole, int(over * _share(b, 1 - t) * (1 << 64))) for b in _BOUNDS]
    base = np.uint64(min(whole, int(min(1.0, 1.5 * (1 - t)) * (1 << 64))))

    def run(batches):
        def below(s, c):
            return len(s) if c == 0 else int(np.searchsorted(s, np.uint64(limits[c])))

        for batch in batches:
            for part in parts(batch):
                rows = []
                for words in hashed_texts(part.column("text").cast(pa.binary()).to_pylist()):
                    s = shingles(words, k)
                    n, least = len(s), -(-len(s) * percent // 100)
                    c1, c0 = (sum(b <= x for b in _BOUNDS) for x in (n, least))
                    s1, s0, low = below(s, c1), below(s, c0), int(np.searchsorted(s, base))
                    # the least hash of each sixteenth of hash space; an empty one takes the next hash, round the end
                    minima = s[np.searchsorted(s, _SIXTEENTHS) % n] if n else s
                    keys = mix(minima[::2] * np.uint64(3) + minima[1::2] + np.arange(len(minima) // 2, dtype=np.uint64)).view(np.int64)
                    rows.append((n, int(np.add.reduce(mix(s ^ np.uint64(1))).view(np.int64)) if n else 0,
                                 int(np.add.reduce(mix(s ^ np.uint64(2))).view(np.int64)) if n else 0, keys,
                                 s[:max(s0, n - least + 1)].view(np.int64), n if c1 == 0 else low, n if c0 == 0 else low, c0, c1, s0, s1))
                col = lambda i, kind: pa.array([r[i] for r in rows], kind)
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), *(col(i, kind) for i, kind in enumerate(kinds))],
                                                 names=["key", "doc_id", "n", "d1", "d2", "keys", "tokens", "m", "e", "c0", "c1", "s0", "s1"])

    return docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "key long, doc_id long, n long, d1 long, d2 long, keys array<long>, tokens array<long>, m long, e long, c0 long, c1 long, s0 long, s1 long")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets, made from `texts` (v, text), pass the threshold. Texts travel, not sets: packed, they are a third as large."""
    def run(batches):
        for batch in batches:
            for part in parts(batch, "ta"):
                left, right = (hashed_texts(part.column(c).cast(pa.binary()).to_pylist()) for c in ("ta", "tb"))
                passed = []
                for x, y in zip(left, right):
                    x, y = shingles(x, k), shingles(y, k)
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int(np.count_nonzero(large[at] == small)) if len(small) else 0
                    passed.append(both * 100 >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))

    named = lambda c: texts.select(F.col("v").alias(c), F.col("text").alias("t" + c))
    return pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(v, root) after the links (a, b) between members have joined their components."""
    root_of = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias("r" + c))
    bridges = links.join(root_of("a"), "a").join(root_of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    tops = connected_components(roots.select(F.col("root").alias("v")).distinct(), stored(bridges, "bridges"))
    return roots.join(tops.select(F.col("v").alias("root"), F.col("root").alias("top")), "root").select("v", F.col("top").alias("root"))


def _may_link(pairs: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose samples, in the class of the smaller set, differ by no more than linked sets may."""
    t = percent / 100
    side = lambda c: kept.select(F.col("v").alias(c), *(F.col(x).alias(x + c) for x in ("n", "tokens", "c0", "c1", "s0", "s1")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    c = F.least("c1a", "c1b")
    size = lambda x: F.when(F.col("c1" + x) == c, F.col("s1" + x)).otherwise(F.col("s0" + x))
    sample = lambda x: F.slice("tokens" + x, F.lit(1), size(x).cast("int"))
    common = F.size(F.array_intersect(sample("a"), sample("b")))
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - 1e-9)
    return both.filter((size("a") - common <= F.col("na") - need) & (size("b") - common <= F.col("nb") - need)).select("a", "b")


def _least_common(n: Column, other: Column, t: float) -> Column:
    """The overlap that a set of size n needs with one of at least `other` elements."""
    return F.ceil(F.lit(t / (1 + t)) * (n + F.greatest(other, F.ceil(n * t - 1e-9))) - 1e-9)


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(key, doc_id, n_shingles, component_id), one row per row of `docs` (doc_id, text): see `_components`."""
    return _components(docs, k, percent).drop("top")


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, top), one row per row of `docs` (doc_id, text); `top` names the component itself.

    Texts are words of lower-cased runs of non-blanks; their sets the distinct k-word shingles, one for a text of fewer words,
    none without words. Two texts link when 100 * overlap >= percent * union; component_id is the smallest doc_id
    reachable. Every link between different sets counts, none is capped or missed; a null doc_id is no candidate
    for the smallest (a component without other ids has null), a text without words is a component of its own. Repeated rows share a component.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    t = percent / 100
    spark, paths = docs.sparkSession, {}

    def keep(df, name):
        with tables_written() as written:
            out = stored(df, name)
        paths.setdefault(name, []).extend(written)
        return out

    def done(*names):  # nothing reads these tables any more
        for name in names:
            drop_tables(spark, paths.pop(name))

    sketch = keep(_sketched(docs, k, percent), "sketch")
    seed = 0
    while True:  # one vertex per set; the seed moves on should two digests meet in 64 bits
        reps = stored(sketch.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"))
                      .withColumn("v", F.xxhash64("d1", "d2", "n", F.lit(seed))), "sets")
        if reps.groupBy("v").count().filter("count > 1").isEmpty():
            break
        seed += 1
    rows = sketch.filter("n > 0").withColumn("v", F.xxhash64("d1", "d2", "n", F.lit(seed)))
    # The coarsest group, all other texts: a set with more sampled tokens of its own than it may miss has no partner at all.
    most_missed = F.col("n") - F.ceil(F.col("n") * t - 1e-9)
    spread = rows.select("v", "m", F.posexplode(F.slice("tokens", F.lit(1), F.col("e").cast("int"))).alias("i", "token")).select(
        "token", "v", F.when(F.col("i") < F.col("m"), F.col("v")).alias("counts"))
    own = spread.groupBy("token").agg(F.min("v").alias("v"), F.max("v").alias("last"), F.max("counts").alias("counts")).filter("v = last and counts is not null")
    kept = reps.select("v", "key", "n").join(own.groupBy("v").agg(F.count("*").alias("own")), "v", "left")
    kept = keep(kept.filter(F.coalesce("own", F.lit(0)) <= most_missed).select("v", "key"), "keys")
    every = stored(sketch.select("key", "doc_id", "n", "d1", "d2"), "rows")
    done("sketch")
    # One pass over the documents; where the keys are few by the size of their files, Spark sends them to the texts.
    texts = stored(docs.select(row_key("doc_id", "text").alias("key"), "text").join(kept, "key").dropDuplicates(["v"]).select("v", "text"), "texts")
    done("keys")
    kept = stored(_sketched(texts.withColumnRenamed("v", "doc_id"), k, percent, _OVER).select(
        F.col("doc_id").alias("v"), "n", "keys", "tokens", "c0", "c1", "s0", "s1"), "kept")
    # Groups: each text with the leader it meets in most buckets of equal minima, when the two link.
    met = kept.select("v", F.explode("keys").alias("bucket"))
    leaders = met.groupBy("bucket").agg(F.min("v").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    most = met.join(leaders, "bucket").filter("v <> b").groupBy("v", "b").agg(F.count("*").alias("times"))
    pairs = most.groupBy(F.col("v").alias("a")).agg(F.max(F.struct("times", "b"))["b"].alias("b"))
    stars = stored(_linked(stored(_may_link(pairs, kept, percent), "stars"), texts, k, percent), "links")
    roots = stored(connected_components(kept.select("v"), stars), "roots")
    sized = lambda roots: roots.join(roots.groupBy("root").agg(F.count("*").alias("members")), "root")
    # Tokens by class (in the low bits): a pair is decided by the sample of its smaller set's class.
    classes = kept.select("v", "n", F.col("c1").alias("c"), F.col("s1").alias("s"), "tokens").unionByName(
        kept.filter("c0 <> c1").select("v", "n", F.col("c0").alias("c"), F.col("s0").alias("s"), "tokens"))
    entries = keep(classes.select("v", "c", F.explode(F.slice("tokens", F.lit(1), F.col("s").cast("int"))).alias("token")).select(
        F.col("token").bitwiseAND(F.lit(-8)).bitwiseOR(F.col("c")).alias("token"), "v", "c"), "entries")
    grouped = keep(classes.drop("tokens").join(sized(roots), "v").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / _BAND)), "groups")
    # Against all other groups: tokens that only the own group holds.
    held = entries.select("token", "v").join(roots, "v")
    tokens = keep(held.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1")).select(
        "token", "df", "r0", (F.col("r0") == F.col("r1")).alias("inside")), "tokens")
    single = tokens.filter("inside").groupBy(F.col("r0").alias("v"), F.col("token").bitwiseAND(F.lit(7)).alias("c")).agg(F.count("*").alias("private"))
    several = entries.join(grouped.filter("members > 1").select("v", "c"), ["v", "c"]).join(tokens.filter("inside").select("token"), "token")
    private = single.join(grouped.filter("members = 1").select("v", "c"), ["v", "c"], "left_semi").unionByName(
        several.groupBy("v", "c").agg(F.count("*").alias("private")))
    open_ = keep(grouped.join(private, ["v", "c"], "left").withColumn("private", F.coalesce("private", F.lit(0)))
                   .filter(F.col("private") <= most_missed), "open")
    # The matrix of what may decide: of each open text the rarest tokens, one more than it may miss; private ones come first.
    # Two linked sets share one of them, within as many as the sizes of the two let them miss.
    rare = entries.join(open_.select("v", "c"), ["v", "c"], "left_semi").join(tokens.filter("not inside").select("token", "df"), "token")
    nth = F.row_number().over(Window.partitionBy("v", "c").orderBy("df", "token")) - 1
    ranked = rare.withColumn("i", nth).join(open_, ["v", "c"]).withColumn("i", F.col("i") + F.col("private")).filter(F.col("i") <= most_missed)
    ranked = keep(ranked.select("token", "i", "v", "c", "s", "n", "root", "band", "members"), "prefixes")
    done("tokens", "open")
    # Where a rare token is held by many, a few leaders first: whoever links to one needs no other pair of that component.
    best = [F.min(F.struct(F.xxhash64("v", F.lit(i)).alias("h"), F.col("v").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))).alias(f"l{i}") for i in range(_LEADERS)]
    led = ranked.join(ranked.groupBy("token").agg(*best), "token").select("v", "n", "root", F.explode(F.array(*[f"l{i}" for i in range(_LEADERS)])).alias("l"))
    led = led.select(F.col("v").alias("a"), "n", "root", "l.b", "l.nb", "l.rb").filter(
        (F.col("root") != F.col("rb")) & (F.col("n") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("n") * percent)).select("a", "b").distinct()
    led = _may_link(stored(led, "led"), kept, percent)
    roots = stored(_joined(roots, stored(_linked(led, texts, k, percent), "links")), "roots")
    label = sized(roots)
    grouped = keep(grouped.drop("root", "members").join(label, "v"), "groups_again")
    ranked = keep(ranked.drop("root", "members").join(label, "v"), "prefixes_again")
    done("groups", "prefixes")
    matrix = keep(ranked.groupBy("token", "root", "band", "members").agg(F.min("i").alias("g_i"), F.min("n").alias("lo"), F.max("n").alias("hi")).select(
        F.col("token").alias("t"), F.col("root").alias("g"), F.col("band").alias("g_band"), F.col("members").alias("g_members"), "g_i", "lo", "hi"), "matrix")
    larger = (F.col("g_members") > F.col("members")) | ((F.col("g_members") == F.col("members")) & (F.col("g") > F.col("root")))
    need = _least_common(F.col("n"), F.col("lo"), t)
    fits = (F.col("n") * 100 >= F.col("lo") * percent) & (F.col("hi") * 100 >= F.col("n") * percent)
    asked = ranked.join(matrix, (F.col("token") == F.col("t")) & larger & fits & (F.col("i") <= F.col("n") - need) & (F.col("g_i") <= F.col("hi") - need))
    asked = keep(asked.select("v", "c", "s", "n", "g", "g_band").distinct(), "asked")
    done("prefixes_again", "matrix")
    # The overlap of a text's sample with the whole union of a group of several; a group of one is opened at once.
    inside = grouped.select("v", "n", "root", "band").distinct()
    many = inside.groupBy(F.col("root").alias("g"), F.col("band").alias("g_band")).agg(
        F.count("*").alias("inside"), F.min("n").alias("lo")).filter("inside > 1")
    doubtful = keep(asked.join(many, ["g", "g_band"]), "doubtful")
    union = (entries.join(grouped.select("v", "c", F.col("root").alias("g"), F.col("band").alias("g_band")), ["v", "c"])
             .join(doubtful.select("g", "g_band").distinct(), ["g", "g_band"], "left_semi").select("g", "g_band", "token").distinct())
    met = doubtful.join(entries, ["v", "c"]).join(union, ["g", "g_band", "token"]).groupBy("v", "c", "s", "n", "g", "g_band", "lo").agg(F.count("*").alias("both"))
    opened = asked.join(many, ["g", "g_band"], "left_anti").select("v", "n", "g", "g_band").unionByName(
        met.filter(F.col("s") - F.col("both") <= F.col("n") - need).select("v", "n", "g", "g_band"))
    members = inside.select(F.col("v").alias("b"), F.col("root").alias("g"), F.col("band").alias("g_band"), F.col("n").alias("nb"))
    asked = opened.withColumnRenamed("v", "a").join(members, ["g", "g_band"]).filter(
        (F.col("n") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("n") * percent)).select("a", "b")
    # Sets whose sample happens to be too small for the argument above (about one in 10^9) meet all others by their smallest hashes.
    short = (F.least("s0", "s1") <= most_missed) & (F.col("c0") + F.col("c1") > 0)
    prefix = lambda rows: rows.select("v", F.explode(F.slice("tokens", F.lit(1), (most_missed + 1).cast("int"))).alias("token"))
    missed = prefix(kept.filter(short)).select(F.col("v").alias("a"), "token").join(prefix(kept).withColumnRenamed("v", "b"), "token").filter("a <> b").select("a", "b")
    pairs = stored(asked.unionByName(missed).distinct(), "opened")
    done("entries", "groups_again", "asked", "doubtful")
    pairs = _may_link(pairs, kept, percent)
    final = stored(_joined(roots, stored(_linked(pairs, texts, k, percent), "links")), "tops").withColumnRenamed("root", "top")
    named = reps.select("v", "d1", "d2", "n", "low").join(final, "v", "left").withColumn("top", F.coalesce("top", "v"))
    lowest = stored(named.groupBy("top").agg(F.min("low").alias("component_id")), "lowest")
    classes = stored(named.join(lowest, "top").select("d1", "d2", "n", "component_id", "top"), "classes")
    out = every.join(classes, ["d1", "d2", "n"], "left")
    return out.select("key", "doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "top")


def keep_one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest doc_id of their component, of one without any id the least by hash; texts
    without words stay. Of rows equal in doc_id and text one stays; other columns are not compared."""
    found = _components(docs, k, percent)
    alone = (F.col("n_shingles") == 0)
    best = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = (found.filter(~alone & best).groupBy("top").agg(F.min("key").alias("key")).select("key")
             .unionByName(found.filter(alone).select("key")))
    key, second = free_name(docs, "key"), free_name(docs, "second")
    keyed = docs.withColumn(key, row_key("doc_id", "text")).withColumn(second, F.sha2(F.to_json(F.struct("doc_id", "text")), 256))
    return (keyed.join(first.select(F.col("key").alias(key)).distinct(), key, "left_semi")
            .dropDuplicates([key, second]).drop(key, second))
