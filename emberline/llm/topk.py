"""Exact top-k search by histogram selection: score everything, narrow down where each k-th value lies, then filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from emberline.llm.common import stored
from emberline.llm.intvec import dots, unpacked, usable_vectors

ROWS, ASKED, BINS = 4096, 1024, 4096  # vectors and queries in one block, bins of one histogram
SLAB = 64  # queries whose scores against a block are held at once


def _scores(a: pd.DataFrame, b: pd.DataFrame, dims: int):
    """(position in b, scores against all of a but the rows of the query's own vec_id, their ids) for every query of b."""
    x, q = unpacked(a["x"], dims), unpacked(b["x"], dims)
    ids, own = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
    for at in range(0, len(q), SLAB):
        for i, s in enumerate(dots(q[at:at + SLAB], x), at):
            other = ids != own[i]
            yield (i, s, ids) if other.all() else (i, s[other], ids[other])


def count_block(a: pd.DataFrame, b: pd.DataFrame, dims: int, most: int) -> pd.DataFrame:
    """(q, bin, n): the histogram of a block inside each query's bracket.

    Bins below the bin of the block's own candidate for the wanted value are left out: the value over
    all blocks cannot lie lower, so at most that many bins are sent per query, whatever the bracket.
    """
    out = []
    if len(a) and len(b):
        lo, width, need = (b[c].to_numpy() for c in ("lo", "width", "need"))
        step = -(-width // most)
        for i, s, _ in _scores(a, b, dims):
            s = s[(s >= lo[i]) & (s - lo[i] < width[i])]
            bins = (s - lo[i]) // step[i]
            if len(bins) > need[i]:
                bins = bins[bins >= np.partition(bins, len(bins) - need[i])[len(bins) - need[i]]]
            values, counts = np.unique(bins, return_counts=True)
            out.append((np.full(len(values), b["q"].iat[i]), values, counts))
    cols = [np.concatenate([o[j] for o in out]) if out else [] for j in range(3)]
    return pd.DataFrame({n: pd.Series(c, dtype="int64") for n, c in zip(("q", "bin", "n"), cols)})


def pick_block(a: pd.DataFrame, b: pd.DataFrame, dims: int, k: int) -> pd.DataFrame:
    """(q, vec_id, score): of a block's scores not below the floor the k first; what comes behind k others of its own block cannot be wanted."""
    out = []
    if len(a) and len(b):
        lo = b["lo"].to_numpy()
        for i, s, ids in _scores(a, b, dims):
            near = np.flatnonzero(s >= lo[i])
            near = near[np.lexsort((ids[near], -s[near]))[:k]]
            out.append((np.full(len(near), b["q"].iat[i]), ids[near], s[near]))
    cols = [np.concatenate([o[j] for o in out]) if out else [] for j in range(3)]
    return pd.DataFrame({n: pd.Series(c, dtype="int64") for n, c in zip(("q", "vec_id", "score"), cols)})


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, scale: int = 1024, every: int = 100,
          rows: int = ROWS, asked: int = ASKED, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query, ties to the smaller vec_id.

    vectors  vec_id, embedding (array of numbers); `queries` alike, by default the vectors whose vec_id is divisible by `every`

    Every row is scored against every query in blocks of rows x queries. A pass sums the blocks' histograms per query, finds the
    bin that holds the k-th largest score and takes that bin as the next bracket, until the scores from its lower end on are at
    most 2k or the bin is a single score; each pass divides the bracket by `bins`, so a few passes end whatever the data. The last pass
    scores once more, keeps what reaches the floor and breaks ties by vec_id, at most k rows a block. Nothing but histograms
    and those rows is shuffled after the vectors; no task grows with the tables.

    Rows of a query's own vec_id are not its candidates; of other repeated vec_ids each row is one. Equal query rows ask once;
    a vec_id with several vectors asks with each of them, with a ranking for each. Vectors that take no part: see
    `usable_vectors`. Fewer than k candidates are all returned; empty tables give no rows; other columns are not read.
    """
    x, dims = usable_vectors(vectors, scale)
    row = lambda d: d.select("vec_id", F.col("x").alias("v"))
    index = stored(_bytes(row(x), dims), "vectors")
    if queries is None:
        ask = index.filter(F.col("vec_id") % every == 0)
    else:
        other, other_dims = usable_vectors(queries, scale)
        ask = _bytes(row(other), other_dims) if other_dims == dims else index.limit(0)
    ask = stored(ask.distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    total = index.agg(F.count("*").alias("n"), F.max("norm").alias("norm")).first()
    n_asked = ask.count()
    n_rows, n_cols = max(1, -(-total.n // rows)), max(1, -(-n_asked // asked))
    left = (index.select("vec_id", "x", F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_rows)).cast("int").alias("rb"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1)))))

    def against(brackets: DataFrame, fn, schema: str) -> DataFrame:
        right = (ask.select("q", "vec_id", "x").join(brackets, "q")
                 .withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_cols)).cast("int"))
                 .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))))
        return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(fn, schema)

    reach = F.ceil(F.sqrt(F.col("norm").cast("double") * F.lit(float(total.norm or 0))) * (1 + 1e-9)) + 1  # no score lies further out
    live = ask.select("q", (-reach).alias("lo"), (2 * reach + 1).alias("width"), F.lit(k).cast("long").alias("need"))
    step = F.expr(f"(width + {bins - 1}) div {bins}")
    floors = []
    while True:
        seen = against(live, lambda a, b: count_block(a, b, dims, bins), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        ahead = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        place = (seen.withColumn("upto", ahead).join(live.select("q", "need"), "q").filter(F.col("upto") >= F.col("need"))
                 .groupBy("q").agg(F.max(F.struct("bin", "n", "upto")).alias("m")))
        # without a k-th value, all candidates are wanted: the bracket's lower end stays the floor
        now = stored(live.join(place, "q", "left").select(
            "q", (F.col("lo") + F.coalesce("m.bin", F.lit(0)) * step).alias("lo"),
            F.least(step, F.col("width") - F.coalesce("m.bin", F.lit(0)) * step).alias("width"),
            (F.col("need") - F.coalesce(F.col("m.upto") - F.col("m.n"), F.lit(0))).alias("need"),
            (F.col("m").isNull() | (step == 1) | (k - F.col("need") + F.col("m.upto") <= 2 * k)).alias("done")), "brackets")
        floors.append(now.filter("done").select("q", "lo"))
        live = now.filter("not done").select("q", "lo", "width", "need")
        if live.isEmpty():
            break
    floor = floors[0]
    for f in floors[1:]:
        floor = floor.unionByName(f)
    found = against(floor, lambda a, b: pick_block(a, b, dims, k), "q long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(ask.select("q", F.col("vec_id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")


def _bytes(df: DataFrame, dims: int) -> DataFrame:
    """(vec_id, x binary, norm long): packed vectors with their squared length."""
    import pyarrow as pa

    def pack(batches):
        for b in batches:
            v = np.ascontiguousarray(b.column("v").flatten().to_numpy(zero_copy_only=False), dtype=np.int32).reshape(b.num_rows, dims)
            norm = (v.astype(np.int64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in v], pa.binary()), pa.array(norm)], names=["vec_id", "x", "norm"])
    return df.mapInArrow(pack, "vec_id long, x binary, norm long")
