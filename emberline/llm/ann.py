"""Approximate nearest neighbours: randomly rotated one-bit codes, inner products estimated from packed bits, error bounds that choose what is reranked."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberline.llm.common import stored

ROWS, ASKED = 16384, 1024  # vectors and queries in one block
CODE_BITS, QUERY_BITS, SIGMAS = 256, 6, 3.5


def rotation(dims: int, bits: int, seed: int = 7) -> np.ndarray:
    """The first `dims` columns of a random orthogonal matrix: rotates a vector padded with zeros to `bits` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :dims]


def encode(x: np.ndarray, turn: np.ndarray):
    """Packed signs, length and the correction scalar of every vector: the inner product of its direction with its code."""
    norm = np.sqrt((x * x).sum(axis=1))
    r = (x / norm[:, None]) @ turn.T
    code = np.packbits(r > 0, axis=1, bitorder="little")
    return code, norm, np.abs(r).sum(axis=1) / math.sqrt(turn.shape[0])


def estimates(q: np.ndarray, codes: np.ndarray, ones: np.ndarray, own: np.ndarray, norm: np.ndarray):
    """Estimated inner products of a rotated query (its direction) with coded vectors, per unit of query length, and their error bounds."""
    bits = len(q)
    lo, step = q.min(), max((q.max() - q.min()) / ((1 << QUERY_BITS) - 1), 1e-300)
    u = np.rint((q - lo) / step).astype(np.uint64)
    total = np.zeros(len(codes))
    for b in range(QUERY_BITS):
        plane = np.packbits(((u >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
        total += np.bitwise_count(codes & plane).sum(axis=1) * float(1 << b)
    dot = (2 * (lo * ones + step * total) - (lo * bits + step * float(u.sum()))) / math.sqrt(bits)
    error = SIGMAS * np.sqrt(np.maximum(1 - own * own, 0) / (bits - 1)) + SIGMAS * step / math.sqrt(12)
    return norm * dot / own, norm * error / own


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with b in double precision, summed in order of dimension."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[j]
    return total


def search_block(rows: dict, asked_ids: np.ndarray, asked: np.ndarray, turn: np.ndarray, k: int):
    """The k best of a block per query: (query, vector, score). What is reranked: every vector whose upper bound reaches the k-th best seen."""
    ids, x = rows["ids"], rows["x"]
    out = []
    unit = asked / np.sqrt((asked * asked).sum(axis=1))[:, None]
    length = np.sqrt((asked * asked).sum(axis=1))
    for qid, q, r, n in zip(asked_ids, asked, unit @ turn.T, length):
        est, err = estimates(r, rows["codes"], rows["ones"], rows["own"], rows["norm"])
        est, err = est * n, err * n
        est[ids == qid] = -np.inf
        first = np.argpartition(-est, k)[:k] if len(est) > k else np.arange(len(est))
        first = first[np.isfinite(est[first])]
        floor = exact(x[first], q).min() if len(first) == k else -np.inf
        near = np.flatnonzero((est + err >= floor) & (ids != qid))
        near = np.union1d(near, first)
        score = exact(x[near], q)
        best = np.lexsort((ids[near], -score))[:k]
        out.append((np.full(len(best), qid), ids[near][best], score[best]))
    return out


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, rows: int = ROWS, asked: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product found for every query, ties to the smaller vec_id.

    vectors  vec_id, embedding (array of numbers); `queries` alike, by default the vectors whose vec_id is divisible by 20

    Every vector is coded and every code is compared, in blocks of rows x queries, so no task grows with the tables; the
    work does, with their product. A true neighbour is missed only when its estimate errs by more than SIGMAS standard errors.
    No part take vectors null, zero or holding null or non-finite components, of a length other than the most common
    (the larger of equals), or without vec_id. A query is not its own neighbour; of repeated vec_ids each row is a candidate. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    good = lambda d: d.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter(
        ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0))
    usable = good(vectors).withColumn("dims", F.size("e"))
    common = usable.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims, count = (common["dims"], common["count"]) if common else (1, 0)
    bits = max(CODE_BITS, -(-dims // 64) * 64)
    turn = spark.sparkContext.broadcast(rotation(dims, bits))
    of_dims = lambda d: d.filter(F.size("e") == dims).select("vec_id", "e")

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            c, norm, own = encode(x, turn.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in c], pa.binary()), pa.array(norm), pa.array(own), pa.array([r.tobytes() for r in x], pa.binary())],
                names=["vec_id", "code", "norm", "own", "x"])

    index = stored(of_dims(usable).mapInArrow(code, "vec_id long, code binary, norm double, own double, x binary"), "codes")
    wanted = of_dims(good(queries)) if queries is not None else of_dims(usable).filter(F.col("vec_id") % 20 == 0)
    n_asked = wanted.count()
    n_rows, n_cols = max(1, -(-count // rows)), max(1, -(-n_asked // asked))
    left = (index.withColumn("rb", F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_rows)).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1)))))
    right = (wanted.withColumn("qb", F.pmod(F.xxhash64("vec_id", "e"), F.lit(n_cols)).cast("int"))
             .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))))

    def search(a, b):
        out = []
        if len(a) and len(b):
            c = np.frombuffer(b"".join(a["code"]), dtype=np.uint64).reshape(len(a), -1)
            block = {"ids": a["vec_id"].to_numpy(), "x": np.frombuffer(b"".join(a["x"])).reshape(len(a), dims), "codes": c,
                     "ones": np.bitwise_count(c).sum(axis=1).astype(float), "own": a["own"].to_numpy(), "norm": a["norm"].to_numpy()}
            out = search_block(block, b["vec_id"].to_numpy(), np.stack(b["e"].to_numpy()), turn.value, k)
        cols = [np.concatenate([o[i] for o in out]) if out else [] for i in range(3)]
        return pd.DataFrame({"query_id": pd.Series(cols[0], dtype="int64"), "vec_id": pd.Series(cols[1], dtype="int64"), "score": pd.Series(cols[2], dtype="float64")})

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
