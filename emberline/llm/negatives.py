"""Hard negatives: Hilbert-ordered blocks with zone maps; interval bounds choose the blocks that an anchor's windows must read."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from emberline.llm.common import stored
from emberline.llm.intvec import dots, packed, unpacked, usable_vectors

BLOCK, ASKED, TOGETHER, BITS = 1024, 1024, 16, 4  # rows of a block, anchors of a chunk, blocks of one task, bits a dimension on the curve
_NONE = -(1 << 62)  # stands for no score: all lie above it


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of cells (rows of numbers under 2^bits) on the Hilbert curve, as rows of bytes that sort like the positions."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(len(x)):
            far = (x[i] >> np.uint64(b)) & one == one
            swap = np.where(far, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(far, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    planes = [((x >> np.uint64(b)) & one).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def zone_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product each row of q can have with a vector inside each box, by interval arithmetic."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return dots(up, lo) + dots(down, hi), dots(up, hi) + dots(down, lo)


def _frame(cols: list[list[np.ndarray]], names: str) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(np.concatenate(c) if c else [], dtype="int64") for n, c in zip(names.split(), cols)})


def candidate_blocks(rows: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """One row per block of at most `block` rows of one label that follow each other on the Hilbert curve.

    block id, label, n, zone map (`lo`, `hi`: packed least and greatest value of every dimension), `ids`, `x` (packed), `fresh`
    (a byte per row: 0 where it repeats the row before). Bounds read only the zone maps' columns of the Parquet files. The order is
    total up to equal rows, so a label or a vector that holds a third of all rows fills many blocks.
    """
    span = rows.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi")).first()
    least, width = span.lo or 0, (span.hi or 0) - (span.lo or 0) + 1

    def keyed(batches):
        for b in batches:
            x = np.ascontiguousarray(b.column("x").flatten().to_numpy(zero_copy_only=False), dtype=np.int32).reshape(b.num_rows, dims)
            h = hilbert_keys((x.astype(np.int64) - least << BITS) // width, BITS)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in h], pa.binary()),
                                              pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "label", "h", "x"])

    def cut(batches):
        part, seq, held, before = TaskContext.get().partitionId() << 32, 0, [], None
        def flush():
            ids, x = np.array([r[0] for r in held], dtype=np.int64), unpacked([r[2] for r in held], dims)
            return pa.RecordBatch.from_arrays(
                [pa.array([part + seq]), pa.array([held[0][1]]), pa.array([len(held)]), pa.array([packed(x.min(axis=0))], pa.binary()),
                 pa.array([packed(x.max(axis=0))], pa.binary()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
                 pa.array([bytes(r[3] for r in held)], pa.binary())], names=["block", "label", "n", "lo", "hi", "ids", "x", "fresh"])
        for b in batches:
            for row in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), b.column("x").to_pylist()):
                if held and (len(held) == block or held[0][1] != row[1]):
                    yield flush()
                    seq, held = seq + 1, []
                held.append((*row, row != before))
                before = row
        if held:
            yield flush()

    order = ["label", "h", "vec_id", "x"]
    along = rows.select("vec_id", F.col("label").cast("long").alias("label"), "x").mapInArrow(keyed, "vec_id long, label long, h binary, x binary").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(along.mapInArrow(cut, "block long, label long, n long, lo binary, hi binary, ids binary, x binary, fresh binary"), "blocks")


def anchor_chunks(blocks: DataFrame, dims: int, positives: int, every: int, asked: int = ASKED) -> DataFrame:
    """Anchors in curve order, `asked` to a chunk: (chunk, ids, labels, x, floors), packed. A floor is the score of the last wanted
    positive among the rows of the anchor's own block: no lower one can be among the first `positives`."""
    def gather(batches):
        part, seq, held = TaskContext.get().partitionId() << 32, 0, []
        def flush(some):
            ids, labels, floors = (np.array([r[j] for r in some], dtype=np.int64).tobytes() for j in (0, 1, 3))
            return pa.RecordBatch.from_arrays([pa.array([part + seq])] + [pa.array([v], pa.binary()) for v in (ids, labels, b"".join(r[2] for r in some), floors)],
                                              names=["chunk", "ids", "labels", "x", "floors"])
        for b in batches:
            for row in b.to_pylist():
                ids, x = np.frombuffer(row["ids"], dtype=np.int64), unpacked([row["x"]], dims)
                at = np.flatnonzero((ids % every == 0) & (np.frombuffer(row["fresh"], dtype=np.uint8) == 1))
                for i, s in zip(at, dots(x[at], x)):
                    s = s[ids != ids[i]]
                    floor = np.partition(s, len(s) - positives)[len(s) - positives] if len(s) >= positives else _NONE
                    held.append((ids[i], row["label"], x[i].tobytes(), floor))
                while len(held) >= asked:
                    yield flush(held[:asked])
                    seq, held = seq + 1, held[asked:]
        if held:
            yield flush(held)
    read = blocks.select("label", "ids", "x", "fresh")
    return stored(read.mapInArrow(gather, "chunk long, ids binary, labels binary, x binary, floors binary"), "anchors")


def _read(chunks: DataFrame, blocks: DataFrame, dims: int, choose, work, schema: str, together: int) -> DataFrame:
    """Anchors against the blocks that bounds do not exclude.

    choose(chunk, labels, lo, hi)  which anchors (rows) must read which block (columns), from the blocks' labels and the bounds of all scores
    work(chunk, anchors, ids, scores)  columns of the result for those anchors of a chunk with the rows of one block

    Zone maps of `together` blocks meet a chunk first. Only the blocks that an anchor of the chunk must read are fetched, each with the
    list of those anchors; a task holds one chunk and at most about `together` blocks.
    """
    n_blocks, n_chunks = max(1, -(-blocks.count() // together)), max(1, chunks.count())
    some = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = chunks.withColumn("cg", some(n_chunks, "chunk")).withColumn("bg", all_of(n_blocks)).groupBy("cg", "bg")
    zones = blocks.select("block", "label", "lo", "hi", some(n_blocks, "block").alias("bg")).withColumn("cg", all_of(n_chunks))

    def bounded(a, b):
        out = []
        if len(a) and len(b):
            low, high, labels = unpacked(a["lo"], dims), unpacked(a["hi"], dims), a["label"].to_numpy()
            for chunk in b.to_dict("records"):
                must = choose(chunk, labels, *zone_bounds(unpacked([chunk["x"]], dims), low, high))
                for j in np.flatnonzero(must.any(axis=0)):
                    out.append((chunk["cg"], chunk["bg"], chunk["chunk"], a["block"].iat[j], np.packbits(must[:, j]).tobytes()))
        return pd.DataFrame(out, columns=["cg", "bg", "chunk", "block", "anchors"])

    needed = zones.groupBy("cg", "bg").cogroup(asked).applyInPandas(bounded, "cg int, bg int, chunk long, block long, anchors binary")
    fetched = needed.join(blocks.select("block", "ids", "x"), "block")

    def read(a, b):
        out = []
        chunks_here = {c["chunk"]: c for c in b.to_dict("records")}
        for row in a.to_dict("records"):
            chunk = chunks_here[row["chunk"]]
            q, own = unpacked([chunk["x"]], dims), np.frombuffer(chunk["ids"], dtype=np.int64)
            at = np.flatnonzero(np.unpackbits(np.frombuffer(row["anchors"], dtype=np.uint8))[:len(own)])
            ids, x = np.frombuffer(row["ids"], dtype=np.int64), unpacked([row["x"]], dims)
            by_id = np.argsort(ids, kind="stable")  # later sorts by score are stable, so ties go to the smaller id
            ids, x = ids[by_id], x[by_id]
            s = dots(q[at], x)
            s[own[at][:, None] == ids[None, :]] = _NONE
            out.append([np.full(len(v[0]), row["chunk"]) if j < 0 else v[j] for v in [work(chunk, at, ids, s)] for j in range(-1, len(v))])
        names = " ".join(f.split()[0] for f in schema.split(", "))
        return _frame([list(c) for c in zip(*out)], names)

    return fetched.groupBy("cg", "bg").cogroup(asked).applyInPandas(read, schema)


def _descending(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of every row's scores from the largest on, equal ones in order, and the scores so ordered."""
    order = np.argsort(-s, axis=1, kind="stable")
    return order, np.take_along_axis(s, order, axis=1)


def _first(ranked, ids: np.ndarray, at: np.ndarray, k: int, top=None, bottom=None):
    """(anchor, id, score): per row the k first scores not above `top` and not below `bottom`."""
    order, t = ranked
    start = (t > top[:, None]).sum(axis=1) if top is not None else np.zeros(len(t), np.int64)
    out = []
    for j in range(k):
        r = np.flatnonzero(start + j < t.shape[1])
        v = t[r, start[r] + j]
        ok = v > _NONE if bottom is None else (v > _NONE) & (v >= bottom[r])
        out.append((at[r[ok]], ids[order[r[ok], start[r[ok]] + j]], v[ok]))
    return [np.concatenate(c) for c in zip(*out)]


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, scale: int = 256, every: int = 50,
                   block: int = BLOCK, asked: int = ASKED, together: int = TOGETHER) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and positive.

    vectors  vec_id, embedding, label. Scores are inner products of components floor(scale * component). Anchors are the rows whose
    vec_id is divisible by `every`; an anchor's positives are its first `positives` other rows of the same label, and the negatives of a
    positive the first `negatives` rows of another label whose score lies from half to 95 hundredths of the positive's.

    Rows lie in blocks of one label along a Hilbert curve, each with the least and greatest value of every dimension. Interval
    arithmetic bounds an anchor's scores with a whole block: for positives it reads blocks of its label that may reach the
    floor its own block sets, for negatives blocks of other labels whose bounds meet a window. Bounds only exclude; what is read is scored
    exactly. In many dimensions without structure they exclude little, and the work is then every anchor with every block.

    No part take rows with a null vec_id or label and the vectors `usable_vectors` names. Rows of an anchor's own vec_id are neither its
    positives nor its negatives; of other repeated vec_ids each row is a candidate. Equal rows ask once; rows that share a
    vec_id but not label or vector ask each. A positive of negative score has no window. Empty tables give no rows; other columns are not read.
    """
    rows, dims = usable_vectors(vectors, scale, ("label",))
    blocks = candidate_blocks(rows, dims, block)
    chunks = anchor_chunks(blocks, dims, positives, every, asked)

    def same(chunk, labels, low, high):
        own, floors = (np.frombuffer(chunk[c], dtype=np.int64)[:, None] for c in ("labels", "floors"))
        return (own == labels[None, :]) & (high >= floors)

    near = _read(chunks, blocks, dims, same, lambda chunk, at, ids, s: _first(_descending(s), ids, at, positives), "chunk long, i long, vec_id long, score long", together)
    liked = stored(_best(near, ["chunk", "i"], positives).select("chunk", "i", F.col("rank").cast("long").alias("p"), "vec_id", "score"), "positives")

    def windows(g):
        tops = np.full((asked, positives), _NONE, dtype=np.int64)
        tops[g["i"].to_numpy(), g["p"].to_numpy() - 1] = g["score"].to_numpy()
        return pd.DataFrame({"chunk": [g["chunk"].iat[0]], "tops": [tops.tobytes()]})

    asking = stored(chunks.join(liked.groupBy("chunk").applyInPandas(windows, "chunk long, tops binary"), "chunk"), "windows")

    def edges(chunk):
        """Least and greatest score of every window; where there is no positive, no score fits."""
        tops = np.frombuffer(chunk["tops"], dtype=np.int64).reshape(-1, positives)[:len(chunk["ids"]) // 8]
        none = tops == _NONE
        tops = np.where(none, 0, tops)
        return np.where(none, 1, -(-tops // 2)), np.where(none, 0, tops - -(-tops // 20))

    def other(chunk, labels, low, high):
        bottom, top = edges(chunk)
        meets = np.zeros(low.shape, dtype=bool)
        for p in range(positives):
            meets |= (high >= bottom[:, p:p + 1]) & (low <= top[:, p:p + 1]) & (bottom[:, p:p + 1] <= top[:, p:p + 1])
        return meets & (np.frombuffer(chunk["labels"], dtype=np.int64)[:, None] != labels[None, :])

    def negative(chunk, at, ids, s):
        bottom, top = edges(chunk)
        ranked = _descending(s)
        found = [_first(ranked, ids, at, negatives, top[at, p], bottom[at, p]) for p in range(positives)]
        ranks = np.concatenate([np.full(len(f[0]), p + 1) for p, f in enumerate(found)])
        i, ids_, score = (np.concatenate([f[j] for f in found]) for j in range(3))
        return i, ranks, ids_, score

    far = _read(asking, blocks, dims, other, negative, "chunk long, i long, p long, vec_id long, score long", together)
    hard = _best(far, ["chunk", "i", "p"], negatives).select("chunk", "i", "p", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chunks.select("chunk", "ids").mapInPandas(
        lambda it: (pd.DataFrame({"chunk": np.full(len(v) // 8, c), "i": np.arange(len(v) // 8), "anchor_id": np.frombuffer(v, dtype=np.int64)})
                    for b in it for c, v in zip(b["chunk"], b["ids"])), "chunk long, i long, anchor_id long")
    return (hard.join(liked.select("chunk", "i", "p", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["chunk", "i", "p"])
            .join(named, ["chunk", "i"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
