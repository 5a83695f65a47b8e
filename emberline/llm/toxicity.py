"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from emberline.llm.common import PLAIN, held_out, hashed_texts, mix, parts, shingles, stored

EXAMPLES = 2048   # labelled rows learnt from, the first by hash of their id: the documented bound of the sample
NEIGHBOURS = 15
BLOCK = 64        # examples whose postings share one maximum
CHI2, MOST = 25.0, 5.0  # a term's chi-square with the label raises its weight by a logarithm from CHI2 on, MOST times at most
FIRST = 6         # blocks opened at once to learn what the k-th best is at least
SLOTS = 1 << 20   # document frequencies are counted by slot of a word's hash, known word or not
TERMS = 4096      # distinct words of the documents searched in one step (a longer document is a step of its own)
_KEYS = 8


# ---- learning

def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start to before its end, one after the other, and how many each gives."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), size


def sample(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic, text): labelled documents outside the held-out fold, at most `examples` of them."""
    picked = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))
    first = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    named = first.join(F.broadcast(picked), "doc_id")  # `examples` ids at most
    return named.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of several texts of one id the least


def terms_of(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms, tf, keys): hashes of the distinct words, their counts, and shingle minima that near copies share."""
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                out = []
                for words in hashed_texts(part.column("text").cast(pa.binary()).to_pylist(), PLAIN):
                    t, n = np.unique(words, return_counts=True)
                    s = shingles(words, 3)
                    keys = [int(mix(s ^ np.uint64(0x51ED270B9A4F + i)).min().astype(np.int64)) for i in range(_KEYS)] if len(s) else []
                    out.append((t.astype(np.int64), n, keys))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("toxic").cast(pa.int32()), pa.array([o[0] for o in out], pa.list_(pa.int64())),
                     pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.int64()))],
                    names=["doc_id", "toxic", "terms", "tf", "keys"])

    return rows.mapInArrow(run, "doc_id long, toxic int, terms array<long>, tf array<long>, keys array<long>")


def _apart(rows) -> list[int]:
    """One id of each cluster of near copies (two pairs of neighbouring minima in common): copies must not vote twice."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for r in rows:
        for i in range(0, len(r["keys"]), 2):
            root[find(("doc", r["doc_id"]))] = find((i, r["keys"][i], r["keys"][i + 1]))
    kept = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        kept.setdefault((find(("doc", r["doc_id"])), r["toxic"]), r["doc_id"])
    return list(kept.values())


class Index:
    """Unit vectors of the examples as postings per term, in blocks of BLOCK examples with the largest weight of each.

    Flat arrays: the entries of term t are head[t] to head[t + 1], each with a block, its largest weight and its postings; the
    postings of entry x are tail[x] to tail[x + 1].
    """

    def __init__(self, terms, idf, ids, labels, example, where, weight):
        self.terms, self.idf, self.ids, self.labels = terms, idf, ids, labels
        self.n, self.total, self.counts = len(ids), 0, np.zeros(SLOTS, np.float32)
        order = np.argsort(where, kind="stable")  # examples rise within a term
        where, self.weight, self.example = where[order].astype(np.int64), weight[order], example[order].astype(np.int32)
        self.blocks = max((self.n + BLOCK - 1) // BLOCK, 1)
        key = where * self.blocks + self.example // BLOCK
        begin = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
        self.block = (self.example[begin] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.tail = np.append(begin, len(key))
        self.head = np.searchsorted(where[begin], np.arange(len(terms) + 1))
        self.curve, self.empty = ([0.0, 1.0], [0.0, 1.0]), 0.0

    def nearest(self, doc, where, weight, n: int, k: int = NEIGHBOURS, without=None):
        """Per document the k examples of largest positive cosine, exactly: (numbers, cosines), a row each, nearest first, ties to the smaller number, -1 for none.

        doc, where, weight: the known terms of documents 0 to n - 1 with their weights in the unit vector; `without`: an example per document that
        is left out. The FIRST blocks of largest bound are opened, then those whose sum of maxima may still reach the k-th best.
        """
        entry, size = _ranges(self.head[where], self.head[where + 1])
        mine, key = np.repeat(weight, size), np.repeat(doc, size) * self.blocks + self.block[entry]
        bound = np.bincount(key, mine * self.most[entry], minlength=n * self.blocks).reshape(n, self.blocks)
        width = self.blocks * BLOCK
        score, shut, least = np.zeros((n, width)), bound > 0, np.full((n, 1), -1.0)
        for most in (FIRST, self.blocks):
            now = shut & (bound >= least - 1e-9)
            if most < self.blocks:
                now &= bound >= np.partition(bound, self.blocks - most, axis=1)[:, self.blocks - most:self.blocks - most + 1]
            if not now.any():
                continue
            shut &= ~now
            some = now.ravel()[key]
            post, size = _ranges(self.tail[entry[some]], self.tail[entry[some] + 1])
            at = np.repeat(key[some] // self.blocks * width, size) + self.example[post]
            score += np.bincount(at, np.repeat(mine[some], size) * self.weight[post], minlength=n * width).reshape(n, width)
            if without is not None:
                score[np.arange(n), without] = 0
            if width > k:
                least = np.maximum(np.partition(score, width - k, axis=1)[:, width - k:width - k + 1], 1e-300)
        k = min(k, width)
        numbers, cosines = np.full((n, k), -1), np.zeros((n, k))
        kth = np.partition(score, width - k, axis=1)[:, width - k:width - k + 1]
        row, col = np.nonzero((score >= kth) & (score > 0))
        order = np.lexsort((col, -score[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, place = row[place < k], col[place < k], place[place < k]
        numbers[row, place], cosines[row, place] = col, score[row, col]
        return numbers, cosines

    def votes(self, numbers, cosines):
        """Per document the share of the toxic among its neighbours, each weighted by the inverse of its distance; NaN without neighbours."""
        w = np.where(numbers >= 0, 1 / (1.05 - np.minimum(cosines, 1.0)), 0)
        total = w.sum(axis=1)
        return np.divide((w * self.labels[numbers]).sum(axis=1), total, out=np.full(len(w), np.nan), where=total > 0) if self.n else np.full(len(w), np.nan)

    def search(self, words: "Words", k: int = NEIGHBOURS, without=None):
        """(numbers, cosines) of all documents of `words`, in steps of about TERMS distinct words."""
        doc, term, weight = words.known(self)
        ends = np.searchsorted(doc, np.arange(words.n + 1))
        parts_, at = [], 0
        while at < words.n:
            upto = max(int(np.searchsorted(ends, ends[at] + TERMS, side="right")) - 1, at + 1)
            s = slice(ends[at], ends[upto])
            parts_.append(self.nearest(doc[s] - at, term[s], weight[s], upto - at, k, None if without is None else without[at:upto]))
            at = upto
        return tuple(np.concatenate(c) for c in zip(*parts_)) if parts_ else (np.zeros((0, k), int), np.zeros((0, k)))


def inverse_frequency(counts: np.ndarray, total: int, hashes: np.ndarray) -> np.ndarray:
    return np.log((1 + total) / (1 + counts[(hashes % np.uint64(SLOTS)).astype(np.int64)])) + 1


class Words:
    """Distinct words of some documents with their counts: document, hash, count, document by document."""

    def __init__(self, n: int, doc: np.ndarray, hashes: np.ndarray, tf: np.ndarray):
        self.n, self.doc, self.hashes, self.tf = n, doc, hashes, tf

    @classmethod
    def of(cls, texts) -> "Words":
        found = [np.unique(w, return_counts=True) for w in hashed_texts(texts, PLAIN)]
        one = lambda j, kind: np.concatenate([f[j] for f in found]) if found else np.zeros(0, kind)
        return cls(len(found), np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), one(0, np.uint64), one(1, np.int64))

    def known(self, index: "Index"):
        """(document, term, weight) of the words of the index, in unit vectors over all words of the documents, unknown ones included."""
        if not len(self.hashes) or not len(index.terms):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        at = np.minimum(np.searchsorted(index.terms, self.hashes), len(index.terms) - 1)
        hit = index.terms[at] == self.hashes
        w = (1 + np.log(self.tf)) * np.where(hit, index.idf[at], inverse_frequency(index.counts, index.total, self.hashes))
        norm = np.sqrt(np.bincount(self.doc, w * w, minlength=self.n))
        return self.doc[hit], at[hit], w[hit] / norm[self.doc[hit]]


def calibrate(votes: np.ndarray, labels: np.ndarray, prior: float):
    """Monotone curve from vote to probability: pooled adjacent violators, each pool drawn a little to `prior`."""
    pools: list[list[float]] = []
    for v, y in sorted(zip(votes, labels)):
        pools.append([y, 1.0, v, v])
        while len(pools) > 1 and (pools[-2][2] == pools[-1][2] or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            a, b = pools[-2:]
            pools[-2:] = [[a[0] + b[0], a[1] + b[1], a[2], b[3]]]
    xs, ys = [], []
    for y, n, lo, hi in pools:
        p = (y + prior) / (n + 1)
        xs += [lo, hi + 1e-9]
        ys += [p, p]
    return (xs, np.maximum.accumulate(ys).tolist()) if xs else ([0.0, 1.0], [prior, prior])


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """The index of the examples over all their terms, calibrated on each example without itself.

    A term weighs its IDF, from frequencies over all documents (by slot of its hash), times 1 to MOST by a logarithm of its chi-square with
    the label; none is left out. A word no example holds weighs its IDF; it finds nothing, but counts in the length of a document. The driver
    holds the distinct words of `examples` texts in flat arrays; neighbours of the examples are searched on the workers.
    """
    spark = docs.sparkSession
    rows = stored(terms_of(sample(docs, labels, examples)), "examples")
    apart = _apart(rows.select("doc_id", "toxic", "keys").collect())  # `examples` rows at most
    kept = rows.join(F.broadcast(spark.createDataFrame([(x,) for x in apart], "doc_id long")), "doc_id")
    data = kept.filter(F.size("terms") > 0).select("doc_id", "toxic", "terms", "tf").orderBy("doc_id").toArrow()  # `examples` rows at most
    empty = kept.filter(F.size("terms") == 0).agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    ys = data.column("toxic").to_numpy().astype(float)
    n, share = len(ys) + empty.n, (float(ys.sum()) + empty.toxic) / max(len(ys) + empty.n, 1)
    sizes = pc.list_value_length(data.column("terms")).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(ys), dtype=np.int32), sizes)
    tf = pc.list_flatten(data.column("tf")).to_numpy().astype(np.int32)
    vocabulary, place = np.unique(pc.list_flatten(data.column("terms")).to_numpy().view(np.uint64), return_inverse=True)
    df, dp = np.bincount(place, minlength=len(vocabulary)), np.bincount(place, ys[doc], minlength=len(vocabulary))
    chi2 = (dp - df * share) ** 2 / (df * share * (1 - share) * (1 - df / max(n, 1)) + 1e-9)
    total, counts = document_counts(docs)
    idf = inverse_frequency(counts, total, vocabulary) * np.minimum(1 + np.log1p(np.maximum(chi2 / CHI2 - 1, 0)), MOST)
    w = (1 + np.log(tf)) * idf[place]
    unit = w / np.sqrt(np.bincount(doc, w * w, minlength=len(ys)))[doc]
    index = Index(vocabulary, idf, data.column("doc_id").to_pylist(), ys, doc, place, unit)
    index.total, index.counts = total, counts
    votes = _votes_without_self(spark, index, rows)
    index.curve = calibrate(np.where(np.isnan(votes), share, votes), ys, share)
    index.empty = (empty.toxic + share) / (empty.n + 1)
    return index


def _votes_without_self(spark, index: Index, rows: DataFrame) -> np.ndarray:
    """The vote on every example by the others, searched on the workers; a number per example comes back."""
    shared, number = spark.sparkContext.broadcast(index), {d: i for i, d in enumerate(index.ids)}

    def run(batches):
        index, number = shared.value, {d: i for i, d in enumerate(shared.value.ids)}
        for batch in batches:
            here = [(number[d], np.array(t, dtype=np.int64).view(np.uint64), c) for d, t, c in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "terms", "tf"))) if d in number]
            words = Words(len(here), np.repeat(np.arange(len(here)), [len(h[1]) for h in here]), np.concatenate([h[1] for h in here] or [np.zeros(0, np.uint64)]),
                          np.concatenate([h[2] for h in here] or [np.zeros(0, np.int64)]))
            own = np.array([h[0] for h in here], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(index.votes(*index.search(words, without=own)))], names=["example", "vote"])

    found = rows.select("doc_id", "terms", "tf").repartition(16, "doc_id").mapInArrow(run, "example long, vote double").toArrow()
    votes = np.full(len(number), np.nan)
    votes[found.column("example").to_numpy()] = found.column("vote").to_numpy()
    return votes


def document_counts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and per slot how often its words' documents counted them, over all of `docs`."""
    def run(batches):
        total, seen = 0, np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in parts(batch):
                words = Words.of(part.column("text").cast(pa.binary()).to_pylist())
                seen += np.bincount((words.hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
                total += part.num_rows
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([total, *seen[some]], pa.int64())], names=["slot", "n"])

    counted = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    slot, n = counted.column("slot").to_numpy(), counted.column("n").to_numpy()
    seen = np.zeros(SLOTS, np.float32)
    seen[slot[slot >= 0]] = n[slot >= 0]
    return int(n[slot < 0].sum()), seen


# ---- scoring

def score_texts(docs: DataFrame, index: Index, keep: list[str] | None = None) -> DataFrame:
    """`docs` with tox_score (0 to 1), tox_label (1 from 0.5 on) and evidence: all examples that voted (doc_id, toxic, cosine), nearest first.

    Only `text` is read. A null or empty text, like one without a word of any example, has the score of examples without one.
    Ties go to the smaller doc_id; repeated rows score alike; columns of these names are replaced.
    """
    docs = docs.drop("tox_score", "tox_label", "evidence")
    kept = [c for c in docs.columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(index)  # the terms of EXAMPLES examples at most
    frame = docs.select(*kept, *([] if "text" in kept else ["text"]))
    one = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])

    def run(batches):
        index, ids = shared.value, np.array(shared.value.ids, dtype=np.int64)
        for batch in batches:
            for part in parts(batch):
                numbers, cosines = index.search(Words.of(part.column("text").cast(pa.binary()).to_pylist()))
                votes, there = index.votes(numbers, cosines), numbers >= 0
                score = np.where(np.isnan(votes), index.empty, np.interp(np.nan_to_num(votes), *index.curve))
                ends, who = np.concatenate([[0], np.cumsum(there.sum(axis=1))]), numbers[there]
                told = pa.StructArray.from_arrays([pa.array(ids[who]), pa.array(index.labels[who].astype(np.int32)), pa.array(cosines[there])], fields=list(one))
                new = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, names=[*kept, "tox_score", "tox_label", "evidence"])

    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
    return frame.mapInArrow(run, T.StructType([frame.schema[c] for c in kept] + [
        T.StructField("tox_score", T.DoubleType()), T.StructField("tox_label", T.IntegerType()), T.StructField("evidence", evidence)]))
