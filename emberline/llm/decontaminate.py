"""Benchmark decontamination: a broadcast set of normalised test n-grams, looked up in every window of the texts."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from emberline.llm.common import PLAIN, parts, stored

N = 10
BLOCK = 400_000  # windows in one broadcast set; a larger benchmark is scanned in several blocks of items
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))]


class TestSet:
    """The windows of a block of test items: ids of words, hashes of windows by length, the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.words: dict[bytes, int] = {}
        windows: dict[tuple, set] = {}
        for item, words in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in words]
            for i in range(max(len(ids) - n, 0) + 1 if ids else 0):
                windows.setdefault(tuple(ids[i:i + n]), set()).add(item)
        self.by_length = {}
        for size in {len(w) for w in windows}:
            rows = [w for w in windows if len(w) == size]
            ids, seed = np.array(rows, dtype=np.int64), 1
            while True:  # a seed under which all windows have hashes of their own
                factors = np.random.default_rng(seed).integers(1, 1 << 62, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                hashes = self.hash(ids.T, factors)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            order = np.argsort(hashes)
            self.by_length[size] = (factors, hashes[order], ids[order], [sorted(windows[rows[i]]) for i in order])

    @staticmethod
    def hash(columns, factors):
        total = np.zeros(len(columns[0]), np.uint64)
        for c, f in zip(columns, factors):
            total += (c.astype(np.uint64) + np.uint64(1)) * f
        return total

    def find(self, texts: list[bytes | None]):
        """Per text: its number of words, the merged spans of hit words (start, end), the items found."""
        ids: list[int] = []
        first = []
        for t in texts:
            first.append(len(ids))
            ids.extend(map(self.words.get, (t or b"").translate(PLAIN).split(), repeat(-1)))
            ids.append(-1)  # no window runs over the end of a text
        ids, first = np.array(ids, dtype=np.int64), np.array([*first, len(ids)])
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        edge, items = np.zeros(len(ids) + 1, np.int64), {}
        for size, (factors, hashes, rows, names) in self.by_length.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            seen = [ids[at + j] for j in range(size)]
            h = self.hash(seen, factors)
            where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[where] == h
            for j in range(size):  # the hash only nominates; the words decide
                hit &= rows[where, j] == seen[j]
            at, where = at[hit], where[hit]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            for doc, w in zip(np.searchsorted(first, at, "right") - 1, where):
                items.setdefault(int(doc), set()).update(names[w])
        covered = np.concatenate((np.cumsum(edge)[:-1] > 0, [False]))
        change = np.flatnonzero(np.diff(np.concatenate(([False], covered)).astype(np.int8)))
        spans: dict[int, list] = {}
        for a, b in zip(change[::2], change[1::2]):
            d = int(np.searchsorted(first, a, "right") - 1)
            spans.setdefault(d, []).append([int(a - first[d]), int(b - first[d])])
        return [(int(first[i + 1] - first[i] - 1), spans.get(i, []), sorted(items.get(i, ()))) for i in range(len(texts))]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, n: int, block: int):
    """The items in blocks of at most about `block` windows; each block alone comes to the driver."""
    items = (benchmark.filter(F.col("text").isNotNull())
             .select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")))
    bound = F.greatest(F.octet_length("text") / 2 + 1, F.lit(1))  # a window starts at a word, a word takes two bytes with its blank
    total = items.agg(F.sum(bound)).first()[0] or 0
    count = max(1, int(-(-total // block)))
    for b in range(count):
        mine = items.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == b)
        yield TestSet([(r.item, bytes(r.text).translate(PLAIN).split()) for r in mine.toLocalIterator()], n)


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, block: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """`docs` with n_words, n_hit, spans (start and end in words) and items (ids of the test items found, sorted).

    docs        any columns with `text`; columns named like the four new ones are replaced
    benchmark   item_id, text; an item of fewer than n words is one window, a null or blank one is none
    keep        the columns of `docs` to return, all by default

    Null and empty texts have no words and no hits. Repeated rows are kept and judged alike, equal items of
    different ids are all named, items with a null id are one item named '', an empty benchmark hits nothing. Words are compared, not hashes alone.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "spans", "items")
    keep = [c for c in docs.columns if keep is None or c in keep]
    frame = docs
    for number, tests in enumerate(_blocks(benchmark, n, block)):
        frame = _scan(stored(frame, "leaks") if number else docs, spark.sparkContext.broadcast(tests), docs.columns, number == 0)
    return frame.select(*keep, "n_words", "n_hit", "spans", "items")


def _scan(frame: DataFrame, shared, kept: list[str], first: bool) -> DataFrame:
    def scan(batches):
        tests = shared.value
        for batch in batches:
            for part in parts(batch):
                found = tests.find(part.column("text").cast(pa.binary()).to_pylist())
                if not first:  # what earlier blocks of items have found
                    found = [(n, _merged(s + [list(x) for x in old]), sorted({*i, *olds})) for (n, s, i), old, olds in zip(
                        found, part.column("spans").to_pylist(), part.column("items").to_pylist())]
                new = [pa.array([f[0] for f in found], pa.int64()),
                       pa.array([sum(b - a for a, b in f[1]) for f in found], pa.int64()),
                       pa.array([f[1] for f in found], pa.list_(pa.list_(pa.int32()))),
                       pa.array([f[2] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, names=[*kept, *(f.name for f in _FOUND)])

    return frame.mapInArrow(scan, T.StructType([frame.schema[c] for c in kept] + _FOUND))


def _without(text, spans):
    if text is None or not len(spans):
        return text
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(PLAIN))]
    for a, b in reversed([list(x) for x in spans]):
        raw = raw[:at[a][0]] + b"\n" + raw[at[b - 1][1]:]
    return raw.decode()


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([_without(t, s) for t, s in zip(text, spans)], dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = N, block: int = BLOCK) -> DataFrame:
    """`docs` without the test passages, with the same columns.

    mode="documents" removes every document with a hit word; mode="spans" cuts the hit words out of the text,
    leaving a line break, and keeps the document. Documents without a hit are returned as they are.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    found = find_leaks(docs, benchmark, n, block)
    if mode == "documents":
        return found.filter(F.col("n_hit") == 0).select(*docs.columns)
    cut = F.when(F.size("spans") > 0, _cut("text", "spans")).otherwise(F.col("text"))
    return found.withColumn("text", cut).select(*docs.columns)
