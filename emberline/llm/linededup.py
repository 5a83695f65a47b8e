"""Line dedup: winnowed fingerprints over line hashes, positions joined, matches extended, later repeated runs deleted."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from emberline.llm.common import parts, row_key, stored

WINDOW, WORDS, SHORT = 3, 20, 4
_CUT = re.compile(rb"(?<=[.!?])(?= )|(?<=\n)")


def line_starts(text: bytes) -> list[int]:
    """Where the lines of a text begin. A line ends after a line break, and after . ! or ? before a blank; blank ones belong to the line before."""
    if b"\0" in text:
        pieces = _CUT.split(text)
    else:
        for mark in (b".", b"!", b"?"):
            text = text.replace(mark + b" ", mark + b"\0 ")
        pieces = text.replace(b"\n", b"\n\0").split(b"\0")
    starts, at = [], 0
    for p in pieces:
        if p and not p.isspace():
            starts.append(at)
        at += len(p)
    if starts:
        starts[0] = 0
    return starts


def fingerprints(text: bytes | None, window: int = WINDOW, words: int = WORDS):
    """(hash and words of every line, numbers of the selected lines).

    Of any `window` lines in a row the one of smallest rank is selected, the first of equals; lines under SHORT words rank
    last. So texts that share a run of `window` lines select the same line of it. Lines of `words` words are always selected.
    """
    text = text or b""
    starts = line_starts(text)
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    lines = [text[a:b].lower().split() for a, b in zip(starts, [*starts[1:], len(text)])]
    h = np.array([xxhash.xxh3_64_intdigest(b" ".join(x)) for x in lines], dtype=np.uint64) | np.uint64(1 << 32 | 1)
    n = np.array([len(x) for x in lines], dtype=np.int32)
    rank = (h >> np.uint64(1)) + (n < SHORT).astype(np.uint64) * np.uint64(1 << 63)
    if len(h) > window:
        picked = np.lib.stride_tricks.sliding_window_view(rank, window).argmin(axis=1) + np.arange(len(h) - window + 1)
    else:
        picked = rank.argmin(keepdims=True)
    return h, n, np.unique(np.concatenate((picked, np.flatnonzero(n >= words))))


def _context(h: np.ndarray, picked: np.ndarray, step: int) -> np.ndarray:
    """32 bits each of the next two lines on one side, the nearer in the low half; 0 where there is none."""
    near, far = picked + step, picked + 2 * step
    get = lambda at: np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)] & np.uint64(0xFFFFFFFF), np.uint64(0))
    return (get(near) | get(far) << np.uint64(32)).astype(np.uint64).view(np.int64)


def picked_lines(docs: DataFrame) -> DataFrame:
    """(key, d, hash, pos, left, right): the selected lines of every text with what stands around them."""
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                cols = [[], [], [], [], [], []]
                for key, d, text in zip(*(part.column(c).to_pylist() for c in ("key", "d")), part.column("text").cast(pa.binary()).to_pylist()):
                    h, _, p = fingerprints(text)
                    if len(p):
                        for c, v in zip(cols, (np.full(len(p), key), np.full(len(p), d), h[p].view(np.int64), p, _context(h, p, -1), _context(h, p, 1))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols],
                                                 names=["key", "d", "hash", "pos", "left", "right"])

    return (docs.select(row_key("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "text")
            .mapInArrow(run, "key long, d long, hash long, pos long, left long, right long"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(key, lines): numbers of the lines covered by a match with an earlier place, per text.

    The earliest place of a selected line (by doc_id, null last, then row key, then line) stands for all; every other place
    matches there, together with up to two equal lines on either side. Where a line of a run first stands in another context, the
    match covers that line alone; `passages.dedup_passages` compares every window with the earliest place of the same window.
    """
    picked = stored(picked_lines(docs), "lines")
    again = stored(picked.groupBy("hash").agg(F.count("*").alias("n"), F.min("d").alias("first")).filter("n > 1").drop("n"), "again")
    places = stored(picked.join(again, "hash").distinct(), "places")
    origin = stored(places.filter(F.col("d") == F.col("first")).groupBy("hash").agg(F.min(F.struct("key", "pos", "left", "right")).alias("o"))
                    .select("hash", *[F.col(f"o.{c}").alias(f"o_{c}") for c in ("key", "pos", "left", "right")]), "origins")
    low, high = (lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    same = lambda half, side: (half(F.col(side)) != 0) & (half(F.col(side)) == half(F.col("o_" + side)))
    reach = lambda side: F.when(same(low, side), F.when(same(high, side), 2).otherwise(1)).otherwise(0)
    met = places.join(origin, "hash").filter((F.col("key") != F.col("o_key")) | (F.col("pos") != F.col("o_pos")))
    covered = met.select("key", F.explode(F.sequence(F.col("pos") - reach("left"), F.col("pos") + reach("right"))).alias("line"))
    return covered.groupBy("key").agg(F.collect_set("line").alias("lines"))  # of one text at most its lines


def _deleted(text: bytes, covered: list[int], words: int) -> tuple[bytes, int, int]:
    starts = [*line_starts(text), len(text)]
    covered, out, n, w, at = sorted(covered), [], 0, 0, 0
    i = 0
    while i < len(covered):
        j = i
        while j + 1 < len(covered) and covered[j + 1] == covered[j] + 1:
            j += 1
        a, b = starts[covered[i]], starts[covered[j] + 1]
        size = len(text[a:b].split())
        if size >= words:
            out.append(text[at:a])
            at, n, w = b, n + j - i + 1, w + size
        i = j + 1
    return b"".join([*out, text[at:]]), n, w


def dedup_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`docs` with `text` less its later repeated runs, and n_lines, n_removed, words_removed.

    A run is a stretch of covered lines (see `repeated_lines`) with at least `words` words in all; what remains is unchanged, byte by byte.
    Each selected line is compared with its earliest place only, so a run may stay whose lines first stand elsewhere in other
    contexts; the query and the pipeline use `passages.dedup_passages`, which finds them. Null and empty texts stay; rows equal in doc_id and text are one
    document and treated alike; no row is removed. Columns of the new names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "words_removed")
    kept = docs.columns
    keyed = docs.withColumn("_key", row_key("doc_id", "text"))
    met = keyed.join(stored(repeated_lines(docs), "covered").withColumnRenamed("key", "_key").withColumnRenamed("lines", "_lines"), "_key", "left")

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                done = []
                for text, covered in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("_lines").to_pylist()):
                    n = len(line_starts(text or b""))
                    done.append((n, *(_deleted(text, covered, words) if covered and text else (text, 0, 0))))
                text = pa.array([x[1] for x in done], pa.binary()).cast(pa.string())
                new = [pa.array([x[i] for x in done], pa.int64()) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([text if c == "text" else part.column(c) for c in kept] + new,
                                                 names=[*kept, "n_lines", "n_removed", "words_removed"])

    return met.select(*kept, "_lines").mapInArrow(run, T.StructType(
        [docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "words_removed")]))
