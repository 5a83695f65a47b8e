"""Passage dedup: windows of words found by winnowed anchors, the later of equal windows deleted, wherever lines begin."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from emberline.llm.common import drop_tables, free_name, mix, parts, row_key, stored, tables_written, CHUNK, LOWER
from emberline.llm.linededup import WORDS, fingerprints, line_starts

GRAM = 8  # words of an anchor
_U = np.uint64
_STEP = [_U((0xD6E8FEB86659FD93 * (2 * j + 1)) % (1 << 64) | 1) for j in range(64)]
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        p = np.full(max(n, 1 << 10), 0x9E3779B97F4A7C15, dtype=np.uint64)
        p[0] = 1
        _POWERS[0] = np.multiply.accumulate(p)
    return _POWERS[0]


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every word in bytes of LOWER: runs of anything but ASCII white space.

    Characters from U+3000 to U+9FFF (kana, Chinese characters, their punctuation) are words of their own, as no blanks part them.
    """
    inside = a != 32
    wide = (a >= 0xE3) & (a <= 0xE9)
    begins = inside & ~np.concatenate(([False], inside[:-1]))
    stops = ~inside & np.concatenate(([False], inside[:-1]))
    if wide.any():
        after = np.zeros(len(a), bool)
        after[3:] = wide[:-3]
        begins |= wide | (after & inside)
        stops |= begins & np.concatenate(([False], inside[:-1]))
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    if len(end) < len(start):
        end = np.append(end, len(a))
    return start, end


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word, A-Z in lower case."""
    a = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
    start, end = word_bounds(a)
    hashes, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):  # about CHUNK bytes at a time; a longer word is a step of its own
        j = max(int(np.searchsorted(start, start[i] + CHUNK)), i + 1)
        size = (end - start)[i:j]
        first = np.cumsum(size) - size
        inner = np.arange(int(size.sum())) - np.repeat(first, size)
        byte = a[np.repeat(start[i:j], size) + inner].astype(np.uint64) + _U(1)
        hashes[i:j] = mix(np.add.reduceat(byte * _powers(int(size.max()))[inner], first) + size.astype(np.uint64))
        i = j
    return start, hashes


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    n, total = len(h) - size + 1, np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for j in range(size):
        total += h[j:j + n] * _STEP[j]
    return mix(total)


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of every `width` values in a row stands, the first of equals."""
    at, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(v[right] < v[left], right, left)
        have += step
    return at


def anchors(h: np.ndarray, doc: np.ndarray, size: int = WORDS):
    """(anchor hash, hash of its windows, first window, last window) for the words `h` of the documents `doc`.

    The anchor of a window of `size` words is its smallest gram of GRAM words, so equal windows have equal anchors. Windows in a row with
    one anchor are one row; as they overlap, the first and the last say all their words.
    """
    n = len(h) - size + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    gram, window = _grams(h, min(GRAM, size)), _grams(h, size)
    s = np.flatnonzero(doc[:n] == doc[size - 1:])
    at = _least(gram, size - min(GRAM, size) + 1)[s]
    new = np.flatnonzero(np.concatenate((np.ones(min(len(s), 1), bool), (at[1:] != at[:-1]))))
    lo, hi = s[new], s[np.append(new[1:], len(s)) - 1] if len(s) else s
    return gram[at[new]], mix(window[lo] * _STEP[1] + window[hi] * _STEP[2] + (hi - lo).astype(np.uint64)), lo, hi


def _words(part: pa.RecordBatch):
    """(hashes of the words of all texts, the text of each, the first word of each text)."""
    texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
    start, h = word_hashes(b" ".join(texts))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return h, doc, np.searchsorted(doc, np.arange(len(texts)))


PLACE = "key long, d long, hash long, ctx long, lo long, hi long"


def _rows(part, doc, *cols):
    key, d = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("key", "d"))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.uint64, copy=False).view(np.int64), pa.int64()) for c in (key, d, *cols)],
                                      names=["key", "d", "hash", "ctx", "lo", "hi"])


LINES = [c + side for c in ("h_", "n_") for side in ("left", "right")]  # hash and words of the line on either side


def line_places(docs: DataFrame) -> DataFrame:
    """(key, d, hash, pos, at, n, LINES): the winnowed lines of every text (`linededup.fingerprints`), each with its number, its first word,
    how many words it has, and the whole hashes of the lines around it; 0 where there is none."""
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                cols: list[list] = [[] for _ in range(6 + len(LINES))]
                for key, d, text in zip(*(part.column(c).to_pylist() for c in ("key", "d")), part.column("text").cast(pa.binary()).to_pylist()):
                    h, _, picked = fingerprints(text)
                    if not len(picked):
                        continue
                    start, _ = word_bounds(np.frombuffer(text.translate(LOWER), dtype=np.uint8))
                    at = np.append(np.searchsorted(start, line_starts(text)), len(start))
                    pad = lambda v: np.concatenate([np.zeros(1, np.int64), v, np.zeros(1, np.int64)])
                    hashes, n = pad(h.view(np.int64)), pad(np.diff(at))
                    around = [v[picked + 1 + step] for v in (hashes, n) for step in (-1, 1)]
                    for c, v in zip(cols, (np.full(len(picked), key), np.full(len(picked), d), h[picked].view(np.int64), picked, at[picked], n[picked + 1], *around)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols],
                                                 names=["key", "d", "hash", "pos", "at", "n", *LINES])

    return docs.select("key", "d", "text").mapInArrow(run, ", ".join(f"{c} long" for c in ("key", "d", "hash", "pos", "at", "n", *LINES)))


def line_matches(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(key, known): the words (from, to) of each text that lines match at one earlier place, `size` words and more in a row.

    Of the places of a selected line the earliest stands for all (by d, key, line); every other place is joined with it and extended by the
    line on either side, where equal. Selected lines stand at most three lines apart, so the matches of a longer run join up. A match is one
    stretch there as here, and inside one text the two do not overlap.
    """
    picked = stored(line_places(docs), "lines")
    again = stored(picked.groupBy("hash").count().filter("count > 1").select("hash"), "line_again")
    picked = stored(picked.join(again, "hash"), "line_places")
    first = picked.groupBy("hash").agg(F.min(F.struct("d", "key", "pos", "at", *LINES)).alias("o"))
    same = lambda side: (F.col("h_" + side) != 0) & (F.col("h_" + side) == F.col("o.h_" + side))
    words = lambda side: F.when(same(side), F.col("n_" + side)).otherwise(0)
    later = (F.col("key") != F.col("o.key")) | (F.col("at") - F.col("o.at") >= F.lit(size) + words("left") + F.col("n") + words("right"))
    matches = picked.join(first, "hash").filter(later).select(
        "key", (F.col("at") - words("left")).alias("a"), (F.col("at") + F.col("n") + words("right")).alias("b")).filter(F.col("b") - F.col("a") >= size)
    return matches.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("known"))  # of one text at most its lines


def _inside(part: pa.RecordBatch, base: np.ndarray, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the words from lo to end of a slice lie in one known match; matches of a text before end where it begins."""
    lists = part.column("known")
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if not n.sum():
        return np.zeros(len(lo), bool)
    flat, begin = lists.flatten(), np.repeat(base, n)
    a, b = (flat.field(c).to_numpy(zero_copy_only=False) + begin for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    reach, i = np.maximum.accumulate(b[order]), np.searchsorted(a[order], lo, side="right") - 1
    return (i >= 0) & (reach[np.maximum(i, 0)] >= end)


def anchor_places(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """PLACE rows (`_combined`) of all texts: an anchor, its windows' hash, and the numbers of their first words; none of rows inside a match of `known`, if given."""
    names = ["key", "d", "text", *(["known"] if "known" in docs.columns else [])]

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                h, doc, base = _words(part)
                gram, ctx, lo, hi = anchors(h, doc, size)
                if len(names) > 3:
                    gram, ctx, lo, hi = (v[~found] for found in [_inside(part, base, lo, hi + size)] for v in (gram, ctx, lo, hi))
                of = doc[lo]
                yield _combined(_rows(part, of, gram, ctx, lo - base[of], hi - base[of]), size)

    return docs.select(*names).mapInArrow(run, PLACE)


def window_places(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """PLACE rows (`_combined`) of single windows, those named by `ranges` (a, b) of each text."""
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                h, doc, base = _words(part)
                window = _grams(h, size)
                ranges = part.column("ranges")
                n = pc.list_value_length(ranges).to_numpy(zero_copy_only=False)
                flat = ranges.flatten()
                lo, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                of = np.repeat(np.arange(len(n)), n)
                many = end - lo
                s = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                of = np.repeat(of, many)
                yield _combined(_rows(part, of, window[s + base[of]], np.zeros(len(s), np.int64), s, s), size)

    return docs.select("key", "d", "text", "ranges").mapInArrow(run, PLACE)


SETTLED = "key long, a long, b long, several boolean"


def _combined(part: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """PLACE rows of a slice, of each class (hash, ctx) only the earliest; the words of the others come as rows with a negative `hi`, ready to go.

    They have an earlier equal place in the slice, so they go wherever the earliest of all stands. If that is in the same text, it is in the slice.
    """
    key, d, gram, ctx, lo, hi = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "d", "hash", "ctx", "lo", "hi"))
    if not len(key):
        return part
    text = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # few: the earlier of two places by (d, key) goes by the rank of their texts
    rank = np.empty(len(text), np.int64)
    rank[np.lexsort((key[text], d[text]))] = np.arange(len(text))
    order = np.lexsort((lo, np.repeat(rank, np.diff(np.append(text, len(key)))), ctx, gram))
    key, d, gram, ctx, lo, hi = (c[order] for c in (key, d, gram, ctx, lo, hi))
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])))
    gone, a, b = _gone(new, key, lo, hi, size)
    columns = [np.concatenate((x[new], y)) for x, y in zip((key, d, gram, ctx, lo, hi), (key[gone], d[gone], key[gone], ctx[gone], a, -b))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=part.schema.names)


def _gone(new: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int):
    """(rows, a, b): of sorted places, of which `new` begins a class, those that are not the earliest, and their words from a to b.

    In one text the words of the earliest place itself stay.
    """
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    own = key == key[first]
    gone = np.flatnonzero(~new & ~(own & (lo == lo[first])))
    return gone, np.where(own, np.maximum(lo, lo[first] + size), lo)[gone], hi[gone] + size


def settled(places: DataFrame, size: int, crowded: list[int] = ()) -> DataFrame:
    """SETTLED rows of PLACE rows: the words (a, b) of every place but the earliest of its class (hash, ctx), and, `several`, the windows (a, b) of
    the earliest of each class of a hash that has several classes.

    One shuffle; a task reads its rows in order and holds one place besides the batch. The classes of a hash in `crowded` count as several and
    are dealt one by one, so that no task has all places of such a hash.
    """
    many = np.sort(np.asarray(crowded, np.int64))

    def run(batches):
        last, shown = None, False  # the earliest place of the class the batch before ended in
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "ctx", "key", "lo", "hi")]
            known = rows[4] < 0
            yield _out(rows[2][known], rows[3][known], -rows[4][known], False)
            rows = [c[~known] for c in rows]
            if last is not None:
                rows = [np.concatenate(([x], c)) for x, c in zip(last, rows)]
            gram, ctx, key, lo, hi = rows
            if not len(gram):
                continue
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])))
            gone, a, b = _gone(new, key, lo, hi, size)
            yield _out(key[gone], a, b, False)
            at = np.flatnonzero(new)
            same = gram[at[1:]] == gram[at[:-1]]
            mixed = np.concatenate(([False], same)) | np.concatenate((same, [False])) | np.isin(gram[at], many)
            mixed[0] &= not (last is not None and shown)
            shown = bool(mixed[-1]) or (len(at) == 1 and last is not None and shown)
            last = [c[at[-1]] for c in rows]
            at = at[mixed]
            yield _out(key[at], lo[at], hi[at] + 1, True)

    apart = F.xxhash64("hash", "ctx")
    by = F.when(F.col("hash").isin(list(map(int, crowded))), apart).otherwise(F.col("hash")) if len(crowded) else F.col("hash")
    return places.repartition(by).sortWithinPartitions("hash", "ctx", "d", "key", "lo").mapInArrow(run, SETTLED)


def _out(key, a, b, several: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (key, a, b)), pa.array(np.full(len(key), several))], names=["key", "a", "b", "several"])


def joined_up(rows: DataFrame, name: str) -> DataFrame:
    """(key, `name`): per text the stretches (a, b) of `rows` (key, a, b), those that meet joined, as an array of structs."""
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    def lists(key, a, b):
        text = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
        values = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], fields=list(pair))
        at = pa.array(np.append(text, len(key)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(key[text], pa.int64()), pa.ListArray.from_arrays(at, values)], names=["key", name])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3  # the stretches of the text the batch before ended in
        for batch in batches:
            key, a, b = (np.concatenate((h, batch.column(c).to_numpy(zero_copy_only=False))) for h, c in zip(held, ("key", "a", "b")))
            if not len(key):
                continue
            text = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
            wide = int(b.max()) + 1
            reach = np.maximum.accumulate(b + text * wide) - text * wide
            new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (a[1:] > reach[:-1]))))
            key, a, b = key[new], a[new], reach[np.append(new[1:], len(key)) - 1]
            end = int(np.searchsorted(key, key[-1]))
            held = [c[end:] for c in (key, a, b)]
            yield lists(key[:end], a[:end], b[:end])
        if len(held[0]):
            yield lists(*held)

    return rows.repartition("key").sortWithinPartitions("key", "a").mapInArrow(run, f"key long, {name} array<struct<a:long,b:long>>")


SAMPLED, CROWDED = 64, 1000  # of one text in SAMPLED, a hash found CROWDED times and more is dealt class by class


def crowded_anchors(docs: DataFrame, size: int) -> list[int]:
    """Hashes with very many places, at most 10 000. Which they are is found on a share of the texts; it decides how rows are dealt, never a result."""
    some = docs.filter(F.pmod("key", F.lit(SAMPLED)) == 0)
    often = anchor_places(some, size).groupBy("hash").count().filter(F.col("count") >= CROWDED)
    return [r.hash for r in often.orderBy(F.desc("count"), "hash").limit(10_000).collect()]


def repeated_words(docs: DataFrame, size: int = WORDS, lines: bool = False) -> DataFrame:
    """(key, spans): the words (from, to) of each text that lie in a window of `size` words standing at an earlier place too.

    Earliest is by doc_id (null last), then row key, then position. Places with one anchor and the same windows are a class: all but its
    earliest go as they are. Only the earliest of each class of an anchor that has several are compared window by window: a window's
    earliest place is that of some class.

    With `lines`, matches of whole lines come first (`line_matches`), and windows are sought only outside of them. A window's earliest place is
    in no match, as every match stands at an earlier place too, so what is found is the same.
    """
    docs = docs.select(row_key("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("long").alias("d"), "text")
    if lines:
        with tables_written() as used:
            known = stored(line_matches(docs, size), "line_spans")
            used.pop()
        drop_tables(docs.sparkSession, used)
        docs = stored(docs.join(known, "key", "left"), "texts")
    found = stored(settled(anchor_places(docs, size), size, crowded_anchors(docs, size)), "anchors")
    mixed = stored(joined_up(found.filter("several"), "ranges"), "mixed")  # of one text at most its words
    again = stored(settled(window_places(docs.join(mixed, "key"), size), size), "windows")
    spans = found.filter("not several").select("key", "a", "b").unionByName(again.select("key", "a", "b"))
    if lines:
        spans = spans.unionByName(known.select("key", F.inline("known")))
    return joined_up(spans, "spans")  # of one text at most its words


def cut(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(text without the words of `spans`, rows of (from, to), lines gone as a whole, words gone).

    The white space behind a run goes with it, or that before it if only the one behind has a line break.
    """
    start, end = word_bounds(np.frombuffer(text.translate(LOWER), dtype=np.uint8))
    line = np.append(np.searchsorted(start, line_starts(text)), len(start))
    spans = spans[spans[:, 0] < spans[:, 1]]
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate((np.ones(min(len(spans), 1), bool), spans[1:, 0] > reach[:-1])))
    runs = zip(spans[first, 0].tolist(), reach[np.append(first[1:], len(spans))[: len(first)] - 1].tolist())
    out, at, lines, words = [], 0, 0, 0
    for a, b in runs:
        before, behind = int(end[a - 1]) if a else 0, int(start[b]) if b < len(start) else len(text)
        x, y = int(start[a]) if a else 0, behind
        if a and b"\n" in text[end[b - 1]:behind] and b"\n" not in text[before:x]:
            x, y = before, int(end[b - 1])
        out.append(text[at:x])
        at, words = y, words + b - a
        lines += max(int(np.searchsorted(line, b, side="right")) - 1 - int(np.searchsorted(line, a)), 0)
    return b"".join([*out, text[at:]]), lines, words


def dedup_passages(docs: DataFrame, size: int = WORDS, lines: bool = False) -> DataFrame:
    """`docs` with `text` less every word of a passage of `size` words or more that stands at an earlier place, and n_lines, n_removed (lines
    gone as a whole), words_removed.

    A passage may begin and end anywhere. What remains is unchanged, byte by byte. Null and empty texts stay; rows equal in doc_id and text
    are one document and treated alike; no row is removed. Columns of the new names are replaced. `lines` finds line matches first.
    """
    docs = docs.drop("n_lines", "n_removed", "words_removed")
    kept = docs.columns
    key, cuts = free_name(docs, "key"), free_name(docs, "spans")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    met = keyed.join(stored(repeated_words(docs.select("doc_id", "text"), size, lines), "spans").select(F.col("key").alias(key), F.col("spans").alias(cuts)), key, "left")

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                done = []
                lists = part.column(cuts)
                upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                spans = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], axis=1)
                for text, at, to in zip(part.column("text").cast(pa.binary()).to_pylist(), [0, *upto[:-1].tolist()], upto.tolist()):
                    n = len(line_starts(text or b""))
                    done.append((n, *(cut(text, spans[at:to]) if at < to and text else (text, 0, 0))))
                text = pa.array([x[1] for x in done], pa.binary()).cast(pa.string())
                new = [pa.array([x[i] for x in done], pa.int64()) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([text if c == "text" else part.column(c) for c in kept] + new,
                                                 names=[*kept, "n_lines", "n_removed", "words_removed"])

    return met.select(*kept, cuts).mapInArrow(run, T.StructType(
        [docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "words_removed")]))
