"""What the operators share: tables written to the shared folder, folds, words and their hashes."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.session import shared_folder

CHUNK = 1 << 20  # bytes of text that one vectorised step takes at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again: short lineage, survives lost executors.

    Nothing reads the shuffles of the write once the table is there, so their files go with it instead of with a later garbage collection.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    for scope in _SCOPES:
        scope.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_SCOPES: list[list[str]] = []


@contextmanager
def tables_written():
    """The paths of the tables that `stored` writes inside the block, for `drop_tables` once nothing reads them any more."""
    _SCOPES.append(paths := [])
    try:
        yield paths
    finally:
        _SCOPES.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables through the file system that holds them; a missing one is no error."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    paths.clear()


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learnt from (a null id is learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def row_key(*cols: str) -> Column:
    """A key of what a row says: equal rows share it; where a null stands counts."""
    return F.xxhash64(*cols, *[F.col(c).isNull() for c in cols])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Words: runs of anything but ASCII white space, A-Z in lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
# Words: runs of ASCII digits, letters and anything beyond ASCII, A-Z in lower case.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def spark_words(text: Column) -> Column:
    """The words of LOWER as a Spark array; null and empty texts have none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def parts(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK):
    """Slices of a batch of about `most` bytes of text; a longer row is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(size) > start:
        yield batch.slice(start)


# ---- 64-bit hashes of words and shingles, all words of a slice at once

_BASE, _U = 0x9E3779B97F4A7C15, np.uint64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    p = np.full(CHUNK + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_TABLES: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend((_powers(_BASE), _powers(_INVERSE)))
    return _TABLES


def _hashed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _tables()
    inside = a != 32
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + _U(1)) * up[: len(a)])))
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _long_word(buffer: bytes, start: int, end: int) -> np.ndarray:
    """The hash of one word, its sum carried on from slice to slice."""
    total = 0
    for at in range(start, end, CHUNK):
        a = np.frombuffer(buffer, dtype=np.uint8, count=min(CHUNK, end - at), offset=at)
        total += int(((a.astype(np.uint64) + _U(1)) * _tables()[0][: len(a)]).sum()) * pow(_BASE, at - start, 1 << 64)
    return mix(np.array([(total + end - start) % (1 << 64)], dtype=np.uint64))


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of non-blank bytes; equal words have equal hashes wherever they stand."""
    starts, hashes, at = [], [], 0
    while at < len(buffer):
        end = min(at + CHUNK, len(buffer))
        if end < len(buffer) and (cut := buffer.rfind(b" ", at, end)) > at:
            end = cut
        elif end < len(buffer):  # one word longer than a slice
            start = at + (buffer[at] == 32)
            at = buffer.find(b" ", start)
            at = len(buffer) if at < 0 else at
            starts.append(np.array([start]))
            hashes.append(_long_word(buffer, start, at))
            continue
        s, h = _hashed(np.frombuffer(buffer, dtype=np.uint8, count=end - at, offset=at))
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def hashed_texts(texts: list[bytes | None], table: bytes = LOWER) -> list[np.ndarray]:
    """Per text the hashes of its words in order."""
    clean = [(t or b"").translate(table) for t in texts]
    ends = np.cumsum([len(c) + 1 for c in clean])
    starts, hashes = word_hashes(b" ".join(clean))
    return np.split(hashes, np.searchsorted(starts, ends[:-1]))


_STEP = [_U((0xD6E8FEB86659FD93 * (2 * j + 1) + 0x2545F4914F6CDD1D * 2 * j) % (1 << 64) | 1) for j in range(64)]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    n = max(len(words) - k + 1, 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        total += words[j:j + n] * _STEP[j]
    return np.unique(mix(total + _U(min(k, len(words)))))
