"""Language ID by multilingual mixtures: expectation-maximisation of each document's language proportions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from emberline.llm.common import CHUNK, PLAIN, held_out, parts

BUCKETS = 1 << 16
ROUNDS = 20
PENALTY = 8.0  # log-likelihood a further language must gain, times the log of the number of n-grams
PATIENCE = 3      # so many larger sets in a row that gain nothing end the growth
LANGUAGES = 1000  # a model is BUCKETS numbers per language; more labels than this are an error
_ASCII = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and bool(_ASCII.search(text) or any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the words, one blank between words and at both ends."""
    a = np.frombuffer(b" " + text.translate(PLAIN) + b" ", dtype=np.uint8)
    blank = a == 32
    a = a[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    h = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int64)


def ngram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs; a long text is counted piece by piece, in whole."""
    if len(text) <= CHUNK:
        return np.unique(trigrams(text), return_counts=True)
    total, at = np.zeros(BUCKETS, np.int64), 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text) and (cut := text.rfind(b" ", at + 1, end)) > 0:
            end = cut
        total += np.bincount(trigrams(text[at:end]), minlength=BUCKETS)
        at = end
    seen = np.flatnonzero(total)
    return seen, total[seen]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket and language) from all rows of text and non-null lang outside the held-out fold."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("lang").cast("string"), "text")

    def count(batches):
        totals: dict[str, np.ndarray] = {}

        def out():
            for lang, total in totals.items():
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())],
                    names=["lang", "bucket", "n"])
            totals.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                seen, n = ngram_counts(text.as_py())
                totals.setdefault(lang, np.zeros(BUCKETS, np.int64))[seen] += n
                if len(totals) > 64:
                    yield from out()
        yield from out()

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") > 0).toArrow()  # BUCKETS rows per language at most
    names = sorted(set(found.column("lang").to_pylist()))
    if len(names) > LANGUAGES:
        raise ValueError(f"{len(names)} languages; the model takes {LANGUAGES}")
    total = np.full((BUCKETS, len(names)), 0.5)
    if names:
        where = {n: i for i, n in enumerate(names)}
        total[found.column("bucket").to_numpy(), [where[x] for x in found.column("lang").to_pylist()]] += found.column("n").to_numpy()
    return names, np.log(total / total.sum(axis=0)).astype(np.float32)


def proportions(like: np.ndarray, weight: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, rounds: int = ROUNDS):
    """EM for many documents at once: shares of the languages with `start` > 0, and the log-likelihood they reach.

    like    (n-grams of all documents) x languages, likelihoods up to a factor per n-gram
    weight  count of each n-gram; first, doc: where a document's n-grams start, whose each n-gram is
    """
    share, total = start, np.add.reduceat(weight, first)[:, None]
    for _ in range(rounds):
        r = like * share[doc]
        r *= (weight / np.maximum(r.sum(axis=1), 1e-30))[:, None]
        share = np.add.reduceat(r, first, axis=0) / total
    reached = np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-30)) * weight
    return share, np.add.reduceat(reached, first)


def infer(texts: list[bytes | None], logp: np.ndarray, penalty: float = PENALTY):
    """Per text the language shares of the best set, or None without a letter.

    Sets grow from the likeliest single language by the languages of largest share in the full mixture; each is
    fitted anew, and the one of highest log-likelihood less `penalty` * log(n-grams) per language wins. A text's set grows, whatever
    the number of languages, until PATIENCE sizes in a row were no better or no larger one can be; only texts still growing are fitted.
    """
    out: list[np.ndarray | None] = [None] * len(texts)
    some = [i for i, t in enumerate(texts) if has_letter(t)]
    if not some or not logp.shape[1]:
        return out
    counted = [ngram_counts(texts[i]) for i in some]
    lens = np.array([len(c[0]) for c in counted])
    first, doc = np.concatenate(([0], np.cumsum(lens)[:-1])), np.repeat(np.arange(len(some)), lens)
    weight = np.concatenate([c[1] for c in counted]).astype(np.float32)
    logs = logp[np.concatenate([c[0] for c in counted])]
    best = logs.max(axis=1)
    like, base = np.exp(logs - best[:, None]), np.add.reduceat(best * weight, first)
    n, k = np.add.reduceat(weight, first), logp.shape[1]
    single = np.add.reduceat(logs * weight[:, None], first, axis=0)
    top = single.argmax(axis=1)
    share = np.eye(k, dtype=np.float32)[top]
    score = single.max(axis=1) - penalty * np.log(n + 1)
    open_ = base - penalty * 2 * np.log(n + 1) > score  # no mixture can beat `base`
    if k > 1 and open_.any():
        sel = np.flatnonzero(open_)
        rows = open_[doc]
        again = np.cumsum(open_)[doc[rows]] - 1
        starts = np.concatenate(([0], np.cumsum(lens[sel])[:-1]))
        l, w = like[rows], weight[rows]
        full, _ = proportions(l, w, starts, again, np.full((len(sel), k), 1 / k, np.float32))
        full[np.arange(len(sel)), top[sel]] += 1  # the set always holds the best single language
        order = np.argsort(-full, axis=1, kind="stable")
        live, missed, many = np.arange(len(sel)), np.zeros(len(sel), int), lens[sel]
        for size in range(2, k + 1):
            at = sel[live]
            live = live[(missed[live] < PATIENCE) & (base[at] - penalty * size * np.log(n[at] + 1) > score[at])]
            if not len(live):
                break
            at, chosen = sel[live], order[live, :size]
            grams = np.isin(again, live)
            picked = np.take_along_axis(l[grams], np.repeat(chosen, many[live], axis=0), axis=1)
            begin = np.concatenate(([0], np.cumsum(many[live])[:-1]))
            fitted, reached = proportions(picked, w[grams], begin, np.repeat(np.arange(len(live)), many[live]), np.full(chosen.shape, 1 / size, np.float32))
            now = reached + base[at] - penalty * size * np.log(n[at] + 1)
            better = now > score[at]
            missed[live] = np.where(better, 0, missed[live] + 1)
            score[at[better]] = now[better]
            row = np.zeros((len(live), k), np.float32)
            np.put_along_axis(row, chosen, fitted, axis=1)
            share[at[better]] = row[better]
    for i, s in zip(some, share):
        out[i] = s
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """`docs` with lang_pred, score (its share) and shares (language to share, of the selected set).

    Only `text` is read. `und` with score 0 where the text is null or has no letter, or nothing was learnt.
    Equal shares go to the language first by name. Repeated rows are judged alike; columns of these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "shares")
    kept = [c for c in docs.columns if keep is None or c in keep]
    names, logp = model
    shared = spark.sparkContext.broadcast((names, logp))  # BUCKETS numbers per language
    frame = docs.select(*kept, *([] if "text" in kept else ["text"]))

    def run(batches):
        names, logp = shared.value
        for batch in batches:
            for part in parts(batch):
                found = infer(part.column("text").cast(pa.binary()).to_pylist(), logp)
                pred = [None if s is None else int(s.argmax()) for s in found]
                new = [pa.array(["und" if p is None else names[p] for p in pred], pa.string()),
                       pa.array([0.0 if p is None else min(1.0, float(s[p])) for p, s in zip(pred, found)], pa.float64()),
                       pa.array([[] if s is None else [(names[j], float(s[j])) for j in np.flatnonzero(s > 0)] for s in found],
                                pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, names=[*kept, "lang_pred", "score", "shares"])

    return frame.mapInArrow(run, T.StructType([frame.schema[c] for c in kept] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))]))
