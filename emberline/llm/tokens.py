"""Alignment of two tokenizers: which tokens of one text overlap, which groups of tokens cover the same bytes, how often pairs of ids end together."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from emberline.llm.common import parts, stored

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how a byte-level tokenizer cuts a text before it merges.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 1 << 19  # bytes of text aligned in one step


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Bytes of every id, joined, with where each begins, and the text of every id before each of the marks that may follow it."""

    def __init__(self, said: list[bytes]):
        self.size = np.array([len(b) for b in said], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(said), dtype=np.uint8)
        self.said = said

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ahead = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[ids] - ahead, size) + np.arange(int(size.sum()))]


def byte_tokenizer(path: str):
    """(encode, vocabulary) of a byte-level BPE file: merges in order of id; strings of special tokens are plain text."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
    said = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
    inner = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks={b: i for i, b in said.items()}, special_tokens={})
    return inner.encode_ordinary, Vocabulary([said.get(i, b"") for i in range(max(said) + 1)])


def piece_tokenizer(path: str):
    """(encode, vocabulary) of a sentencepiece file; <0xHH> is a byte, U+2581 a space."""
    import sentencepiece

    inner = sentencepiece.SentencePieceProcessor(model_file=path)
    said = [bytes([int(p[3:5], 16)]) if inner.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(inner.id_to_piece, range(inner.get_piece_size())))]
    return lambda text: inner.encode(text, num_threads=1), Vocabulary(said)


def most_pairs(a: Vocabulary, b: Vocabulary) -> int:
    """How many pairs of ids can ever end together: over the same bytes one of the two is the other's end."""
    def ends(long, short, whole):
        count = pd.Series(short).value_counts()
        return sum(int(count.get(t[i:], 0)) for t in long for i in range(0 if whole else 1, len(t)))
    return ends(a.said, b.said, True) + ends(b.said, a.said, False)


def covering(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """(l, r): for every token of `left` the token of `right` in which it starts; both (doc, start, n), in order."""
    return pd.merge_asof(left.rename(columns={"n": "l"}), right.rename(columns={"n": "r"}), on="start", by="doc")[["l", "r"]]


def overlaps(ids_a, ids_b, size_a: np.ndarray, size_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray):
    """(a, b): positions of all tokens that share a byte, once each. Texts stand one behind the other, equally long on both sides."""
    start = lambda s: np.cumsum(s) - s
    one = pd.DataFrame({"doc": doc_a, "start": start(size_a), "n": np.arange(len(ids_a))})
    two = pd.DataFrame({"doc": doc_b, "start": start(size_b), "n": np.arange(len(ids_b))})
    there = covering(one, two)
    back = covering(two, one)
    back = back[one["start"].to_numpy()[back["r"].to_numpy()] != two["start"].to_numpy()]  # tokens that start together were found from the other side
    return np.concatenate([there["l"], back["r"]]), np.concatenate([there["r"], back["l"]])


_WORKER: dict = {}


def _tools(a_file: str, b_file: str):
    if (a_file, b_file) not in _WORKER:
        a, b = byte_tokenizer(a_file), piece_tokenizer(b_file)
        marks = lambda v, last: np.array([f"{i}{m}" for m in (",", last) for i in range(len(v.said))], dtype=object)
        _WORKER[a_file, b_file] = (*a, *b, marks(a[1], "|"), marks(b[1], ";"))
    return _WORKER[a_file, b_file]


def _aligned(texts: list[str | None], a_file: str, b_file: str):
    """Per text (n_a, n_b, n_groups, n_overlaps, groups as text, link codes); None where the text has no tokens."""
    encode_a, a, encode_b, b, text_a, text_b = _tools(a_file, b_file)
    out: list = [None] * len(texts)
    which, ids_a, ids_b = [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        x, y = np.array(encode_a(" " + t), dtype=np.int64), np.array(encode_b(t), dtype=np.int64)
        whole = b" " + t.encode()
        if a.joined(x).tobytes() == whole and b.joined(y).tobytes() == whole:
            which.append(i)
            ids_a.append(x)
            ids_b.append(y)
    if not which:
        return out
    per_a, per_b = np.array([len(x) for x in ids_a]), np.array([len(y) for y in ids_b])
    doc_a, doc_b = np.repeat(np.arange(len(which)), per_a), np.repeat(np.arange(len(which)), per_b)
    all_a, all_b = np.concatenate(ids_a), np.concatenate(ids_b)
    size_a, size_b = a.size[all_a], b.size[all_b]
    at_a, at_b = overlaps(all_a, all_b, size_a, size_b, doc_a, doc_b)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    together = end_a[at_a] == end_b[at_b]
    order = np.argsort(at_a[together], kind="stable")
    la, lb = at_a[together][order], at_b[together][order]
    codes = all_a[la] * len(b.said) + all_b[lb]
    # a group ends where a token of A and one of B end together
    last_a, last_b = np.zeros(len(all_a), bool), np.zeros(len(all_b), bool)
    last_a[la], last_b[lb] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    words = np.concatenate([text_a[all_a + last_a * len(a.said)], text_b[all_b + last_b * len(b.said)]])
    words = words[np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")]
    groups_in = np.bincount(doc_a[la], minlength=len(which))
    met = np.bincount(doc_a[at_a], minlength=len(which))
    token_at = np.concatenate([[0], np.cumsum(per_a + per_b)])
    group_at = np.concatenate([[0], np.cumsum(groups_in)])
    for j, i in enumerate(which):
        said = "".join(words[token_at[j]:token_at[j + 1]])[:-1]
        out[i] = (int(per_a[j]), int(per_b[j]), int(groups_in[j]), int(met[j]), said, codes[group_at[j]:group_at[j + 1]])
    return out


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """`docs` with `tokens`: n_a, n_b, n_groups, n_overlaps, groups (`a1,a2|b1;a3|b2,b3`), links (a code a_id * |B| + b_id per link).

    text is read; a column `tokens` is replaced, all others stay. Space + text is encoded by a byte-level BPE file (A), text by a
    sentencepiece file that adds the space itself (B); both files must be readable on every worker. Starts are matched per slice
    of whole texts by `merge_asof` with the text as key, in both directions; their union are the overlaps. Overlapping tokens that end at
    one byte are a link, and close a group. A text is aligned as a whole, so memory grows with the longest single text only.
    Null and empty texts, and texts that either side does not give back byte by byte, have zeros, '' and no links.
    """
    row = F.struct(*[F.col(_quoted(c)) for c in docs.columns if c != "tokens"]).alias("row")
    return _encoded(docs.select(row, F.col("text").alias("text")), a_file, b_file).select("row.*", "tokens")


def _encoded(read: DataFrame, a_file: str, b_file: str, hashed: bool = False) -> DataFrame:
    """(row, tokens) of (row, text); with `hashed`, groups is its SHA-256 ('' without tokens), so that no text goes back to Spark."""
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_overlaps")]
                        + [T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType()))])
    fields = pa.struct([(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_overlaps")] + [("groups", pa.string()), ("links", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for piece in parts(batch, "text", SLICE):
                found = _aligned(piece.column("text").to_pylist(), a_file, b_file)
                none = (0, 0, 0, 0, "", np.zeros(0, np.int64))
                cols = list(zip(*[f or none for f in found]))
                if hashed:
                    cols[4] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in cols[4]]
                links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in cols[5]])]), pa.int32()), pa.array(np.concatenate(cols[5])))
                tokens = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols[:5], fields)] + [links], fields=list(fields))
                yield pa.RecordBatch.from_arrays([piece.column("row"), tokens], names=["row", "tokens"])

    return read.mapInArrow(run, T.StructType([read.schema["row"], T.StructField("tokens", kind)]))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _by_links(batch: pa.RecordBatch, most: int = SLICE):
    """Slices of a batch of about `most` links; a text of more is a slice of its own. A batch of 10 000 texts can hold millions."""
    upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("links")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(upto[start - 1]) if start else 0
        end = max(int(np.searchsorted(upto, before + most, side="right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def pair_counts(aligned: DataFrame, links: str = "links") -> DataFrame:
    """(code, n) over all texts; each batch is counted before the shuffle."""
    def count(batches):
        for batch in batches:
            found = [np.unique(part.column("links").flatten().to_numpy(zero_copy_only=False), return_counts=True) for part in _by_links(batch)]
            codes, at = np.unique(np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, at, np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])
    return aligned.select(F.col(links).alias("links")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def alignment_strength(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum, groups_sha256): how well the corpus-wide pairing of ids fits every text.

    n_best counts links whose pair is the most frequent of its B id (ties included), count_sum adds the pairs' frequencies.
    Texts are encoded once; links are kept as a written table until the frequencies are known. These reach every worker as one broadcast: as
    one token of a link is the end of the other, the two files alone bound the number of pairs (`most_pairs`), however large the corpus.
    Rows with a null or repeated doc_id stay rows of their own.
    """
    aligned = _encoded(docs.select(F.col("doc_id").alias("row"), "text"), a_file, b_file, hashed=True)
    t = F.col("tokens")
    once = stored(aligned.select(
        F.col("row").alias("doc_id"), *[t[c].alias(c) for c in ("n_a", "n_b", "n_groups", "n_overlaps")], t["links"].alias("links"),
        t["groups"].alias("groups_sha256")), "aligned")
    (_, a), (_, b) = byte_tokenizer(a_file), piece_tokenizer(b_file)
    width = len(b.said)
    of_b = Window.partitionBy(F.col("code") % width)
    ranked = pair_counts(once).withColumn("best", F.col("n") == F.max("n").over(of_b)).toArrow()
    if ranked.num_rows > most_pairs(a, b):
        raise ValueError("more pairs than the vocabularies allow")
    order = np.argsort(ranked["code"].to_numpy())
    known = docs.sparkSession.sparkContext.broadcast(tuple(ranked[c].to_numpy()[order] for c in ("code", "n", "best")))

    def weigh(batches):
        codes, n, best = known.value
        for batch in batches:
            for part in _by_links(batch):
                links = part.column("links")
                at = np.searchsorted(codes, links.flatten().to_numpy(zero_copy_only=False))
                size = np.diff(links.offsets.to_numpy())
                upto = lambda v: np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], np.cumsum(size)])]
                new = [pa.array(size.astype(np.int64)), pa.array(np.diff(upto(best[at].astype(np.int64)))), pa.array(np.diff(upto(n[at])))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, names=[*kept, "n_links", "n_best", "count_sum"])

    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256"]
    return once.mapInArrow(weigh, f"doc_id {dict(once.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, n_links long, n_best long, count_sum long")
