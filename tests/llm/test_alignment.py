"""Cross-tokenizer alignment against every pair of tokens, with the tokenizers' own libraries."""

import hashlib
from collections import Counter

import pytest

from emberline.llm import tokens
from tests.llm.test_llm import ODD, prose

TEXTS = ["Hello world", "  two  spaces\n\nand\tlines ", "naïve café – 東京 🙂🙂", "a▁b", "<|endoftext|> and <s> </s>", "it's we'll I'D", "  x", "x\x00y", "１２３ ½ ٣", "ﬁ ﬂ"]


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokens.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokens.B_FILE)
    letters = tokens.byte_letters()
    rows = []
    for t in texts:
        if not t:
            rows.append(None)
            continue
        whole = b" " + t.encode()
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        sx = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        sy = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(sx) != whole or b"".join(sy) != whole:
            rows.append(None)
            continue
        ends = lambda s: [sum(map(len, s[:i + 1])) for i in range(len(s))]
        ex, ey = ends(sx), ends(sy)
        met = sum(max(e - len(s), f - len(r)) < min(e, f) for e, s in zip(ex, sx) for f, r in zip(ey, sy))
        links = [(x[i], y[j]) for i, e in enumerate(ex) for j, f in enumerate(ey) if e == f]
        groups, i, j = [], 0, 0
        for e in sorted(set(ex) & set(ey)):
            p, q = ex.index(e) + 1, ey.index(e) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        rows.append((len(x), len(y), len(groups), met, links, ";".join(groups)))
    count = Counter(p for r in rows if r for p in r[4])
    high = Counter()
    for (_, q), n in count.items():
        high[q] = max(high[q], n)
    return [(0,) * 7 + ("",) if r is None else (r[0], r[1], r[2], r[3], len(r[4]), sum(count[p] == high[p[1]] for p in r[4]), sum(count[p] for p in r[4]),
                                                hashlib.sha256(r[5].encode()).hexdigest()) for r in rows]


def test_alignment_against_brute_force(frame):
    rows = [(i, t) for i, t in enumerate(TEXTS + [prose(i, 60) for i in range(8)])] + [(r[0] and r[0] + 100, r[1]) for r in ODD if len(r[1] or "") < 1000]
    want = brute([t for _, t in rows])
    got = tokens.alignment_strength(frame(rows)).collect()
    names = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links", "n_best", "count_sum", "groups_sha256")
    key = lambda r: str(r)
    assert sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key) == sorted(((r.doc_id, *[r[n] for n in names]) for r in got), key=key)
    assert sum(w[0] == 0 for w in want) > 3  # texts without tokens are among them


def test_slices_long_texts_and_empty_tables(frame, monkeypatch):
    rows = [(i, prose(i, 50)) for i in range(20)] + [(90, "x" * 70000), (91, "word " * 30000), (92, "é" * 3000)]
    a = {r.doc_id: r.tokens for r in tokens.align(frame(rows)).collect()}
    for i in (0, 7, 90, 91, 92):
        alone = tokens._aligned([dict(rows)[i]], tokens.A_FILE, tokens.B_FILE)[0]
        assert (a[i].n_a, a[i].n_b, a[i].n_groups, a[i].n_overlaps, a[i].groups, a[i].links) == (*alone[:5], alone[5].tolist())
        assert a[i].n_groups == len(a[i].links) == len(a[i].groups.split(";"))
    assert tokens.alignment_strength(frame([])).count() == 0


def test_other_columns_stay(frame):
    docs = frame([(1, "one two"), (None, None)]).selectExpr("*", "'kept' as row", "7 as tokens", "1.5 as `n a`")
    out = tokens.align(docs).orderBy("doc_id").collect()
    assert [r.row for r in out] == ["kept", "kept"] and out[1]["n a"] == pytest.approx(1.5) and out[1].tokens.n_a == 2 and out[0].tokens.groups == ""


def test_pairs_are_bounded_by_the_vocabularies():
    a, b = tokens.Vocabulary([b"a", b"ba", b"c", b""]), tokens.Vocabulary([b"a", b"cba", b"a"])
    # a: a, a; ba: a, a; cba ends with a and ba
    assert tokens.most_pairs(a, b) == 4 + 2


def test_links_are_weighed_in_slices_of_bounded_size():
    import pyarrow as pa
    rows = [[1] * n for n in (3, 0, 4, 20, 1, 1, 8, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], names=["links"])
    got = [part.column("links").to_pylist() for part in tokens._by_links(batch, 8)]
    assert [r for part in got for r in part] == rows
    assert all(sum(len(r or []) for r in part) <= 8 or len(part) == 1 for part in got)


def test_strength_takes_no_text_back_from_the_workers(spark):
    docs = spark.createDataFrame([(1, "ein Satz, zwei Worte"), (2, ""), (3, None)], "doc_id long, text string")
    encoded = tokens._encoded(docs.selectExpr("doc_id as row", "text"), tokens.A_FILE, tokens.B_FILE, hashed=True)
    assert encoded.columns == ["row", "tokens"]
    said = {r["doc_id"]: r["tokens"]["groups"] for r in tokens.align(docs).collect()}
    short = {r["row"]: r["tokens"]["groups"] for r in encoded.collect()}
    assert short == {k: hashlib.sha256(g.encode()).hexdigest() if g else "" for k, g in said.items()}
