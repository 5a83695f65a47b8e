"""Odd input that once crashed an operator, lost a column or departed from a contract."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import common, decontaminate, jaccard, langid, mixing, passages
from tests.llm.test_llm import ODD, prose


def test_null_item_ids_hit_words(frame, scratch):
    test = prose(1, 20)
    bench = scratch.createDataFrame([(None, test), (4, test), (None, prose(2, 20))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(frame([(1, "so " + test), (2, prose(2, 20)), (3, "clean")]), bench).collect()}
    assert (got[1]["items"], got[2]["items"], got[3]["items"]) == (["", "4"], [""], []) and got[1].n_hit == 20
    assert decontaminate.decontaminate(frame([(1, test), (3, "clean")]), bench, mode="documents").count() == 1


@pytest.mark.parametrize("text, is_one", [("½ ② ²", False), ("Ⅷ _ 7", False), ("123 é", True), ("東京", True), ("", False), (None, False), ("a", True), ("٣ ", False), ("🙂", False)])
def test_letters(text, is_one):
    assert langid.has_letter(None if text is None else text.encode()) == is_one


def test_long_words_are_one_word():
    r = random.Random(1)
    long = bytes(r.choice(b"abcdef") for _ in range(2_500_000))
    cases = [b"one " + long + b" two", long, b" " + long + b" ", long + b" " + long, b"x " * 600_000 + long + b" y " * 500_000]
    for text in cases:
        starts, hashes = common.word_hashes(text)
        assert len(hashes) == len(text.split()) and [text[s:s + 1] != b" " for s in starts[:5]]
    _, (first, second) = common.word_hashes(cases[3])
    assert first == second == common.word_hashes(cases[1])[1][0] != common.word_hashes(long[:-1])[1][0]
    short = common.CHUNK
    common.CHUNK = 64  # the same words whatever the slices
    try:
        some = b" ".join(bytes(r.choice(b"ab") for _ in range(n)) for n in (3, 63, 64, 65, 300, 1, 128))
        sliced = common.word_hashes(some)
    finally:
        common.CHUNK = short
    whole = common.word_hashes(some)
    assert np.array_equal(sliced[0], whole[0]) and np.array_equal(sliced[1], whole[1])


def test_shingles_of_a_long_word(frame):
    docs = frame([(1, "one " + "z" * 2_500_000 + " two"), (2, "ONE " + "z" * 2_500_000 + " two"), (3, "one " + "z" * 2_499_999 + " two")])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3)}


def test_one_of_each_component_of_a_shared_id(frame):
    a, b = prose(1, 60), prose(2, 60)
    docs = frame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, prose(3, 60)), (None, prose(3, 60) + " x"), (7, ""), (7, "")])
    docs = docs.selectExpr("*", "'mine' as key", "'mine' as top", "'mine' as second", "'mine' as _key")
    kept = jaccard.keep_one_per_component(docs).collect()
    assert sorted(str((r.doc_id, r.text))[:30] for r in kept) == sorted(str((i, t))[:30] for i, t in [(1, a), (1, b), (None, prose(3, 60)), (7, "")])
    assert {(r.key, r.top, r.second, r._key) for r in kept} == {("mine",) * 4}


def test_other_columns_survive(frame):
    docs = frame([(i, prose(i % 7, 40)) for i in range(20)] + ODD).selectExpr("*", "'mine' as key", "'mine' as nth", "'mine' as n", "'mine' as _spans", "'mine' as n_lines")
    for out in (mixing.mix(docs), passages.dedup_passages(docs)):
        assert {(r.key, r.nth, r.n, r._spans, r.spans) for r in out.collect()} == {("mine",) * 5}


def test_keys_tell_nulls_apart(scratch):
    rows = scratch.createDataFrame([(1, "abc", None), (1, None, "abc"), (None, "abc", None)], "doc_id long, text string, source string")
    assert rows.select(common.row_key("doc_id", "text", "source")).distinct().count() == 3


def test_every_source_lands_near_its_target(frame, scratch):
    r = random.Random(3)
    sizes = [int(r.paretovariate(0.9) * 20) for _ in range(1500)]
    docs = frame([(i, "w " * min(n, 8000), None, ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i, n in enumerate(sizes)])
    per = mixing.mixing_plan(docs, block=128).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(per) == 4 and all(abs(x.taken - x.target) <= 0.002 * x.target + 1 for x in per)


def test_exchange_only_improves():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 40):
        size, was = rng.integers(0, 500, n), rng.random(n)
        p = (rng.random(n) < was).astype(float)
        new = mixing.exchange(p, was, size)
        assert set(new) <= {0.0, 1.0} and abs(np.dot(new - was, size)) <= abs(np.dot(p - was, size))
