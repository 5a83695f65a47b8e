"""Exact top-k, hard negatives and the Hilbert curve against brute force."""

import itertools

import numpy as np
import pytest

from emberline.llm import negatives, topk
from emberline.llm.intvec import dots

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, x string, q long"


@pytest.fixture(scope="module")
def vectors(scratch):
    def make(rows):
        return scratch.createDataFrame([(i, v, lab, "mine", 5) for i, v, lab in rows], SCHEMA)
    return make


def some(seed, n, dims=6, labels=3, copies=0):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(c) for c in np.round(r.standard_normal(dims), 2)], int(r.integers(labels))) for i in range(n)]
    hot = rows[3][1]
    return rows + [(n + i, list(hot), int(i % labels)) for i in range(copies)]


ODD = [(None, [1.0] * 6, 1), (1000, None, 1), (1100, [], 1), (1200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1300, [NAN] * 6, 1), (1400, [INF] * 6, 1), (1500, [1.0] * 5, 1),
       (1600, [0.0] * 6, 1), (1700, [1e300] * 6, 1), (1800, [2.5] * 6, 1), (1800, [2.5] * 6, 1), (1800, [-2.5] * 6, 2), (1900, [1.0] * 6, None)]


def usable(rows, scale, labelled=False):
    out = []
    for i, v, lab in rows:
        if i is not None and v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v) and max(map(abs, v)) < 1e6 and not (labelled and lab is None):
            out.append((i, tuple(int(np.floor(scale * c)) for c in v), lab))
    return out


def dot(a, b):
    return sum(p * q for p, q in zip(a, b))


def brute_top(rows, k, every=100):
    use = usable(rows, 1024)
    out = []
    for qi, q in sorted({(i, v) for i, v, _ in use if i % every == 0}):
        best = sorted((-dot(q, v), i) for i, v, _ in use if i != qi)[:k]
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k, bins, rows, asked", [(10, 4096, 4096, 1024), (3, 4, 50, 2), (400, 16, 64, 3)])
def test_top_k_against_brute_force(vectors, k, bins, rows, asked):
    data = some(1, 260, copies=90) + ODD
    got = topk.top_k(vectors(data), k=k, rows=rows, asked=asked, bins=bins)
    assert sorted(map(tuple, got.collect())) == brute_top(data, k)


def test_top_k_of_given_queries_and_empty_tables(vectors):
    data = some(2, 120)
    asked = [(7, [0.5] * 6, None), (500, [-1.0] * 6, None)]
    got = sorted(map(tuple, topk.top_k(vectors(data), queries=vectors(asked), k=4).collect()))
    use = usable(data, 1024)
    want = []
    for qi, q, _ in usable(asked, 1024):
        want += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(sorted((-dot(q, v), i) for i, v, _ in use if i != qi)[:4])]
    assert got == sorted(want)
    assert topk.top_k(vectors([])).count() == 0 and topk.top_k(vectors(data), queries=vectors([(1, [1.0] * 5, 1)])).count() == 0
    assert topk.top_k(vectors([(100, [1.0, 2.0], 1)])).count() == 0


def test_large_components_stay_exact():
    a, b = np.array([[2 ** 30, 2 ** 30 - 1]], dtype=np.int32), np.array([[2 ** 30, -(2 ** 30)], [1, 2 ** 30 - 3]], dtype=np.int32)
    assert dots(a, b).tolist() == [[dot(map(int, a[0]), map(int, r)) for r in b]]


def brute_negatives(rows, every=50):
    use = usable(rows, 256, labelled=True)
    out = []
    for ai, a, lab in sorted({u for u in use if u[0] % every == 0}):
        ranked = sorted((-dot(a, v), i, other) for i, v, other in use if i != ai)
        for s, p, _ in [r for r in ranked if r[2] == lab][:5]:
            near = [(n, m) for n, m, other in ranked if other != lab and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(ai, p, k + 1, m, -s, -n) for k, (n, m) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block, asked, together", [(1024, 1024, 16), (7, 3, 2), (32, 64, 4)])
def test_negatives_against_brute_force(vectors, block, asked, together):
    data = some(3, 260, copies=90) + ODD
    got = negatives.mine_negatives(vectors(data), block=block, asked=asked, together=together)
    assert sorted(map(tuple, got.collect())) == brute_negatives(data)


def test_negatives_of_empty_and_small_tables(vectors):
    assert negatives.mine_negatives(vectors([])).count() == 0
    assert negatives.mine_negatives(vectors([(50, [1.0] * 6, 1)])).count() == 0
    assert negatives.mine_negatives(vectors([(50, [1.0] * 6, 1), (51, [1.0] * 6, 1), (52, [0.75] * 6, 2)])).count() == 1


def test_bounds_leave_blocks_unread(scratch, vectors):
    """Far clusters of one label each: an anchor reads its own label's block for positives, not the blocks whose bounds cannot reach its floor."""
    r = np.random.default_rng(5)
    centres = np.eye(6) * 10
    data = [(int(i), [float(c) for c in centres[i % 6] + r.standard_normal(6) * 0.05], 0) for i in range(600)]
    rows, dims = negatives.usable_vectors(vectors(data), 256, ("label",))
    blocks = negatives.candidate_blocks(rows, dims, 50)
    chunks = negatives.anchor_chunks(blocks, dims, 5, 50, 4)
    seen = []

    def work(chunk, at, ids, s):
        return [at, np.full(len(at), len(ids))]
    same = lambda chunk, labels, low, high: high >= np.frombuffer(chunk["floors"], dtype=np.int64)[:, None]
    read = negatives._read(chunks, blocks, dims, same, work, "chunk long, i long, n long", 4).groupBy("chunk", "i").count().collect()
    total = blocks.count()
    assert max(x["count"] for x in read) <= total / 2 and len(read) == 12


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2), (5, 1)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [bytes(k) for k in negatives.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    along = cells[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()
