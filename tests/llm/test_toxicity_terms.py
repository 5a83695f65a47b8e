"""Every word of the examples is in the index, and every neighbour that voted is told."""

import random

import numpy as np

from emberline.llm import toxicity
from emberline.llm.common import PLAIN, hashed_texts


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(900)}" for _ in range(n))


def test_all_terms_and_all_voters(frame, scratch):
    rows = [(i, prose(i, 40) + (" vile wretch" if i % 6 == 0 else "")) for i in range(300)]
    labels = scratch.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = frame(rows + [(5000, "w7 w8 w9 once"), (5001, "vile words w3 w4"), (5002, "nothing known")])
    index = toxicity.learn(docs, labels)
    texts = dict(rows)
    bag = lambda text: dict(zip(*np.unique(hashed_texts([text.encode()], PLAIN)[0], return_counts=True)))
    words = {i: bag(texts[i]) for i in index.ids}
    assert set(index.terms.tolist()) == {int(w) for x in words.values() for w in x}
    weight = dict(zip(index.terms.tolist(), index.idf))
    assert min(weight.values()) >= 1  # none weighs nothing
    everything = [bag(x.text) for x in docs.collect()]
    total = len(everything)
    slot = lambda t: int(t) % toxicity.SLOTS
    held = {slot(t): sum(any(slot(u) == slot(t) for u in b) for b in everything) for b in everything[-3:] for t in b}
    rare = lambda t: np.log((1 + total) / (1 + held[slot(t)])) + 1  # words without an example count in a document's length
    for t in everything[-2]:  # the label raises no weight beyond its bound
        assert int(t) not in weight or rare(t) - 1e-5 <= weight[int(t)] <= toxicity.MOST * rare(t) + 1e-5

    def vector(x):
        v = {int(t): (1 + np.log(n)) * (weight[int(t)] if int(t) in weight else rare(t)) for t, n in x.items()}
        norm = sum(w * w for w in v.values()) ** 0.5
        return {t: w / norm for t, w in v.items()}

    unit = {i: vector(x) for i, x in words.items()}
    got = {x.doc_id: x for x in toxicity.score_texts(docs, index).collect()}
    for d, text in [(5000, "w7 w8 w9 once"), (5001, "vile words w3 w4"), (17, texts[17])]:
        q = vector(bag(text))
        cos = sorted((round(-sum(w * v.get(t, 0) for t, w in q.items()), 9), i) for i, v in unit.items())
        want = [c for c in cos if c[0] < 0][:toxicity.NEIGHBOURS]
        assert len(want) == toxicity.NEIGHBOURS and np.allclose([-c for c, _ in want], [e.cosine for e in got[d].evidence])
    assert got[5001].tox_label == 1 and got[5000].tox_label == 0 and not got[5002].evidence


def test_clashing_columns_and_texts_of_one_id(frame, scratch):
    rows = [(i, prose(i, 30) + (" vile wretch" if i % 5 == 0 else "")) for i in range(100)] + [(0, "another text"), (3, None)]
    labels = scratch.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    docs = frame(rows).selectExpr("*", "'old' as tox_score", "'kept' as slot", "'kept' as doc", "1 as toxic")
    index = toxicity.learn(docs, labels)
    again = toxicity.learn(docs.orderBy("text"), labels)
    assert index.ids == again.ids and np.array_equal(index.weight, again.weight)
    got = toxicity.score_texts(docs, index).collect()
    assert len(got) == len(rows) and {(r.slot, r.doc, r.toxic) for r in got} == {("kept", "kept", 1)} and all(0 <= r.tox_score <= 1 for r in got)
    assert toxicity.score_texts(docs.limit(0), index).count() == 0 and not toxicity.learn(docs.limit(0), labels).ids
