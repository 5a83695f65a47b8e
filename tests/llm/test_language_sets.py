"""Mixtures of more than four languages, among eight."""

import random

from emberline.llm import langid


def test_six_languages_of_eight(frame):
    r = random.Random(3)
    voc = {f"l{i}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for i in range(8)}
    say = lambda l, n: " ".join(r.choice(voc[l]) for _ in range(n))
    rows = [(i, say(f"l{i % 8}", 80), f"l{i % 8}") for i in range(200)]
    mixed = ["l0", "l2", "l3", "l5", "l6", "l7"]
    asked = [(900, " ".join(say(l, 200) for l in mixed)), (901, say("l1", 300)), (902, say("l4", 200) + " " + say("l1", 200))]
    got = {x.doc_id: x for x in langid.identify(frame(asked), langid.train(frame(rows))).collect()}
    assert set(got[900].shares) == set(mixed) and all(0.1 < x < 0.24 for x in got[900].shares.values()) and got[900].score < 0.24
    assert set(got[901].shares) == {"l1"} and set(got[902].shares) == {"l1", "l4"}
