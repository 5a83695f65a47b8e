"""Repeated passages against a finder that compares every window of words with all others and knows nothing of anchors or lines."""

import random
import time

from emberline.llm import linededup, passages

SIZE = linededup.WORDS


def units(text):
    """Words with where they stand, read character by character."""
    out, begun = [], None
    for i, c in enumerate(text + " "):
        wide = 0x3000 <= ord(c) <= 0x9FFF
        if begun is not None and (wide or c in " \t\n\r\v\f"):
            out.append((begun, i))
            begun = None
        if wide:
            out.append((i, i + 1))
        elif c not in " \t\n\r\v\f" and begun is None:
            begun = i
    return [(a, b, text[a:b].translate({x: x + 32 for x in range(65, 91)})) for a, b in out]


def left_over(rows):
    """Per doc_id the words that stay."""
    words = {d: units(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - SIZE + 1):
            first.setdefault(tuple(w[2] for w in words[d][s:s + SIZE]), (d, s))
    out = {}
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - SIZE + 1):
            e, q = first[tuple(x[2] for x in w[s:s + SIZE])]
            if (e, q) != (d, s):
                gone |= set(range(max(s, q + SIZE) if e == d else s, s + SIZE))
        out[d] = [dict(rows)[d][a:b] for i, (a, b, _) in enumerate(w) if i not in gone]
    return out


def prose(seed, n, stop=0.1):
    r = random.Random(seed)
    return " ".join(f"{r.choice('Ww')}{r.randrange(3000)}" + ("." if r.random() < stop else "") for _ in range(n))


def test_passages_against_all_windows(frame):
    bank = [prose(i, 10 + 4 * i, 0.0) for i in range(12)]  # 10 to 54 words without a full stop
    cjk = "".join(chr(0x4E00 + random.Random(5).randrange(2000) * 7 % 5000 + i) for i in range(40)) + "。"
    hot = prose(77, 25)
    rows = []
    for i in range(60):
        r = random.Random(100 + i)
        pieces = [prose(1000 + 10 * i + j, r.randrange(1, 40)) for j in range(3)]
        pieces += r.sample(bank, 2) + ([hot] if i % 2 else []) + ([cjk] if i % 7 == 0 else [])
        if i % 5 == 0:
            pieces += [hot + " " + bank[11]]  # the hot line in front of another context
        r.shuffle(pieces)
        rows.append((i, r.choice([" ", "\n", ", "]).join(pieces)))
    rows += [(100, rows[4][1]), (101, "ha " * 300), (102, None), (103, ""), (104, "a b"), (105, bank[11] + "\n" + bank[11]), (106, rows[9][1].upper())]
    got = passages.dedup_passages(frame(rows)).collect()
    want = left_over(rows)
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) and by[102].text is None and by[103].text == "" and by[100].text == ""
    for d, t in rows:
        assert [t2[2] for t2 in units(by[d].text or "")] == [w.translate({x: x + 32 for x in range(65, 91)}) for w in want[d]], d
        assert by[d].words_removed == len(units(t or "")) - len(want[d])
    assert len(units(by[101].text)) == SIZE
    assert passages.dedup_passages(frame([])).count() == 0


def test_passage_spliced_into_sentences(frame):
    shared = prose(1, 30, 0.0)  # shares no whole line with the other place
    rows = [(1, f"Here begins {shared} and ends."), (2, f"Elsewhere stands {shared} too.\nLast line.")]
    assert {x.doc_id: x.text for x in passages.dedup_passages(frame(rows)).collect()} == {1: rows[0][1], 2: "Elsewhere stands too.\nLast line."}
    assert {x.doc_id: x.text for x in linededup.dedup_lines(frame(rows)).collect()}[2] == rows[1][1]  # what whole lines leave


def test_run_whose_hot_line_first_stands_elsewhere(frame):
    run = [" " + prose(60 + i, 8, 0.0).replace(".", "") + "." for i in range(5)]
    rows = [(i, f"Other words {i}.{x} More words {i}.") for i, x in enumerate(run)]  # every line stands alone before
    rows += [(10, f"Begin now.{''.join(run)} End."), (11, f"Start here.{''.join(run)} Close.")]
    assert {x.doc_id: x.text for x in linededup.dedup_lines(frame(rows)).collect()}[11] == rows[-1][1]  # what one place per line leaves
    assert {x.doc_id: x.text for x in passages.dedup_passages(frame(rows)).collect()} == {**dict(rows), 11: "Start here. Close."}


def test_line_matches_come_first_and_nothing_else_changes(frame):
    lined = lambda seed: "\n".join(prose(seed + j, 9, 0.0) for j in range(12))
    bank = [lined(50 * i) for i in range(4)]
    rows = []
    for i in range(40):
        r = random.Random(300 + i)
        pieces = [prose(5000 + 10 * i + j, r.randrange(1, 40)) for j in range(2)] + r.sample(bank, 2) + [" ".join(bank[i % 4].split()[7:40])]
        r.shuffle(pieces)
        rows.append((i, "\n".join(pieces)))
    rows += [(100, rows[3][1]), (101, "ha ha ha\n" * 60), (102, bank[0] + "\n" + bank[0]), (103, None), (104, ""), (None, rows[5][1]),
             (105, "\n".join([bank[1].split("\n")[0]] * 9)), (106, prose(9, 25, 0.0) + "\n" + prose(9, 25, 0.0)), (100, rows[3][1])]
    text = lambda lines: sorted((x.doc_id is None, x.doc_id, x.text or "", x.words_removed) for x in passages.dedup_passages(frame(rows), lines=lines).collect())
    assert text(True) == text(False)
    known = passages.line_matches(frame(rows).selectExpr("coalesce(doc_id, 999) as key", "coalesce(doc_id, 999) as d", "text")).collect()
    assert len(known) > 20 and all(b - a >= SIZE for r in known for a, b in r.known)
    whole = {d: [w[2] for w in units(t or "")] for d, t in rows}
    whole[999] = whole.pop(None)
    for r in known:  # every match stands at an earlier place, word by word
        for a, b in r.known:
            places = [(d, s) for d, w in whole.items() if d <= r.key for s in range(len(w) - (b - a) + 1) if w[s:s + b - a] == whole[r.key][a:b]]
            assert min(places) < (r.key, a)


def test_places_settle_in_one_pass_over_small_batches(scratch):
    r = random.Random(4)
    texts = {k: (k % 5, k * 7 - 40) for k in range(12)}  # (d, key); several texts of one d
    places = [(texts[k][1], texts[k][0], r.randrange(6), r.randrange(3), lo, lo + 2) for k in texts for lo in r.sample(range(90), 12)]
    rows = scratch.createDataFrame(places + places[:5] + [(3, 0, 3, 8, 8, -30)], passages.PLACE)
    first = {}
    for p in sorted(places, key=lambda p: (p[1], p[0], p[4])):
        first.setdefault(p[2:4], p)
    gone, several = {(3, w) for w in range(8, 30)}, set()
    for key, d, gram, ctx, lo, hi in places:
        e = first[gram, ctx]
        if (e[0], e[4]) != (key, lo):
            gone |= {(key, w) for w in range(max(lo, e[4] + SIZE) if e[0] == key else lo, hi + SIZE)}
        else:
            several.add((key, lo, hi + 1))  # every hash has more than one class here
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = scratch.conf.get(size)
    try:
        for batch, crowded in (("3", []), ("10000", [2, 4]), ("1", [0])):
            scratch.conf.set(size, batch)
            found = passages.settled(rows, SIZE, crowded).collect()
            assert {(x.key, w) for x in found if not x.several for w in range(x.a, x.b)} == gone
            assert sorted((x.key, x.a, x.b) for x in found if x.several) == sorted(several)
            listed = passages.joined_up(passages.settled(rows, SIZE, crowded).filter("not several"), "spans").collect()
            assert len({x.key for x in listed}) == len(listed) and {(x.key, w) for x in listed for a, b in x.spans for w in range(a, b)} == gone
            assert all(b < c for x in listed for (_, b), (c, _) in zip(x.spans, x.spans[1:]))
    finally:
        scratch.conf.set(size, before)


def test_tables_leave_no_shuffle_files(scratch):
    from emberline.llm.common import stored
    files = lambda: scratch.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffles = lambda: {f.getName() for f in scratch.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files()) if f.getName().startswith("shuffle")}
    before, table = shuffles(), stored(scratch.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counts")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and table.count() == 7
