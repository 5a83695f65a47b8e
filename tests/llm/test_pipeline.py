"""The pipeline: every stage on odd rows, and against a small restatement of what it must keep."""

import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from emberline.llm.common import drop_tables, stored, tables_written
from tests.llm.test_llm import ODD, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus(scratch, tmp_path_factory):
    """Tables of a small corpus: 0-199 prose, of which every eighth is toxic; 200 copies of 5; 300 near 7; 400 holds benchmark words; 500 a passage of 9."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, prose(i, 90) + (" vile wretch vile" if i % 8 == 0 else "")) for i in range(200)]
    text = dict(rows)
    test = prose(777, 25)
    rows += [(200, text[5]), (201, text[5]), (300, text[7] + " tail"), (400, prose(400, 40) + " " + test + " " + prose(401, 40)),
             (500, prose(500, 60) + " " + " ".join(text[9].split()[20:75]) + " " + prose(501, 60))]
    rows += [(r[0] and r[0] + 600, r[1]) for r in ODD]
    docs = [(i, t, "en", ["a", "b", "c", None][n % 4], None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    save = lambda data, schema, name: scratch.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    save(docs, SCHEMA, "documents")
    save([(i, 1, int(i % 8 == 0)) for i in range(200)], "doc_id long, quality int, toxic int", "labels")
    save([(1, test), (2, None), (None, "")], "item_id long, text string", "benchmark")
    return folder, docs


@pytest.fixture(scope="module")
def passed(scratch, corpus):
    """Input and output rows of every stage, in order."""
    folder, docs = corpus
    now, out = scratch.read.parquet(f"{folder}/documents.parquet"), []
    for name, fn in cp.STAGES:
        after = stored(fn(scratch, now, folder), name)
        out.append((name, now.collect(), after.collect(), after.columns))
        now = after
    return {o[0]: o[1:] for o in out}


def test_stages_keep_their_columns(passed):
    assert list(passed) == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "source_mix"]
    for name, (_, _, columns) in passed.items():
        assert columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and (name == "source_mix" or len(columns) == 5)


def test_toxic_documents_go_and_clean_ones_stay(passed):
    before, after, _ = passed["toxicity"]
    kept = {r.doc_id for r in after}
    assert not [i for i in range(200) if i % 8 == 0 and i in kept] and {i for i in range(200) if i % 8} <= kept
    assert len(after) == len([r for r in before if not (r.text and "vile" in r.text)])


def test_line_dedup_removes_later_passages_only(passed):
    before, after, _ = passed["line_dedup"]
    was, now = {r.doc_id: r.text for r in before}, {r.doc_id: r for r in after}
    assert 200 not in now and 201 not in now  # copies of 5, of which nothing is left
    passage = " ".join(was[9].split()[20:75])
    assert passage in now[9].text and passage not in now[500].text
    assert words(prose(500, 60))[5:50] == words(now[500].text)[5:50] and now[500].n_chars == len(now[500].text)
    for i in (1, 2, 3, 5, 7, 9):
        assert now[i].text == was[i]


def test_jaccard_keeps_one_of_each_component(passed):
    before, after, _ = passed["jaccard_join"]
    sets = {}
    for n, r in enumerate(before):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(r.text)]
        sets[n] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {n: n for n in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    assert len(after) == len({find(n) for n in sets})


def test_contaminated_documents_go(passed):
    before, after, _ = passed["decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {400} and len(before) - len(after) == 1


def test_mix_counts_words(passed):
    before, after, columns = passed["source_mix"]
    size, taken = defaultdict(int), defaultdict(int)
    for r in before:
        size[r.source] += len(words(r.text))
    for r in after:
        assert r.taken == r.copies * len(words(r.text)) and 1 <= r.copies <= 3
        taken[r.source] += r.taken
    assert all(taken[s] <= 3.2 * size[s] for s in size) and {"taken", "copies"} <= set(columns)


def test_run_gives_the_same_rows_and_clears_up(scratch, corpus, passed):
    folder, _ = corpus
    got = cp.run(scratch, folder)
    key = lambda r: str((r.doc_id, r.text, r.taken))
    assert sorted(map(key, got.collect())) == sorted(map(key, passed["source_mix"][1]))


def test_stages_on_empty_tables_and_other_columns(scratch, corpus):
    folder, _ = corpus
    docs = scratch.read.parquet(f"{folder}/documents.parquet")
    more = docs.filter("doc_id < 40 or doc_id is null").selectExpr("*", "1 as key", "2 as nth", "3 as _key", "4 as _spans", "5 as size", "6 as tokens", "7 as row")
    for name, fn in cp.STAGES:
        assert stored(fn(scratch, docs.limit(0), folder), name).count() == 0
        out = stored(fn(scratch, more, folder), name)
        assert {tuple(r[c] for c in more.columns[5:]) for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7)}, name


def test_tables_are_dropped(scratch):
    with tables_written() as outer:
        kept = stored(scratch.range(3), "kept")
        with tables_written() as inner:
            stored(scratch.range(4), "gone")
    assert len(outer) == 2 and len(inner) == 1
    place = inner[0].removeprefix("file:")
    assert os.path.exists(place)
    drop_tables(scratch, inner)
    assert not os.path.exists(place) and kept.count() == 3 and inner == []


def test_jaccard_drops_tables_that_nothing_reads_any_more(frame, scratch):
    from emberline.llm import jaccard
    from emberline.llm.common import tables_written
    text = " ".join(f"w{i}" for i in range(80))
    with tables_written() as paths:
        rows = jaccard.jaccard_components(frame([(1, text), (2, text + " end"), (3, "a b c d"), (4, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    path = scratch.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: path(p).getFileSystem(scratch.sparkContext._jsc.hadoopConfiguration()).exists(path(p))
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in paths if there(p)}
    assert len(paths) > 20 and not left & {"sketch", "keys", "entries", "tokens", "open", "prefixes", "prefixes_again", "groups", "groups_again", "matrix", "asked", "doubtful"}
