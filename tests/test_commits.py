"""Publishing: all tables of a commit at once, runs of their own, two writers, leftovers."""

import pytest
from pyspark.sql import functions as F

from emberline.sources import commits, tables

PER = "event_id long, iou double, dice double, brier double, ece double"


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def values(df):
    return sorted(r.x for r in df.collect())


def failing(spark):
    return frame(spark, 1).withColumn("x", F.when(F.col("x") > 0, F.raise_error(F.lit("lost"))).cast("long"))


def test_failure_between_two_tables_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.read_table(spark, path, "a") is None and commits.manifests(spark, path) == []
    assert commits.commit(spark, path, {"a": frame(spark, 1), "b": frame(spark, 10)}) == 1
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, path, {"a": frame(spark, 2), "b": failing(spark)}, stamp="s2")
    assert values(commits.read_table(spark, path, "a")) == [1] and values(commits.read_table(spark, path, "b")) == [10]
    # the job is repeated under its stamp, twice: its rows come once
    for _ in range(2):
        assert commits.commit(spark, path, {"a": frame(spark, 2), "b": frame(spark, 20)}, stamp="s2") == 2
    assert values(commits.read_table(spark, path, "a")) == [1, 2] and values(commits.read_table(spark, path, "b")) == [10, 20]
    assert values(commits.read_table(spark, path, "a", version=1)) == [1]


def test_replacing_and_growing_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.commit(spark, path, {"a": frame(spark, 1), "b": frame(spark, 10)})
    commits.commit(spark, path, {"a": frame(spark, 5, 6), "b": frame(spark, 20)}, replace=("a",))
    commits.commit(spark, path, {"a": frame(spark, 7)})
    assert values(commits.read_table(spark, path, "a")) == [5, 6, 7] and values(commits.read_table(spark, path, "b")) == [10, 20]
    commits.commit(spark, path, {"a": frame(spark)}, replace=("a",))
    assert values(commits.read_table(spark, path, "a")) == []
    assert values(commits.read_table(spark, path, "a", version=2)) == [5, 6]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    commits.commit(spark, path, {"a": frame(spark, 1)})
    commits.commit(spark, path, {"a": frame(spark, 2)}, expected=1)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, {"a": frame(spark, 3)}, expected=1, stamp="late")
    assert values(commits.read_table(spark, path, "a")) == [1, 2]
    assert commits.drop_unpublished(spark, path) == []  # too young
    assert commits.drop_unpublished(spark, path, older_than_hours=0) == ["a/commit=late"]
    assert values(commits.read_table(spark, path, "a")) == [1, 2]


def test_a_version_taken_while_writing_is_passed_over(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    before = commits.manifests(spark, path)
    commits.commit(spark, path, {"a": frame(spark, 1)})
    monkeypatch.setattr(commits, "manifests", lambda *_: before)  # a writer that looked before the other was done
    assert commits.commit(spark, path, {"a": frame(spark, 2)}) == 2
    monkeypatch.undo()
    assert values(commits.read_table(spark, path, "a")) == [1, 2] and [m["version"] for m in commits.manifests(spark, path)] == [1, 2]


def test_names(spark, tmp_path):
    for name in ("commits", "../x", "_log", ""):
        with pytest.raises(ValueError):
            commits.commit(spark, str(tmp_path), {name: frame(spark, 1)})
    with pytest.raises(ValueError):
        commits.commit(spark, str(tmp_path), {"a": frame(spark, 1)}, replace=("b",))


def test_the_same_run_twice_is_two_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    per = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4)], PER)
    events = spark.createDataFrame([(1, 11)], "firms_event_id long, id long")
    for _ in range(2):
        tables.append_runs(per, events, "m", "test", "{}", path)
    runs, results = tables.read_runs(spark, path)
    assert len({r.run_id for r in runs.collect()}) == 2 and results.count() == 8
    assert sorted(results.groupBy("run_id").count().select("count").toPandas()["count"]) == [4, 4]


def test_upsert_merges_again_after_another_job(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    mk = lambda *ids: spark.createDataFrame([(i, None, None, 0.0, 0.0, 1.0, 1.0) for i in ids],
                                            "event_id long, start_date date, end_date date, west double, south double, east double, north double")
    assert tables.read_events(spark, path) is None
    tables.upsert_events(spark, mk(1), path)
    real, calls = commits.commit, []

    def slow(*args, **kw):  # another job publishes event 2 between this one's read and its commit
        if not calls:
            calls.append(1)
            monkeypatch.setattr(tables, "commit", real)
            tables.upsert_events(spark, mk(2), path)
        return real(*args, **kw)

    monkeypatch.setattr(tables, "commit", slow)
    tables.upsert_events(spark, mk(1, 3), path)
    assert sorted(r.firms_event_id for r in tables.read_events(spark, path).collect()) == [1, 2, 3]


def test_results_are_written_in_files_and_read_back(spark, tmp_path):
    path = str(tmp_path / "results")
    per = spark.range(25).selectExpr("concat('m ', id % 2) as model", "id as event_id", "id / 10 as iou", "0.5D as dice", "double('nan') as brier", "cast(null as double) as ece")
    tables.write_results(per, "test", path, per_file=2)
    rows, kinds = tables.load_results(spark, path)
    assert rows.count() == 25 and kinds.count() > 2
    assert {(r.model, r.event_id, r.iou) for r in rows.collect()} == {(r.model, r.event_id, r.iou) for r in per.collect()}
    tables.write_results(per.filter("model = 'm 0' and event_id < 4"), "test", path)
    rows = tables.load_results(spark, path)[0]
    assert sorted(r.event_id for r in rows.filter("model = 'm 0'").collect()) == [0, 2]  # the model's earlier files are gone
    assert rows.filter("model = 'm 1'").count() == 12
