"""Tables by month and event cells without a folder an event."""

import os

import pytest
from pyspark.sql import functions as F

from emberline.session import DataError
from emberline.sources import commits, detections as src, tables


def raw(spark, days, copy=0):
    rows = [("-37.05", "-72.0", d, "1305", "N", "VIIRS", "h", str(i), (f"f{copy}", i)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "latitude string, longitude string, acq_date string, acq_time string, satellite string, instrument string, "
                                       "confidence string, frp string, seq struct<path:string,row:bigint>")


def test_one_month_reads_one_month(spark, tmp_path):
    path = str(tmp_path / "curated")
    assert src.read_curated(spark, path) is None
    src.append_curated(raw(spark, ["2024-01-05", "2024-02-05", "2024-03-05"]), path, "s1")
    src.append_curated(raw(spark, ["2024-01-05", "2024-02-06"], 1), path, "s2")
    src.append_curated(raw(spark, ["2024-01-05", "2024-02-06"], 1), path, "s2")  # the same landing again
    assert src.read_curated(spark, path).count() == 5 and src.load_detections(src.read_curated(spark, path)).count() == 4
    one = src.read_curated(spark, path, "2024-02-01", "2024-02-28")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "acq_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # a month that is not asked for may be unreadable
    for folder, _, files in os.walk(f"{path}/detections"):
        for f in files:
            if folder.endswith("acq_month=202403") and f.endswith(".parquet"):
                with open(os.path.join(folder, f), "wb") as out:
                    out.write(b"broken")
    found = src.load_detections(one, "2024-02-01", "2024-02-28")
    assert sorted(str(r.detected_at)[:10] for r in found.collect()) == ["2024-02-05", "2024-02-06"]
    ranges = spark.sql("select date'2024-01-01' as start, date'2024-01-07' as end union all select date'2024-02-06', date'2024-02-06'")
    days = src.load_days(spark, path, ranges)
    assert "dynamicpruning" in days._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted((str(r.detected_at)[:10], r.frp) for r in days.collect()) == [("2024-01-05", 0.0), ("2024-02-06", 1.0)]
    with pytest.raises(Exception):
        src.read_curated(spark, path).agg(F.max("frp")).collect()


def cells(spark, events, value):
    return spark.range(events * 6).selectExpr("id div 6 as event_id", "cast(id % 3 as int) as day_idx", "cast(id % 2 as int) as row", "0 as col", f"double({value}) as fire_mask")


def files(path):
    return [f for folder, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]


def test_many_events_make_few_files(spark, tmp_path):
    path = str(tmp_path / "cells")
    with pytest.raises(DataError):
        tables.read_event_cells(spark, path)
    tables.write_event_cells(cells(spark, 5000, 0), path)
    assert len(files(f"{path}/cells")) <= 8 and len(os.listdir(f"{path}/cells")) == 1
    assert tables.read_event_cells(spark, path).count() == 30_000
    # an event that comes again with fewer rows is replaced as a whole, the others stay
    tables.write_event_cells(cells(spark, 10, 1).filter("day_idx = 0"), path)
    found = tables.read_event_cells(spark, path)
    by = {r.event_id: (r.n, r.f) for r in found.groupBy("event_id").agg(F.count("*").alias("n"), F.avg("fire_mask").alias("f")).collect()}
    assert len(by) == 5000 and all(by[e] == ((2, 1.0) if e < 10 else (6, 0.0)) for e in by)
    tables.compact_event_cells(spark, path)
    again = tables.read_event_cells(spark, path)
    assert again.exceptAll(found).isEmpty() and again.count() == 29_960
    assert len(commits.live_stamps(commits.manifests(spark, path), "cells")) == 1


def test_a_failed_rewrite_leaves_the_event(spark, tmp_path):
    path = str(tmp_path / "cells")
    tables.write_event_cells(cells(spark, 3, 0), path)
    bad = cells(spark, 3, 1).withColumn("fire_mask", F.when(F.col("event_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("fire_mask")))
    with pytest.raises(Exception, match="lost"):
        tables.write_event_cells(bad, path)
    assert tables.read_event_cells(spark, path).agg(F.sum("fire_mask")).first()[0] == 0
