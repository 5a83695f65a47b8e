"""Streams over the landing folder: late rows, re-downloads, restarts."""

from pyspark.sql import functions as F

from emberline.streaming import detections as live


def land(spark, base, rows):
    cols = [c.split()[0] for c in live.RAW_SCHEMA.split(", ")]
    full = [(lat, "-72.01", day, "1305", "N", "VIIRS", "h", frp, arrived) for lat, day, frp, arrived in rows]
    spark.createDataFrame(full, ", ".join(f"{c} string" for c in cols)).coalesce(1).write.mode("append").parquet(f"{base}/raw")


def run_both(spark, base, out):
    live.run_available(live.stream_detections(live.read_landing(spark, base)), f"{out}/t1")
    live.run_available(live.density_parts(live.stream_detections(live.read_landing(spark, base))), f"{out}/t2")
    return spark.read.parquet(f"{out}/t1/data"), live.read_density(spark, f"{out}/t2")


def test_late_rows_come_out_and_copies_count_once(spark, tmp_path):
    base, out = str(tmp_path / "landing"), str(tmp_path / "out")
    land(spark, base, [("-37.05", "2024-01-20", "5.5", "2024-01-21"), ("-37.05", "2024-01-20", "5.5", "2024-01-21")])
    found, density = run_both(spark, base, out)
    assert found.count() == 1 and [(r.n, r.frp) for r in density.collect()] == [(1, 5.5)]
    # seven rows years behind, from an older download, a copy of the first landing and one new row on its day without a power
    land(spark, base, [(f"-37.{i}5", f"20{i + 10}-01-01", "1.0", "2019-01-01") for i in range(1, 8)]
         + [("-37.05", "2024-01-20", "5.5", "2024-02-02"), ("-37.06", "2024-01-20", "", "2024-02-02")])
    found, density = run_both(spark, base, out)
    assert found.count() == 9 and found.filter(F.year("detected_at") < 2020).count() == 7
    assert density.agg(F.sum("n")).first()[0] == 9
    assert [(r.n, r.frp) for r in density.filter("day = date'2024-01-20'").collect()] == [(2, 5.5)]
    again, density = run_both(spark, base, out)  # nothing new has landed
    assert again.count() == 9 and density.agg(F.sum("n")).first()[0] == 9


def test_density_equals_the_batch_sum(spark, tmp_path):
    base, out = str(tmp_path / "landing"), str(tmp_path / "out")
    rows = [(f"-{37 + i % 40 / 100:.2f}", f"2024-01-{1 + i % 9:02d}", str(i), "2024-02-01") for i in range(3000)]
    land(spark, base, rows)
    land(spark, base, rows[::3])
    found, density = run_both(spark, base, out)
    want = found.groupBy(F.to_date("detected_at").alias("day"), (F.floor(F.col("latitude") / 0.1) * 0.1).alias("south")).agg(
        F.count("*").alias("n"), F.sum("frp").alias("frp"))
    listed = lambda df: sorted((r.day, r.south, r.n, r.frp) for r in df.collect())
    assert listed(density) == listed(want) and found.count() == len({(lat, day) for lat, day, _, _ in rows})


def test_empty_landing(spark, tmp_path):
    base, out = str(tmp_path / "landing"), str(tmp_path / "out")
    land(spark, base, [])
    found, density = run_both(spark, base, out)
    assert density.count() == 0
