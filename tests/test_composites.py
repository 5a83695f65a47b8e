"""Composites of all months at once against those of single months."""

from pyspark.sql import functions as F

from emberline.operators import vegetation


def test_all_months_at_once(spark):
    obs = spark.range(4000).selectExpr(
        "id % 25 as cell_id", "cast(id % 12 as int) as scl", "cast(id * 7 % 100 as int) as cloud_cover", "double(id * 31 % 997) as red",
        "if(id % 13 = 0, null, double(id * 17 % 1009)) as nir", "date_add(date'2023-11-20', cast(id % 100 as int)) as scene_day")
    every = vegetation.monthly_composites(obs)
    for year, month in ((2023, 11), (2023, 12), (2024, 1), (2024, 2)):
        one = sorted(map(tuple, vegetation.monthly_composite(obs, year, month).collect()))
        of = every.filter((F.col("year") == year) & (F.col("month") == month)).select("cell_id", "red", "nir")
        assert sorted(map(tuple, of.collect())) == one and one
    assert every.select("year", "month").distinct().count() == 4
    assert vegetation.monthly_composites(obs.filter("false")).count() == 0
