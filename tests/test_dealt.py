"""Tables that unroll to many rows a row are spread first, whatever their files look like."""

import pytest
from pyspark.sql import functions as F

from emberline.sources import fixtures

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["weather_hourly", "reflectance_obs", "event_cell_day", "predictions"])
def test_no_task_unrolls_a_whole_table(spark, monkeypatch, name):
    whole = getattr(fixtures, name)(spark, D)
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 2000)
    dealt = getattr(fixtures, name)(spark, D)
    tasks = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == whole.count() and max(tasks) <= 2 * 2000
    assert dealt.exceptAll(whole).isEmpty()
