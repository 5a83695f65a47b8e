"""Links between bricks come once each, without a last shuffle of all of them."""

import datetime as dt
import random

from emberline.operators.clustering import brick_items, detection_links, with_bricks
from emberline.operators.components import connected_components


def _bricked(spark, places):
    day = dt.datetime(2024, 1, 5)
    rows = [(la, lo, day + dt.timedelta(seconds=s)) for la, lo, s in places]
    return with_bricks(spark.createDataFrame(rows, "latitude double, longitude double, detected_at timestamp"))


def test_links_once_each_with_and_without_parts(spark):
    r = random.Random(2)
    sparse = [(-38 + r.random() / 40, -72 + r.random() / 40, r.randrange(500_000)) for _ in range(150)]
    dense = [(-37.5 + r.random() / 150, -72 + r.random() / 150, r.randrange(300_000)) for _ in range(1500)]  # more than 4096 pairs of items
    for places in (sparse, dense):
        bricked = _bricked(spark, places)
        links = [(r.a, r.b) for r in detection_links(bricked).collect()]
        assert links and len({frozenset(p) for p in links}) == len(links) and all(a != b for a, b in links)
        vertices = brick_items(bricked).select("g").distinct().withColumnRenamed("g", "v")
        groups = lambda unique: sorted((r.v, r.root) for r in connected_components(vertices, detection_links(bricked), unique).collect())
        assert groups(True) == groups(False)


def test_whole_pairs_are_not_shuffled_again(spark):
    links = detection_links(_bricked(spark, [(-38 + i / 500, -72.0, 60 * i) for i in range(30)]))
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Union")]
