"""The nearest event of another split over long periods."""

import datetime as dt
import random

from emberline.operators import splits


def test_a_long_period_is_searched_in_proportion(spark, monkeypatch):
    """Four times the events over four times the days: what is joined grows with the events, not with events times days."""
    rows, real = [], splits.durable

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out
    monkeypatch.setattr(splits, "durable", counted)
    seen = []
    for n in (150, 600):
        rnd = random.Random(n)
        box = [(i, -72.0 + 0.05 * (i % 7), -37.0, dt.date(2000, 1, 1) + dt.timedelta(rnd.randrange(10 * n)), rnd.randrange(3)) for i in range(n)]
        fp = spark.createDataFrame([(i, x, y, x + 0.02, y + 0.02, d, d + dt.timedelta(k)) for i, x, y, d, k in box],
                                   "event_id long, west double, south double, east double, north double, first_day date, last_day date")
        of = lambda i: ("train", "train", "train", "val", "test")[i % 5]
        split = spark.createDataFrame([(i, of(i)) for i in range(n)], "event_id long, split string")
        rows.clear()
        got = {r.event_id: (r.gap_days, r.nearest_event_id) for r in splits.nearest_cross_split(fp, split).collect()}
        seen.append(sum(rows))
        for a in [b for b in box if of(b[0]) != "train"]:
            near = [(max((max(a[3], b[3]) - min(a[3] + dt.timedelta(a[4]), b[3] + dt.timedelta(b[4]))).days, 0), b[0])
                    for b in box if of(b[0]) != of(a[0]) and b[0] % 7 == a[0] % 7]
            assert got[a[0]] == min(near)
    assert seen[1] <= 6 * seen[0], seen
