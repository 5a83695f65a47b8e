"""Metrics, guards, splits, ensembles, reports and sinks."""

import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import ensembles as en, evaluation as ev, ranking, reporting, splits
from emberline.session import DataError
from emberline.sources import tables

DAY = dt.date(2024, 1, 1)


def scored(spark, pairs, model="m", event=1):
    return spark.createDataFrame([(model, event, 1, 0, i, float(p), float(y)) for i, (p, y) in enumerate(pairs)],
                                 "model string, event_id long, day_idx int, row int, col int, p double, y double")


def metrics(spark, pairs):
    return ev.event_metrics(scored(spark, pairs)).first()


def test_empty_masks_score_one(spark):
    m = metrics(spark, [(0.1, 0), (0.2, 0)])
    assert (m.iou, m.dice) == (1.0, 1.0)


def test_partial_overlap_and_inclusive_threshold(spark):
    m = metrics(spark, [(0.5, 1), (0.9, 0), (0.1, 1)])
    assert math.isclose(m.iou, 1 / 3) and math.isclose(m.dice, 0.5)


def test_two_bin_ece(spark):
    m = metrics(spark, [(0.15, 0), (0.15, 1), (0.85, 1), (0.85, 1)])
    assert math.isclose(m.ece, 0.5 * 0.35 + 0.5 * 0.15)


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.1 * 3,), (1.0,)], "p double")
    assert [r[0] for r in df.select(ev.bin_of("p")).collect()] == [0, 0, 2, 2, 9]


def test_empty_bins_are_listed(spark):
    rows = ev.reliability_bins(scored(spark, [(0.95, 1)]), ["model"]).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0] * 9 + [1] and rows[0].mean_pred is None


def state(spark, masks, event=1):
    """masks: per day the list of burning columns of a 1 x 3 event."""
    rows = [(event, d, DAY + dt.timedelta(days=d), 0, c, float(c in m)) for d, m in enumerate(masks) for c in range(3)]
    return spark.createDataFrame(rows, "event_id long, day_idx int, day date, row int, col int, fire_mask double")


def forecast(spark, days, p=0.9, cols=range(3), event=1):
    return spark.createDataFrame([("m", event, d, 0, c, float(p)) for d in days for c in cols],
                                 "model string, event_id long, day_idx int, row int, col int, p double")


def test_truth_is_cumulative_and_anchor_excluded(spark):
    truth = ev.truth_cells(state(spark, [[], [0], [1], []]))
    out = {(r.day_idx, r.col): r.y for r in ev.score_join(forecast(spark, range(4)), truth).collect()}
    assert out == {(2, 0): 1.0, (2, 1): 1.0, (2, 2): 0.0, (3, 0): 1.0, (3, 1): 1.0, (3, 2): 0.0}


def test_trim_keeps_an_event_without_fire(spark):
    assert ev.trim_to_first_fire_day(state(spark, [[], []])).count() == 6
    assert ev.trim_to_first_fire_day(state(spark, [[], [1], []])).count() == 6


def test_short_event_is_an_error(spark):
    with pytest.raises(Exception, match="fewer than two days"):
        ev.exclude_anchor_day(state(spark, [[0]])).collect()
    with pytest.raises(DataError, match="fewer than two days"):
        ev.backtest(forecast(spark, [0]), state(spark, [[0]]))


@pytest.mark.parametrize("bad,fault", [
    (lambda f: f.filter("col < 2"), "missing cells"),
    (lambda f: f.union(f.filter("col = 0")), "repeated cell"),
    (lambda f: f.withColumn("p", F.lit(1.2)), "outside"),
    (lambda f: f.withColumn("p", F.lit(None).cast("double")), "outside"),
    (lambda f: f.withColumn("col", F.col("col") + 1), "cell outside the event"),
    (lambda f: f.withColumn("day_idx", F.lit(0)).distinct(), "missing cells"),
    (lambda f: f.filter("false"), "no prediction")])
def test_invalid_predictions(spark, bad, fault):
    truth = ev.truth_cells(state(spark, [[0], [1], []]))
    pred = bad(forecast(spark, [1, 2]))
    with pytest.raises(DataError, match=fault):
        ev.validate_prediction(pred, truth)


def test_event_without_prediction_is_an_error(spark):
    truth = ev.truth_cells(state(spark, [[0], [1]]).union(state(spark, [[0], [1]], event=2)))
    with pytest.raises(DataError, match="model without"):
        ev.validate_prediction(forecast(spark, [1]), truth)


def test_event_with_only_its_anchor_day_is_an_error(spark):
    truth = ev.truth_cells(state(spark, [[0], [1]]).union(state(spark, [[0], [1]], event=2)))
    with pytest.raises(DataError, match="event_id': 2.*missing cells"):
        ev.validate_prediction(forecast(spark, [1]).union(forecast(spark, [0], event=2)), truth)


def test_bootstrap(spark):
    one = spark.createDataFrame([("m", 1, 0.4, 0.5, 0.1, 0.2)], "model string, event_id long, iou double, dice double, brier double, ece double")
    r = {x.metric: x for x in ev.bootstrap_ci(one, 50).collect()}
    assert (r["iou"].point, r["iou"].lower, r["iou"].upper) == (0.4, 0.4, 0.4)
    two = one.union(spark.createDataFrame([("m", 2, 0.6, 0.7, 0.3, 0.4)], one.schema))
    a, b = (sorted(ev.bootstrap_ci(two, 200).collect()) for _ in range(2))
    assert a == b and all(x.lower <= x.point <= x.upper for x in a)
    assert ev.bootstrap_ci(one.filter("false"), 10).count() == 0


def test_registry(spark):
    reg = {}
    ev.register_model(reg, "x", lambda c: c.withColumn("p", F.lit(0.5)))
    with pytest.raises(ValueError):
        ev.register_model(reg, "x", lambda c: c)
    assert ev.predict_all(reg, state(spark, [[0]])).count() == 3


# ---------------------------------------------------------------- ranking
def test_median_and_running_total_are_exact(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([0.5, rnd.random(), rnd.random() * 1000])) for k in "ab" for _ in range(401 if k == "a" else 400)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r["median"] for r in ranking.exact_median(df, ["k"], "v").collect()}
    for k in "ab":
        assert math.isclose(got[k], float(np.median([v for q, v in rows if q == k])))
    r = ranking.value_ranks(df, ["k"], "v").filter("k = 'a'").collect()
    values = [v for q, v in rows if q == "a"]
    assert all(x.below == sum(v < x.v for v in values) and x.ties == values.count(x.v) for x in r)


# ---------------------------------------------------------------- splits
def prints(spark, rows):
    return spark.createDataFrame([(i, w, s, w + 0.01, s + 0.01, a, b) for i, w, s, a, b in rows],
                                 "event_id long, west double, south double, east double, north double, first_day date, last_day date")


def days(n):
    return DAY + dt.timedelta(days=n)


def gap(a, b):
    lat = math.radians((a["south"] + a["north"] + b["south"] + b["north"]) / 4)
    dx = max(0.0, max(a["west"], b["west"]) - min(a["east"], b["east"])) * 111.32 * math.cos(lat)
    dy = max(0.0, max(a["south"], b["south"]) - min(a["north"], b["north"])) * 110.57
    return math.hypot(dx, dy), max(0, (max(a["first_day"], b["first_day"]) - min(a["last_day"], b["last_day"])).days)


def random_prints(spark, n, seed, hot=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        d0 = rnd.randrange(0, 20)
        where = (-72.0 + rnd.random() * 0.03, -37.0 + rnd.random() * 0.03) if hot and i % 3 else (-72.5 + rnd.random(), -38 + rnd.random())
        rows.append((i, *where, days(d0), days(d0 + rnd.randrange(0, 3))))
    return prints(spark, rows)


@pytest.mark.parametrize("hot", [False, True])
def test_groups_leaks_and_nearest_match_brute_force(spark, hot):
    fp = random_prints(spark, 90, 7, hot)
    rows = {r.event_id: r.asDict() for r in fp.collect()}
    near = lambda a, b: (lambda g: g[0] <= 10 and g[1] <= 3)(gap(rows[a], rows[b]))
    label = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(rows, 2):
            if label[a] != label[b] and near(a, b):
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {r.event_id: r.group_id for r in splits.group_events(fp).collect()} == label
    split = splits.split_events(fp.select("event_id"), seed=3)
    where = {r.event_id: r.split for r in split.collect()}
    want = {(a, where[a], where[b]) for a in rows for b in rows if where[a] != where[b] and near(a, b)}
    assert {tuple(r) for r in splits.split_leakage(fp, split).collect()} == want
    pairs = {(a, b) for a, b in itertools.combinations(sorted(rows), 2) if where[a] != where[b] and near(a, b)}
    assert {(r.a_event_id, r.b_event_id) for r in splits.leaking_pairs(fp, split).collect()} == pairs
    best = {a: min((*gap(rows[a], rows[b]), b) for b in rows if where[b] != where[a]) for a in rows if where[a] != "train"}
    got = {r.event_id: (r.gap_km, r.gap_days, r.nearest_event_id) for r in splits.nearest_cross_split(fp, split).collect()}
    assert set(got) == set(best)
    for e in best:
        assert math.isclose(got[e][0], best[e][0], abs_tol=1e-9) and got[e][1:] == best[e][1:]


def test_far_nearest_is_found(spark):
    fp = prints(spark, [(1, -72.0, -37.0, days(0), days(1)), (2, 100.0, 60.0, days(0), days(1)), (3, -71.9, -37.0, days(0), days(1))])
    split = spark.createDataFrame([(1, "val"), (2, "train"), (3, "val")], "event_id long, split string")
    assert {r.nearest_event_id for r in splits.nearest_cross_split(fp, split).collect()} == {2}


def test_grouping_by_hand(spark):
    chain = [(i, -72.0 + 0.07 * i, -37.0, days(0), days(1)) for i in range(3)]
    late = [(9, -72.0, -37.0, days(11), days(12))]
    got = {r.event_id: r.group_id for r in splits.group_events(prints(spark, chain + late)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 9: 9}


@pytest.mark.parametrize("n,want", [(0, (0, 0, 0)), (2, (2, 0, 0)), (3, (1, 1, 1)), (10, (6, 2, 2)), (100, (70, 15, 15))])
def test_split_sizes(n, want):
    assert splits.split_sizes(n) == want


def test_split_is_a_partition_and_seeded(spark):
    ids = spark.range(40).withColumnRenamed("id", "event_id")
    one, two = (sorted(map(tuple, splits.split_events(x, 5).collect())) for x in (ids, ids.orderBy(F.desc("event_id"))))
    assert one == two and len(one) == 40
    assert one != sorted(map(tuple, splits.split_events(ids, 6).collect()))


def test_grouped_split_never_cuts_a_group(spark):
    fp = random_prints(spark, 60, 11, True)
    out = splits.split_events_grouped(fp).collect()
    per = {}
    for r in out:
        per.setdefault(r.group_id, set()).add(r.split)
    assert len(out) == 60 and all(len(s) == 1 for s in per.values())
    assert {r.split for r in out} == {"train", "val", "test"}
    assert splits.split_leakage(fp, spark.createDataFrame(out)).count() == 0
    with pytest.raises(DataError, match="independent groups"):
        splits.split_events_grouped(prints(spark, [(1, -72.0, -37.0, DAY, DAY), (2, -72.0, -37.0, DAY, DAY)]))


def test_shards(spark):
    paths = lambda n: spark.createDataFrame([(f"f{i}",) for i in range(n)], "path string")
    count = lambda n: sorted((r.split, r["count"]) for r in splits.split_shards(paths(n)).groupBy("split").count().collect())
    assert count(1) == [("train", 1)] and count(2) == [("train", 1), ("val", 1)] and count(20) == [("train", 17), ("val", 3)]


# ---------------------------------------------------------------- ensembles
def pairs(spark, rows):
    return spark.createDataFrame([(e, 1, 0, i, a, b, y) for i, (e, a, b, y) in enumerate(rows)],
                                 "event_id long, day_idx int, row int, col int, pa double, pb double, y double")


def test_weight_prefers_the_better_model_and_the_lower_on_a_tie(spark):
    good_b = pairs(spark, [(1, 0.9, 0.1, 0.0), (1, 0.1, 0.9, 1.0)])
    assert en.select_blend_weight(good_b) == 1.0
    assert en.select_blend_weight(pairs(spark, [(1, 0.4, 0.4, 0.0)])) == 0.0
    with pytest.raises(DataError):
        en.select_blend_weight(good_b.filter("false"))
    with pytest.raises(ValueError):
        en.blended(1.1)


def test_stacking_matches_newton_and_keeps_day_zero(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(300):
        a, b = rnd.uniform(0.05, 0.95), rnd.uniform(0.05, 0.95)
        rows.append((1, a, b, float(rnd.random() < 0.2 * a + 0.7 * b)))
    df = pairs(spark, rows)
    model = en.fit_stacking(df)
    lg = lambda p: math.log(p / (1 - p))
    x = np.array([[1, lg(a), lg(b)] for _, a, b, _ in rows])
    y = np.array([r[3] for r in rows])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    assert np.allclose([model.intercept, *model.coefficients], w, atol=1e-4)
    anchor = df.limit(1).select(*en.KEY, F.lit(1.0).alias("y"))
    key = anchor.first()
    out = en.stack(model, df, anchor).filter((F.col("col") == key.col) & (F.col("event_id") == key.event_id)).first()
    assert out.p == 1.0
    with pytest.raises(DataError):
        en.fit_stacking(df.filter("y = 1"))


def test_isotonic_clips_and_refuses_another_version(spark):
    df = spark.createDataFrame([(0.2, 0.0), (0.4, 1.0), (0.6, 0.0), (0.8, 1.0)], "p double, y double")
    cal = en.fit_isotonic(df, "v1")
    got = {r.p: r.q for r in en.calibrate(spark.createDataFrame([(0.0,), (0.4,), (0.5,), (1.0,)], "p double"), cal, "v1").collect()}
    assert got == {0.0: 0.0, 0.4: 0.5, 0.5: 0.5, 1.0: 1.0}
    with pytest.raises(DataError, match="v2"):
        en.calibrate(df, cal, "v2")
    with pytest.raises(DataError, match="non-finite"):
        en.fit_isotonic(df.withColumn("p", F.lit(float("nan"))), "v1")


def sequential_fit(levels):
    """(lo, hi, mean) blocks of (p, sum, weight) by one walk."""
    done = []
    for p, total, w in sorted(levels):
        done.append([p, p, total, w])
        while len(done) > 1 and done[-2][2] / done[-2][3] >= done[-1][2] / done[-1][3]:
            right = done.pop()
            done[-1] = [done[-1][0], right[1], done[-1][2] + right[2], done[-1][3] + right[3]]
    return [(lo, hi, total / w) for lo, hi, total, w in done]


@pytest.mark.parametrize("kind, span", [("rising", 8), ("falling", 8), ("noise", 50), ("late dip", 16)])
def test_isotonic_fit_in_ranges_equals_one_walk(spark, kind, span):
    rnd = random.Random(4)
    n = 1500
    label = {"rising": lambda i: float(rnd.random() < i / n), "falling": lambda i: float(rnd.random() > i / n), "noise": lambda i: rnd.random(),
             "late dip": lambda i: i / n if i < n - 5 else 0.0}[kind]
    rows = [(i / n, label(i)) for i in range(n)] + [(0.25, 1.0), (0.25, 0.0)]
    levels = {}
    for p, y in rows:
        total, w = levels.get(p, (0.0, 0))
        levels[p] = (total + y, w + 1)
    want = sequential_fit([(p, *v) for p, v in levels.items()])
    cal = en.fit_isotonic(spark.createDataFrame(rows, "p double, y double"), "v", span=span)
    steps = lambda blocks: [(lo, m) for i, (lo, _, m) in enumerate(blocks) if i == 0 or abs(m - blocks[i - 1][2]) > 1e-12]
    got = sorted((r.lo, r.hi, r["mean"]) for r in cal.blocks.collect())
    assert np.allclose(steps(got), steps(want), atol=1e-12)


def test_calibrator_is_stored_and_refused(spark, tmp_path):
    df = spark.createDataFrame([(0.2, 0.0), (0.4, 1.0), (0.6, 0.0), (0.8, 1.0)], "p double, y double")
    path = str(tmp_path / "cal")
    en.save_calibrator(en.fit_isotonic(df, "v1"), path)
    cal = en.load_calibrator(spark, path, "v1")
    got = {r.p: r.q for r in en.calibrate(spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.3, 0.5, 0.7, 0.9)] * 2, "p double"), cal, "v1").collect()}
    assert all(math.isclose(got[p], q, abs_tol=1e-12) for p, q in {0.0: 0.0, 0.2: 0.0, 0.3: 0.25, 0.5: 0.5, 0.7: 0.75, 0.9: 1.0}.items())
    with pytest.raises(DataError, match="v1 does not belong to v2"):
        en.load_calibrator(spark, path, "v2")


# ---------------------------------------------------------------- reports
def test_percentile_rank_counts_ties_half(spark):
    mk = lambda vs: spark.createDataFrame([("d", float(v)) for v in vs], "descriptor string, value double")
    got = {r.value: r["rank"] for r in reporting.percentile_rank(mk([1, 2, 9, 0]), mk([1, 2, 2, 3])).collect()}
    assert got == {1.0: 0.125, 2.0: 0.5, 9.0: 1.0, 0.0: 0.0}


def test_hypotheses(spark):
    mk = lambda rows: spark.createDataFrame(rows, "event_id long, split string, descriptor string, value double")
    train = mk([(i, "train", d, float(v)) for d in ("true_cells_final", "mean_slope_deg") for i, v in enumerate((10, 20, 30, 40))])
    out = {r.descriptor: (r.flag, r.hypothesis) for r in reporting.descriptor_analysis(
        mk([(9, "test", "true_cells_final", 10.0), (9, "test", "mean_slope_deg", 25.0)]), train).collect()}
    assert out == {"true_cells_final": ("low", "size"), "mean_slope_deg": ("inside", None)}


def test_best_model(spark):
    agg = spark.createDataFrame([("a", "iou", 0.5, 0.4, 0.6), ("b", "iou", 0.5, 0.55, 0.7), ("a", "brier", 0.2, 0.1, 0.3), ("b", "brier", 0.05, 0.0, 0.06)],
                                "model string, metric string, point double, lower double, upper double")
    got = {r.metric: (r.best, r.overlapping, r.verdict) for r in reporting.best_model_per_metric(agg, ["b", "a"]).collect()}
    assert got == {"iou": ("b", "a", "not distinguishable"), "brier": ("b", "", "distinct")}
    assert {r.metric: r.all_overlap for r in reporting.all_intervals_overlap(agg).collect()} == {"iou": True, "brier": False}


def test_wind_spread_of_descriptors(spark):
    rows = [(1, d, days(d), 0, 0, u, v, 1.0, 1.0, 1.0, 290.0, 50.0, 0.0) for d, (u, v) in enumerate([(1.0, 0.0), (0.0, 1.0)])]
    cells = spark.createDataFrame(rows, "event_id long, day_idx int, day date, row int, col int, wind_u double, wind_v double, elevation double, "
                                        "slope_deg double, fuel_type double, temperature double, relative_humidity double, fire_mask double")
    r = reporting.event_descriptors(cells).first()
    assert math.isclose(r.wind_dir_circ_std_deg, math.degrees(math.sqrt(-2 * math.log(math.sqrt(0.5)))))
    assert reporting.event_descriptors(cells.filter("day_idx = 0")).first().wind_dir_circ_std_deg == 0.0


# ---------------------------------------------------------------- sinks
def test_unknown_event_writes_nothing(spark, tmp_path):
    per = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4), (2, 0.1, 0.2, 0.3, 0.4)], "event_id long, iou double, dice double, brier double, ece double")
    events = spark.createDataFrame([(1, 11)], "firms_event_id long, id long")
    path = tmp_path / "runs"
    with pytest.raises(DataError, match="unknown event"):
        tables.append_runs(per, events, "m", "test", "{}", str(path))
    assert not path.exists()
    tables.append_runs(per.filter("event_id = 1"), events, "m", "test", "{}", str(path))
    assert tables.read_runs(spark, str(path))[1].count() == 4


def test_results_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"model_name": "a", "split": "test", "per_event": [
        {"event_id": 3, "iou": 0.5, "dice": 0.6, "brier": 0.1, "ece": 0.2}]}, indent=1))
    (tmp_path / "k.json").write_text(json.dumps({"kind": "artifacts"}))
    rows, kinds = tables.load_results(spark, str(tmp_path))
    assert [(r.model, r.event_id, r.iou) for r in rows.collect()] == [("a", 3, 0.5)]
    assert [r.kind for r in kinds.collect()] == ["artifacts"]


def test_one_elevation_layer(spark):
    mk = lambda srcs: spark.createDataFrame([("elevation", None, 0, 0, 1.0, s) for s in srcs], "layer string, day date, row int, col int, value double, source string")
    assert tables.require_one_elevation(mk(["a"])).count() == 1
    for bad in ([], ["a", "b"]):
        with pytest.raises(DataError):
            tables.require_one_elevation(mk(bad))


def first_fit(groups, need, keep):
    """The rule of the grouped split on a list of (id, size) in order: ids taken."""
    left, taken, have = list(groups), [], 0
    while have < need and len(left) > keep:
        fits = [g for g in left if g[1] <= need - have]
        chosen = fits[0] if fits else min(left, key=lambda g: g[1])
        left.remove(chosen)
        taken.append(chosen[0])
        have += chosen[1]
    return taken


@pytest.mark.parametrize("sizes, need, keep", [
    ([5, 1, 4, 1, 3, 1, 2, 1, 1], 7, 2), ([9, 9, 9], 4, 2), ([1, 1, 1, 1], 30, 2), ([50, 2, 50, 3, 50, 1, 2], 5, 1), ([3, 8, 3, 7, 3, 6, 2, 5], 12, 2), ([2, 2, 2], 1, 1)])
def test_first_fit_in_rounds(spark, sizes, need, keep):
    groups = [(i, n, f"{i:064x}") for i, n in enumerate(sizes)]
    df = spark.createDataFrame(groups, "group_id int, size long, digest string")
    got = sorted(r.group_id for r in splits._first_fit(df, need, len(sizes) - keep).collect())
    assert got == sorted(first_fit([g[:2] for g in groups], need, keep))


def test_a_crowded_place_is_searched_in_proportion(spark, monkeypatch):
    """Footprints of one place all overlap: parts answer with their least id, and what is joined grows with the events."""
    rows, real = [], splits.durable

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out
    monkeypatch.setattr(splits, "durable", counted)
    seen = []
    for n in (120, 480):
        rnd = random.Random(n)
        fp = prints(spark, [(i, -72.0 + rnd.random() * 0.004, -37.0 + rnd.random() * 0.004, days(d := rnd.randrange(0, 30)), days(d + rnd.randrange(0, 3))) for i in range(n)])
        split = spark.createDataFrame([(i, ("train", "train", "train", "val", "test")[i % 5]) for i in range(n)], "event_id long, split string")
        rows.clear()
        got = splits.nearest_cross_split(fp, split).collect()
        assert len(got) == n // 5 * 2 and all(r.gap_km == 0 for r in got)
        seen.append(sum(rows))
    assert seen[1] <= 6 * seen[0], seen
