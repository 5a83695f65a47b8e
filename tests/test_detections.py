"""Loading and clustering, with cases computed by hand and brute force on small fixtures."""

import datetime as dt
import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.functions.when import day_chunks, month_chunks, parse_acq_time
from emberline.operators import clustering, components
from emberline.operators.proximity import near_groups
from emberline.session import DataError
from emberline.sources import detections as src

T0 = dt.datetime(2026, 1, 15, 0, 5)
STEP = 700 / 111194.93  # 700 m of latitude


def frame(spark, rows):
    return spark.createDataFrame([(float(a), float(o), t) for a, o, t in rows],
                                 "latitude double, longitude double, detected_at timestamp")


def brute_force(rows, near_m=750.0, days=2):
    def hav(p, q):
        a1, a2 = math.radians(p[0]), math.radians(q[0])
        h = math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))
    parent = list(range(len(rows)))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if abs(rows[i][2] - rows[j][2]) <= dt.timedelta(days=days) and hav(rows[i], rows[j]) <= near_m:
            parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), set()).add(r)
    return {frozenset(g) for g in groups.values()}


def clusters(spark, rows):
    out = {}
    for r in clustering.cluster_detections(frame(spark, rows)).collect():
        out.setdefault(r.event_id, set()).add((r.latitude, r.longitude, r.detected_at))
    return {frozenset(g) for g in out.values()}, set(out)


def test_acq_time_lost_zeros(spark):
    df = spark.createDataFrame([("2026-01-15", "517"), ("2026-01-15", "0005"), ("2026-01-15", "5")], "d string, t string")
    got = [r[0] for r in df.select(F.date_format(parse_acq_time("d", "t"), "HH:mm")).collect()]
    assert got == ["05:17", "00:05", "00:05"]


def test_chain_is_one_event_and_time_separates(spark):
    chain = [(-37 + i * STEP, -72.0, T0 + dt.timedelta(days=i)) for i in range(3)]
    assert len(clusters(spark, chain)[0]) == 1
    apart = [(-37.0, -72.0, T0), (-37.0, -72.0, T0 + dt.timedelta(days=30))]
    assert len(clusters(spark, apart)[0]) == 2


def test_time_limit_is_inclusive(spark):
    two = dt.timedelta(days=2)
    assert len(clusters(spark, [(-37.0, -72.0, T0), (-37.0, -72.0, T0 + two)])[0]) == 1
    assert len(clusters(spark, [(-37.0, -72.0, T0), (-37.0, -72.0, T0 + two + dt.timedelta(seconds=1))])[0]) == 2


@pytest.mark.parametrize("seed,spread", [(1, 0.02), (2, 0.06)])
def test_clusters_match_brute_force(spark, seed, spread):
    rnd = random.Random(seed)
    rows = list({(round(-37 + rnd.random() * spread, 5), round(-72 + rnd.random() * spread, 5),
                  T0 + dt.timedelta(minutes=rnd.randrange(0, 20 * 1440))) for _ in range(250)})
    got, ids = clusters(spark, rows)
    assert got == brute_force(rows)
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    assert clusters(spark, shuffled)[1] == ids


def test_date_line_and_pole(spark):
    rows = [(0.0, 179.999, T0), (0.0, -179.999, T0), (89.9999, 10.0, T0), (89.9999, -170.0, T0)]
    assert len(clusters(spark, rows)[0]) == 2


def test_refinement_of_large_groups_is_exact(spark):
    """A tiny budget sends every pair of bricks through the finer parts."""
    rnd = random.Random(5)
    rows = list({(round(-37 + rnd.random() * 0.02, 6), round(-72 + rnd.random() * 0.02, 6),
                  T0 + dt.timedelta(minutes=rnd.randrange(0, 6 * 1440))) for _ in range(300)})
    bricked = clustering.with_bricks(frame(spark, rows))
    plain = {(r.a, r.b) for r in clustering.detection_links(bricked).collect()}
    original = clustering.near_groups
    try:
        clustering.near_groups = lambda *a, **k: near_groups(*a, **{**k, "budget": 1})
        fine = {(r.a, r.b) for r in clustering.detection_links(bricked).collect()}
    finally:
        clustering.near_groups = original
    assert plain and fine == plain


def set_id(rows):
    """The id of a set of detections, from its keys alone."""
    digests = [hashlib.sha256(f"{t.isoformat()}+00:00|{a:.6f}|{o:.6f}".encode()).hexdigest() for a, o, t in rows]
    sums = [sum(int(d[i:i + 15], 16) for d in digests) % (1 << 60) for i in (0, 15)]
    return int(hashlib.sha256("|".join(map(str, (len(rows), *sums))).encode()).hexdigest()[:15], 16)


def test_stable_id_is_the_digest_of_the_set_of_keys(spark):
    rows = [(-37.5, -72.25, T0), (-37.5001, -72.25, T0 + dt.timedelta(hours=3))]
    assert clusters(spark, rows)[1] == {set_id(rows)} == clusters(spark, rows[::-1])[1]


def test_one_id_at_every_size_and_partitioning(spark):
    rows = [(-37.0 - i % 7 / 1e4, -72.0 - i % 5 / 1e4, T0 + dt.timedelta(minutes=i)) for i in range(900)]
    for parts in (1, 3, 17):
        got = clustering.stable_ids(frame(spark, rows[::-1]).repartition(parts).withColumn("g", F.lit(1)), "g").first().event_id
        assert got == set_id(rows)
    assert clusters(spark, rows)[1] == {set_id(rows)}  # added up over bricks
    assert clustering.stable_ids(frame(spark, rows[:-1]).withColumn("g", F.lit(1)), "g").first().event_id != set_id(rows)


def test_digests_that_meet_in_one_id_are_told_apart(spark, monkeypatch):
    rows = spark.range(60).selectExpr("cast(id as int) as g", "1L as n", "cast(id % 40 as decimal(28,0)) as da", "cast(7 as decimal(28,0)) as db")
    real = F.sha2
    monkeypatch.setattr(clustering.F, "sha2", lambda c, bits: F.concat(F.lit("00000000000000"), F.substring(real(c, bits), 1, 50)))
    got = {r.g: r.event_id for r in clustering.ids_of_digests(rows).collect()}  # ids of four bits
    plain = {r.g: r.event_id for r in clustering.ids_of_digests(rows.filter("g < 3")).collect()}
    assert all(got[i] == got[i + 40] for i in range(20)) and len(set(plain.values())) <= 3 and len(set(got.values())) > 8


def test_hot_keys_join_like_any_other(spark):
    from emberline.operators.skew import join_counted
    left = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 3), ("c", 1)) for i in range(n)], "k string, i int")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").filter("k <> 'c'")
    plain, split = (sorted(map(tuple, join_counted(left, right, "k", h).select("k", "i", "n").collect())) for h in (100, 10))
    assert plain == split and len(plain) == 53


@pytest.mark.parametrize("shape", ["path", "star", "forest"])
def test_components(spark, shape):
    rnd = random.Random(3)
    if shape == "path":
        edges = [(i, i + 1) for i in range(300)]
    elif shape == "star":
        edges = [(0, i) for i in range(1, 200)]
    else:
        edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)]
    label = {i: i for e in edges for i in e} | {900: 900}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    v = spark.createDataFrame([(i,) for i in label], "v long")
    out = components.connected_components(v, spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == len(label)
    groups = {}
    for r in out:
        groups.setdefault(r.root, set()).add(label[r.v])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(label.values()))


def raw(spark, rows):
    return spark.createDataFrame(rows, "latitude string, longitude string, acq_date string, acq_time string, confidence string, "
                                       "satellite string, instrument string, frp string, seq int")


ROW = ("-37.5", "-72.5", "2026-01-15", "0005", "n", "N", "VIIRS", "1.5", 1)


def test_first_delivery_wins_and_key_is_as_delivered(spark):
    again = ROW[:4] + ("h",) + ROW[5:8] + (2,)
    other_text = ROW[:3] + ("5",) + ROW[4:8] + (3,)
    out = src.load_detections(raw(spark, [again, ROW, other_text])).collect()
    assert sorted(r.confidence for r in out) == ["n", "n"] and len(out) == 2


def test_blank_frp_is_missing(spark):
    assert src.to_detections(raw(spark, [ROW[:7] + ("", 1)])).first().frp is None


def test_missing_column_is_named(spark):
    with pytest.raises(DataError, match="acq_time"):
        src.to_detections(raw(spark, [ROW]).drop("acq_time"))


def test_bad_coordinates_fail(spark):
    with pytest.raises(Exception, match="out of range"):
        src.to_detections(raw(spark, [("-95",) + ROW[1:]])).collect()


def test_missing_folder_reads_empty(spark, tmp_path):
    assert src.load_detections(src.read_landed(spark, str(tmp_path / "none"))).count() == 0


def test_csv_and_error_body(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("latitude,longitude,acq_date,acq_time,satellite,instrument,confidence,frp\n"
                                     "-37.1,-72.1,2026-01-15,517,N,VIIRS,n,2.5\n")
    (tmp_path / "bad.csv").write_text("Invalid key.\n")
    r = src.read_detections_csv(spark, str(tmp_path / "ok.csv")).first()
    assert (r.frp, r.detected_at) == (2.5, dt.datetime(2026, 1, 15, 5, 17))
    with pytest.raises(DataError):
        src.read_detections_csv(spark, str(tmp_path / "bad.csv"))


def test_days_must_be_one_to_five(spark):
    with pytest.raises(ValueError):
        src.active_fires(src.to_detections(raw(spark, [ROW])), "2026-01-15", 6)


def test_point_outside_area_names_the_box(spark):
    with pytest.raises(Exception, match="-73.7"):
        src.require_in_study_area(spark.createDataFrame([(-60.0, -37.0)], "lon double, lat double")).collect()


def test_chunks(spark):
    df = spark.sql("select date '2026-01-20' as a, date '2026-03-05' as b")
    got = [(str(c.start), str(c.end)) for c in df.select(month_chunks("a", "b")).first()[0]]
    assert got == [("2026-01-20", "2026-01-31"), ("2026-02-01", "2026-02-28"), ("2026-03-01", "2026-03-05")]
    assert len(df.select(day_chunks("a", "b")).first()[0]) == 9
    with pytest.raises(Exception, match="end is before start"):
        df.select(month_chunks("b", "a")).collect()


def test_tiles_are_open_at_the_upper_edge(spark):
    df = spark.sql("select -72.5D as w, -38.0D as s, -71.0D as e, -37.0D as n")
    got = [(t.lat, t.lon) for t in df.select(geo.tiles("elevation", "w", "s", "e", "n")).first()[0]]
    assert got == [(-38, -73), (-38, -72)]
    assert [(t.lat, t.lon) for t in df.select(geo.tiles("landcover", "w", "s", "e", "n")).first()[0]] == [(-39, -75), (-39, -72)]
