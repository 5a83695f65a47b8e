"""Queries over event footprints and splits."""

from pyspark.sql import functions as F

from checks.registry import check
from checks.utm_sql import lonlat
from emberline.functions import geo
from emberline.operators import assembly, splits
from emberline.sources import fixtures

KM = """sqrt(power(greatest(0, greatest(a.west, b.west) - least(a.east, b.east)) * 111.32
   * cos(radians((a.south + a.north + b.south + b.north) / 4)), 2)
   + power(greatest(0, greatest(a.south, b.south) - least(a.north, b.north)) * 110.57, 2))"""
DAYS = "greatest(0, greatest(a.first_day, b.first_day) - least(a.last_day, b.last_day))"
COUPLED = f"""
gap as (select a.event_id as a, b.event_id as b, {KM} as gap_km, {DAYS} as gap_days
        from footprints a join footprints b on a.event_id <> b.event_id),
coupled as (select * from gap where gap_km <= 10 and gap_days <= 3)"""
GROUPS = COUPLED + """,
reach(id, low) as (select event_id, event_id from footprints union
  select c.b, r.low from reach r join coupled c on c.a = r.id where r.low < c.b),
grp as (select id as event_id, min(low) as group_id from reach group by id)"""
GROUPED = GROUPS + """,
sizes as (select group_id, count(*) as size from grp group by group_id),
tot as (select count(*) as g, sum(size) as n from sizes),
want as (select g, n, greatest(1, round_even(n * 0.15::double, 0)) as n_val, greatest(1, round_even(n * (1 - 0.7::double - 0.15::double), 0)) as n_test from tot),
ordered as (select s.*, w.*, row_number() over (order by sha256('42|' || group_id)) as pos from sizes s, want w),
scan1(pos, used, cnt, took) as (select 0::bigint, 0::hugeint, 0, false union all
  select pos, used + case when fits then size else 0 end, cnt + fits::int, fits from (
    select o.pos, o.size, s.used, s.cnt, (o.size <= o.n_test - s.used and s.cnt < o.g - 2) as fits from scan1 s join ordered o on o.pos = s.pos + 1) x),
end1 as (select max(used) as used, max(cnt) as cnt from scan1),
held1 as (select group_id from ordered o join scan1 using (pos) where took union
  select group_id from (select o.group_id from ordered o, end1 e where e.used < o.n_test and e.cnt < o.g - 2
    and o.pos not in (select pos from scan1 where took) order by o.size, o.pos limit 1) y),
rest as (select o.group_id, o.size, o.n_val, count(*) over () as g, row_number() over (order by o.pos) as pos from ordered o
  where o.group_id not in (select group_id from held1)),
scan2(pos, used, cnt, took) as (select 0::bigint, 0::hugeint, 0, false union all
  select pos, used + case when fits then size else 0 end, cnt + fits::int, fits from (
    select o.pos, o.size, s.used, s.cnt, (o.size <= o.n_val - s.used and s.cnt < o.g - 1) as fits from scan2 s join rest o on o.pos = s.pos + 1) x),
end2 as (select max(used) as used, max(cnt) as cnt from scan2),
held2 as (select group_id from rest o join scan2 using (pos) where took union
  select group_id from (select o.group_id from rest o, end2 e where e.used < o.n_val and e.cnt < o.g - 1
    and o.pos not in (select pos from scan2 where took) order by o.size, o.pos limit 1) y),
named as (select group_id, case when group_id in (select group_id from held1) then 'test'
  when group_id in (select group_id from held2) then 'val' else 'train' end as split from ordered),
gsplit as (select grp.event_id, named.split, grp.group_id from grp join named using (group_id))"""
PLAIN = """
n as (select count(*) as n, greatest(1, round_even(count(*) * 0.15::double, 0)) as n_val, greatest(1, round_even(count(*) * (1 - 0.7::double - 0.15::double), 0)) as n_test from footprints),
o as (select event_id, row_number() over (order by sha256('42|' || event_id)) - 1 as pos from footprints),
plain as (select event_id, case when pos < n - n_val - n_test then 'train' when pos < n - n_test then 'val' else 'test' end as split from o, n)"""


def prints(spark, d):
    return fixtures.footprints(spark, d)


def plain(spark, d):
    return splits.split_events(prints(spark, d).select("event_id"))


def centre(df):
    """Footprints as one point pair each, for the gap functions."""
    rename = lambda p: [F.col(c).alias(p + c) for c in df.columns]
    shifted = df.withColumns({"west": F.col("west") + 0.1, "east": F.col("east") + 0.1, "south": F.col("south") - 0.05,
                              "north": F.col("north") - 0.05, "first_day": F.date_add("first_day", 5),
                              "last_day": F.date_add("last_day", 5)})
    return df.select(rename("a_")).join(shifted.select(rename("b_")), F.col("a_event_id") == F.col("b_event_id"))


SHIFTED = """
s as (select event_id, west + 0.1::double as west, east + 0.1::double as east, south - 0.05::double as south,
  north - 0.05::double as north, first_day + 5 as first_day, last_day + 5 as last_day from footprints)"""


@check("x25_footprint_gap_km", "a_event_id:i km:f", "footprints", SHIFTED + f""",
result as (select a.event_id as a_event_id, {KM} as km from footprints a join s b using (event_id))""")
def _(spark, d):
    return centre(prints(spark, d)).withColumn("km", geo.footprint_gap_km("a_", "b_"))


@check("x26_footprint_gap_days", "a_event_id:i days:i", "footprints", SHIFTED + f""",
result as (select a.event_id as a_event_id, {DAYS} as days from footprints a join s b using (event_id))""")
def _(spark, d):
    return centre(prints(spark, d)).withColumn("days", geo.footprint_gap_days("a_", "b_"))


@check("j10_coupled_events", "a_i:i a_j:i a_s:i b_i:i b_j:i b_s:i", "footprints", COUPLED + """,
brick as (select event_id, floor(south * (2 * 110.57 / 10)) as i, floor(west * (2 * 111.32 / 10)) as j,
  floor((first_day - date '1970-01-01') / 4) as s from footprints),
result as (select distinct p.i as a_i, p.j as a_j, p.s as a_s, q.i as b_i, q.j as b_j, q.s as b_s
  from coupled c join brick p on p.event_id = c.a join brick q on q.event_id = c.b where (p.i, p.j, p.s) < (q.i, q.j, q.s))""")
def _(spark, d):
    links = splits.coupled_bricks(splits.with_bricks(prints(spark, d)))
    return links.select([F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in "ijs"])


@check("a6_group_events", "event_id:i group_id:i", "footprints", GROUPS + ", result as (select * from grp)", recursive=True)
def _(spark, d):
    return splits.group_events(prints(spark, d))


@check("p1_split_events", "event_id:i split:s", "footprints", PLAIN + ", result as (select * from plain)")
def _(spark, d):
    return plain(spark, d)


@check("p2_split_events_grouped", "event_id:i split:s group_id:i", "footprints", GROUPED + ", result as (select * from gsplit)", recursive=True)
def _(spark, d):
    return splits.split_events_grouped(prints(spark, d))


@check("p3_split_shards", "path:s split:s", "", """
paths as (select distinct doc.source || '/' || lang as path from documents doc),
o as (select path, row_number() over (order by sha256('42|' || path)) - 1 as pos, count(*) over () as n from paths),
result as (select path, case when n < 2 or pos < n - least(greatest(1, round_even(n * (1 - 0.85::double), 0)), n - 1) then 'train' else 'val' end as split from o)""")
def _(spark, d):
    docs = fixtures.table(spark, d, "documents")
    return splits.split_shards(docs.select(F.concat_ws("/", "source", "lang").alias("path")))


@check("p4_resplit", "event_id:i split:s previous_split:s leaks:i", "footprints", GROUPED + "," + PLAIN + """,
leaky as (select distinct c.a from coupled c join plain x on x.event_id = c.a join plain y on y.event_id = c.b where x.split <> y.split),
result as (select g.event_id, g.split, p.split as previous_split, (l.a is not null)::int as leaks
  from gsplit g join plain p using (event_id) left join leaky l on l.a = g.event_id)""", recursive=True)
def _(spark, d):
    new, leaks = splits.resplit(prints(spark, d), plain(spark, d))
    flag = leaks.select("event_id").distinct().withColumn("leaks", F.lit(1))
    return new.join(flag, "event_id", "left").withColumn("leaks", F.coalesce("leaks", F.lit(0)))


@check("j11_split_leakage", "event_id:i split:s other_split:s", "footprints", COUPLED + "," + PLAIN + """,
result as (select distinct x.event_id, x.split, y.split as other_split from coupled c
  join plain x on x.event_id = c.a join plain y on y.event_id = c.b where x.split <> y.split)""")
def _(spark, d):
    return splits.split_leakage(prints(spark, d), plain(spark, d))


@check("j11_leaking_pairs", "a_event_id:i split_a:s b_event_id:i split_b:s gap_km:f gap_days:i", "footprints", COUPLED + "," + PLAIN + """,
result as (select c.a as a_event_id, x.split as split_a, c.b as b_event_id, y.split as split_b, gap_km, gap_days from coupled c
  join plain x on x.event_id = c.a join plain y on y.event_id = c.b where x.split <> y.split and c.a < c.b)""")
def _(spark, d):
    return splits.leaking_pairs(prints(spark, d), plain(spark, d))


NEAREST = """,
best as (select x.event_id, x.split, y.event_id as nearest_event_id, y.split as nearest_split, gap_km, gap_days,
   row_number() over (partition by x.event_id order by gap_km, gap_days, y.event_id) as rn
 from gap c join plain x on x.event_id = c.a join plain y on y.event_id = c.b where x.split <> y.split and x.split <> 'train'),
nearest as (select * from best where rn = 1)"""


@check("j12_nearest_cross_split", "event_id:i split:s nearest_event_id:i nearest_split:s gap_km:f gap_days:i", "footprints",
       COUPLED + "," + PLAIN + NEAREST + ", result as (select * from nearest)")
def _(spark, d):
    return splits.nearest_cross_split(prints(spark, d), plain(spark, d))


@check("a27_split_audit", "event_id:i nearest_event_id:i gap_km:f leaks:i n_groups:i n_leaking:i", "footprints",
       GROUPS + "," + PLAIN + NEAREST + """,
leaky as (select distinct c.a from coupled c join plain x on x.event_id = c.a join plain y on y.event_id = c.b where x.split <> y.split),
result as (select n.*, (l.a is not null)::int as leaks, (select count(distinct group_id) from grp) as n_groups,
  (select count(*) from leaky) as n_leaking from nearest n left join leaky l on l.a = n.event_id)""", recursive=True)
def _(spark, d):
    return splits.split_audit(prints(spark, d), plain(spark, d))


@check("a4_footprint_from_cells", "event_id:i west:f south:f east:f north:f first_day:d last_day:d", "event_cell_day", """
c as (select *, 300000 + 250.0::double * (col + 0.5) as x, 5900000 - 250.0::double * (row + 0.5) as y from event_cell_day where fire_mask >= 0.5),
%s,
result as (select event_id, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north, min(day) as first_day,
  max(day) as last_day from lonlat group by event_id)""" % lonlat("c"))
def _(spark, d):
    return splits.footprint_from_cells(fixtures.event_cell_day(spark, d), {"x0": 300000.0, "y0": 5900000.0, "res": 250.0})


@check("o3_sample_cap", "split:s event_id:i day_idx:i n:i", "event_cell_day", """
pairs as (select distinct case event_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split, event_id, day_idx from event_cell_day),
k as (select *, row_number() over (partition by split order by sha256('42|' || event_id || '|' || day_idx), event_id, day_idx) as k from pairs),
result as (select split, k.event_id, k.day_idx, count(*) as n from k join event_cell_day e on e.event_id = k.event_id and e.day_idx = k.day_idx
  where k <= 3 or split <> 'train' group by all)""")
def _(spark, d):
    cells = fixtures.event_cell_day(spark, d)
    k = F.col("event_id") % 3
    named = cells.withColumn("split", F.when(k == 0, "train").when(k == 1, "val").otherwise("test"))
    return assembly.sample_cap(named, 3).groupBy("split", "event_id", "day_idx").agg(F.count("*").alias("n"))
