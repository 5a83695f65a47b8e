"""Queries over event cells: assembly, training pairs, spread, forecasts, sinks and streams."""

from pyspark.sql import functions as F

from checks.detections import loaded, raw
from checks.evaluation import EVENT_METRICS
from checks.registry import check
from checks.utm_sql import lonlat, utm
from emberline.functions.surface import normalized_inputs
from emberline.operators import assembly, evaluation as ev, forecast, spread
from emberline.session import durable, shared_folder
from emberline.sources import detections as src, fixtures, tables
from emberline.streaming import detections as live

ECD = "event_cell_day"
CELL = "event_id:i day_idx:i row:i col:i"
DETECTION = "latitude:f longitude:f detected_at:t frp:f confidence:s satellite:s instrument:s"


def state(spark, d):
    return fixtures.event_cell_day(spark, d)


def split_of(c="event_id"):
    k = F.col(c) % 3
    return F.when(k == 0, "train").when(k == 1, "val").otherwise("test")


SPLIT = "case event_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end"


def parts(spark, d):
    """Grids, days, static, weather, ndvi and fire tables taken from the event cells; some weather and ndvi lacking."""
    c = state(spark, d).withColumn("row", (F.col("row") % 10).cast("int"))
    ids = c.select("event_id").distinct()
    grids = ids.withColumn("grid", F.struct(F.lit(300000.0).alias("x0"), F.lit(5900000.0).alias("y0"), F.lit(250.0).alias("res"),
                                            F.lit(50).alias("width"), F.lit(10).alias("height")))
    days = ids.withColumn("days", F.expr("sequence(date '2023-12-30', date '2024-01-05')"))
    static = c.filter("day_idx = 0").select("event_id", "row", "col", "elevation", "slope_deg", F.lit(-1.0).alias("aspect_deg"), "fuel_type")
    weather = c.select("event_id", "day", "row", "col", "wind_u", "wind_v", "temperature", "relative_humidity",
                       F.lit(0.0).alias("precipitation"))
    ndvi = static.select("event_id", F.lit(2024).alias("year"), F.lit(1).alias("month"), "row", "col",
                         (F.col("slope_deg") / 50).alias("ndvi"))
    fire = c.filter("fire_mask = 1").select("event_id", "day", "row", "col")
    return grids, days, static, weather, ndvi, fire


@check("j8_assemble_event", "event_id:i day:d day_idx:i row:i col:i elevation:f slope_deg:f aspect_deg:f wind_u:f wind_v:f temperature:f relative_humidity:f precipitation:f ndvi:f fuel_type:f fire_mask:f",
       ECD, """
ids as (select distinct event_id from event_cell_day),
frame as (select event_id, date '2023-12-30' + i::int as day, i as day_idx, r as row, c as col
  from ids cross join range(7) a(i) cross join range(10) b(r) cross join range(50) e(c)),
e as (select * replace (row % 10 as row) from event_cell_day),
s as (select * from e where day_idx = 0),
result as (select f.*, s.elevation, s.slope_deg, case when s.event_id is not null then -1.0 end as aspect_deg, w.wind_u, w.wind_v,
  w.temperature, w.relative_humidity, case when w.event_id is not null then 0.0 end as precipitation,
  case when f.day >= date '2024-01-01' then s.slope_deg / 50 end as ndvi, s.fuel_type, coalesce(w.fire_mask, 0) as fire_mask
  from frame f left join s on s.event_id = f.event_id and s.row = f.row and s.col = f.col
  left join e w on w.event_id = f.event_id and w.row = f.row and w.col = f.col and w.day = f.day)""")
def _(spark, d):
    return assembly.assemble_event(*parts(spark, d))


@check("w4_day_index", "event_id:i day:d day_idx:i row:i col:i", ECD, """
result as (select event_id, day, dense_rank() over (partition by event_id order by day) - 1 as day_idx, row, col from event_cell_day)""")
def _(spark, d):
    return assembly.day_index(state(spark, d).drop("day_idx"))


PAIRS = """
cum as (select *, max((fire_mask >= 0.5)::int) over (partition by event_id, row, col order by day_idx)::double as cf from event_cell_day),
pairs as (select *, lead(cf) over (partition by event_id, row, col order by day_idx) as label,
   lead(fire_mask) over (partition by event_id, row, col order by day_idx) as next_mask from cum)"""


@check("j15_training_pairs", CELL + " fire_mask:f label:f", ECD, PAIRS + """,
result as (select event_id, day_idx, row, col, cf as fire_mask, label from pairs where label is not null)""")
def _(spark, d):
    return assembly.training_pairs(state(spark, d))


@check("w6_next_day_label", CELL + " fire_mask:f label:f", ECD, PAIRS + """,
result as (select event_id, day_idx, row, col, fire_mask, next_mask as label from pairs where next_mask is not null)""")
def _(spark, d):
    return assembly.training_pairs(state(spark, d), cumulative=False)


@check("f9_check_channel_coverage", "event_id:i channel:s missing:i total:i", ECD, """
result as (select event_id, 'relative_humidity' as channel, count(*) - count(relative_humidity) as missing, count(*) as total
  from event_cell_day group by event_id having count(*) > count(relative_humidity))""")
def _(spark, d):
    return assembly.check_channel_coverage(state(spark, d))


@check("f14_nan_to_zero", CELL + " relative_humidity:f", ECD, """
result as (select event_id, day_idx, row, col, coalesce(relative_humidity, 0) as relative_humidity from event_cell_day)""")
def _(spark, d):
    return assembly.nan_to_zero(state(spark, d), ["relative_humidity"])


@check("x17_normalize_inputs", CELL + " elevation:f slope_deg:f aspect_deg:f wind_u:f temperature:f relative_humidity:f precipitation:f fuel_type:f",
       ECD, """
result as (select event_id, day_idx, row, col, elevation / 1000 as elevation, slope_deg / 30 as slope_deg, slope_deg * 8 / 360 as aspect_deg,
  wind_u / 5 as wind_u, (temperature - 290) / 10 as temperature, relative_humidity / 100 as relative_humidity, 0.002 / 0.01 as precipitation,
  case round_even(fuel_type + 0.5, 0) when 1 then 1.0 when 2 then 0.8 when 3 then 0.6 when 4 then 0.3 when 5 then 0.1 else 0 end as fuel_type
  from event_cell_day)""")
def _(spark, d):
    c = state(spark, d).withColumns({"aspect_deg": F.col("slope_deg") * 8, "precipitation": F.lit(0.002), "fuel_type": F.col("fuel_type") + 0.5})
    return c.withColumns(normalized_inputs())


def ndws(spark, d):
    k = F.col("p_partkey")
    num = lambda c: c.cast("double")
    return fixtures.table(spark, d, "part").select(
        F.floor(k / 400).alias("sample_id"), F.floor(k % 400 / 20).cast("int").alias("row"), (k % 20).cast("int").alias("col"),
        num(F.col("p_size") * 10 + k % 37).alias("elevation"), num(k % 7).alias("pdsi"), num(k * 31 % 13000 - 1000).alias("NDVI"),
        num(k % 11).alias("pr"), (num(k % 20) / 1000).alias("sph"), num(k * 17 % 360).alias("th"), num(280 + k % 9).alias("tmmn"),
        num(290 + k % 13).alias("tmmx"), (num(k % 90) / 10).alias("vs"), num(k % 60).alias("erc"), num(k % 100).alias("population"),
        num(k % 3 - 1).alias("PrevFireMask"), num(k % 4 - 1).alias("FireMask"))


@check("x30_ndws_to_channels", "sample_id:i row:i col:i elevation:f slope_deg:f aspect_deg:f wind_u:f wind_v:f temperature:f relative_humidity:f precipitation:f ndvi:f fuel_type:f fire_mask:f label:f",
       "", """
n as (select p_partkey as k, p_partkey // 400 as sample_id, p_partkey % 400 // 20 as row, p_partkey % 20 as col,
  (p_size * 10 + p_partkey % 37)::double as elevation from part),
dim as (select sample_id, max(row) as h, max(col) as w from n group by sample_id),
nb as (select a.k, r.dr, s.dc, b.elevation as z from n a join dim using (sample_id) cross join (values (-1), (0), (1)) r(dr)
  cross join (values (-1), (0), (1)) s(dc) join n b on b.sample_id = a.sample_id and b.row = least(greatest(a.row + dr, 0), h)
  and b.col = least(greatest(a.col + dc, 0), w)),
gr as (select k, sum(z * dc * (case when dr = 0 then 2 else 1 end)) / 8000 as gx, sum(z * dr * (case when dc = 0 then 2 else 1 end)) / 8000 as gy from nb group by k),
v as (select n.*, gx, gy, (280 + k % 9 + 290 + k % 13) / 2 as t, (k % 20) / 1000 as q from n join gr using (k)),
result as (select sample_id, row, col, elevation, degrees(atan(sqrt(gx * gx + gy * gy))) as slope_deg,
  case when gx = 0 and gy = 0 then -1 else (degrees(atan2(-gx, gy)) + 360) % 360 end as aspect_deg,
  -(k % 90) / 10 * sin(radians(k * 17 % 360)) as wind_u, -(k % 90) / 10 * cos(radians(k * 17 % 360)) as wind_v, t as temperature,
  least(greatest(100 * (q * 101325 / (0.622 + 0.378 * q)) / (611.2 * exp(17.625 * (t - 273.15) / (243.04 + t - 273.15))), 0), 100) as relative_humidity,
  (k % 11) / 1000 as precipitation, least(greatest((k * 31 % 13000 - 1000) / 10000, -1), 1) as ndvi, 99 as fuel_type,
  least(greatest(k % 3 - 1, 0), 1) as fire_mask, least(greatest(k % 4 - 1, 0), 1) as label from v)""")
def _(spark, d):
    return assembly.ndws_to_channels(ndws(spark, d))


# ---------------------------------------------------------------- spread
FLAM = "case {0} when 1 then 1.0 when 2 then 0.8 when 3 then 0.6 when 4 then 0.3 when 5 then 0.1 else 0 end"
STEP = """
base as (select *, fire_mask >= 0.5 as burning from event_cell_day),
way as (select dr, dc, sqrt(dr * dr + dc * dc) as nm from (values (-1), (0), (1)) a(dr) cross join (values (-1), (0), (1)) b(dc) where dr <> 0 or dc <> 0)"""
ONE = """least(greatest({base} * exp({slope} * (t.elevation - n.elevation) / (nm * 250)) * exp({wind} * (t.wind_u * -dc + t.wind_v * dr) / nm) * """ + FLAM.format("t.fuel_type") + ", 0), 1)"


@check("n3_ignition_probability", CELL + " p:f", ECD, STEP + f""",
hit as (select t.event_id, t.day_idx, t.row, t.col, 1 - product(1 - {ONE.format(base=0.3, slope=4.0, wind=0.2)}) as p
  from base n join way on true join base t on t.event_id = n.event_id and t.day_idx = n.day_idx and t.row = n.row - dr and t.col = n.col - dc
  where n.burning group by all),
result as (select b.event_id, b.day_idx, b.row, b.col, case when b.burning then 1 else coalesce(h.p, 0) end as p from base b
  left join hit h using (event_id, day_idx, row, col))""")
def _(spark, d):
    return spread.ignition_probability(state(spark, d))


GRID = {"base_spread_prob": [0.1, 0.3, 0.6], "slope_coefficient": [0.0, 4.0], "wind_coefficient": [0.1, 0.4]}


def samples(spark, d):
    pairs = assembly.training_pairs(state(spark, d))
    return pairs.select((F.col("event_id") * 10 + F.col("day_idx")).alias("sample_id"), "row", "col",
                        F.col("fire_mask").alias("burning"), "elevation", "wind_u", "wind_v", "fuel_type", F.col("label").alias("observed"))


SEARCH = PAIRS + """,
base as (select event_id * 10 + day_idx as sid, row, col, cf = 1 as burning, elevation, wind_u, wind_v, fuel_type, label from pairs where label is not null),
way as (select dr, dc, sqrt(dr * dr + dc * dc) as nm from (values (-1), (0), (1)) a(dr) cross join (values (-1), (0), (1)) b(dc) where dr <> 0 or dc <> 0),
par as (select row_number() over (order by i, j, k) - 1 as combo, b, s, w from (values (0, 0.1::double), (1, 0.3::double), (2, 0.6::double)) x(i, b)
  cross join (values (0, 0.0::double), (1, 4.0::double)) y(j, s) cross join (values (0, 0.1::double), (1, 0.4::double)) z(k, w)),
hit as (select combo, t.sid, t.row, t.col, 1 - product(1 - """ + ONE.format(base="b", slope="s", wind="w") + """) as p
  from base n join way on true join base t on t.sid = n.sid and t.row = n.row - dr and t.col = n.col - dc cross join par where n.burning group by all),
cell as (select combo, c.sid, case when c.burning then 1 else coalesce(h.p, 0) end as p, label from base c cross join par
  left join hit h using (combo, sid, row, col)),
one as (select combo, sid, count(*) filter (where p >= 0.5 or label = 1) as u, count(*) filter (where p >= 0.5 and label = 1) as i,
  -avg(power(p - label, 2)) as b from cell group by all),
sc as (select combo, avg(case when u = 0 then 1 else i / u end) as iou, avg(b) as brier from one group by combo)"""
COMBO = "combo:i base_spread_prob:f slope_coefficient:f wind_coefficient:f score:f"


@check("a18_spread_scores", COMBO, ECD, SEARCH + """,
result as (select combo, b as base_spread_prob, s as slope_coefficient, w as wind_coefficient, brier as score from sc join par using (combo))""")
def _(spark, d):
    return spread.spread_scores(samples(spark, d), GRID, "brier")


@check("a18_grid_search_spread", COMBO, ECD, SEARCH + """,
result as (select combo, b as base_spread_prob, s as slope_coefficient, w as wind_coefficient, iou as score from sc join par using (combo)
  order by round(iou, 12) desc, combo limit 1)""")
def _(spark, d):
    return spread.grid_search_spread(samples(spark, d), GRID, "iou")


# ---------------------------------------------------------------- forecasts
def requests(spark, d):
    k = F.col("s_suppkey")
    return fixtures.table(spark, d, "supplier").select(
        k.alias("request_id"), (-73.5 + k * 37 % 200 / 100.0).alias("lon"), (-39.2 + k * 23 % 260 / 100.0).alias("lat"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 3).cast("int")).alias("day"), (1 + k % 7).cast("int").alias("horizon"))


REQ = """
rq as (select s_suppkey as event_id, -73.5::double + s_suppkey * 37 % 200 / 100.0::double as longitude, -39.2::double + s_suppkey * 23 % 260 / 100.0::double as latitude,
  date '2024-01-01' + (s_suppkey % 3)::int as day, 1 + s_suppkey % 7 as horizon from supplier),
""" + utm("rq", "at0", tag="a") + """,
mid as (select event_id, day, horizon, (floor(x / 250) + 0.5) * 250 as cx, (floor(y / 250) + 0.5) * 250 as cy, floor(x / 250) as gx, floor(y / 250) as gy,
  greatest(2000, (horizon + 4) * 250) as b from at0)"""


@check("n9_point_ignition_grids", "event_id:i x0:f y0:f width:i height:i", "", REQ + """,
box as (select *, cx - b as xa, cy - b as ya, cx + b as xb, cy + b as yb from mid),
""" + lonlat("box", "sw", "xa", "ya", "s") + "," + lonlat("box", "ne", "xb", "yb", "n") + """,
bx as (select sw.event_id, sw.lon as west, sw.lat as south, ne.lon as east, ne.lat as north from sw join ne using (event_id)),
edge as (select event_id, unnest([west + (east - west) * i / 22, west + (east - west) * i / 22, west, east]) as longitude,
    unnest([south, north, south + (north - south) * i / 22, south + (north - south) * i / 22]) as latitude from bx cross join range(23) t(i)),
""" + utm("edge", "ex", tag="e") + """,
result as (select event_id, floor(min(x) / 250) * 250 as x0, ceil(max(y) / 250) * 250 as y0, (ceil(max(x) / 250) - floor(min(x) / 250)) as width,
  (ceil(max(y) / 250) - floor(min(y) / 250)) as height from ex group by event_id)""")
def _(spark, d):
    return forecast.point_ignition_inputs(requests(spark, d))[0].select("event_id", "grid.*")


@check("n9_point_ignition_fire", "event_id:i day:d gx:i gy:i", "", REQ + ", result as (select * from mid)")
def _(spark, d):
    return forecast.point_ignition_inputs(requests(spark, d))[2]


@check("n9_point_ignition_days", "event_id:i day:d", "", REQ + """,
result as (select event_id, day + i::int as day from (select *, unnest(range(horizon + 1)) as i from mid) z)""")
def _(spark, d):
    return forecast.point_ignition_inputs(requests(spark, d))[1].select("event_id", F.explode("days").alias("day"))


@check("n10_forecast_features", "event_id:i row:i col:i pos:i p:f lon:f lat:f kind:s", "predictions", """
pa as (select *, 300000 + 250.0::double * col as x, 5900000 - 250.0::double * row as y from predictions where model = 'a' and day_idx > 0),
""" + lonlat("pa") + """,
result as (select event_id, row, col, day_idx - 1 as pos, round_even(p, 4) as p, lon, lat, 'Polygon' as kind from lonlat)""")
def _(spark, d):
    pred = fixtures.predictions(spark, d).filter("model = 'a'")
    grids = pred.select("event_id").distinct().withColumn("grid", F.struct(
        F.lit(300000.0).alias("x0"), F.lit(5900000.0).alias("y0"), F.lit(250.0).alias("res")))
    f = forecast.forecast_features(pred, grids).select(
        "event_id", "row", "col", F.posexplode("probability_by_day").alias("pos", "p"),
        F.get(F.get("ring", F.lit(0)), F.lit(0)).alias("lon"), F.get(F.get("ring", F.lit(0)), F.lit(1)).alias("lat"), "feature")
    return f.withColumn("kind", F.get_json_object("feature", "$.geometry.type"))


# ---------------------------------------------------------------- sinks
@check("s2_land_raw", DETECTION, "detections_raw detections", "result as (select * from detections)")
def _(spark, d):
    base = shared_folder(spark, "landing")
    rows = raw(spark, d).drop("seq")
    for day in ("2024-02-02", "2024-02-01"):
        query = spark.sql(f"select date '2024-01-01' as query_start, date '2024-01-05' as query_end, -73.7 as west, -39.3 as south, "
                          f"-71.0 as east, -36.5 as north, 'VIIRS' as sensor, timestamp '{day} 06:00:00' as downloaded_at")
        src.land_raw(rows.filter(F.col("download_date") == day).drop("download_date"), query, base)
    return src.load_detections(src.read_landed(spark, base))


@check("s7_write_event_cells", CELL + " fire_mask:f", ECD, """
result as (select event_id, day_idx, row, col, case when event_id % 3 <> 0 then fire_mask + 1 else fire_mask end as fire_mask from event_cell_day)""")
def _(spark, d):
    path = shared_folder(spark, "event_cells")
    cells = state(spark, d)
    tables.write_event_cells(cells, path)
    tables.write_event_cells(cells.filter(split_of() != "train").withColumn("fire_mask", F.col("fire_mask") + 1), path)
    return tables.read_event_cells(spark, path)


@check("s8_upsert_events", "firms_event_id:i start_date:d bbox:s", "footprints", """
result as (select event_id as firms_event_id, case when west < -72.6 then first_day + 1 else first_day end as start_date,
  concat_ws(',', west, south, east, north) as bbox from footprints)""")
def _(spark, d):
    path = shared_folder(spark, "events")
    f = fixtures.footprints(spark, d).withColumnsRenamed({"first_day": "start_date", "last_day": "end_date"})
    tables.upsert_events(spark, f, path)
    tables.upsert_events(spark, f.filter("west < -72.6").withColumn("start_date", F.date_add("start_date", 1)), path)
    return tables.read_events(spark, path)


def scored_events(spark, d):
    s = ev.score_join(fixtures.predictions(spark, d), ev.truth_cells(state(spark, d)))
    return ev.event_metrics(s)


@check("s9_append_runs", "event_id:i model_name:s metric_name:s value:f split:s runs:i", "event_cell_day predictions", EVENT_METRICS + """,
result as (select event_id + 1000 as event_id, 'model-' || model as model_name, unnest(['iou', 'dice', 'brier', 'ece']) as metric_name,
   unnest([iou, dice, brier, ece]) as value, 'test' as split, case model when 'a' then 2 else 1 end as runs
  from per_event join (values ('a', 1), ('a', 2), ('b', 1)) t(model, run) using (model))""")
def _(spark, d):
    path, scores = shared_folder(spark, "runs"), durable(scored_events(spark, d))
    events = durable(state(spark, d).select(F.col("event_id").alias("firms_event_id"), (F.col("event_id") + 1000).alias("id")).distinct())
    for model, stamp in (("a", "first"), ("a", "second"), ("a", "second"), ("b", "third")):  # a repeated stamp is one run
        tables.append_runs(scores.filter(F.col("model") == model).drop("model"), events, f"model-{model}", "test", "{}", path, stamp)
    runs, results = (t.drop("commit") for t in tables.read_runs(spark, path))
    counted = runs.groupBy("event_id", "model_name").agg(F.countDistinct("run_id").alias("runs"))
    return results.join(runs, "run_id").join(counted, ["event_id", "model_name"])


@check("s10_load_split_cells", CELL + " fire_mask:f", ECD, f"""
f as (select event_id, min(day_idx) filter (where fire_mask >= 0.5) as f from event_cell_day group by 1),
result as (select e.* from event_cell_day e join f using (event_id) where {SPLIT} = 'test' and (f is null or day_idx >= f))""")
def _(spark, d):
    c = state(spark, d)
    return tables.load_split_cells(c, c.select("event_id").distinct().withColumn("split", split_of()), "test")


@check("s11_load_results", "model:s split:s event_id:i iou:f dice:f brier:f ece:f", "event_cell_day predictions", EVENT_METRICS + """,
result as (select *, 'test' as split from per_event)""")
def _(spark, d):
    path, scores = shared_folder(spark, "results"), durable(scored_events(spark, d))
    tables.write_results(scores, "test", path, per_file=1)
    tables.write_results(scores, "test", path, per_file=50)  # replaces the many files of the first
    return tables.load_results(spark, path)[0]


# ---------------------------------------------------------------- streams
def landed_stream(spark, d):
    base = shared_folder(spark, "landing")
    raw(spark, d).drop("seq").write.parquet(f"{base}/raw")
    return live.read_landing(spark, base)


@check("t1_stream_detections", DETECTION, "detections_raw detections", "result as (select * from detections)")
def _(spark, d):
    out = shared_folder(spark, "stream")
    live.run_available(live.stream_detections(landed_stream(spark, d)), out)
    return spark.read.parquet(f"{out}/data")


@check("t2_daily_density", "day:d south:f west:f n:i frp:f", "detections_raw detections", """
result as (select detected_at::date as day, floor(latitude / 0.1::double) * 0.1::double as south, floor(longitude / 0.1::double) * 0.1::double as west,
  count(*) as n, sum(frp) as frp from detections group by all)""")
def _(spark, d):
    out = shared_folder(spark, "stream")
    live.run_available(live.density_parts(live.stream_detections(landed_stream(spark, d))), out)
    return live.read_density(spark, out)
