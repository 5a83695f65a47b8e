"""Queries over hourly weather, reflectance scenes and request arithmetic."""

from pyspark.sql import functions as F

from checks.registry import check
from emberline.functions import meteo, surface, when
from emberline.operators import assembly, vegetation, weather
from emberline.sources import fixtures, tables

DAILY = """
daily as (select cell_id, day, avg(t2m) as t2m, avg(d2m) as d2m, avg(u10) as u10, avg(v10) as v10 from weather_hourly group by all),
carry as (select cell_id, day - 1 as day, tp from weather_hourly where hour = 0),
day2 as (select d.*, c.tp from daily d join carry c using (cell_id, day) where day <= date '2024-01-02')"""
MAGNUS = "exp(17.625 * ({0} - 273.15) / (243.04 + ({0} - 273.15)))"
RH = f"least(greatest(100 * {MAGNUS.format('d2m')} / {MAGNUS.format('t2m')}, 0), 100)"
DERIVED = DAILY + f""",
derived as (select cell_id, day, sqrt(u10 * u10 + v10 * v10) as wind_speed,
  (degrees(atan2(u10, v10)) + 180) % 360 as wind_direction, u10 as wind_u, v10 as wind_v, {RH} as relative_humidity,
  t2m as temperature, tp as precipitation from day2)"""
END = "2024-01-02"
# catalogue of layers: every cell and day names one field; some days lack some
CATALOGUE = """
cat as (select distinct day + cast(cell_id // 300 as int) as day,
   ['wind_u', 'wind_v', 'temperature', 'relative_humidity', 'precipitation'][(cell_id // 300 * 2 + (day - date '2024-01-01') + hour // 8) % 5 + 1] as field
   from weather_hourly)"""


def hourly(spark, d):
    return fixtures.weather_hourly(spark, d)


def catalogue(spark, d):
    """Which field of which day has a layer, one mention per hourly sample."""
    h = hourly(spark, d)
    names = F.array(*[F.lit(f) for f in weather.FIELDS])
    block, at = F.floor(F.col("cell_id") / 300), F.datediff("day", F.lit("2024-01-01").cast("date"))
    return h.select(F.date_add("day", block.cast("int")).alias("day"),
                    F.get(names, ((block * 2 + at + F.floor(F.col("hour") / 8)) % 5).cast("int")).alias("field"))


def derived(spark, d):
    return weather.derive_weather(weather.daily_weather(hourly(spark, d), "2024-01-01", END))


@check("a1_daily_mean", "cell_id:i day:d t2m:f d2m:f u10:f v10:f", "weather_hourly",
       DAILY + ", result as (select * from daily where day <= date '2024-01-02')")
def _(spark, d):
    return weather.daily_mean(hourly(spark, d), "2024-01-01", END)


@check("a2_daily_carryover", "cell_id:i day:d tp:f", "weather_hourly", DAILY + ", result as (select * from day2)")
def _(spark, d):
    return weather.daily_carryover(hourly(spark, d), "2024-01-01", END)


@check("n2_derive_weather", "cell_id:i day:d wind_speed:f wind_direction:f wind_u:f wind_v:f relative_humidity:f temperature:f precipitation:f",
       "weather_hourly", DERIVED + ", result as (select * from derived)")
def _(spark, d):
    return derived(spark, d)


@check("x9_wind_speed_direction", "cell_id:i day:d hour:i speed:f direction:f", "weather_hourly", """
result as (select cell_id, day, hour, sqrt(u10 * u10 + v10 * v10) as speed, (degrees(atan2(u10, v10)) + 180) % 360 as direction
  from weather_hourly)""")
def _(spark, d):
    return hourly(spark, d).withColumns({"speed": meteo.wind_speed("u10", "v10"),
                                         "direction": meteo.wind_from_direction("u10", "v10")})


@check("x10_wind_components", "cell_id:i day:d hour:i u:f v:f", "weather_hourly", """
result as (select cell_id, day, hour, -t2m / 100 * sin(radians(d2m)) as u, -t2m / 100 * cos(radians(d2m)) as v from weather_hourly)""")
def _(spark, d):
    u, v = meteo.wind_components(F.col("t2m") / 100, F.col("d2m"))
    return hourly(spark, d).withColumns({"u": u, "v": v})


@check("x11_relative_humidity", "cell_id:i day:d hour:i rh:f", "weather_hourly",
       f"result as (select cell_id, day, hour, {RH} as rh from weather_hourly)")
def _(spark, d):
    return hourly(spark, d).withColumn("rh", meteo.relative_humidity("t2m", "d2m"))


@check("x12_specific_humidity", "cell_id:i day:d hour:i rh:f q_sat:f", "weather_hourly", f"""
e as (select *, 611.2 * {MAGNUS.format('t2m')} as es, (d2m - 271) / 2000 as q from weather_hourly),
result as (select cell_id, day, hour, least(greatest(100 * (q * 101325.0 / (0.622 + 0.378 * q)) / es, 0), 100) as rh,
  0.622 * es / (101325.0 - 0.378 * es) as q_sat from e)""")
def _(spark, d):
    return hourly(spark, d).withColumn("q", (F.col("d2m") - 271) / 2000).withColumns(
        {"rh": meteo.rh_from_specific_humidity("q", "t2m"), "q_sat": meteo.saturation_specific_humidity("t2m")})


@check("j9_fill_weather_from_source_mean", "cell_id:i day:d temperature:f wind_u:f imputed:i", "weather_hourly", DERIVED + """,
gappy as (select cell_id, day, case when cell_id % 4 = 0 then null else temperature end as temperature,
  case when cell_id % 6 = 1 then null else wind_u end as wind_u from derived),
m as (select day, avg(temperature) as mt, avg(wind_u) as mu from derived group by day),
result as (select cell_id, g.day, coalesce(temperature, mt) as temperature, coalesce(wind_u, mu) as wind_u,
  (temperature is null)::int + (wind_u is null)::int as imputed from gappy g join m using (day))""")
def _(spark, d):
    src = derived(spark, d)
    gap = lambda c, k, r: F.when(F.col("cell_id") % k != r, F.col(c))
    gappy = src.withColumns({"temperature": gap("temperature", 4, 0), "wind_u": gap("wind_u", 6, 1)})
    return weather.fill_from_source_mean(gappy, src, ("temperature", "wind_u"))


@check("s6_resolve_sources", "day:d wind_u:i wind_v:i temperature:i relative_humidity:i precipitation:i", "weather_hourly",
       CATALOGUE + """,
result as (select day, max((field = 'wind_u')::int) as wind_u, max((field = 'wind_v')::int) as wind_v,
  max((field = 'temperature')::int) as temperature, max((field = 'relative_humidity')::int) as relative_humidity,
  max((field = 'precipitation')::int) as precipitation from cat group by day)""")
def _(spark, d):
    return weather.resolve_sources(catalogue(spark, d))


@check("f10_missing_weather_days", "day:d field:s", "weather_hourly", CATALOGUE + """,
req as (select distinct day + cast(cell_id // 200 as int) as day from weather_hourly),
result as (select day, field from req cross join (values ('wind_u'), ('wind_v'), ('temperature'), ('relative_humidity'), ('precipitation')) f(field)
  except select day, field from cat)""")
def _(spark, d):
    req = hourly(spark, d).select(F.date_add("day", F.floor(F.col("cell_id") / 200).cast("int")).alias("day"))
    return weather.missing_weather_days(req, catalogue(spark, d))


@check("f11_weather_range", "first_day:d last_day:d", "weather_hourly", CATALOGUE + """,
full_days as (select day from cat group by day having count(distinct field) = 5),
result as (select min(day) as first_day, max(day) as last_day from full_days)""")
def _(spark, d):
    return weather.weather_range(catalogue(spark, d))


@check("o5_complete_days", "day:d", "weather_hourly", CATALOGUE + """,
result as (select day from cat where field = 'wind_u' intersect select day from cat where field = 'wind_v'
  intersect select day from cat where field = 'temperature' intersect select day from cat where field = 'relative_humidity'
  intersect select day from cat where field = 'precipitation')""")
def _(spark, d):
    return weather.complete_days(catalogue(spark, d))


@check("o6_missing_days", "day:d", "weather_hourly", CATALOGUE + """,
req as (select distinct day + cast(cell_id // 200 as int) as day from weather_hourly),
result as (select day from req except select day from cat where field = 'precipitation')""")
def _(spark, d):
    req = hourly(spark, d).select(F.date_add("day", F.floor(F.col("cell_id") / 200).cast("int")).alias("day"))
    return weather.missing_weather_days(req, catalogue(spark, d), ("precipitation",))


@check("o4_union_sorted", "cell_id:i day:d hour:i t2m:f", "weather_hourly", "result as (select * from weather_hourly)")
def _(spark, d):
    h = hourly(spark, d)
    days = ("2024-01-01", "2024-01-02", "2024-01-03")
    return tables.union_sorted([h.filter(F.col("day") == F.lit(x).cast("date")) for x in reversed(days)], "day", "hour")


@check("f8_require_finite", "cell_id:i day:d hour:i t2m:f tp:f", "weather_hourly", "result as (select * from weather_hourly)")
def _(spark, d):
    return assembly.require_finite(hourly(spark, d), ["t2m", "d2m", "u10", "v10", "tp"])


# ---------------------------------------------------------------- request arithmetic
ORDER = "o as (select o_orderkey as k, cast(o_orderdate as date) as d0, cast(o_orderdate as date) + cast(o_orderkey % 90 as int) as d1 from orders)"


def ranges(spark, d):
    o = fixtures.table(spark, d, "orders")
    d0 = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("k"), d0.alias("d0"),
                    F.date_add(d0, (F.col("o_orderkey") % 90).cast("int")).alias("d1"))


@check("x22_month_chunks", "k:i start:d end:d", "", ORDER + """,
m as (select *, unnest(generate_series(date_trunc('month', d0)::timestamp, d1::timestamp, interval 1 month))::date as f from o),
result as (select k, greatest(f, d0) as start, least((f + interval 1 month)::date - 1, d1) as "end" from m)""")
def _(spark, d):
    return ranges(spark, d).select("k", F.explode(when.month_chunks("d0", "d1")).alias("c")).select("k", "c.start", "c.end")


@check("x23_day_chunks", "k:i start:d end:d", "", ORDER + """,
m as (select *, unnest(generate_series(d0::timestamp, d1::timestamp, interval 5 day))::date as f from o),
result as (select k, f as start, least(f + 4, d1) as "end" from m)""")
def _(spark, d):
    return ranges(spark, d).select("k", F.explode(when.day_chunks("d0", "d1")).alias("c")).select("k", "c.start", "c.end")


@check("x24_request_key", "k:i key:s", "", ORDER + """,
result as (select k, substr(sha256(d0 || '|' || d1 || '|' || k), 1, 16) as key from o)""")
def _(spark, d):
    return ranges(spark, d).withColumn("key", when.request_key(
        F.col("d0").cast("string"), F.col("d1").cast("string"), F.col("k").cast("string")))


@check("a26_ingest_summary", "query_start:d query_end:d n_queries:i n_detections:i resume_from:d", "", """
q as (select date_trunc('week', o_orderdate)::date as query_start, o_orderkey % 50 as row_count from orders),
per as (select query_start, query_start + 4 as query_end, count(*) as n_queries, sum(row_count) as n_detections,
  query_start + 5 as resume_from from q group by all),
result as (select * from per union all select null, null, sum(n_queries), sum(n_detections), max(query_end) + 1 from per)""")
def _(spark, d):
    from emberline.sources.detections import ingest_summary
    o = fixtures.table(spark, d, "orders")
    start = F.to_date(F.date_trunc("week", "o_orderdate"))
    return ingest_summary(o.select(start.alias("query_start"), F.date_add(start, 4).alias("query_end"),
                                   (F.col("o_orderkey") % 50).alias("row_count")))


# ---------------------------------------------------------------- vegetation
def obs(spark, d):
    return fixtures.reflectance_obs(spark, d)


OBS = "cell_id:i scene:i scene_day:d red:f nir:f"
CLEAR = """
clear as (select * from reflectance_obs where scl not in (3, 8, 9, 10) and scene_day >= date '2024-01-01'
  and scene_day < date '2024-02-01' and cloud_cover <= 85),
comp as (select cell_id, quantile_cont(red, 0.5) as red, quantile_cont(nir, 0.5) as nir from clear group by cell_id)"""
MASKED = "case when red + {o} > 0 and nir + {o} > 0 and red + nir + 2 * {o} >= 100 then (nir - red) / (nir + red + 2 * {o}) end"


@check("f6_cloud_mask", OBS + " scl:i", "reflectance_obs", "result as (select * from reflectance_obs where scl not in (3, 8, 9, 10))")
def _(spark, d):
    return vegetation.cloud_mask(obs(spark, d))


@check("f7_scene_filter", OBS + " cloud_cover:i", "reflectance_obs", """
result as (select * from reflectance_obs where scene_day >= date '2024-01-01' and scene_day < date '2024-02-01' and cloud_cover <= 85)""")
def _(spark, d):
    return vegetation.scene_filter(obs(spark, d), 2024, 1)


@check("a7_monthly_composite", "cell_id:i red:f nir:f", "reflectance_obs", CLEAR + ", result as (select * from comp)")
def _(spark, d):
    return vegetation.monthly_composite(obs(spark, d), 2024, 1)


@check("a7_all_months", "year:i month:i cell_id:i red:f nir:f", "reflectance_obs", """
result as (select year(scene_day) as year, month(scene_day) as month, cell_id, median(red) as red, median(nir) as nir
  from reflectance_obs where cloud_cover <= 85 and scl not in (3, 8, 9, 10) group by all)""")
def _(spark, d):
    return vegetation.monthly_composites(obs(spark, d))


@check("x13_ndvi", "cell_id:i scene:i ndvi:f", "reflectance_obs", """
result as (select cell_id, scene, case when nir + red <> 0 then (nir - red) / (nir + red) end as ndvi from reflectance_obs)""")
def _(spark, d):
    return obs(spark, d).withColumn("ndvi", surface.ndvi("red", "nir"))


@check("x14_ndvi_masked", "cell_id:i scene:i ndvi:f shifted:f", "reflectance_obs", f"""
result as (select cell_id, scene, {MASKED.format(o='0')} as ndvi, {MASKED.format(o='(-100)')} as shifted from reflectance_obs)""")
def _(spark, d):
    return obs(spark, d).withColumns({"ndvi": surface.ndvi_masked("red", "nir"), "shifted": surface.ndvi_masked("red", "nir", -100.0)})


@check("f15_ndvi_range_guard", "cell_id:i scene:i ndvi:f", "reflectance_obs", f"""
result as (select cell_id, scene, {MASKED.format(o='0')} as ndvi from reflectance_obs)""")
def _(spark, d):
    return vegetation.ndvi_range_guard(obs(spark, d).withColumn("ndvi", surface.ndvi_masked("red", "nir")))


MONTHS = "t as (select o_orderkey as k, year(o_orderdate) as year, month(o_orderdate) as month from orders)"
# every ship month counts for the first of its nine months, so that layers have gaps
HAVE = """gap as (select distinct (year(l_shipdate) * 12 + month(l_shipdate) - 1) // 9 * 9 as g from lineitem),
have as (select g // 12 as ly, g % 12 + 1 as lm from gap)"""


@check("x32_month_distance", "k:i distance:i", "", MONTHS + """,
result as (select k, abs(year * 12 + month - (1995 * 12 + 6)) as distance from t)""")
def _(spark, d):
    o = fixtures.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), when.month_distance(
        F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1995), F.lit(6)).alias("distance"))


def months(spark, d):
    o, li = fixtures.table(spark, d, "orders"), fixtures.table(spark, d, "lineitem")
    t = o.select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    first = F.floor((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1) / 9) * 9
    return t, li.select(F.floor(first / 12).cast("int").alias("year"), (first % 12 + 1).cast("int").alias("month"))


NEAREST = MONTHS + "," + HAVE + """,
c as (select t.k, h.*, abs(t.year * 12 + t.month - h.ly * 12 - h.lm) as dist, row_number() over (partition by t.k
  order by abs(t.year * 12 + t.month - h.ly * 12 - h.lm), h.ly * 12 + h.lm) as rn from t join have h on {0}),
result as (select t.k, t.year, t.month, case when dist <= 3 then ly end as layer_year, case when dist <= 3 then lm end as layer_month
  from t left join c on c.k = t.k and rn = 1)"""


@check("j3_nearest_month_layer", "k:i year:i month:i layer_year:f layer_month:f", "", NEAREST.format("true"))
def _(spark, d):
    return vegetation.nearest_month_layer(*months(spark, d))


@check("j3_backward_month_layer", "k:i year:i month:i layer_year:f layer_month:f", "",
       NEAREST.format("h.ly * 12 + h.lm <= t.year * 12 + t.month"))
def _(spark, d):
    return vegetation.nearest_month_layer(*months(spark, d), direction="backward")


def composites(spark, d):
    """The stored layer is the raw NDVI of the January composite; candidates are two months, one shifted."""
    jan = vegetation.monthly_composite(obs(spark, d), 2024, 1)
    raw = lambda shift: surface.ndvi(F.col("red") + shift, F.col("nir") + shift)
    stored = jan.select("cell_id", raw(0).alias("value"))
    cand = jan.select("cell_id", F.explode(F.array(
        F.struct(F.lit("same").alias("candidate"), raw(0).alias("value")),
        F.struct(F.lit("shifted").alias("candidate"), raw(40).alias("value")))).alias("c")).select("cell_id", "c.*")
    return stored, cand


@check("j17_match_composite", "candidate:s max_diff:f", "reflectance_obs", CLEAR + """,
v as (select (nir - red) / nullif(nir + red, 0) as a, (nir - red) / nullif(nir + red + 80, 0) as b from comp),
dd as (select 'same' as candidate, max(abs(a - a)) as max_diff from v union all select 'shifted', max(abs(b - a)) from v),
result as (select * from dd order by max_diff limit 1)""")
def _(spark, d):
    return vegetation.match_composite(*composites(spark, d))


@check("j17_composite_differences", "candidate:s max_diff:f n:i", "reflectance_obs", CLEAR + """,
v as (select (nir - red) / nullif(nir + red, 0) as a, (nir - red) / nullif(nir + red + 80, 0) as b from comp),
result as (select 'same' as candidate, max(abs(a - a)) as max_diff, count(a) as n from v
  union all select 'shifted', max(abs(b - a)), count(*) filter (where a is not null and b is not null) from v)""")
def _(spark, d):
    return vegetation.composite_differences(*composites(spark, d))


@check("a15_ndvi_audit", "event_id:i old_median:f old_max:f new_median:f new_min:f new_max:f new_mean_burned:f new_mean_unburned:f",
       "reflectance_obs", CLEAR + f""",
v as (select cell_id // 200 as event_id, (cell_id % 3 = 0) as burned, (nir - red) / nullif(nir + red, 0) as o, {MASKED.format(o='0')} as n from comp),
result as (select event_id, quantile_cont(o, 0.5) as old_median, max(o) as old_max, quantile_cont(n, 0.5) as new_median, min(n) as new_min,
  max(n) as new_max, avg(n) filter (where burned) as new_mean_burned, avg(n) filter (where not burned) as new_mean_unburned from v group by event_id)""")
def _(spark, d):
    comp = vegetation.monthly_composite(obs(spark, d), 2024, 1)
    return vegetation.ndvi_audit(comp.select(
        F.floor(F.col("cell_id") / 200).alias("event_id"), (F.col("cell_id") % 3 == 0).cast("int").alias("burned"),
        surface.ndvi("red", "nir").alias("old_ndvi"), surface.ndvi_masked("red", "nir").alias("new_ndvi")))
