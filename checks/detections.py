"""Queries over detections: loading, clustering, summaries, rasterised fire days."""

from pyspark.sql import functions as F

from checks.registry import check
from emberline.functions import geo, when
from emberline.operators import clustering
from emberline.session import shared_folder
from emberline.sources import detections as src, fixtures

DET = "detections_raw detections"
STUDY = "longitude between -73.7 and -71.0 and latitude between -39.3 and -36.5"
HAV = ("2 * 6371000.0 * asin(least(1.0, sqrt(power(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + "
       "cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * "
       "power(sin((radians({b}.longitude) - radians({a}.longitude)) / 2), 2))))")
# detections with a dense number, and all near pairs through 0.02 degree bands
PAIRS = f"""
det as (select *, row_number() over (order by detected_at, latitude, longitude, satellite) as id,
          cast(floor(latitude / 0.01) as int) as bla, cast(floor(longitude / 0.01) as int) as blo from detections),
probe as (select d.*, unnest([-1, 0, 1]) as da from det d),
probes as (select p.*, unnest([-1, 0, 1]) as dn from probe p),
near as (select a.id as a, b.id as b from probes a join det b on b.bla = a.bla + a.da and b.blo = a.blo + a.dn
         where abs(epoch(a.detected_at) - epoch(b.detected_at)) <= 2 * 86400 and a.id <> b.id
           and {HAV.format(a='a', b='b')} <= 750)"""
# size and, modulo 2^60, sums of two pieces of the keys' digests
EVENT_ID = """('0x' || substr(sha256(count(*) || '|' || sum(('0x' || substr(sha256(key), 1, 15))::bigint) % 1152921504606846976
  || '|' || sum(('0x' || substr(sha256(key), 16, 15))::bigint) % 1152921504606846976), 1, 15))::bigint"""
EVENTS = PAIRS + """,
reach(id, low) as (select id, id from det union select n.b, r.low from reach r join near n on n.a = r.id where r.low < n.b),
lab as (select id, min(low) as root from reach group by id),
keyed as (select l.root, d.*, strftime(detected_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || printf('%.6f', latitude) || '|'
            || printf('%.6f', longitude) as key from det d join lab l on l.id = d.id),
ids as (select root, """ + EVENT_ID + """ as event_id from keyed group by root),
ev as (select i.event_id, k.* from keyed k join ids i on i.root = k.root)"""


def raw(spark, d):
    return fixtures.detections_raw(spark, d)


def loaded(spark, d):
    return src.load_detections(raw(spark, d))


def clustered(spark, d):
    return clustering.cluster_detections(loaded(spark, d))


def flagship(spark, d):
    return clustering.event_summary(clustered(spark, d))


@check("s1_read_detections", "latitude:f longitude:f detected_at:t frp:f confidence:s satellite:s instrument:s",
       "detections_raw", """
result as (select cast(latitude as double) as latitude, cast(longitude as double) as longitude,
  cast(acq_date as timestamp) + to_minutes(cast(acq_time as int) // 100 * 60 + cast(acq_time as int) % 100) as detected_at,
  cast(nullif(frp, '') as double) as frp, confidence, satellite, instrument from detections_raw)""")
def _(spark, d):
    return src.to_detections(raw(spark, d))


DET_SPEC = "latitude:f longitude:f detected_at:t frp:f confidence:s satellite:s instrument:s"


@check("s3_load_detections", DET_SPEC, DET,
       "result as (select * from detections where acq_date between '2024-01-03' and '2024-01-28')")
def _(spark, d):
    return src.load_detections(raw(spark, d), "2024-01-03", "2024-01-28")


@check("s3_curated_months", DET_SPEC, DET,
       "result as (select * from detections where acq_date between '2024-01-03' and '2024-02-10')")
def _(spark, d):
    path = shared_folder(spark, "curated")
    landed = raw(spark, d)
    for part in (0, 1):  # two landings, of which the second holds copies of rows of the first
        src.append_curated(landed.filter(F.col("seq.copy") == part), path)
    return src.load_detections(src.read_curated(spark, path, "2024-01-03", "2024-02-10"), "2024-01-03", "2024-02-10")


@check("w3_first_detection_wins", "acq_date:s acq_time:s latitude:s longitude:s satellite:s frp:s download_date:s",
       "detections_raw", """
result as (select * from (select *, row_number() over (partition by acq_date, acq_time, latitude, longitude, satellite
  order by copy, eid) as rn from detections_raw) x where rn = 1)""")
def _(spark, d):
    return src.first_detection_wins(raw(spark, d))


@check("s4_active_fires", "detected_at:t longitude:f latitude:f kind:s frp:f confidence:s stamp:s", DET, f"""
result as (select *, 'Point' as kind, strftime(detected_at, '%Y-%m-%dT%H:%M:%SZ') as stamp from detections
  where {STUDY} and acq_date between '2024-01-16' and '2024-01-20')""")
def _(spark, d):
    f = src.active_fires(loaded(spark, d), "2024-01-20", 5)
    g = lambda p: F.get_json_object("feature", p)
    return f.select("detected_at", g("$.geometry.coordinates[0]").cast("double").alias("longitude"),
                    g("$.geometry.coordinates[1]").cast("double").alias("latitude"), g("$.geometry.type").alias("kind"),
                    g("$.properties.frp").cast("double").alias("frp"), g("$.properties.confidence").alias("confidence"),
                    g("$.properties.detected_at").alias("stamp"))


@check("f1_in_study_area", "inside:i n:i", DET,
       """result as (select (longitude between -73.0 and -71.5 and latitude between -38.5 and -37.0)::int as inside,
  count(*) as n from detections group by 1)""")
def _(spark, d):
    return (loaded(spark, d).groupBy(geo.in_bbox("longitude", "latitude", (-73.0, -38.5, -71.5, -37.0)).cast("int")
                                     .alias("inside")).agg(F.count("*").alias("n")))


@check("f2_valid_coordinates", "ok:i n:i", DET, """
result as (select (latitude * 3 between -90 and 90 and longitude * 3 between -180 and 180)::int as ok, count(*) as n
  from detections group by 1)""")
def _(spark, d):
    df = loaded(spark, d).select((F.col("latitude") * 3).alias("lat"), (F.col("longitude") * 3).alias("lon"))
    return df.groupBy(geo.valid_coordinates("lat", "lon").cast("int").alias("ok")).agg(F.count("*").alias("n"))


@check("x1_parse_acq_time", "acq_date:s acq_time:s detected_at:t", "detections_raw", """
result as (select distinct acq_date, acq_time, cast(acq_date as timestamp)
  + to_minutes(cast(acq_time as int) // 100 * 60 + cast(acq_time as int) % 100) as detected_at from detections_raw)""")
def _(spark, d):
    return raw(spark, d).select("acq_date", "acq_time",
                                when.parse_acq_time("acq_date", "acq_time").alias("detected_at")).distinct()


@check("x2_haversine_m", "latitude:f longitude:f metres:f", DET, f"""
result as (select b.latitude, b.longitude, {HAV.format(a='a', b='b')} as metres
  from detections b, (select -38.0 as latitude, -72.5 as longitude) a)""")
def _(spark, d):
    return loaded(spark, d).select("latitude", "longitude", geo.haversine_m(
        F.lit(-38.0), F.lit(-72.5), "latitude", "longitude").alias("metres"))


@check("j1_detection_links", "a_i:i a_j:i a_k:i a_s:i b_i:i b_j:i b_k:i b_s:i", DET, PAIRS + """,
par as (select (2 * 6371000.0 * sin(750.0 / (2 * 6371000.0)) - 0.002) / sqrt(3) as side),
brick as (select id, floor(6371000.0 * cos(radians(latitude)) * cos(radians(longitude)) / side) as i,
            floor(6371000.0 * cos(radians(latitude)) * sin(radians(longitude)) / side) as j,
            floor(6371000.0 * sin(radians(latitude)) / side) as k, floor(epoch(detected_at) / 172800) as s
          from det cross join par),
result as (select distinct p.i as a_i, p.j as a_j, p.k as a_k, p.s as a_s, q.i as b_i, q.j as b_j, q.k as b_k, q.s as b_s
  from near n join brick p on p.id = n.a join brick q on q.id = n.b
  where q.s > p.s or (q.s = p.s and (p.i, p.j, p.k) < (q.i, q.j, q.k)))""")
def _(spark, d):
    links = clustering.detection_links(clustering.with_bricks(loaded(spark, d)))
    return links.select([F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in "ijks"])


@check("a5_cluster_events", "event_id:i latitude:f longitude:f detected_at:t satellite:s", DET,
       EVENTS + ", result as (select * from ev)", recursive=True)
def _(spark, d):
    return clustered(spark, d)


@check("a3_event_summary", "event_id:i start_date:d end_date:d n_detections:i west:f south:f east:f north:f", DET,
       EVENTS + """, result as (select event_id, min(detected_at) as start_date, max(detected_at) as end_date,
  count(*) as n_detections, min(longitude) as west, min(latitude) as south, max(longitude) as east,
  max(latitude) as north from ev group by event_id)""", recursive=True)
def _(spark, d):
    return flagship(spark, d)
