"""Queries over grids: projection, fire days, resampling, terrain."""

from pyspark.sql import functions as F

from checks.detections import EVENT_ID, loaded
from checks.registry import check
from checks.utm_sql import lonlat, utm
from emberline.functions import geo, surface, when
from emberline.operators import assembly, clustering, grids as g
from emberline.sources import fixtures, tables

DET = "detections_raw detections"


@check("x3_lonlat_to_utm", "latitude:f longitude:f x:m y:m", DET, utm("detections") + ", result as (select * from utm)")
def _(spark, d):
    return geo.UTM19S.with_xy(loaded(spark, d))


@check("x4_utm_to_lonlat", "cell_id:i lon:f lat:f", "cells",
       "c as (select *, 200000 + col * 777.0 as x, 5600000 + row * 431.0 as y from cells)," + lonlat("c") + ", result as (select * from lonlat)")
def _(spark, d):
    c = fixtures.cells(spark, d).withColumns({"x": 200000 + F.col("col") * 777.0, "y": 5600000 + F.col("row") * 431.0})
    return geo.UTM19S.with_lonlat(c)


GRID = """
edge as (select f.event_id, unnest([west + (east - west) * i / 22, west + (east - west) * i / 22, west, east]) as longitude,
    unnest([south, north, south + (north - south) * i / 22, south + (north - south) * i / 22]) as latitude
  from footprints f cross join range(23) t(i)),
""" + utm("edge") + """,
snap as (select event_id, floor(min(x) / 250) * 250 as x0, ceil(max(y) / 250) * 250 as y0, ceil(max(x) / 250) * 250 as x1,
  floor(min(y) / 250) * 250 as y1 from utm group by event_id),
grid as (select *, ((x1 - x0) / 250)::int as width, ((y0 - y1) / 250)::int as height from snap)"""


def gridded(spark, d):
    return g.build_grid(fixtures.footprints(spark, d))


@check("x5_build_grid", "event_id:i x0:f y0:f width:i height:i", "footprints", GRID + ", result as (select * from grid)")
def _(spark, d):
    return gridded(spark, d).select("event_id", "grid.*")


@check("x6_grid_cells", "event_id:i row:i col:i x:f y:f", "footprints", GRID + """,
result as (select event_id, r as row, c as col, x0 + 250 * (c + 0.5::double) as x, y0 - 250 * (r + 0.5::double) as y
  from (select *, unnest(range(width)) as c from (select *, unnest(range(height)) as r from grid) a) b)""")
def _(spark, d):
    return g.grid_cells(gridded(spark, d))


@check("x7_cell_of", "latitude:f longitude:f gx:i gy:i cx:f cy:f", DET, utm("detections") + """,
result as (select *, floor(x / 250) as gx, floor(y / 250) as gy, (floor(x / 250) + 0.5) * 250 as cx, (floor(y / 250) + 0.5) * 250 as cy from utm)""")
def _(spark, d):
    return geo.UTM19S.with_xy(loaded(spark, d)).withColumns({
        "gx": F.floor(F.col("x") / 250), "gy": F.floor(F.col("y") / 250),
        "cx": geo.cell_centre("x", 250.0), "cy": geo.cell_centre("y", 250.0)})


@check("x8_cell_polygon", "cell_id:i corner:i lon:f lat:f", "cells", """
v as (select cell_id, i as corner, 300000 + 250.0::double * (col + [0, 1, 1, 0, 0][i + 1]) as x,
  5900000 - 250.0::double * (row + [0, 0, 1, 1, 0][i + 1]) as y from cells cross join range(5) t(i)),
""" + lonlat("v") + ", result as (select * from lonlat)")
def _(spark, d):
    ring = geo.cell_ring("row", "col", F.lit(300000.0), F.lit(5900000.0), F.lit(250.0))
    return (fixtures.cells(spark, d).select("cell_id", F.posexplode(ring).alias("corner", "v"))
            .select("cell_id", "corner", F.get("v", F.lit(0)).alias("lon"), F.get("v", F.lit(1)).alias("lat")))


BOXED = """
pt as (select c_custkey as id, -75 + (c_custkey * 37) % 400 / 100.0::double as west, -41 + (c_custkey * 23) % 500 / 100.0::double as south from customer),
bx as (select *, west + id % 5 as east, south + id % 4 * 1.5::double as north from pt),
tl as (select *, unnest(range((floor(south / {s}) * {s})::int, ((ceil(north / {s}) - 1) * {s})::int + 1, {s})) as lat from bx),
ll as (select *, unnest(range((floor(west / {s}) * {s})::int, ((ceil(east / {s}) - 1) * {s})::int + 1, {s})) as lon from tl),
result as (select *, printf('{f}', case when lat < 0 then 'S' else 'N' end, abs(lat), case when lon < 0 then 'W' else 'E' end, abs(lon)) as name from ll)"""


def boxes(spark, d):
    k = F.col("id")
    c = fixtures.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return (c.withColumns({"west": -75 + (k * 37) % 400 / 100.0, "south": -41 + (k * 23) % 500 / 100.0})
            .withColumns({"east": F.col("west") + k % 5, "north": F.col("south") + k % 4 * 1.5}))


@check("x20_dem_tiles", "id:i lat:i lon:i name:s", "", BOXED.format(s=1, f="Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM"))
def _(spark, d):
    return boxes(spark, d).select("id", F.explode(geo.tiles("elevation", "west", "south", "east", "north")).alias("t")).select("id", "t.*")


@check("x21_landcover_tiles", "id:i lat:i lon:i name:s", "", BOXED.format(s=3, f="ESA_WorldCover_10m_2021_v200_%s%02d%s%03d_Map"))
def _(spark, d):
    return boxes(spark, d).select("id", F.explode(geo.tiles("landcover", "west", "south", "east", "north")).alias("t")).select("id", "t.*")


@check("x31_bbox_wkt", "event_id:i bbox:s geom:s", "footprints", """
result as (select event_id, concat_ws(',', west, south, east, north) as bbox,
  'SRID=4326;POLYGON((' || concat_ws(', ', west || ' ' || south, west || ' ' || north, east || ' ' || north, east || ' ' || south, west || ' ' || south) || '))' as geom from footprints)""")
def _(spark, d):
    box = ("west", "south", "east", "north")
    return fixtures.footprints(spark, d).select("event_id", geo.bbox_text(*box).alias("bbox"), geo.bbox_wkt(*box).alias("geom"))


# ---------------------------------------------------------------- events on the grid
def tiled(spark, d):
    """Detections of a 0.05 degree tile as one event: fixed groups, so the grid operators are tested on their own."""
    return loaded(spark, d).withColumn("event_id", F.floor((F.col("latitude") + 90) * 20) * 10000
                                       + F.floor((F.col("longitude") + 180) * 20))


TILE = "tile as (select *, floor((latitude + 90) * 20)::bigint * 10000 + floor((longitude + 180) * 20)::bigint as event_id from detections),"
FIRE = TILE + utm("tile") + """,
cand as (select *, unnest(range(floor((x - 375) / 250)::bigint, floor((x + 375) / 250)::bigint + 1)) as gx from utm),
cand2 as (select *, unnest(range(floor((y - 375) / 250)::bigint, floor((y + 375) / 250)::bigint + 1)) as gy from cand),
fire as (select distinct event_id, detected_at::date as day, gx, gy from cand2
  where sqrt(power((gx + 0.5) * 250 - x, 2) + power((gy + 0.5) * 250 - y, 2)) <= 375),
adays as (select distinct event_id, day from fire),
anchors as (select *, lag(day) over (partition by event_id order by day) as prev_day, lead(day) over (partition by event_id order by day) as next_day from adays)"""


@check("x27_event_bbox", "event_id:i west:f south:f east:f north:f", DET, TILE + utm("tile") + """,
b as (select event_id, min(x) - 2000 as x0, min(y) - 2000 as y0, max(x) + 2000 as x1, max(y) + 2000 as y1 from utm group by event_id),
""" + lonlat("b", "sw", "x0", "y0", "s") + "," + lonlat("b", "ne", "x1", "y1", "n") + """,
result as (select sw.event_id, sw.lon as west, sw.lat as south, ne.lon as east, ne.lat as north from sw join ne using (event_id))""")
def _(spark, d):
    return g.event_bbox(tiled(spark, d))


@check("j2_rasterize_detections", "event_id:i day:d gx:i gy:i", DET, FIRE + ", result as (select * from fire)")
def _(spark, d):
    return g.rasterize_detections(tiled(spark, d))


@check("w5_anchor_neighbors", "event_id:i day:d prev_day:d next_day:d", DET, FIRE + ", result as (select * from anchors)")
def _(spark, d):
    return g.anchor_neighbors(g.rasterize_detections(tiled(spark, d)))


GAPS = FIRE + """,
alldays as (select event_id, unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from adays group by event_id),
around as (select a.event_id, a.day, max(n.day) filter (where n.day <= a.day) as p, min(n.day) filter (where n.day >= a.day) as q
  from alldays a join adays n using (event_id) group by all),
result as (select distinct a.event_id, a.day, f.gx, f.gy from around a join fire f on f.event_id = a.event_id and (f.day = a.p or f.day = a.q))"""


@check("j4_fill_fire_gaps", "event_id:i day:d gx:i gy:i", DET, GAPS)
def _(spark, d):
    return g.fill_fire_gaps(g.rasterize_detections(tiled(spark, d)))


@check("o7_union_of_anchors", "event_id:i day:d n:i", DET, GAPS.replace("result as (select distinct", "filled as (select distinct")
       + ", result as (select event_id, day, count(*) as n from filled group by all)")
def _(spark, d):
    return g.fill_fire_gaps(g.rasterize_detections(tiled(spark, d))).groupBy("event_id", "day").agg(F.count("*").alias("n"))


@check("x19_stable_event_id", "tile:i event_id:i", DET, TILE + """
k as (select event_id as tile, strftime(detected_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || printf('%.6f', latitude) || '|' || printf('%.6f', longitude) as key from tile),
result as (select tile, """ + EVENT_ID + """ as event_id from k group by tile)""")
def _(spark, d):
    return clustering.stable_ids(tiled(spark, d).withColumnRenamed("event_id", "tile"), "tile")


SUMMARY = TILE + """
ev as (select event_id, min(detected_at)::date as start_date, max(detected_at)::date as end_date, count(*) as n_detections from tile group by event_id)"""


@check("x28_padded_days", "event_id:i day:d", DET, SUMMARY + """,
result as (select event_id, unnest(generate_series((start_date - 5)::timestamp, (end_date + 2)::timestamp, interval 1 day)) as day from ev)""")
def _(spark, d):
    s = clustering.event_summary(tiled(spark, d))
    return s.select("event_id", F.explode(when.padded_days("start_date", "end_date", 5, 2)).alias("day"))


@check("f3_select_events", "event_id:i n_detections:i", DET, SUMMARY + """,
result as (select * from ev where n_detections >= 40 and event_id in (select event_id from tile where confidence = 'h'))""")
def _(spark, d):
    det = tiled(spark, d)
    return clustering.select_events(clustering.event_summary(det), det.filter("confidence = 'h'"), 40)


@check("o1_events_by_id", "event_id:i start_date:d end_date:d n_detections:i", DET, SUMMARY + ", result as (select * from ev order by event_id)")
def _(spark, d):
    return clustering.event_summary(tiled(spark, d)).orderBy("event_id")


@check("s8_event_rows", "firms_event_id:i id:i bbox:s start_date:d", "footprints", """
old as (select event_id, event_id + 100 as id, first_day from footprints where west < -72.6),
result as (select coalesce(f.event_id, o.event_id) as firms_event_id, coalesce(o.id, -1) as id,
  concat_ws(',', west, south, east, north) as bbox, f.first_day as start_date from footprints f left join old o using (event_id))""")
def _(spark, d):
    f = fixtures.footprints(spark, d).withColumnsRenamed({"first_day": "start_date", "last_day": "end_date"})
    rows = tables.event_rows(f)
    current = (tables.event_rows(f.filter("west < -72.6").withColumn("start_date", F.date_add("start_date", -9)))
               .withColumn("id", F.col("firms_event_id") + 100))
    known = current.select("firms_event_id").withColumn("known", F.lit(1))
    return tables.merge_events(current, rows).join(known, "firms_event_id", "left").withColumn(
        "id", F.when(F.col("known") == 1, F.col("id")).otherwise(-1))


# ---------------------------------------------------------------- rasters
def cells(spark, d):
    return fixtures.cells(spark, d)


HORN = """
dim as (select max(row) as h, max(col) as w from cells),
nb as (select c.cell_id, c.elevation, r.dr, s.dc, n.elevation as z from cells c cross join (values (-1), (0), (1)) r(dr)
  cross join (values (-1), (0), (1)) s(dc) cross join dim
  left join cells n on n.row = least(greatest(c.row + dr, 0), h) and n.col = least(greatest(c.col + dc, 0), w)),
gr as (select cell_id, sum(z * dc * (case when dr = 0 then 2 else 1 end)) / (8 * 30.0) as gx,
  sum(z * dr * (case when dc = 0 then 2 else 1 end)) / (8 * 30.0) as gy, count(z) as k from nb group by cell_id),
result as (select c.*, case when k = 9 then degrees(atan(sqrt(gx * gx + gy * gy))) end as slope_deg,
  case when k = 9 then case when gx = 0 and gy = 0 then -1 else (degrees(atan2(-gx, gy)) + 360) % 360 end end as aspect_deg from cells c join gr using (cell_id))"""


@check("n1_slope_aspect", "row:i col:i elevation:f slope_deg:f aspect_deg:f", "cells", HORN)
def _(spark, d):
    return g.slope_aspect(cells(spark, d), 30.0, 30.0)


@check("j13_moore_neighbors", "row:i col:i d_row:i d_col:i elevation:f", "cells", """
result as (select c.row, c.col, dr as d_row, dc as d_col, n.elevation from cells c cross join (values (-1), (0), (1)) r(dr)
  cross join (values (-1), (0), (1)) s(dc) join cells n on n.row = c.row + dr and n.col = c.col + dc where dr <> 0 or dc <> 0)""")
def _(spark, d):
    c = cells(spark, d)
    return g.moore_neighbors(c, [], ["elevation"]).join(c.select("row", "col"), ["row", "col"], "left_semi")


@check("a16_block_average", "row:i col:i value:f", "cells", """
result as (select row // 8 as row, col // 8 as col, avg(elevation) as value from cells group by all)""")
def _(spark, d):
    return g.block_average(cells(spark, d).withColumnRenamed("elevation", "value"), 8)


@check("a16_block_majority", "row:i col:i value:i", "cells", """
n as (select row // 8 as r, col // 8 as c, landcover, count(*) as k from cells group by all),
o as (select *, row_number() over (partition by r, c order by k desc, landcover) as rn from n),
result as (select r as row, c as col, landcover as value from o where rn = 1)""")
def _(spark, d):
    return g.block_majority(cells(spark, d).withColumnRenamed("landcover", "value"), 8)


@check("j7_mosaic", "row:i col:i value:f", "cells", """
tiles as (select t as tile_order, row + t * 7 as row, col, case when (cell_id + t) % 5 <> 0 then elevation + t * 1000 end as value
  from cells cross join range(3) r(t)),
o as (select *, row_number() over (partition by row, col order by value is null, tile_order) as rn from tiles where row < 30 and col < 45),
result as (select * from o where rn = 1)""")
def _(spark, d):
    t = cells(spark, d).withColumn("tile_order", F.explode(F.sequence(F.lit(0), F.lit(2))))
    k = F.col("tile_order")
    return g.mosaic(t.select(k, (F.col("row") + k * 7).alias("row"), "col", F.when(
        (F.col("cell_id") + k) % 5 != 0, F.col("elevation") + k * 1000).alias("value")), (0, 0, 30, 45))


REF = g.Georef(-72.0, -37.0, 0.01, 0.01, True)
TARGETS = """
tg as (select cell_id, 278000 + col * 900.0::double as x, 5903000 - row * 1000.0::double as y from cells),
""" + lonlat("tg") + """,
spot as (select *, (lon + 72.0) / 0.01::double as sx, (-37.0 - lat) / 0.01::double as sy from lonlat)"""


def targets(spark, d):
    return cells(spark, d).select("cell_id", (278000 + F.col("col") * 900.0).alias("x"), (5903000 - F.col("row") * 1000.0).alias("y"))


@check("j5_resample_nearest", "cell_id:i value:f", "cells", TARGETS + """,
result as (select a.cell_id, s.landcover as value from spot a left join cells s on s.row = floor(sy) and s.col = floor(sx))""")
def _(spark, d):
    return g.resample_nearest(targets(spark, d), cells(spark, d).withColumnRenamed("landcover", "value"), REF)


@check("j6_resample_bilinear", "cell_id:i value:f", "cells", TARGETS + """,
q as (select cell_id, floor(sx - 0.5) as c0, floor(sy - 0.5) as r0, sx - 0.5 - floor(sx - 0.5) as fx, sy - 0.5 - floor(sy - 0.5) as fy from spot),
k as (select q.*, r0 + dr as r, c0 + dc as c, (case when dr = 1 then fy else 1 - fy end) * (case when dc = 1 then fx else 1 - fx end) as w
  from q cross join range(2) a(dr) cross join range(2) b(dc)),
j as (select k.cell_id, w, case when s.cell_id % 23 <> 0 then s.elevation end as v from k left join cells s on s.row = k.r and s.col = k.c where w > 0),
result as (select cell_id, case when count(v) = count(*) then sum(w * v) end as value from j group by cell_id)""")
def _(spark, d):
    src = cells(spark, d).select("row", "col", F.when(F.col("cell_id") % 23 != 0, F.col("elevation")).alias("value"))
    return g.resample_bilinear(targets(spark, d), src, REF)


FUEL = "[3, 2, 1, 4, 90, 91, 93, 92, 5, 5, 93, 1, 99][cell_id % 13 + 1]"


@check("x15_fuel_from_landcover", "cell_id:i fuel:i", "cells", f"result as (select cell_id, {FUEL} as fuel from cells)")
def _(spark, d):
    return cells(spark, d).withColumn("fuel", surface.fuel_from_landcover("landcover"))


@check("x16_flammability", "cell_id:i flam:f", "cells", f"""
result as (select cell_id, case {FUEL} when 1 then 1.0 when 2 then 0.8 when 3 then 0.6 when 4 then 0.3 when 5 then 0.1 else 0 end as flam from cells)""")
def _(spark, d):
    return cells(spark, d).withColumn("flam", surface.flammability(surface.fuel_from_landcover("landcover")))


def layers(spark, d):
    """CELL rows: elevation, land cover, slope as static layers and five weather fields on two days."""
    c = cells(spark, d)
    one = lambda layer, day, v: F.struct(F.lit(layer).alias("layer"), F.lit(day).cast("date").alias("day"),
                                         v.cast("double").alias("value"))
    made = [one("elevation", None, F.when(F.col("cell_id") % 19 == 0, -32767).otherwise(F.col("elevation"))),
            one("landcover", None, F.col("landcover")), one("slope_deg", None, F.col("cell_id") % 45)]
    for i, f in enumerate(assembly.FIELDS):
        for day in ("2024-01-01", "2024-01-02"):
            made.append(one(f, day, (F.col("cell_id") * (i + 3)) % 17 + int(day[-1])))
    return (c.select("row", "col", F.explode(F.array(*made)).alias("l"))
            .select("l.layer", "l.day", "row", "col", "l.value", F.lit("area").alias("source")))


LAYERS = """
st as (select row, col, cell_id, unnest(['elevation', 'landcover', 'slope_deg']) as layer,
   unnest([case when cell_id % 19 = 0 then -32767 else elevation end, landcover, cell_id % 45]) as value from cells),
we as (select row, col, cell_id, ['wind_u', 'wind_v', 'temperature', 'relative_humidity', 'precipitation'][i + 1] as layer,
   date '2024-01-01' + j::int as day, ((cell_id * (i + 3)) % 17 + j + 1)::double as value from cells cross join range(5) a(i) cross join range(2) b(j)),
lay as (select layer, null::date as day, row, col, value from st union all select layer, day, row, col, value from we)"""
LAY = "layer:s day:d row:i col:i value:f"


@check("s5_read_layer_cells", LAY, "cells", LAYERS + """,
result as (select layer, day, row, col, case when not (layer = 'elevation' and value = -32767 or layer = 'landcover' and value = 0) then value end as value from lay)""")
def _(spark, d):
    return tables.nodata_to_null(tables.require_one_elevation(layers(spark, d)))


@check("s12_export_served_layers", LAY, "cells", LAYERS + """,
result as (select layer, day, row, col, value from lay where layer in ('elevation', 'slope_deg') union all
  select layer, day, row // 8, col // 8, avg(value) from lay where day is not null group by all)""")
def _(spark, d):
    return assembly.export_served_layers(layers(spark, d))


@check("s13_demo_layers", LAY, "event_cell_day", """
dy as (select distinct day from event_cell_day),
k as (select unnest(['elevation', 'slope_deg', 'aspect_deg', 'fuel_type', 'ndvi']) as layer, unnest([100.0, 0, -1, 1, 0.5]) as value, null::date as day
  union all select l, v, day from dy cross join (values ('wind_u', 3.0), ('wind_v', 0), ('temperature', 25), ('relative_humidity', 30), ('precipitation', 0)) t(l, v)),
result as (select layer, day, r as row, c as col, value from k cross join range(80) a(r) cross join range(80) b(c))""")
def _(spark, d):
    return assembly.demo_layers(fixtures.event_cell_day(spark, d).select("day").distinct())
