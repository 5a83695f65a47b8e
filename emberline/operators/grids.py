"""Work grids, rasterised fire days, resampling, mosaics and terrain on cell tables.

Grids are aligned to multiples of their resolution, so a cell has a global index: `gx` grows east
and `gy` grows north, in units of the resolution. `row` grows south from a grid's top edge.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.functions.geo import UTM19S, Utm, snap_down, snap_up
from emberline.session import DataError, require_none

CONTEXT_BUFFER_M = 2000.0
FIRE_BUFFER_M = 375.0
MOORE = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0))


class Georef(NamedTuple):
    """Top-left corner and cell size of a raster; `lonlat` when its axes are degrees."""
    x0: float
    y0: float
    dx: float
    dy: float
    lonlat: bool = False


# ---------------------------------------------------------------- grids
def build_grid(boxes: DataFrame, res: float = 250.0, utm: Utm = UTM19S, densify: int = 21) -> DataFrame:
    """Add `grid` (x0, y0 of the top-left corner, res, width, height) to rows with a lon/lat box.

    The edges are projected at `densify` inner points each and the bounds snapped outwards.
    """
    steps = F.sequence(F.lit(0), F.lit(densify + 1))
    between = lambda a, b: (lambda i: F.col(a) + (F.col(b) - F.col(a)) * i / (densify + 1))
    still = lambda c: (lambda i: F.col(c) + i * 0.0)
    edge = lambda lon, lat: F.transform(steps, lambda i: F.struct(lon(i).alias("lon"), lat(i).alias("lat")))
    ring = F.concat(edge(between("west", "east"), still("south")), edge(between("west", "east"), still("north")),
                    edge(still("west"), between("south", "north")), edge(still("east"), between("south", "north")))
    out = boxes.withColumn("_ring", utm.points_xy(ring))
    lo = lambda c: snap_down(F.array_min(F.transform("_ring", lambda p: p[c])), res)
    hi = lambda c: snap_up(F.array_max(F.transform("_ring", lambda p: p[c])), res)
    out = out.withColumns({"_x0": lo("x"), "_x1": hi("x"), "_y0": lo("y"), "_y1": hi("y")})
    return out.withColumn("grid", F.struct(
        F.col("_x0").alias("x0"), F.col("_y1").alias("y0"), F.lit(float(res)).alias("res"),
        F.round((F.col("_x1") - F.col("_x0")) / res).cast("int").alias("width"),
        F.round((F.col("_y1") - F.col("_y0")) / res).cast("int").alias("height"))).drop("_ring", "_x0", "_x1", "_y0", "_y1")


def grid_cells(grids: DataFrame) -> DataFrame:
    """One row per cell of every `grid`: row, col and centre x, y."""
    g = lambda n: F.col(f"grid.{n}")
    return with_centre(grids.withColumn("row", F.explode_outer(F.sequence(F.lit(0), g("height") - 1)))
                       .withColumn("col", F.explode_outer(F.sequence(F.lit(0), g("width") - 1))))


def with_centre(cells: DataFrame) -> DataFrame:
    """Add the centre x, y of cells (row, col) of a `grid`."""
    g = lambda n: F.col(f"grid.{n}")
    return (cells.withColumn("x", g("x0") + g("res") * (F.col("col") + 0.5))
            .withColumn("y", g("y0") - g("res") * (F.col("row") + 0.5)))


def event_bbox(detections: DataFrame, buffer_m=CONTEXT_BUFFER_M, utm: Utm = UTM19S, keys=("event_id",)) -> DataFrame:
    """(event_id, west, south, east, north): projected bounds grown by the buffer, corners back in degrees."""
    b = buffer_m if isinstance(buffer_m, Column) else F.lit(float(buffer_m))
    box = utm.with_xy(detections.select(*keys, "longitude", "latitude", b.alias("b"))).groupBy(*keys).agg(
        F.min(F.col("x") - F.col("b")).alias("x0"), F.min(F.col("y") - F.col("b")).alias("y0"),
        F.max(F.col("x") + F.col("b")).alias("x1"), F.max(F.col("y") + F.col("b")).alias("y1"))
    box = utm.with_lonlat(utm.with_lonlat(box, "x0", "y0", "west", "south"), "x1", "y1", "east", "north")
    return box.select(*keys, "west", "south", "east", "north")


# ---------------------------------------------------------------- fire days
def rasterize_detections(detections: DataFrame, res: float = 250.0, radius_m: float = FIRE_BUFFER_M,
                         utm: Utm = UTM19S) -> DataFrame:
    """(event_id, day, gx, gy): cells whose centre lies within `radius_m` of a detection of that UTC day.

    A detection visits the few cells around it, so no join is needed; repeats collapse map-side.
    A detection that marks no cell at all fails the job.
    """
    at = utm.with_xy(detections.select("event_id", F.to_date("detected_at").alias("day"), "longitude", "latitude"))
    # explode_outer and coalesce: the null tests inferred without them would repeat the projection below
    span = lambda c: F.explode_outer(F.sequence(F.floor((F.col(c) - radius_m) / res), F.floor((F.col(c) + radius_m) / res)))
    near = F.coalesce(F.hypot((F.col("gx") + 0.5) * res - F.col("x"), (F.col("gy") + 0.5) * res - F.col("y")) <= radius_m,
                      F.lit(False))
    fire = (at.withColumn("gx", span("x")).withColumn("gy", span("y")).filter(near)
            .select("event_id", "day", "gx", "gy").distinct())
    if radius_m < res * 0.7072:  # only a disc this small can fall between centres
        days = at.select("event_id", "day").distinct()
        require_none(days.join(fire.select("event_id", "day").distinct(), ["event_id", "day"], "left_anti"),
                     "day with detections but no burning cell")
    return fire


def anchor_neighbors(fire: DataFrame) -> DataFrame:
    """(event_id, day, prev_day, next_day) of the days with fire cells."""
    w = Window.partitionBy("event_id").orderBy("day")
    return fire.select("event_id", "day").distinct().withColumns(
        {"prev_day": F.lag("day").over(w), "next_day": F.lead("day").over(w)})


def fill_fire_gaps(fire: DataFrame) -> DataFrame:
    """Fire cells with every gap day filled by the union of the anchor days around it, never beyond them."""
    first = F.coalesce(F.date_add("prev_day", 1), F.col("day"))
    last = F.coalesce(F.date_sub("next_day", 1), F.col("day"))
    reach = anchor_neighbors(fire).select("event_id", "day", F.sequence(first, last).alias("days"))
    return (fire.join(reach, ["event_id", "day"])
            .select("event_id", F.explode("days").alias("day"), "gx", "gy").distinct())


def to_local(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Global cells -> (row, col) of their event's grid; cells outside it are dropped."""
    g = lambda n: F.col(f"grid.{n}")
    col = (F.col("gx") - F.round(g("x0") / g("res"))).cast("int")
    row = (F.round(g("y0") / g("res")) - 1 - F.col("gy")).cast("int")
    return (cells.join(grids.select("event_id", "grid"), "event_id").withColumns({"row": row, "col": col})
            .filter(F.col("row").between(0, g("height") - 1) & F.col("col").between(0, g("width") - 1))
            .drop("grid", "gx", "gy"))


# ---------------------------------------------------------------- resampling
def source_position(targets: DataFrame, ref: Georef, utm: Utm = UTM19S) -> DataFrame:
    """Add `sx`, `sy`: position of the target centre (x, y in UTM metres) in cells of the source."""
    if ref.lonlat:
        targets = utm.with_lonlat(targets, "x", "y", "sx", "sy")
    else:
        targets = targets.withColumns({"sx": F.col("x"), "sy": F.col("y")})
    return targets.withColumns({"sx": (F.col("sx") - ref.x0) / ref.dx, "sy": (F.lit(ref.y0) - F.col("sy")) / ref.dy})


def resample_nearest(targets: DataFrame, source: DataFrame, ref: Georef, utm: Utm = UTM19S,
                     by: tuple[str, ...] = ()) -> DataFrame:
    """Add `value` of the source cell (row, col, value) that holds the target centre; none is missing."""
    at = source_position(targets, ref, utm).withColumns(
        {"_r": F.floor("sy").cast("int"), "_c": F.floor("sx").cast("int")}).drop("sx", "sy")
    src = source.select(*by, F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    return at.join(src, [*by, "_r", "_c"], "left").drop("_r", "_c")


def resample_bilinear(targets: DataFrame, source: DataFrame, ref: Georef, utm: Utm = UTM19S,
                      by: tuple[str, ...] = (), values: tuple[str, ...] = ("value",), nearest: tuple[str, ...] = (),
                      placed: bool = False) -> DataFrame:
    """Add `values`, bilinear between the four source centres around the target centre.

    A corner of positive weight that is missing makes the result missing. The source is first
    folded into 2x2 neighbourhoods, so a target joins once for all values, whichever grid is the finer.
    Columns of `source` named `nearest` come with the same join, each from the source cell that holds the centre.
    `placed` targets already have the `sx`, `sy` of `source_position`, and keep them.
    """
    corners = [(r, c) for r in (0, 1) for c in (0, 1)]
    both = (*values, *nearest)
    offset = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in corners]))
    pick = lambda v, r, c: F.max(F.when((F.col("o.r") == r) & (F.col("o.c") == c), F.col(v))).alias(f"_{v}{r}{c}")
    quads = (source.withColumn("o", offset)
             .withColumns({"_r": F.col("row") - F.col("o.r"), "_c": F.col("col") - F.col("o.c")})
             .groupBy(*by, "_r", "_c").agg(*[pick(v, r, c) for v in both for r, c in corners]))
    at = targets if placed else source_position(targets, ref, utm)
    y, x = F.col("sy") - 0.5, F.col("sx") - 0.5
    at = at.withColumns({"_r": F.floor(y).cast("int"), "_c": F.floor(x).cast("int")})
    out = at.join(quads, [*by, "_r", "_c"], "left").withColumns({"_fy": y - F.floor(y), "_fx": x - F.floor(x)})
    out = out.withColumns({f"_w{r}{c}": (F.col("_fy") if r else 1 - F.col("_fy")) * (F.col("_fx") if c else 1 - F.col("_fx"))
                           for r, c in corners})
    def mix(v):
        terms = [F.when(F.col(f"_w{r}{c}") > 0, F.col(f"_w{r}{c}") * F.col(f"_{v}{r}{c}")).otherwise(0.0) for r, c in corners]
        return terms[0] + terms[1] + terms[2] + terms[3]
    lower, right = F.floor("sy") > F.col("_r"), F.floor("sx") > F.col("_c")
    held = lambda v: F.when(lower, F.when(right, F.col(f"_{v}11")).otherwise(F.col(f"_{v}10"))).otherwise(
        F.when(right, F.col(f"_{v}01")).otherwise(F.col(f"_{v}00")))
    made = [f"_w{r}{c}" for r, c in corners] + [f"_{v}{r}{c}" for v in both for r, c in corners]
    return (out.withColumns({**{v: mix(v) for v in values}, **{v: held(v) for v in nearest}})
            .drop("_r", "_c", "_fx", "_fy", *([] if placed else ["sx", "sy"]), *made))


def block_average(cells: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the valid cells of every k x k block."""
    return (cells.groupBy(*keys, F.floor(F.col("row") / k).cast("int").alias("row"),
                          F.floor(F.col("col") / k).cast("int").alias("col")).agg(F.avg("value").alias("value")))


def block_majority(cells: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent class of every k x k block, the lowest on a tie."""
    at = [*keys, F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")]
    n = cells.filter(F.col("value").isNotNull()).groupBy(*at, "value").agg(F.count("*").alias("n"))
    return n.groupBy(*keys, "row", "col").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"))


def mosaic(tiles: DataFrame, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """First non-missing value per cell in `tile_order`; `window` crops to (row0, col0, row1, col1), half open.

    Missing tiles leave gaps; no tile at all is an error.
    """
    if tiles.isEmpty():
        raise DataError("no tile to merge")
    if window:
        r0, c0, r1, c1 = window
        tiles = tiles.filter((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return tiles.groupBy("row", "col").agg(
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("tile_order"))).alias("value"))


# ---------------------------------------------------------------- stencils
def moore_neighbors(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of `columns` seen from each of the 8 neighbours: (keys, row, col) is the viewer, (d_row, d_col) the way."""
    way = F.explode(F.array(*[F.struct(F.lit(r).alias("d_row"), F.lit(c).alias("d_col")) for r, c in MOORE]))
    return (cells.select(*keys, "row", "col", *columns, way.alias("w"))
            .select(*keys, (F.col("row") - F.col("w.d_row")).alias("row"), (F.col("col") - F.col("w.d_col")).alias("col"),
                    "w.d_row", "w.d_col", *columns))


def slope_aspect(cells: DataFrame, cell_x: float, cell_y: float, keys: tuple[str, ...] = (), projected: bool = True,
                 rotated: bool = False) -> DataFrame:
    """Horn slope and aspect of `elevation` in degrees; aspect is -1 on flat ground, edges repeat the nearest cell.

    Two window passes (along the row, then along the column) carry the 3x3 neighbourhood, so a cell
    is shuffled twice rather than nine times. A missing neighbour makes the result missing.
    """
    if not projected:
        raise DataError("slope needs a projected grid in metres, not degrees")
    if rotated:
        raise DataError("slope needs a grid without rotation")

    def beside(cols, part, along, before, after):
        w = Window.partitionBy(*keys, part).orderBy(along)
        out = {}
        for c in cols:
            for name, fn, step in ((before, F.lag, -1), (after, F.lead, 1)):
                near = fn(along).over(w)
                out[c + name] = (F.when(near.isNull(), F.col(c))  # edge of the raster
                                 .when(near == F.col(along) + step, fn(c).over(w)))
        return out
    z = cells.withColumn("z", F.col("elevation"))
    z = z.withColumns(beside(["z"], "row", "col", "w", "e"))
    z = z.withColumns(beside(["z", "zw", "ze"], "col", "row", "n", "s"))
    c = F.col
    dzdx = ((c("zen") + 2 * c("ze") + c("zes")) - (c("zwn") + 2 * c("zw") + c("zws"))) / (8 * cell_x)
    dzdy = ((c("zws") + 2 * c("zs") + c("zes")) - (c("zwn") + 2 * c("zn") + c("zen"))) / (8 * cell_y)
    z = z.withColumns({"dzdx": dzdx, "dzdy": dzdy})
    known = c("z").isNotNull() & c("dzdx").isNotNull() & c("dzdy").isNotNull()
    aspect = F.when((c("dzdx") == 0) & (c("dzdy") == 0), F.lit(-1.0)).otherwise(
        F.pmod(F.degrees(F.atan2(-c("dzdx"), c("dzdy"))), F.lit(360.0)))
    return z.withColumns({"slope_deg": F.when(known, F.degrees(F.atan(F.hypot("dzdx", "dzdy")))),
                          "aspect_deg": F.when(known, aspect)}).drop(
        "z", "zw", "ze", "zn", "zs", "zwn", "zws", "zen", "zes", "dzdx", "dzdy")
