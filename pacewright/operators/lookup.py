"""Lookups along tracks: nearest places, terrain under points, readings and axis conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacewright.functions.geo import EARTH_RADIUS_M, TILE_PIXELS, haversine, speed_to_pace, terrarium, tile_x, tile_y
from pacewright.operators.sector import SECTOR, point_at_distance
from pacewright.operators.track import ordered
from pacewright.operators.zones import classify_hr_zone
from pacewright.sources.scratch import stored


TERRAIN_BLOCK = 32  # pixels a side
NEAR_BLOCK = 128  # vertices that a place meets together
METRE = EARTH_RADIUS_M * 3.141592653589793 / 180  # of a degree north


def _nearest(q: DataFrame, p: DataFrame, cell: float | Column | None) -> DataFrame:
    """Each place (track_id, lat, lon, qx, qy, sx) with ``v``, its nearest vertex, and ``d2``: among those of the nine cells
    around it (null if there are none), or of its whole track without a cell size.

    Vertices come as arrays, ``NEAR_BLOCK`` of a cell at most, and an array is searched in the row in which it meets a
    place: no row is made, sorted or moved for a pair of place and vertex.
    """
    keys = ["track_id"]
    if cell is not None:
        at = lambda c, by: F.floor(F.col(c) / cell) + by
        around = F.array(*[F.struct(at("qx", i).alias("gx"), at("qy", j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        q, p, keys = q.select("*", F.inline(around)), p.withColumns({"gx": at("x", 0), "gy": at("y", 0)}), ["track_id", "gx", "gy"]
    arrays = p.filter("x is not null and y is not null").groupBy(*keys, F.expr(f"seq div {NEAR_BLOCK}").alias("_block"))
    arrays = arrays.agg(F.collect_list(F.struct("seq", "lon", "lat", "d", "before", "after")).alias("ps"))
    # degrees first: of two vertices as far on either side, differences of metres would take one by their rounding
    dx, dy = "((v.lon - lon) * sx)", f"((v.lat - lat) * {METRE}D)"
    best = F.expr(f"array_min(transform(ps, v -> named_struct('d2', {dx} * {dx} + {dy} * {dy}, 'seq', v.seq, 'v', v)))")
    d = q.join(arrays, keys, "left").groupBy("track_id", "lat", "lon", "qx", "qy", "sx").agg(F.min(best).alias("b"))
    return d.select("track_id", "lat", "lon", "qx", "qy", "sx", "b.v", "b.d2")


def nearest_on_track(probes: DataFrame, points: DataFrame, within: float | None = None, cells: tuple[float, ...] = (256.0, 8192.0)) -> DataFrame:
    """Adds to each probe (track_id, wp_seq, lat, lon, ...) its nearest vertex's best adjoining place:
    ``dist`` along the track and ``off_track`` metres. Vertices first, so not always the nearest segment.

    Places are looked up, each once for a track however many probes it has. They look into the cells around them. With
    ``within`` only probes that are no further off their track are given out, and one pass finds them: a place within
    that distance has an end of its segment within that and half a segment, so cells of each track are as wide as that
    for its longest segment. Without it, a vertex found within one cell's width is the nearest of all; places without
    one go on to larger cells, and those still without one are compared with their whole track.
    """
    w = ordered()
    metre = METRE
    cos = lambda lat: F.cos(F.radians(lat))
    low, high, longest = F.min("lat"), F.max("lat"), F.max("seg_m")
    middle = cos((low + high) / 2)
    # metres east are taken at the middle of the track; where it is nearer a pole they come out larger
    stretch = F.greatest(F.lit(1.0), middle / cos(low), middle / cos(high)) * 1.001
    sized = [(stretch * (within + longest / 2)).alias("cell")] if within is not None else []
    scale = points.groupBy("track_id").agg((metre * middle).alias("sx"), *sized)
    place = F.struct("lon", "lat", F.col("cum_dist").alias("d"))
    p = points.select("track_id", "seq", "lon", "lat", F.col("cum_dist").alias("d"), F.lag(place).over(w).alias("before"), F.lead(place).over(w).alias("after"))
    p = p.join(scale, "track_id").withColumns({"x": F.col("lon") * F.col("sx"), "y": F.col("lat") * metre})
    names = [c for c in probes.columns if c != "track_id"]
    rest = probes.filter("lat is not null and lon is not null").select("track_id", "lat", "lon").distinct().join(scale, "track_id")
    rest = rest.select("track_id", "lat", "lon", (F.col("lon") * F.col("sx")).alias("qx"), (F.col("lat") * metre).alias("qy"), *scale.columns[1:])
    found = [_nearest(rest, p, F.col("cell")).filter("d2 is not null")] if within is not None else []
    for cell in cells if within is None else ():
        near = stored(_nearest(rest, p, cell), "nearest")
        done = F.coalesce(F.col("d2") <= cell * cell, F.lit(False))
        found.append(near.filter(done))
        rest = near.filter(~done).select("track_id", "lat", "lon", "qx", "qy", "sx")
        if rest.isEmpty():
            break
    else:
        if within is None:
            found.append(_nearest(rest, p, None))
    d = reduce(DataFrame.unionByName, found)

    # of the two segments at the vertex the nearer one, the one before it first; positions in metres from the segment's beginning
    here = "named_struct('lon', v.lon, 'lat', v.lat, 'd', v.d)"
    segments = f"filter(array(named_struct('k', 0, 'a', v.before, 'b', {here}), named_struct('k', 1, 'a', {here}, 'b', v.after)), s -> s.a is not null and s.b is not null)"
    flat = f"transform({segments}, s -> named_struct('k', s.k, 'a', s.a, 'b', s.b, 'vx', (s.b.lon - s.a.lon) * sx, 'vy', (s.b.lat - s.a.lat) * {metre}D, 'px', (lon - s.a.lon) * sx, 'py', (lat - s.a.lat) * {metre}D))"
    share = f"transform({flat}, s -> named_struct('s', s, 't', if(s.vx * s.vx + s.vy * s.vy > 0, least(1D, greatest(0D, (s.px * s.vx + s.py * s.vy) / (s.vx * s.vx + s.vy * s.vy))), 0D)))"
    off = "(x.s.px - x.t * x.s.vx) * (x.s.px - x.t * x.s.vx) + (x.s.py - x.t * x.s.vy) * (x.s.py - x.t * x.s.vy)"
    at = ", ".join(f"'{name}', x.s.a.{c} + x.t * (x.s.b.{c} - x.s.a.{c})" for name, c in (("dist", "d"), ("lat", "lat"), ("lon", "lon")))
    d = d.withColumn("_r", F.expr(f"array_min(transform({share}, x -> named_struct('d2', {off}, 'k', x.s.k, {at})))"))
    d = d.select("track_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("_r.dist").alias("_dist"), haversine(F.col("lat"), F.col("lon"), F.col("_r.lat"), F.col("_r.lon")).alias("_off"))
    q = probes.select("track_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.struct(*names).alias("q"))
    if within is None:
        d = q.join(scale, "track_id", "left_semi").join(d, ["track_id", "_lat", "_lon"], "left")
    else:
        d = q.join(d.filter(F.col("_off") <= within), ["track_id", "_lat", "_lon"])
    return d.select("track_id", *[F.col(f"q.{c}").alias(c) for c in names], F.col("_dist").alias("dist"), F.col("_off").alias("off_track"))


def resolve_waypoints(waypoints: DataFrame, points: DataFrame, most: float = 50.0) -> DataFrame:
    return nearest_on_track(waypoints, points, most)


def _corners(points: DataFrame) -> DataFrame:
    x, y = tile_x(F.col("lon")) * TILE_PIXELS, tile_y(F.col("lat")) * TILE_PIXELS
    return points.withColumns({"_fx": x, "_fy": y}).withColumns({"_gx": F.floor("_fx"), "_gy": F.floor("_fy")})


def terrain_blocks(dem: DataFrame) -> DataFrame:
    """(tx, ty, bx, by, rows) of coded pixels (gx, gy, r, g, b): elevations of square blocks as arrays by row, with one more row
    and column from the blocks beyond, so that all four neighbours of a place lie in one block. A pixel that is missing is null."""
    side = TERRAIN_BLOCK
    pixels = dem.select("gx", "gy", terrarium(F.col("r"), F.col("g"), F.col("b")).alias("e"))
    own, edge = "array({0} div {1})", "array({0} div {1}, {0} div {1} - 1)"
    for g, b in (("gx", "bx"), ("gy", "by")):
        held = f"if({g} % {side} = 0, {edge.format(g, side)}, {own.format(g, side)})"
        pixels = pixels.withColumn(b, F.explode(F.expr(held)))
    cells = pixels.select("bx", "by", (F.col("gy") - F.col("by") * side).cast("int").alias("y"), (F.col("gx") - F.col("bx") * side).cast("int").alias("x"), "e")
    lines = cells.groupBy("bx", "by", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", "e"))).alias("m"))
    lines = lines.select("bx", "by", "y", F.expr(f"transform(sequence(0, {side}), x -> m[x])").alias("line"))
    blocks = lines.groupBy("bx", "by").agg(F.map_from_entries(F.collect_list(F.struct("y", "line"))).alias("rows"))
    tile = f"{{}} div {TILE_PIXELS // side}"
    return blocks.select(F.expr(tile.format("bx")).alias("tx"), F.expr(tile.format("by")).alias("ty"), "bx", "by", "rows")


def write_terrain(dem: DataFrame, path: str) -> DataFrame:
    """``terrain_blocks`` in a folder for each tile, so that sampling reads the tiles that it needs."""
    blocks = terrain_blocks(dem)
    blocks.repartition("tx", "ty").write.partitionBy("tx", "ty").parquet(path)
    return dem.sparkSession.read.schema(blocks.schema).parquet(path)


def dem_sample(points: DataFrame, terrain: DataFrame) -> DataFrame:
    """Adds ``dem_ele``: terrain at each point, bilinear over four pixels; a missing neighbour takes the value it lies next to.

    ``terrain`` are blocks (``write_terrain``). A point meets the one block that holds its four pixels. The tiles that points
    lie in are found first; while they are few enough to be sent to all tasks, Spark leaves out the folders of all others.
    """
    side = TERRAIN_BLOCK
    needed = stored(dem_tiles_needed(points), "tiles").filter("tx >= 0 and ty >= 0")
    d = _corners(points).withColumns({"_bx": F.expr(f"_gx div {side}"), "_by": F.expr(f"_gy div {side}"), "_tx": F.expr(f"_gx div {TILE_PIXELS}"), "_ty": F.expr(f"_gy div {TILE_PIXELS}")})
    t = terrain.join(needed, ["tx", "ty"], "left_semi").select(*[F.col(c).alias(f"_t_{c}") for c in ("tx", "ty", "bx", "by", "rows")])
    d = d.join(t, F.expr("_tx = _t_tx and _ty = _t_ty and _bx = _t_bx and _by = _t_by"), "left")
    pixel = lambda dx, dy: F.expr(f"get(_t_rows[cast(_gy - _by * {side} + {dy} as int)], cast(_gx - _bx * {side} + {dx} as int))")
    d = d.withColumns({"_00": pixel(0, 0), "_10": pixel(1, 0), "_01": pixel(0, 1), "_11": pixel(1, 1)})
    d = d.withColumns({"_10": F.coalesce("_10", "_00"), "_01": F.coalesce("_01", "_00")}).withColumn("_11", F.coalesce("_11", "_10"))
    dx, dy = F.col("_fx") - F.col("_gx"), F.col("_fy") - F.col("_gy")
    top, low = (F.col(a) + (F.col(b) - F.col(a)) * dx for a, b in (("_00", "_10"), ("_01", "_11")))
    return d.select(*points.columns, F.when(F.col("_00").isNotNull(), top + (low - top) * dy).alias("dem_ele"))


def dem_tiles_needed(points: DataFrame) -> DataFrame:
    """The distinct tiles (tx, ty) that sampling the points reads."""
    d = _corners(points.select("lat", "lon")).filter("_gx is not null and _gy is not null")
    tiles = F.inline(F.expr(f"transform(array(named_struct('i', 0, 'j', 0), named_struct('i', 1, 'j', 0), named_struct('i', 0, 'j', 1), named_struct('i', 1, 'j', 1)), o -> named_struct('tx', (_gx + o.i) div {TILE_PIXELS}, 'ty', (_gy + o.j) div {TILE_PIXELS}))"))
    return d.select(tiles).distinct()


def probe_reading(series: DataFrame, requests: DataFrame, zones: DataFrame) -> DataFrame:
    """What a track shows at a distance: interpolated elevation; from the nearer end heart rate and its zone, cadence,
    power, temperature, clean speed, pace and grade-adjusted pace, and the grade reading.

    ``series`` are points with ``clean_speed``, ``gap_speed`` and ``reading`` (see track.py).
    """
    here = point_at_distance(series, requests)
    near = here.withColumn("seq", F.col("i") + F.when(F.col("t") < 0.5, 0).otherwise(1))
    readings = series.select("track_id", "seq", "hr", "cad", "power", "temp", F.col("clean_speed").alias("speed"), speed_to_pace(F.col("clean_speed")).alias("pace"), speed_to_pace(F.col("gap_speed")).alias("gap"), F.col("reading").alias("grade"))
    return classify_hr_zone(near.join(readings, ["track_id", "seq"], "left"), zones)


def bridge_interpolate(points: DataFrame, requests: DataFrame, value: str = "hr", at: str = "d") -> DataFrame:
    """Adds ``value`` at each request's distance on the line between the last reading before and the next after, over gaps."""
    p = points.filter(F.col(value).isNotNull()).select("track_id", F.col("cum_dist").alias("_x"), F.col("seq").alias("_k"), F.struct(F.col("cum_dist").alias("x"), F.col(value).alias("v")).alias("_p"))
    names = [c for c in requests.columns if c != "track_id"]
    r = requests.select("track_id", F.col(at).alias("_x"), F.lit(1 << 30).alias("_k"), F.struct(*names).alias("_r"))
    w = Window.partitionBy("track_id")
    before, after = w.orderBy("_x", "_k"), w.orderBy(F.col("_x").desc(), F.col("_k").desc())
    both = p.unionByName(r, allowMissingColumns=True)
    d = both.withColumns({c: F.last("_p", True).over(o.rowsBetween(Window.unboundedPreceding, 0)) for c, o in (("_a", before), ("_b", after))}).filter("_r is not null")
    span = F.col("_b.x") - F.col("_a.x")
    between = F.when(span > 0, F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_x") - F.col("_a.x")) / span).otherwise(F.col("_a.v"))
    exact = F.col("_a.x") == F.col("_x")
    return d.select("track_id", *[F.col(f"_r.{c}").alias(c) for c in names], F.when(exact, F.col("_a.v")).when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), between).alias(value))


def dist_to_time(points: DataFrame, requests: DataFrame) -> DataFrame:
    return point_at_distance(points, requests).drop("lat", "lon", "ele", "i", "t", "dist")


def time_to_dist(points: DataFrame, requests: DataFrame, at: str = "ms") -> DataFrame:
    """Adds ``dist`` of each request's time, held within the track."""
    swapped = points.select("track_id", "seq", F.col("time_ms").cast("double").alias("cum_dist"), "lat", "lon", "ele", F.col("cum_dist").alias("time_ms"))
    return point_at_distance(swapped, requests, at).drop("lat", "lon", "ele", "i", "t", "dist").withColumnRenamed("time_ms", "dist_m")


def pause_overlap(readings: DataFrame, spans: DataFrame) -> DataFrame:
    """Readings (track_id, sector_id, ms, ...) that lie in no pause: after its first moment up to its end.

    A sweep: readings and the beginnings of pauses in one order of time, with the furthest end of all pauses begun so
    far; a reading at the moment when a pause begins comes before it. Readings without time lie in no pause.
    """
    names = [c for c in readings.columns if c not in SECTOR]
    r = readings.select(*SECTOR, F.col("ms").alias("_at"), F.lit(0).alias("_begins"), F.struct(*names).alias("_r"))
    s = spans.select(*SECTOR, F.col("t0").alias("_at"), F.lit(1).alias("_begins"), F.col("t1").alias("_end"))
    sweep = Window.partitionBy(*SECTOR).orderBy("_at", "_begins").rowsBetween(Window.unboundedPreceding, 0)
    d = r.unionByName(s, allowMissingColumns=True).withColumn("_open", F.max("_end").over(sweep))
    return d.filter(F.expr("_begins = 0 and not coalesce(_at <= _open, false)")).select(*SECTOR, *[F.col(f"_r.{c}").alias(c) for c in names])
