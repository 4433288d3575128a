"""Building tracks: distances, summaries, gaps and per-point series. Points are keyed by (track_id, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pacewright.functions.geo import EARTH_RADIUS_M, haversine, minetti_factor, speed_implausible
from pacewright.sources.layout import laid_by_track
from pacewright.sources.scratch import stored

BY_TRACK = ("track_id",)
SPAN_BLOCK = 128  # points that a span of ``simplify_dp`` meets together


def ordered(keys: tuple[str, ...] = BY_TRACK, by: str = "seq") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def running(keys: tuple[str, ...] = BY_TRACK, by: str = "seq") -> WindowSpec:
    return ordered(keys, by).rowsBetween(Window.unboundedPreceding, 0)


def cum_distance(points: DataFrame, digits: int | None = None) -> DataFrame:
    """Adds ``seg_m`` (metres from the point before) and ``cum_dist``.

    With ``digits`` both are rounded, so that they do not depend on the order in which an engine adds.
    """
    w = ordered()
    seg = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    cut = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return points.withColumn("seg_m", cut(F.coalesce(seg, F.lit(0.0)))).withColumn("cum_dist", cut(F.sum("seg_m").over(running())))


def with_next(points: DataFrame) -> DataFrame:
    """Adds the distance and seconds to the next point (``dd``, ``dt``; null at the end), its reading and zone where points
    have them (``next_hr``, ``next_zone``), and ``recorded`` for the track."""
    w = ordered()
    d = points.withColumn("dd", F.lead("seg_m").over(w)).withColumn("dt", (F.lead("time_ms").over(w) - F.col("time_ms")) / 1000.0)
    d = d.withColumn("dz", F.lead("ele").over(w) - F.col("ele"))
    d = d.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("hr", "zone") if c in points.columns})
    return d.withColumn("recorded", F.max(F.coalesce(F.col("speed") >= 0, F.lit(False))).over(Window.partitionBy("track_id")))


def track_summary(points: DataFrame) -> DataFrame:
    """One row per track: bounds, distance and which series it has (elevation and time: at every point; sensors: at any)."""
    any_of = {"has_hr": "hr", "has_cad": "cad", "has_temp": "temp", "has_power": "power"}
    found = points.groupBy("track_id").agg(
        F.count("*").alias("point_count"),
        F.max("cum_dist").alias("total_distance"),
        *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")],
        F.bool_and(F.col("ele").isNotNull()).alias("has_elevation"),
        F.bool_and(F.col("time_ms").isNotNull()).alias("has_time"),
        *[F.bool_or(F.col(c).isNotNull()).alias(n) for n, c in any_of.items()],
        F.bool_or(F.coalesce(F.col("speed") >= 0, F.lit(False))).alias("has_recorded_speed"),
        F.min("ele").alias("ele_min"),
        F.max("ele").alias("ele_max"),
    )
    return found.withColumns({c: F.when(F.col("has_elevation"), F.col(c)) for c in ("ele_min", "ele_max")})


def from_end(keys: tuple[str, ...] = BY_TRACK, by: str = "seq") -> WindowSpec:
    """All rows from the last down to this one. Looking ahead this way costs a sort; a frame that reaches to the end
    of its partition would be gone through again for every row."""
    return Window.partitionBy(*keys).orderBy(F.col(by).desc()).rowsBetween(Window.unboundedPreceding, 0)


def _around(value: str, keys: tuple[str, ...], by: str) -> tuple[Column, Column, Column, Column]:
    """The last value before or at a row and the next after or at it, with their places."""
    at = F.when(F.col(value).isNotNull(), F.col(by))
    return tuple(F.last(c, True).over(w) for w in (running(keys, by), from_end(keys, by)) for c in (F.col(value), at))


def interpolated_gaps(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = BY_TRACK, by: str = "seq") -> DataFrame:
    """Nulls of ``value`` linear by place between their neighbours; at the ends the nearest value."""
    a, i, b, j = _around(value, keys, by)
    d = df.withColumns({"_a": a, "_i": i, "_b": b, "_j": j})
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * F.try_divide(F.col(by) - F.col("_i"), F.col("_j") - F.col("_i"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(between)
    return d.withColumn(out, filled).drop("_a", "_i", "_b", "_j")


def fill_ele_gaps(points: DataFrame) -> DataFrame:
    return interpolated_gaps(points, "ele", "ele")


def smooth5(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = BY_TRACK, by: str = "seq") -> DataFrame:
    """Mean of the values two rows either side; fills nulls that have a value near."""
    return df.withColumn(out, F.avg(value).over(ordered(keys, by).rowsBetween(-2, 2)))


def _spread(value: str, keys: tuple[str, ...]) -> tuple[Column, Column, Column]:
    w = Window.partitionBy(*keys)
    return F.avg(value).over(w), F.stddev_pop(value).over(w), F.count(value).over(w)


def sigma_filter(df: DataFrame, value: str, keys: tuple[str, ...] = BY_TRACK) -> DataFrame:
    """Rows within three standard deviations of their partition's mean."""
    mean, sigma, _ = _spread(value, keys)
    return df.withColumns({"_m": mean, "_s": sigma}).filter(F.abs(F.col(value) - F.col("_m")) <= 3 * F.col("_s")).drop("_m", "_s")


def sigma_repair(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = BY_TRACK, by: str = "seq") -> DataFrame:
    """Values beyond three standard deviations replaced by the line between their kept neighbours; fewer than three values stay."""
    mean, sigma, n = _spread(value, keys)
    d = df.withColumns({"_m": mean, "_s": sigma, "_n": n})
    off = (F.col("_n") >= 3) & (F.col("_s") > 0) & (F.abs(F.col(value) - F.col("_m")) > 3 * F.col("_s"))
    d = d.withColumn("_off", F.coalesce(off, F.lit(False))).withColumn("_kept", F.when(~F.col("_off"), F.col(value)))
    d = interpolated_gaps(d, "_kept", "_fixed", keys, by)
    return d.withColumn(out, F.when(F.col("_off"), F.col("_fixed")).otherwise(F.col(value))).drop("_m", "_s", "_n", "_off", "_kept", "_fixed")


def raw_speed(df: DataFrame, keys: tuple[str, ...] = BY_TRACK, by: str = "seq") -> DataFrame:
    """Adds ``raw_speed``: recorded, else from the step to the next point; recorded values that the step rules out become null."""
    derived = F.when((F.col("dt") > 0) & (F.col("dd") >= 0), F.try_divide(F.col("dd"), F.col("dt")))
    own = F.when(F.col("speed") >= 0, F.col("speed"))
    last = F.lead(by).over(ordered(keys, by)).isNull()
    drop = own.isNotNull() & ~last & speed_implausible(own, F.col("dd"), F.col("dt"))
    return df.withColumn("raw_speed", F.when(drop, None).otherwise(F.coalesce(own, derived)))


def speed_series(df: DataFrame, keys: tuple[str, ...] = BY_TRACK, by: str = "seq") -> DataFrame:
    """Adds ``clean_speed``: the mean of five for tracks with any recorded speed, else the 3-sigma repair."""
    d = smooth5(raw_speed(df, keys, by), "raw_speed", "_smooth", keys, by)
    d = sigma_repair(d, "raw_speed", "_repaired", keys, by)
    return d.withColumn("clean_speed", F.when(F.col("recorded"), F.col("_smooth")).otherwise(F.col("_repaired"))).drop("_smooth", "_repaired")


def gap_speed_series(df: DataFrame) -> DataFrame:
    """Adds ``gap_speed``: the clean speed at the effort of level ground."""
    return df.withColumn("gap_speed", F.when((F.col("dd") > 0) & F.col("dz").isNotNull(), F.col("clean_speed") / minetti_factor(F.try_divide(F.col("dz"), F.col("dd")))))


def grade_series(points: DataFrame) -> DataFrame:
    """(track_id, seq, grade) per point: rise over run of the open window, once it is 20 m long; it restarts at 50 m.

    Where windows restart depends on all points before, so that is a fold over a track's ordered points, inside the
    JVM; it keeps nothing but the restarts. The points of each window then take their grade from the point at its base.
    """
    d = points.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("cum_dist").alias("x"), "ele"))).alias("ps"))
    # the place in ``ps`` of each window's base: the first point, then every restart
    zero = "named_struct('i', 0, 'base', ps[0].x, 'at', array(0))"
    step = "(s, p) -> named_struct('i', s.i + 1, 'base', if(p.x - s.base >= 50, p.x, s.base), 'at', if(p.x - s.base >= 50, array_append(s.at, s.i + 1), s.at))"
    d = d.select("track_id", "ps", F.expr(f"aggregate(slice(ps, 2, size(ps)), {zero}, {step}).at").alias("at"))
    window = "slice(ps, at[k] + 2, coalesce(get(at, k + 1), size(ps) - 1) - at[k])"
    grade = "if(p.x - ps[at[k]].x >= 20, (p.ele - ps[at[k]].ele) / (p.x - ps[at[k]].x), null)"
    each = f"flatten(transform(sequence(0, size(at) - 1), k -> transform({window}, p -> named_struct('seq', p.seq, 'grade', {grade}))))"
    return d.select("track_id", F.inline(F.expr(f"concat(array(named_struct('seq', ps[0].seq, 'grade', cast(null as double))), {each})")))


def grade_reading(series: DataFrame) -> DataFrame:
    """Adds ``reading``: the grade nearest by place where there is none; of two as near, the earlier."""
    a, i, b, j = _around("grade", BY_TRACK, "seq")
    d = series.withColumns({"_a": a, "_i": i, "_b": b, "_j": j})
    near = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).when(F.col("seq") - F.col("_i") <= F.col("_j") - F.col("seq"), F.col("_a")).otherwise(F.col("_b"))
    return d.withColumn("reading", near).drop("_a", "_i", "_b", "_j")


def elapsed_axis(points: DataFrame) -> DataFrame:
    return points.withColumn("elapsed_ms", F.greatest(F.lit(0), F.col("time_ms") - F.first("time_ms").over(ordered())))


def series_extremes(points: DataFrame, series: list[str]) -> DataFrame:
    """(track_id, series, lo, hi) of each named column."""
    long = points.unpivot(["track_id"], series, "series", "value")
    return long.groupBy("track_id", "series").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def series_range(extremes: DataFrame) -> DataFrame:
    """Adds a padded ``y_min`` and ``y_max``; the speed family keeps its top, elevation is padded by 4 m at least."""
    span, mean = F.col("hi") - F.col("lo"), (F.col("hi") + F.col("lo")) / 2
    pad = F.greatest(0.08 * span, 0.04 * F.abs(mean))
    pad = F.when(F.col("series") == "ele", F.greatest(0.08 * span, F.lit(4.0))).otherwise(F.when(pad > 0, pad).otherwise(F.lit(1.0)))
    low = F.when(F.col("series") == "ele", F.col("lo") - pad).otherwise(F.greatest(F.lit(0.0), F.col("lo") - pad))
    high = F.when(F.col("series").isin("clean_speed", "gap_speed"), F.col("hi")).otherwise(F.col("hi") + pad)
    return extremes.withColumns({"y_min": low, "y_max": high})


def overlay_availability(tracks: DataFrame) -> DataFrame:
    timed = F.col("has_time") | F.col("has_recorded_speed")
    return tracks.select("track_id", F.col("has_hr").alias("hr"), F.col("has_cad").alias("cad"), F.col("has_power").alias("power"), F.col("has_temp").alias("temp"), timed.alias("speed"), (timed & F.col("has_elevation")).alias("gap"), F.col("has_elevation").alias("grade"))


def thin_stride(points: DataFrame, most: int = 12000) -> DataFrame:
    """Every n-th point and the last, so that a track has about ``most`` at most."""
    w = Window.partitionBy("track_id")
    d = points.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(ordered()) - 1)
    return d.filter((F.col("_k") % F.ceil(F.col("_n") / most) == 0) | (F.col("_k") == F.col("_n") - 1)).drop("_n", "_k")


def simplify_dp(points: DataFrame, tolerance: float = 1.5, most: int = 12000) -> DataFrame:
    """(track_id, seq) of the points that Douglas-Peucker keeps; the tolerance doubles, eight times at most, until they are few enough.

    Level by level for all tracks at once: every open span between two kept points finds its farthest point; where that
    is beyond the tolerance the span splits there, else its points are done. Points are laid out once, by track and
    block of ``SPAN_BLOCK`` points, and never again: a level moves its open spans to the blocks that they reach into, each
    task finds its own farthest, and only those meet. A wider tolerance cuts the same tree higher up, so each kept point
    remembers the least distance on its way down, and nothing is done twice.
    """
    metre = EARTH_RADIUS_M * 3.141592653589793 / 180
    block = lambda seq: F.expr(f"({seq}) div {SPAN_BLOCK}")
    points = laid_by_track(points.select("track_id", block("seq").alias("block"), "seq", "lon", "lat"), "spans", by=("track_id", "block"))
    tracks = points.groupBy("track_id").agg(F.cos(F.radians(F.avg("lat"))).alias("_c"), F.min(F.struct("seq", "lon", "lat")).alias("_a"), F.max(F.struct("seq", "lon", "lat")).alias("_b"))
    tracks = stored(tracks, "ends")
    x, y = (lambda lon: lon * metre * F.col("_c")), (lambda lat: lat * metre)
    end = lambda e: F.struct(F.col(f"{e}.seq").alias("seq"), x(F.col(f"{e}.lon")).alias("x"), y(F.col(f"{e}.lat")).alias("y"))
    spans = tracks.select("track_id", "_c", end("_a").alias("a"), end("_b").alias("b"), F.lit(float("inf")).alias("reach"))
    share = "if(w > 0, least(1D, greatest(0D, ((x - a.x) * (b.x - a.x) + (y - a.y) * (b.y - a.y)) / w)), 0D)"
    levels: list[DataFrame] = []
    while True:
        spans = spans.filter("b.seq - a.seq > 1")
        marks = spans.select("track_id", "_c", "a", "b", F.explode(F.sequence(block("a.seq + 1"), block("b.seq - 1"))).alias("block"))
        d = points.join(marks, ["track_id", "block"]).filter("seq > a.seq and seq < b.seq").withColumns({"x": x(F.col("lon")), "y": y(F.col("lat"))})
        d = d.withColumn("w", F.expr("(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)")).withColumn("t", F.expr(share))
        d = d.withColumn("off", F.expr("sqrt(pow(x - a.x - t * (b.x - a.x), 2) + pow(y - a.y - t * (b.y - a.y), 2))"))
        far = d.groupBy("track_id", F.col("a.seq").alias("from")).agg(F.max(F.struct("off", (-F.col("seq")).alias("_n"), F.struct("seq", "x", "y").alias("at"))).alias("m"))
        far = far.filter(F.col("m.off") > tolerance)
        d = spans.withColumn("from", F.col("a.seq")).join(far, ["track_id", "from"])
        levels.append(stored(d.select("track_id", "_c", "a", "b", F.col("m.at").alias("at"), F.least("reach", "m.off").alias("reach")), "splits"))
        if levels[-1].isEmpty():
            break
        halves = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("a", "at"), ("at", "b"))])
        spans = levels[-1].select("track_id", "_c", F.inline(halves), "reach")
    kept = tracks.select("track_id", F.explode(F.array_distinct(F.array("_a.seq", "_b.seq"))).alias("seq"), F.lit(float("inf")).alias("reach"))
    for level in levels[:-1]:
        kept = kept.unionByName(level.select("track_id", F.col("at.seq").alias("seq"), "reach"))
    limits = [tolerance * 2**k for k in range(9)]
    few = kept.groupBy("track_id").agg(*[F.count_if(F.col("reach") > limit).alias(f"n{k}") for k, limit in enumerate(limits)])
    limit = F.coalesce(*[F.when(F.col(f"n{k}") <= most, F.lit(limit)) for k, limit in enumerate(limits)], F.lit(limits[-1]))
    return kept.join(few.select("track_id", limit.alias("limit")), "track_id").filter("reach > limit").select("track_id", "seq")


def cum_distance_by_blocks(points: DataFrame, digits: int | None = None, block: int = 65536) -> DataFrame:
    """``cum_distance`` for tracks of any length: a track is worked in blocks of points by many tasks.

    Two levels: distances and running sums inside each block, then the sums of the blocks before it, of which a track has
    one for each block. A block's first point is measured from the last one of the block before.
    """
    cut = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    p = points.withColumn("_block", F.expr(f"seq div {block}"))
    lasts = p.groupBy("track_id", "_block").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("_last"))
    over = ordered(by="_block")
    lasts = lasts.select("track_id", "_block", F.lag("_last").over(over).alias("_before"))
    w = ordered(("track_id", "_block"))
    d = p.join(lasts, ["track_id", "_block"])
    lat, lon = (F.coalesce(F.lag(c).over(w), F.col(f"_before.{c}")) for c in ("lat", "lon"))
    d = d.withColumn("seg_m", cut(F.coalesce(haversine(lat, lon, F.col("lat"), F.col("lon")), F.lit(0.0)))).drop("_before")
    d = stored(d.withColumn("cum_dist", F.sum("seg_m").over(running(("track_id", "_block")))), "blocks")
    sums = d.groupBy("track_id", "_block").agg(F.max("cum_dist").alias("_sum"))
    sums = sums.select("track_id", "_block", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_earlier"))
    return d.join(sums, ["track_id", "_block"]).withColumn("cum_dist", cut(F.col("_earlier") + F.col("cum_dist"))).select(*points.columns, "seg_m", "cum_dist")


def cadence_convention(records: DataFrame) -> DataFrame:
    """(track_id, convention, factor): whether cadence counts one leg or both, from speed and step length."""
    k = F.col("speed") * 60 / (F.col("step_length") / 1000) / F.col("cadence")
    usable = records.filter("speed > 0.5 and cadence > 0 and step_length > 0").withColumn("k", k)
    share = usable.groupBy("track_id").agg(F.count("*").alias("n"), F.avg(F.col("k").between(1.6, 2.4).cast("double")).alias("single"), F.avg(F.col("k").between(0.7, 1.4).cast("double")).alias("double"))
    known = (F.col("n") >= 30) & (F.greatest("single", "double") >= 0.55)
    kind = F.when(~known, "unknown").when(F.col("single") >= F.col("double"), "single").otherwise("double")
    return share.select("track_id", kind.alias("convention"), F.when(kind == "single", 2).otherwise(1).alias("factor"))
