"""Sectors of tracks: places along a track, the walk over a sector, pauses, and all metrics of a sector.

As-of lookups are partitioned by track. A sector's points are found through blocks of neighbouring points, so a
sector meets only the blocks it reaches into; from there on everything is partitioned by (track_id, sector_id), and
the sectors of one long track are worked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacewright.functions.geo import MOVING_MPS, PAUSE_MIN_S, lerp, minetti_factor, segment_3d, segment_type, speed_implausible
from pacewright.operators.track import ordered, running, speed_series, with_next
from pacewright.sources.layout import laid_by_track

SECTOR = ("track_id", "sector_id")
BLOCK = 128  # points that a sector meets together
_PLACE = ("lat", "lon", "ele", "time_ms")


def length_sectors(length: float, tail: str) -> Column:
    """The sectors of ``split_by_length`` of a row with ``total_distance``, as an array."""
    total = F.col("total_distance")
    n = F.greatest(F.lit(1), F.ceil((total - 200) / length)).cast("int")

    def one(k: Column) -> Column:
        end = F.least(k * length + length, total)
        end = F.when(k == n - 1, total).otherwise(end) if tail == "fold" else end
        return F.struct(k.alias("sector_id"), (k * length).alias("start_m"), end.alias("end_m"))

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def split_by_length(tracks: DataFrame, length: float = 1000.0, tail: str = "drop") -> DataFrame:
    """Sectors of a fixed length; a rest of up to 200 m is left out or folded into the last one (``tail``)."""
    return tracks.select("track_id", F.inline(length_sectors(length, tail)))


def normalize_sector(sectors: DataFrame, tracks: DataFrame, least: float = 5.0) -> DataFrame:
    """Ends put in order, held within the track and at least ``least`` metres apart."""
    d = sectors.join(tracks.select("track_id", "total_distance"), "track_id")
    a = F.greatest(F.lit(0.0), F.least(F.least("start_m", "end_m"), F.col("total_distance")))
    b = F.greatest(F.lit(0.0), F.least(F.greatest("start_m", "end_m"), F.col("total_distance")))
    d = d.withColumns({"_a": a, "_b": b})
    short = F.col("_b") - F.col("_a") < least
    b2 = F.when(short, F.least(F.col("_a") + least, F.col("total_distance"))).otherwise(F.col("_b"))
    a2 = F.when(short, F.greatest(F.lit(0.0), F.least(F.col("_a"), b2 - least))).otherwise(F.col("_a"))
    return d.withColumns({"start_m": a2, "end_m": b2}).drop("_a", "_b")


def is_entire_track(sectors: DataFrame, tracks: DataFrame) -> DataFrame:
    d = sectors.join(tracks.select("track_id", "total_distance"), "track_id")
    return d.withColumn("entire", (F.col("start_m") <= 0.5) & (F.col("end_m") >= F.col("total_distance") - 0.5))


def sector_context_window(sectors: DataFrame, tracks: DataFrame, least: float = 100.0) -> DataFrame:
    """Adds the window in which the sector fills 82 %; null where that is the whole track."""
    d = sectors.join(tracks.select("track_id", "total_distance"), "track_id")
    lo, hi, total = F.least("start_m", "end_m"), F.greatest("start_m", "end_m"), F.col("total_distance")
    width = F.least(F.greatest((hi - lo) / 0.82, F.lit(least)), total)
    start = F.least(F.greatest((lo + hi) / 2 - width / 2, F.lit(0.0)), total - width)
    return d.withColumn("win_start", F.when(width < total, start)).withColumn("win_end", F.when(width < total, start + width))


def point_at_distance(points: DataFrame, requests: DataFrame, at: str = "d") -> DataFrame:
    """Adds to each request (track_id, d, ...) the point of the track there: i, t, lat, lon, ele, time_ms, dist.

    An as-of join: points and requests are put in one order by distance, and each request takes the last
    point before it. Distances are held within the track; at 0 it is the first point.
    """
    names = [c for c in requests.columns if c != "track_id"]
    w = ordered()
    ahead = F.struct(F.lead("cum_dist").over(w).alias("cum"), *[F.lead(c).over(w).cast("double").alias(c) for c in _PLACE])
    here = F.struct(F.col("seq"), F.col("cum_dist").alias("cum"), *[F.col(c).cast("double").alias(c) for c in _PLACE], ahead.alias("next"))
    p = points.select("track_id", F.col("cum_dist").alias("_x"), F.col("seq").alias("_k"), here.alias("_p"))
    r = requests.select("track_id", F.greatest(F.col(at), F.lit(0.0)).alias("_x"), F.lit(1 << 30).alias("_k"), F.struct(*names).alias("_r"))
    both = p.unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy("track_id").orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn("_first", F.first("_p", True).over(order)).withColumn("_last", F.last("_p", True).over(order)).filter("_r is not null")
    d = d.withColumn("_p", F.when(F.col("_x") <= 0, F.col("_first")).otherwise(F.col("_last")))
    span = F.col("_p.next.cum") - F.col("_p.cum")
    t = F.when((F.col("_x") > 0) & (span > 0), F.least(F.lit(1.0), (F.col("_x") - F.col("_p.cum")) / span)).otherwise(F.lit(0.0))
    d = d.withColumn("_t", t)
    placed = [F.when(F.col("_p.next.cum").isNull(), F.col(f"_p.{c}")).otherwise(lerp(F.col(f"_p.{c}"), F.col(f"_p.next.{c}"), F.col("_t"))).alias(c) for c in _PLACE]
    dist = F.when(F.col("_p.next.cum").isNull(), F.col("_p.cum")).otherwise(F.col("_x"))
    return d.select("track_id", *[F.col(f"_r.{c}").alias(c) for c in names], F.col("_p.seq").alias("i"), F.col("_t").alias("t"), *placed, dist.alias("dist"))


def located(points: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sectors with the points before their ends as ``a`` and ``b``, structs of number ``i`` and distance ``x``.

    The as-of join of ``point_at_distance``, with nothing of a point but its number.
    """
    ends = sectors.select("track_id", F.inline(F.array(*[F.struct(F.struct("sector_id", F.lit(e).alias("end")).alias("_r"), x.alias("_x")) for e, x in (("a", F.col("start_m")), ("b", F.greatest("start_m", "end_m")))])))
    r = ends.select("track_id", F.greatest("_x", F.lit(0.0)).alias("_x"), F.lit(1 << 30).alias("_k"), "_r")
    both = points.select("track_id", F.col("cum_dist").alias("_x"), F.col("seq").alias("_k")).unionByName(r, allowMissingColumns=True)
    order = Window.partitionBy("track_id").orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("_r").isNull(), F.col("_k"))
    d = both.withColumns({"_first": F.first(own, True).over(order), "_last": F.last(own, True).over(order)}).filter("_r is not null")
    d = d.select("track_id", "_r.*", F.struct(F.when(F.col("_x") <= 0, F.col("_first")).otherwise(F.col("_last")).alias("i"), F.col("_x").alias("x")).alias("p"))
    return d.groupBy(*SECTOR).agg(*[F.max(F.when(F.col("end") == e, F.col("p"))).alias(e) for e in ("a", "b")])


def _place_at(end: str) -> dict[str, Column]:
    """The place of a sector's end on the step from its point to the next, as ``point_at_distance`` has it."""
    x, cum, ahead = F.col(f"{end}.x"), F.col("cum_dist"), F.col("n_cum")
    t = F.when((x > 0) & (ahead - cum > 0), F.least(F.lit(1.0), (x - cum) / (ahead - cum))).otherwise(F.lit(0.0))
    at = lambda own, after: F.when(ahead.isNull(), F.col(own)).otherwise(lerp(F.col(own), F.col(after), t))
    return {"t": t, "dist": F.when(ahead.isNull(), cum).otherwise(x), "ele": at("v_ele", "n_ele"), "ms": at("v_ms", "n_ms")}


def sector_walk(points: DataFrame, sectors: DataFrame) -> DataFrame:
    """The steps of each sector: from its interpolated start over its points to its interpolated end.

    Row 0 stands for the point at or before the start; each later row closes a step (``seg_h``, ``d_ele``,
    ``dt`` in seconds). Rows of points carry their readings (and zones, where points have them); the last row is the
    sector's end and has none.
    ``moving`` marks timed steps of 0.5 km/h or more, ``paused`` those in a stop of ten seconds or more.
    """
    p, w = with_next(points), ordered()
    cols = ["hr", "cad", "power", "temp", "speed", "recorded", "dd", "dt", "dz", *[c for c in ("next_hr", "zone", "next_zone") if c in p.columns]]
    ahead = {"n_cum": F.lead("cum_dist").over(w), "n_ele": F.lead("ele").over(w), "n_ms": F.lead("time_ms").over(w).cast("double")}
    # what follows from a point and the next one is made behind the join
    moved = [c for c in cols if c not in ("dt", "dz")]
    p = p.withColumns(ahead).select("track_id", F.col("seq").alias("vseq"), "cum_dist", F.col("ele").cast("double").alias("v_ele"), F.col("time_ms").cast("double").alias("v_ms"), *ahead, *[F.col(c).alias(f"v_{c}") for c in moved])
    s = located(points, sectors).withColumn("block", F.explode(F.expr(f"sequence(a.i div {BLOCK}, b.i div {BLOCK})")))
    d = s.join(p.withColumn("block", F.expr(f"vseq div {BLOCK}")), ["track_id", "block"]).filter("vseq between a.i and b.i")
    d = d.withColumns({"v_dt": (F.col("n_ms") - F.col("v_ms")) / 1000.0, "v_dz": F.col("n_ele") - F.col("v_ele")})
    a, b = _place_at("a"), _place_at("b")
    row = lambda kind, step, dist, ele, ms: F.struct(F.lit(kind).alias("kind"), step.cast("int").alias("step"), dist.alias("to_dist"), ele.alias("to_ele"), ms.alias("to_ms"))
    first = F.when(F.col("vseq") == F.col("a.i"), row("start", F.lit(0), a["dist"], a["ele"], a["ms"]))
    inner = F.when(F.col("vseq") > F.col("a.i"), row("point", F.col("vseq") - F.col("a.i"), F.col("cum_dist"), F.col("v_ele"), F.col("v_ms")))
    last = F.when(F.col("vseq") == F.col("b.i"), row("end", F.col("vseq") - F.col("a.i") + 1, b["dist"], b["ele"], b["ms"]))
    d = d.withColumns({"_1": first, "_2": inner, "_3": last}).withColumn("_r", F.explode(F.expr("filter(array(_1, _2, _3), r -> r is not null)")))
    # between the ends these follow from the step's own columns, so they are not moved
    own = {c: F.when((F.col("_r.kind") != "point") | rest, F.col(c)).alias(c) for c, rest in (("v_ele", F.lit(False)), ("v_dt", F.col("vseq") == F.col("b.i")), ("v_dz", F.col("vseq") == F.col("b.i")))}
    d = d.select(*SECTOR, "vseq", own["v_ele"], *[own.get(f"v_{c}", F.col(f"v_{c}")) for c in cols], F.when(F.col("_r.kind") == "end", b["t"]).alias("end_t"), (F.col("vseq") == F.col("b.i")).alias("last"), "_r.*")
    # points met their sectors where they lie, by track; from here on the sectors of one track are dealt out
    d, w = d.repartition(*SECTOR), ordered(SECTOR, "step")
    d = d.withColumn("seg_h", F.greatest(F.lit(0.0), F.col("to_dist") - F.lag("to_dist").over(w)))
    d = d.withColumn("d_ele", F.col("to_ele") - F.lag("to_ele").over(w)).withColumn("from_ms", F.lag("to_ms").over(w)).withColumn("from_dist", F.lag("to_dist").over(w))
    d = d.withColumn("dt", (F.col("to_ms") - F.col("from_ms")) / 1000)
    inner, w = (F.col("kind") == "point"), ordered(SECTOR, "step")
    d = d.withColumns({c: F.when(inner & ~F.col("last"), F.lead(n).over(w)).otherwise(F.col(c)) for c, n in (("v_dt", "dt"), ("v_dz", "d_ele"))} | {"v_ele": F.when(inner, F.col("to_ele")).otherwise(F.col("v_ele"))})
    timed = F.coalesce(F.col("dt") > 0, F.lit(False))
    d = d.withColumn("timed", timed).withColumn("moving", timed & (F.try_divide(F.col("seg_h"), F.col("dt")) >= MOVING_MPS))
    d = d.withColumn("moving", F.coalesce("moving", F.lit(False))).withColumn("island", F.sum(F.col("moving").cast("int")).over(running(SECTOR, "step")))
    stop = F.sum(F.when(F.col("timed") & ~F.col("moving"), F.col("dt"))).over(Window.partitionBy(*SECTOR, "island"))
    return d.withColumn("paused", F.col("timed") & ~F.col("moving") & F.coalesce(stop >= PAUSE_MIN_S, F.lit(False)))


def laid_walk(walk: DataFrame) -> DataFrame:
    """A walk written by sector, for what reads it more than once: every reader takes its sectors where they lie."""
    return laid_by_track(walk, "walk", by=SECTOR, order=("step",), dealt=True)


def pause_spans(walk: DataFrame) -> DataFrame:
    """(track_id, sector_id, t0, t1) of the confirmed pauses."""
    spans = walk.filter("paused").groupBy(*SECTOR, "island").agg(F.min("from_ms").alias("t0"), F.max("to_ms").alias("t1"))
    return spans.drop("island")


class Part:
    """Some measures of a sector: aggregates over its walk, columns made of them, and the names given out."""

    def __init__(self, names: list[str], sums: list[Column], *steps: dict[str, Column]):
        self.names, self.sums, self.steps = names, sums, steps


def aggregated(walk: DataFrame, *parts: Part) -> DataFrame:
    """The measures of some parts in one pass over the walk."""
    d = walk.groupBy(*SECTOR).agg(*[c for p in parts for c in p.sums])
    for p in parts:
        for columns in p.steps:
            d = d.withColumns(columns)
    return d.select(*SECTOR, *[n for p in parts for n in p.names])


def _at(kind: str, column: str) -> Column:
    return F.max(F.when(F.col("kind") == kind, F.col(column)))


def _distance() -> Part:
    return Part(["horizontal_m", "distance_3d"], [(F.max("to_dist") - F.min("to_dist")).alias("horizontal_m"), F.sum(segment_3d(F.col("seg_h"), F.col("d_ele"))).alias("distance_3d")])


def sector_distance(walk: DataFrame) -> DataFrame:
    return aggregated(walk, _distance())


def _fold() -> Part:
    """What depends on all steps before: filtered gain and loss, seconds of rising and falling trend, and grade windows.

    One fold per sector over its ordered steps, inside the JVM: the residual is credited past 3 m; a grade
    window closes at 50 m; the last open one counts from 20 m.
    """
    step = F.struct("step", "d_ele", "seg_h", F.col("to_ele").alias("e"), F.when(F.col("timed") & ~F.col("paused"), F.col("dt")).otherwise(F.lit(0.0)).alias("dt"))
    sums = [F.array_sort(F.collect_list(F.when(F.col("step") > 0, step))).alias("steps"), F.max(F.when(F.col("step") == 0, F.col("to_ele"))).alias("e0")]
    zero = "named_struct('r', 0D, 'g', 0D, 'l', 0D, 'up', 0D, 'down', 0D, 'acc', 0D, 'we', e0, 'hi', cast(null as double), 'lo', cast(null as double))"
    # the new residual, then what is credited, then the trend and the window
    merge = """(s, x) -> if(x.d_ele is null, s, named_struct(
        'r', if(abs(s.r + x.d_ele) > 3, 0D, s.r + x.d_ele),
        'g', s.g + if(s.r + x.d_ele > 3, s.r + x.d_ele, 0D),
        'l', s.l + if(s.r + x.d_ele < -3, -(s.r + x.d_ele), 0D),
        'up', s.up + if(s.r + x.d_ele > 0, x.dt, 0D),
        'down', s.down + if(s.r + x.d_ele < 0, x.dt, 0D),
        'acc', if(s.acc + x.seg_h >= 50, 0D, s.acc + x.seg_h),
        'we', if(s.acc + x.seg_h >= 50, x.e, s.we),
        'hi', if(s.acc + x.seg_h >= 50, greatest(s.hi, (x.e - s.we) / (s.acc + x.seg_h)), s.hi),
        'lo', if(s.acc + x.seg_h >= 50, least(s.lo, (x.e - s.we) / (s.acc + x.seg_h)), s.lo)))"""
    tail = "if(f.acc >= 20, (element_at(steps, -1).e - f.we) / f.acc, null)"
    known = F.col("e0").isNotNull()
    out = {
        "gain": F.when(known, F.col("f.g")),
        "loss": F.when(known, F.col("f.l")),
        "climb_s": F.col("f.up"),
        "descend_s": F.col("f.down"),
        "max_grade": F.expr(f"greatest(f.hi, {tail})"),
        "min_grade": F.expr(f"least(f.lo, {tail})"),
    }
    return Part(list(out), sums, {"f": F.expr(f"aggregate(steps, {zero}, {merge})")}, out)


def folded(walk: DataFrame) -> DataFrame:
    return aggregated(walk, _fold())


def sector_gain_loss(walk: DataFrame) -> DataFrame:
    return folded(walk).select(*SECTOR, "gain", "loss")


def sector_grades(walk: DataFrame) -> DataFrame:
    return folded(walk).select(*SECTOR, "max_grade", "min_grade")


def _rates() -> dict[str, Column]:
    rate = lambda m, s: F.when((F.col(s) > 0) & (F.col(m) > 0), F.col(m) / (F.col(s) / 3600))
    return {"vam": rate("gain", "climb_s"), "vdm": rate("loss", "descend_s")}


def vertical_rates(walk: DataFrame) -> DataFrame:
    """Metres an hour while the filtered trend rises (vam) or falls (vdm)."""
    return folded(walk).withColumns(_rates()).select(*SECTOR, "vam", "vdm")


def _elevation() -> Part:
    own = F.when(F.col("kind") != "end", F.col("v_ele"))
    sums = [_at("start", "to_ele").alias("ele_start"), _at("end", "to_ele").alias("ele_end"), F.min(F.least("to_ele", own)).alias("ele_min"), F.max(F.greatest("to_ele", own)).alias("ele_max")]
    return Part(["ele_start", "ele_end", "ele_min", "ele_max", "net"], sums, {"net": F.col("ele_end") - F.col("ele_start")})


def sector_elevation(walk: DataFrame) -> DataFrame:
    return aggregated(walk, _elevation())


def _times() -> Part:
    return Part(["start_ms", "end_ms"], [_at("start", "to_ms").alias("start_ms"), _at("end", "to_ms").alias("end_ms")])


def _moving() -> Part:
    elapsed = (F.col("t_b") - F.col("t_a")) / 1000
    sums = [F.sum(F.when(F.col("timed") & ~F.col("paused"), F.col("dt"))).alias("moving"), _at("start", "to_ms").alias("t_a"), _at("end", "to_ms").alias("t_b")]
    return Part(["moving_s", "elapsed_s"], sums, {"moving_s": F.when(F.col("moving") > 0, F.col("moving")), "elapsed_s": F.when(elapsed > 0, elapsed)})


def moving_time(walk: DataFrame) -> DataFrame:
    """Seconds outside confirmed pauses, and between the ends; null if not positive."""
    return aggregated(walk, _moving())


def _temperature() -> Part:
    t = F.when(F.col("kind") != "end", F.col("v_temp"))
    return Part(["avg_temp", "min_temp", "max_temp"], [F.avg(t).alias("avg_temp"), F.min(t).alias("min_temp"), F.max(t).alias("max_temp")])


def temp_stats(walk: DataFrame) -> DataFrame:
    return aggregated(walk, _temperature())


def _series() -> dict[str, Column]:
    """What is cleaned within a sector: its values at the rows of the walk that have any."""
    own = F.when(F.col("v_speed") >= 0, F.col("v_speed"))
    derived = F.when((F.col("v_dt") > 0) & (F.col("v_dd") >= 0), F.try_divide("v_dd", "v_dt"))
    ruled_out = own.isNotNull() & ~F.col("last") & speed_implausible(own, F.col("v_dd"), F.col("v_dt"))
    step = F.col("moving") & (F.col("seg_h") > 0) & F.col("d_ele").isNotNull()
    reading = (F.col("kind") != "end") & ~((F.col("kind") == "point") & F.col("paused"))
    return {
        "speed": F.when(F.col("moving"), F.try_divide("seg_h", "dt")),
        "gap": F.when(step, F.col("dt") / F.col("seg_h") * 1000 / minetti_factor(F.try_divide("d_ele", "seg_h"))),
        "top": F.when(~ruled_out, F.coalesce(own, derived)),
        **{c: F.when(reading, F.col(f"v_{c}")) for c in ("hr", "cad", "power")},
    }


def cleaned(walk: DataFrame, *names: str) -> DataFrame:
    """(track_id, sector_id, vseq, metric, recorded, smooth, kept) of the named series, all cleaned in one pass.

    ``smooth`` is the mean of five values, ``kept`` the value if it lies within three standard deviations of the
    sector's mean. Rows without a value are left out, but for ``top``, whose places count for the mean of five.
    """
    series = _series()
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), series[n].alias("v"), (F.col("kind") != "end" if n == "top" else series[n].isNotNull()).alias("use")) for n in names]))
    d = walk.select(*SECTOR, "step", "vseq", F.col("v_recorded").alias("recorded"), each).filter("use")
    keys = (*SECTOR, "metric")
    w = Window.partitionBy(*keys)
    d = d.withColumns({"smooth": F.avg("v").over(ordered(keys, "step").rowsBetween(-2, 2)), "_m": F.avg("v").over(w), "_s": F.stddev_pop("v").over(w), "_n": F.count("v").over(w)})
    off = F.abs(F.col("v") - F.col("_m")) > 3 * F.col("_s")
    few = (F.col("metric") == "top") & ((F.col("_n") < 3) | (F.col("_s") == 0))
    return d.select(*SECTOR, "vseq", "metric", "recorded", "smooth", F.when(few | ~off, F.col("v")).alias("kept"))


def _clean_stats(walk: DataFrame, *names: str) -> DataFrame:
    """One row per sector with means and tops of the named series; speeds are smoothed where any speed is recorded, else
    without outliers. A repaired outlier lies between its neighbours, so the top of the kept values is the top of all."""
    best = F.when(F.col("recorded"), F.col("smooth")).otherwise(F.col("kept"))
    of = lambda n, c: F.when(F.col("metric") == n, c)
    sums = {"speed": [F.avg(of("speed", best)).alias("avg_speed")], "gap": [F.avg(of("gap", best)).alias("avg_gap")], "top": [F.max(of("top", best)).alias("max_speed")]}
    sums |= {c: [f(of(c, F.col("smooth"))).alias(f"{k}_{c}") for k, f in (("avg", F.avg), ("max", F.max))] for c in ("hr", "cad", "power")}
    d = cleaned(walk, *names).groupBy(*SECTOR).agg(*[c for n in names for c in sums[n]])
    if "speed" in names:
        d = d.withColumn("avg_pace", F.when(F.col("avg_speed") > 0, 1000 / F.col("avg_speed")))
    if "top" in names:
        d = d.withColumn("max_speed", F.when(F.col("max_speed") > 0, F.col("max_speed")))
    return d


def avg_speed(walk: DataFrame) -> DataFrame:
    return _clean_stats(walk, "speed")


def avg_gap(walk: DataFrame) -> DataFrame:
    return _clean_stats(walk, "gap")


def max_speed(walk: DataFrame) -> DataFrame:
    return _clean_stats(walk, "top")


def fitness_series(walk: DataFrame) -> DataFrame:
    """(track_id, sector_id, vseq, metric, value): readings outside pauses, smoothed over those left."""
    return cleaned(walk, "hr", "cad", "power").select(*SECTOR, "vseq", "metric", F.col("smooth").alias("value"))


def fitness_readings(walk: DataFrame) -> DataFrame:
    """The walk with ``hr``, ``cad`` and ``power`` as ``fitness_series`` has them, in the rows that they belong to."""
    d, series = walk, _series()
    for c in ("hr", "cad", "power"):
        d = d.withColumn("_v", series[c]).withColumn("_has", F.col("_v").isNotNull())
        d = d.withColumn(c, F.when(F.col("_has"), F.avg("_v").over(ordered((*SECTOR, "_has"), "step").rowsBetween(-2, 2))))
    return d.drop("_v", "_has")


def fitness_stats(walk: DataFrame) -> DataFrame:
    return _clean_stats(walk, "hr", "cad", "power")


def sector_speed_series(walk: DataFrame, *more: str) -> DataFrame:
    """(track_id, sector_id, vseq, clean_speed, v_dd, v_dz, more columns of the walk) of the sector's points, cleaned within the sector."""
    rows = walk.filter("kind <> 'end'").select(*SECTOR, "vseq", F.col("v_speed").alias("speed"), F.col("v_recorded").alias("recorded"), F.col("v_dd").alias("dd"), F.col("v_dt").alias("dt"), "v_dd", "v_dz", *more)
    return speed_series(rows, SECTOR, "vseq").select(*SECTOR, "vseq", "clean_speed", "v_dd", "v_dz", *more)


def fastest_slowest_km(walk: DataFrame, window: float = 1000.0) -> DataFrame:
    """Least and most pause-free seconds over any whole kilometre that begins at a point of the walk, and where it ends.

    An as-of join of the walk with itself a kilometre further on: ends of windows and points of the walk
    are put in one order, and each end lies between its neighbours. Paused seconds up to any place are a
    running sum, so those inside a window are a difference.
    """
    w = running(SECTOR, "step")
    d = walk.withColumn("_p", F.sum(F.when(F.col("paused"), F.col("to_ms") - F.col("from_ms")).otherwise(F.lit(0.0))).over(w))
    place = F.struct(F.col("to_dist").alias("d"), F.col("to_ms").alias("t"), F.col("_p").alias("p"), "paused", "step")
    row = lambda x, k, at, begin: F.struct(x.alias("x"), k.alias("k"), at.alias("at"), begin.alias("begin"))
    both = d.select(*SECTOR, "to_dist", "step", place.alias("place")).withColumn("no", F.when(F.lit(False), F.col("place")))
    here = row(F.col("to_dist"), F.col("step"), F.col("place"), F.col("no"))
    both = both.select(*SECTOR, F.inline(F.array(here, row(F.col("to_dist") + window, F.lit(-1), F.col("no"), F.col("place")))))
    before = Window.partitionBy(*SECTOR).orderBy("x", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*SECTOR).orderBy(F.col("x").desc(), F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("lo", F.last("at", True).over(before)).withColumn("hi", F.last("at", True).over(after))
    both = both.filter("begin is not null and hi is not null and lo is not null")
    span = F.col("hi.d") - F.col("lo.d")
    t = F.when(span > 0, F.col("lo.t") + (F.col("hi.t") - F.col("lo.t")) * (F.col("x") - F.col("lo.d")) / span).otherwise(F.col("lo.t"))
    both = both.withColumn("t", t)
    paused = F.col("lo.p") - F.col("begin.p") + F.when(F.col("hi.paused"), F.col("t") - F.col("lo.t")).otherwise(F.lit(0.0))
    pace = (F.col("t") - F.col("begin.t") - paused) / 1000
    rows = both.select(*SECTOR, pace.alias("pace"), F.col("x").alias("dist"), F.col("begin.step").alias("step")).filter("pace > 0")
    low = F.min_by(F.struct("pace", "dist"), F.struct("pace", "step"))
    high = F.max_by(F.struct("pace", "dist"), F.struct(F.col("pace"), -F.col("step")))
    return rows.groupBy(*SECTOR).agg(low.alias("f"), high.alias("s")).select(*SECTOR, F.col("f.pace").alias("fastest_pace"), F.col("f.dist").alias("fastest_dist"), F.col("s.pace").alias("slowest_pace"), F.col("s.dist").alias("slowest_dist"))


def effort_and_grade(horizontal: str = "horizontal_m") -> dict:
    h, gain, loss = F.col(horizontal), F.col("gain"), F.col("loss")
    return {"effort_distance": h + gain * 10, "avg_grade": F.when((h > 0) & ~((gain == 0) & (loss > 0)), gain / h)}


def effort_distance(walk: DataFrame) -> DataFrame:
    """Metres with climb, and the average grade."""
    return aggregated(walk, _distance(), _fold()).withColumns(effort_and_grade()).select(*SECTOR, "effort_distance", "avg_grade")


def sector_kind(walk: DataFrame) -> DataFrame:
    """flat, climb, descent or mixed."""
    return aggregated(walk, _fold(), _elevation()).select(*SECTOR, segment_type(F.col("gain"), F.col("loss"), F.col("net")).alias("kind"))


def sector_metrics(points: DataFrame, sectors: DataFrame) -> DataFrame:
    """All metrics of each sector, one row each."""
    return walk_metrics(laid_walk(sector_walk(points, sectors)))


def walk_metrics(walk: DataFrame) -> DataFrame:
    """All metrics of each sector of a walk that is stored: aggregates and folds, cleaned series, and kilometres each read it in one pass."""
    found = aggregated(walk, _distance(), _fold(), _elevation(), _moving(), _times(), _temperature())
    for part in (_clean_stats(walk, "speed", "gap", "top", "hr", "cad", "power"), fastest_slowest_km(walk)):
        found = found.join(part, list(SECTOR), "left")
    found = found.withColumns(effort_and_grade() | _rates())
    return found.withColumn("segment_type", segment_type(F.col("gain"), F.col("loss"), F.col("net"))).drop("climb_s", "descend_s")


def track_stats(points: DataFrame, tracks: DataFrame) -> DataFrame:
    whole = tracks.select("track_id", F.lit(0).alias("sector_id"), F.lit(0.0).alias("start_m"), F.col("total_distance").alias("end_m"))
    return sector_metrics(points, whole)


def sector_leaderboard(metrics: DataFrame, best: int = 3) -> DataFrame:
    """The fastest sectors of each type, by average pace."""
    w = Window.partitionBy("segment_type").orderBy("avg_pace", *SECTOR)
    return metrics.filter("avg_pace is not null").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= best).select("segment_type", "place", *SECTOR, "avg_pace")


def sector_totals(metrics: DataFrame, *keys: str) -> DataFrame:
    """Totals over all sectors, per leading key, and per all keys: sectors, metres, gain, loss, moving seconds, mean pace."""
    d = metrics.rollup(*keys).agg(F.count("*").alias("sectors"), F.sum("horizontal_m").alias("horizontal_m"), F.sum("gain").alias("gain"), F.sum("loss").alias("loss"), F.sum("moving_s").alias("moving_s"), F.grouping_id().alias("level"))
    return d.withColumn("pace", F.when(F.col("horizontal_m") > 0, F.col("moving_s") / F.col("horizontal_m") * 1000))
