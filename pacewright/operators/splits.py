"""Splitting tracks by waypoint and by slope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacewright.operators.track import ordered, running


def split_by_waypoint(waypoints: DataFrame, tracks: DataFrame, spacing: float = 100.0) -> DataFrame:
    """Sectors between waypoints (track_id, dist, name) that lie far enough from the one kept before and from the end.

    Which waypoints stay depends on those kept before: a fold over each track's few waypoints, inside the JVM.
    """
    w = waypoints.join(tracks.select("track_id", "total_distance"), "track_id").groupBy("track_id", "total_distance")
    d = w.agg(F.array_sort(F.collect_list(F.struct("dist", "wp_seq", "name"))).alias("ws"))
    first = "array(named_struct('dist', 0D, 'name', cast(null as string)))"
    keep = f"x.dist - element_at(s, -1).dist >= {spacing} and total_distance - x.dist >= {spacing}"
    d = d.withColumn("b", F.expr(f"aggregate(ws, {first}, (s, x) -> if({keep}, concat(s, array(named_struct('dist', x.dist, 'name', nullif(x.name, '')))), s))"))
    d = d.filter("size(b) > 1").select("track_id", "total_distance", F.posexplode("b").alias("sector_id", "s"))
    end = F.coalesce(F.lead("s.dist").over(ordered(("track_id",), "sector_id")), F.col("total_distance"))
    return d.select("track_id", "sector_id", F.col("s.dist").alias("start_m"), end.alias("end_m"), F.col("s.name").alias("name"))


def grade_class(points: DataFrame, half: float = 25.0, limit: float = 0.025) -> DataFrame:
    """Adds ``cls``: 1 climbing, -1 descending, 0 flat, by the slope over the points within 25 m either side; tracks without
    elevation at every point are left out."""
    w = Window.partitionBy("track_id").orderBy("cum_dist").rangeBetween(-int(half), int(half))
    low, high = F.struct("cum_dist", "seq", "ele"), F.struct("cum_dist", "seq", "ele")
    d = points.withColumn("_all", F.bool_and(F.col("ele").isNotNull()).over(Window.partitionBy("track_id"))).filter("_all").drop("_all")
    d = d.withColumns({"_a": F.min(low).over(w), "_b": F.max(high).over(w)})
    span = F.col("_b.cum_dist") - F.col("_a.cum_dist")
    grade = F.when((span >= half), (F.col("_b.ele") - F.col("_a.ele")) / span)
    return d.withColumn("cls", F.coalesce(F.when(grade > limit, 1).when(grade < -limit, -1), F.lit(0))).drop("_a", "_b")


def grade_runs(classed: DataFrame) -> DataFrame:
    """(track_id, run, cls, start_m, end_m): runs of one class; the outer ones reach the ends of the track."""
    w = ordered()
    d = classed.withColumn("_new", F.coalesce((F.col("cls") != F.lag("cls").over(w)).cast("int"), F.lit(0))).withColumn("run", F.sum("_new").over(running()))
    return d.groupBy("track_id", "run").agg(F.first("cls").alias("cls"), F.min("cum_dist").alias("start_m"), F.max("cum_dist").alias("end_m"))


#: A round of merges over ``a.s``, the runs (b, e, c, n: begin, end, class, length) of a track that are left. A run shorter than
#: the least length goes now if none within two places comes before it in order of (length, place). Merges of shorter runs
#: farther off then change neither its neighbours nor which of them it joins, so all such runs go at once and the result
#: is that of one after another. ``l`` and ``r``: it joins the run to its left, to its right, or both if they are of one class.
_BEFORE, _AFTER = (lambda k: f"coalesce(get(a.s, i - {k}).n > x.n, true)"), (lambda k: f"coalesce(get(a.s, i + {k}).n >= x.n, true)")
_GOES = f"x.n < {{least}} and {_BEFORE(2)} and {_BEFORE(1)} and {_AFTER(1)} and {_AFTER(2)}"
_LEFT, _RIGHT = "get(a.s, i - 1)", "get(a.s, i + 1)"
_JOINS = f"""transform(a.s, (x, i) -> named_struct('b', x.b, 'e', x.e, 'c', x.c,
    'l', {_GOES} and {_LEFT} is not null and ({_RIGHT} is null or {_LEFT}.c = {_RIGHT}.c or {_LEFT}.n >= {_RIGHT}.n),
    'r', {_GOES} and {_RIGHT} is not null and ({_LEFT} is null or {_LEFT}.c = {_RIGHT}.c or {_LEFT}.n < {_RIGHT}.n)))"""
_JOINED = "coalesce(get(t, i + {0}).r or get(t, i + {0} + 1).l, false)".format
_ENDS = f"""filter(transform(t, (x, i) -> named_struct('b', x.b, 'c', if(x.r, get(t, i + 1).c, x.c), 'gone', {_JOINED(-1)},
    'e', case when not {_JOINED(0)} then x.e when {_JOINED(1)} then get(t, i + 2).e else get(t, i + 1).e end)), x -> not x.gone)"""
_ROUND = f"transform(array({_JOINS}), t -> transform({_ENDS}, x -> named_struct('b', x.b, 'e', x.e, 'c', x.c, 'n', x.e - x.b)))[0]"


def split_by_grade(classed: DataFrame, least: float = 400.0) -> DataFrame:
    """Sectors of one slope class each, at least ``least`` metres long where the track is.

    The shortest run always joins its longer neighbour (the one before it if both are as long), and neighbours of one class become
    one. All that can go at once goes in one round: few rounds for most tracks, as many as runs where lengths only
    grow along the track. The rounds are a fold over a track's short list of runs, inside the JVM.
    """
    runs = grade_runs(classed).groupBy("track_id").agg(F.expr("transform(array_sort(collect_list(struct(run, start_m, end_m, cls))), x -> named_struct('b', x.start_m, 'e', x.end_m, 'c', x.cls, 'n', x.end_m - x.start_m))").alias("s"))
    more = f"size(s) > 1 and exists(s, x -> x.n < {least})"
    step = f"transform(array({_ROUND.format(least=least)}), s -> named_struct('s', s, 'more', {more}))[0]"
    left = f"aggregate(sequence(1, size(s)), named_struct('s', s, 'more', {more}), (a, k) -> if(a.more, {step}, a), a -> a.s)"
    return runs.select("track_id", F.posexplode(F.expr(left)).alias("sector_id", "x")).select("track_id", "sector_id", F.col("x.b").alias("start_m"), F.col("x.e").alias("end_m"))
