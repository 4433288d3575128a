"""Findings of reviews, each with a small case that went wrong before."""

import math

from pacewright.operators import lookup, track, zones

POINT = "track_id long, seq int, lat double, lon double, ele double, time_ms long, hr double, cad double, power double, temp double, speed double"
METRE = 6371008.8 * 3.141592653589793 / 180


def test_shares_of_zones_are_exact_at_halves(spark):
    """14 of 80 seconds are 17.5 %, whatever the order of adding; sums of seconds give 17.499999999999996."""
    ms = [1000.0, 1000.0, 1000.0, 2000.0, 2000.0, 3000.0, 2000.0, 2000.0, 260.123291015625, 65739.87670898438, 54617.285400390625]
    zone = [1] * 8 + [2, 2, 0]
    at = [1704067200000.0]
    for m in ms:
        at.append(at[-1] + m)
    rows = [(1, 0, "point", k, 0.0, 100.0, 100.0, z, z, True, False, a, b, (b - a) / 1000) for k, (z, a, b) in enumerate(zip(zone, at, at[1:]))]
    names = "track_id long, sector_id int, kind string, step int, end_t double, v_hr double, v_next_hr double, v_zone int, v_next_zone int, timed boolean, paused boolean, from_ms double, to_ms double, dt double"
    for some in (rows, rows[::-1], rows[5:] + rows[:5]):
        share = zones.zone_share_pct(zones.hr_zone_time(spark.createDataFrame(some, names).coalesce(1))).first()
        assert (share["z1_pct"], share["z2_pct"]) == (18, 83)


def test_shares_of_zones_are_exact_where_a_part_below_is_left_out(spark):
    """13 of 104 seconds are 12.5 %; seconds moving less seconds below are 104.00000000000001 of them."""
    ms, zone = [1150.3017578125, 23000.0, 91000.0, 13000.0], [0, 0, 1, 5]
    at = [1704067200000.0]
    for m in ms:
        at.append(at[-1] + m)
    rows = [(1, 0, "point", k, 0.0, 100.0, 100.0, z, z, True, False, a, b, (b - a) / 1000) for k, (z, a, b) in enumerate(zip(zone, at, at[1:]))]
    names = "track_id long, sector_id int, kind string, step int, end_t double, v_hr double, v_next_hr double, v_zone int, v_next_zone int, timed boolean, paused boolean, from_ms double, to_ms double, dt double"
    times = zones.hr_zone_time(spark.createDataFrame(rows, names))
    assert times.selectExpr("moving_s - below_s").first()[0] > 104
    share = zones.zone_share_pct(times).first()
    assert (share["z1_pct"], share["z5_pct"]) == (88, 13)


def test_of_two_vertices_as_far_the_degrees_decide(spark):
    """A stop and the next point, and a probe in their middle: the difference of degrees is what SQL takes."""
    off = lambda p, q: ((p - q) * METRE) ** 2
    metres = lambda p, q: (p * METRE - q * METRE) ** 2
    cases = [(45 + (k * 1000 - w) / 1e7, 45 + k / 1e4, 45 + (k * 1000 + w) / 1e7) for k in range(1, 60) for w in (270, 301, 333)]
    cases = [(a, q, b) for a, q, b in cases if (off(b, q) < off(a, q)) != (metres(b, q) < metres(a, q))]
    assert cases
    rows = [(t, s, lat, 7.0, *[None] * 7) for t, (a, _, b) in enumerate(cases) for s, lat in enumerate((a - 3e-5, a, a, b, b, b + 3e-5))]
    points = track.cum_distance(spark.createDataFrame(rows, POINT), 6)
    probes = spark.createDataFrame([(t, 0, q, 7.0) for t, (_, q, _) in enumerate(cases)], "track_id long, wp_seq int, lat double, lon double")
    found = {r["track_id"]: r["off_track"] for r in lookup.nearest_on_track(probes, points, 250.0).collect()}
    # the stop's first vertex has no segment towards the probe, the next point has one that runs through it
    assert {t: r < 0.1 for t, r in found.items()} == {t: off(b, q) < off(a, q) for t, (a, q, b) in enumerate(cases)}


def test_tasks_grow_in_number_not_in_size(spark):
    from pacewright.sources import layout

    has = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert layout.sized(spark, 10) == int(has)
        assert layout.sized(spark, 80_000 * 50 + 1) == 51 and spark.conf.get("spark.sql.shuffle.partitions") == "51"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", has)


def test_all_measures_of_a_walk_are_read_where_it_lies(spark):
    from pacewright.operators import dual, sector
    from pacewright.plans.queries import Base

    b = Base(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(sector.walk_metrics(b.stored_walk)).replace("BroadcastExchange", "")
    # the samples' own rows meet their grades and nothing else
    assert plan(dual.analysis_samples(b.walk)).count("SortMergeJoin") + plan(dual.analysis_samples(b.walk)).count("BroadcastHashJoin") <= 5


def test_documents_are_made_where_the_points_lie(spark):
    from pacewright.plans.queries import Base, kml_documents, tcx_documents

    b = Base(spark, "/root/testdata/sf0.001")
    for made in (tcx_documents, kml_documents):
        assert made(b.points)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_sectors_meet_points_where_they_lie(spark):
    """With tables too large to be broadcast: no exchange of points for their documents, one of the walk, none behind it."""
    from pacewright.operators import dual, export
    from pacewright.plans.queries import Base

    has = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        b = Base(spark, "/root/testdata/sf0.001").lay()
        assert "Exchange" not in plan(export.sector_gpx(b.points, b.sectors))
        # the ends of sectors among the points, and the walk
        assert plan(b.walk).count("Exchange hashpartitioning") == 2
        assert "Exchange" not in plan(dual.density_2d(dual.extract_pair(b.samples, "hr", "speed")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", has)


def test_levels_write_spans_not_points(spark, monkeypatch):
    """Points of a track of many blocks, with gaps in seq: a level writes the spans that split, each kept point once."""
    import math

    def plain(p, tolerance):
        a, b = p[0], p[-1]
        if len(p) < 3:
            return set()
        w = (b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2

        def off(q):
            t = min(1.0, max(0.0, ((q[1] - a[1]) * (b[1] - a[1]) + (q[2] - a[2]) * (b[2] - a[2])) / w)) if w > 0 else 0.0
            return math.hypot(q[1] - a[1] - t * (b[1] - a[1]), q[2] - a[2] - t * (b[2] - a[2]))

        k = max(range(1, len(p) - 1), key=lambda i: (off(p[i]), -p[i][0]))
        return plain(p[: k + 1], tolerance) | {p[k][0]} | plain(p[k:], tolerance) if off(p[k]) > tolerance else set()

    rows = [(1, s, 45 + k / 3e4, 7 + math.sin(k / 40) / 900 + (k * 37 % 11) / 1e6) for k, s in enumerate(s for s in range(3, 1500) if s % 29 < 20 or s % 128 == 0)]
    c = math.cos(math.radians(sum(r[2] for r in rows) / len(rows)))
    expected = plain([(s, lon * METRE * c, lat * METRE) for _, s, lat, lon in rows], 1.5) | {rows[0][1], rows[-1][1]}
    written, stored = [], track.stored
    monkeypatch.setattr(track, "stored", lambda df, name: (out := stored(df, name), written.append(out.count()))[0])
    found = track.simplify_dp(spark.createDataFrame(rows, "track_id long, seq int, lat double, lon double"))
    assert {r["seq"] for r in found.collect()} == expected and 60 < len(expected) < len(rows)
    assert sum(written) == 1 + len(expected) - 2


def _joined_rows(df):
    """Rows that came out of each join of a query that has run."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
            if "Join" in name:
                found.append(node.metrics().apply("numOutputRows").value())
    return found


def test_places_meet_vertices_by_the_array(spark):
    """Many probes of few places over a track that stays near them: no join gives a row for each pair of place and vertex."""
    rows = [(1, s, 45 + (s * 7 % 300) / 1e5, 7 + (s * 11 % 200) / 1e5, *[None] * 7) for s in range(2000)]
    points = track.cum_distance(spark.createDataFrame(rows, POINT), 6)
    at = [(45 + 0.0001 * (k % 5) + 3e-6, 7 + 0.0002 * (k % 5) + 1e-6) for k in range(500)]
    probes = spark.createDataFrame([(1, k, *p) for k, p in enumerate(at)] + [(1, 900, None, 7.0), (2, 901, 45.0, 7.0)], "track_id long, wp_seq int, lat double, lon double")
    c = METRE * math.cos(math.radians((min(r[2] for r in rows) + max(r[2] for r in rows)) / 2))
    off = {p: min(((r[3] - p[1]) * c) ** 2 + ((r[2] - p[0]) * METRE) ** 2 for r in rows) ** 0.5 for p in set(at)}
    near = lookup.nearest_on_track(probes, points, 250.0)
    found = {r["wp_seq"]: r["off_track"] for r in near.collect()}
    assert set(found) == set(range(500)) and all(found[k] <= off[at[k]] + 1e-3 for k in found)
    assert max(_joined_rows(near)) <= 2000
    every = {r["wp_seq"]: r["off_track"] for r in lookup.nearest_on_track(probes, points).collect()}
    assert every == found | {900: None}


def test_texts_of_points_are_searched_and_parsed_once(spark, tmp_path):
    from pacewright.sources import activity

    path = str(tmp_path / "a.xml")
    inner = "<speed>2</speed><extensions><a:power/><a:PowerInWatts>9</a:PowerInWatts><a:hrx>1</a:hrx><a:hr> 120 </a:hr><a:cad>NaN</a:cad><a:atemp>x</a:atemp></extensions>"
    (tmp_path / "a.xml").write_text(f'<gpx xmlns:a="a"><trk><trkseg><trkpt lat="1" lon=" 2 "><ele>-Infinity</ele>{inner}</trkpt></trkseg></trk></gpx>')
    r = activity.scan_gpx(spark, path).first()
    assert (r["lat"], r["lon"], r["ele"], r["hr"], r["cad"], r["power"], r["temp"], r["speed"]) == (1, 2, None, 120, None, None, None, 2)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for points, names, numbers in ((activity.scan_gpx(spark, path), 7, 8), (activity.scan_tcx(spark, path), 3, 7)):
        assert plan(points).count("regexp_extract(") == names
        # each number once, those of the place again where rows without one are dropped
        assert plan(points).count("try_cast(") <= numbers + 2 * 3


def test_folders_are_listed_by_as_many_tasks_as_there_are_partitions(spark):
    from pacewright.sources import layout

    names = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.shuffle.partitions")
    has = {n: spark.conf.get(n) for n in names}
    try:
        layout.sized(spark, 80_000 * 20)
        assert [int(spark.conf.get(n)) for n in names] == [20, 20]
    finally:
        for n, v in has.items():
            spark.conf.set(n, v)
