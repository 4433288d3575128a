"""Golden cases: small tracks with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from pacewright.functions import geo, text
from pacewright.operators import sector, splits, track, zones

STEP = 0.001 * math.pi / 180 * geo.EARTH_RADIUS_M  # metres of 0.001 degrees on the equator
POINT = "track_id long, seq int, lat double, lon double, ele double, time_ms long, hr double, cad double, power double, temp double, speed double"


def east(spark, n, track_id=1, step=0.001, **of):
    rows = [(track_id, i, 0.0, i * step, *[f(i) if f else None for f in (of.get(c) for c in ("ele", "time_ms", "hr", "cad", "power", "temp", "speed"))]) for i in range(n)]
    return track.cum_distance(spark.createDataFrame(rows, POINT))


def whole(points):
    t = track.track_summary(points)
    return t.select("track_id", F.lit(0).alias("sector_id"), F.lit(0.0).alias("start_m"), F.col("total_distance").alias("end_m"))


def test_distance(spark):
    r = track.track_summary(east(spark, 11)).first()
    assert r["total_distance"] == pytest.approx(10 * STEP) and not r["has_elevation"] and not r["has_time"]


def test_sawtooth_gain(spark):
    p = east(spark, 30, ele=lambda i: float((2 if i % 2 else 0) if i <= 20 else (i - 20) * 2))
    walk = sector.sector_walk(p, whole(p))
    r = sector.sector_gain_loss(walk).join(sector.sector_elevation(walk), ["track_id", "sector_id"]).first()
    assert (r["gain"], r["loss"], r["net"]) == (16, 0, 18)


def test_pause_does_not_count(spark):
    def ms(i):
        return i * 1000 + (30_000 if i > 60 else 0)

    rows = [(1, i, 0.0, (i if i <= 60 else i - 1) * 10 / STEP * 0.001, None, ms(i) if i != 61 else 90_000, None, None, None, None, None) for i in range(202)]
    p = track.cum_distance(spark.createDataFrame(rows, POINT))
    walk = sector.sector_walk(p, whole(p))
    km = sector.fastest_slowest_km(walk).first()
    assert km["fastest_pace"] == pytest.approx(100, abs=1.5) and km["slowest_pace"] == pytest.approx(100, abs=1.5)
    span = sector.pause_spans(walk).collect()
    assert len(span) == 1 and span[0]["t1"] - span[0]["t0"] == pytest.approx(30_000)


@pytest.mark.parametrize(("stops", "paused"), [(0, 0), (4, 0), (7, 14)])
def test_zone_seconds(spark, stops, paused):
    rows = []
    for i in range(20 + stops + 20):
        moved = i if i < 20 else max(19, i - stops)
        rows.append((1, i, 0.0, moved * 0.0001, None, i * 2000, 60.0 if 20 <= i < 20 + stops else 150.0, None, None, None, None))
    p = track.cum_distance(spark.createDataFrame(rows, POINT))
    z = zones.zone_bounds(spark.createDataFrame([([95.0, 114.0, 133.0, 152.0, 171.0],)], "bounds array<double>"))
    walk = sector.sector_walk(p, whole(p))
    r = zones.hr_zone_time(walk, z).first()
    assert r["paused_s"] == pytest.approx(paused) and r["z3_s"] == pytest.approx(78)
    assert r["below_s"] == pytest.approx(0 if stops != 4 else 8)
    assert r["moving_s"] == pytest.approx(sum(r[f"z{k}_s"] for k in range(1, 6)) + r["below_s"] + r["no_hr_s"])


def test_segment_types(spark):
    rows = [(1.0, 1.0, 0.0, "flat"), (100.0, 10.0, 90.0, "climb"), (10.0, 100.0, -90.0, "descent"), (50.0, 50.0, 0.0, "mixed"), (60.0, 40.0, 20.0, "climb"), (None, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g double, l double, n double, want string")
    assert df.filter(~geo.segment_type(F.col("g"), F.col("l"), F.col("n")).eqNullSafe(F.col("want"))).count() == 0


def test_waypoints_keep_their_distance(spark):
    t = spark.createDataFrame([(1, 1000.0)], "track_id long, total_distance double")
    w = spark.createDataFrame([(1, 0, 300.0, "First"), (1, 1, 350.0, "near"), (1, 2, 600.0, "Second"), (1, 3, 950.0, "end")], "track_id long, wp_seq int, dist double, name string")
    found = [(r["start_m"], r["end_m"], r["name"]) for r in splits.split_by_waypoint(w, t).orderBy("sector_id").collect()]
    assert found == [(0, 300, None), (300, 600, "First"), (600, 1000, "Second")]


def test_split_tails(spark):
    t = spark.createDataFrame([(1, 1100.0), (2, 1300.0), (3, 150.0)], "track_id long, total_distance double")
    ends = lambda tail: {(r[0], r[2], r[3]) for r in sector.split_by_length(t, 1000, tail).collect()}
    assert ends("fold") == {(1, 0, 1100), (2, 0, 1000), (2, 1000, 1300), (3, 0, 150)}
    assert ends("drop") == {(1, 0, 1000), (2, 0, 1000), (2, 1000, 1300), (3, 0, 150)}


def test_places_along_a_track(spark):
    p = east(spark, 3, ele=lambda i: 10.0 * i, time_ms=lambda i: i * 1000)
    r = spark.createDataFrame([(1, 0, -5.0), (1, 1, STEP / 2), (1, 2, STEP), (1, 3, 99999.0)], "track_id long, k int, d double")
    found = {x["k"]: (x["i"], round(x["t"], 6), round(x["ele"], 4), round(x["time_ms"], 2)) for x in sector.point_at_distance(p, r).collect()}
    assert found == {0: (0, 0, 0, 0), 1: (0, 0.5, 5, 500), 2: (1, 0, 10, 1000), 3: (2, 0, 20, 2000)}


def test_text(spark):
    df = spark.createDataFrame([(999.4, 59.6), (1234.0, 3661.0), (123456.0, 0.0)], "d double, s double")
    assert [tuple(r) for r in df.select(text.format_distance(F.col("d")), text.format_duration(F.col("s"))).collect()] == [("999 m", "1:00"), ("1.23 km", "1:01:01"), ("123.5 km", "0:00")]


def in_batches(step, empty, rows, cuts):
    state, found = empty, []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        state, more = step(state, rows.iloc[a:b])
        found += more
    return state, found


def test_live_pauses_do_not_depend_on_batches():
    import functools

    import pandas as pd

    from pacewright.streaming.live import NEVER, pause_ending, pause_step

    step = functools.partial(pause_step, idle=3600 * 10**6)
    empty = (NEVER, 0.0, NEVER, 0.0)
    x = [float(i if i < 15 else max(14, i - 10)) for i in range(40)] + [30.0] * 8
    rows = pd.DataFrame({"us": [i * 2_000_000 for i in range(48)], "x": x})
    state, once = step(empty, rows)
    assert once == [(28_000_000, 48_000_000, 20.0)]
    for cuts in ([0, 7, 14, 21, 28, 35, 42, 48], [0, 20, 21, 48]):
        assert in_batches(step, empty, rows, cuts) == (state, once)
    late = pd.concat([rows.iloc[:20], rows.iloc[5:10], pd.DataFrame({"us": [39_000_000], "x": [float("nan")]}), rows.iloc[20:]])
    assert step(empty, late) == (state, once)  # what comes late, or without a place, adds nothing
    # the last stop is over when the device has been silent for long enough
    assert pause_ending(state, 94_000_000 + 3599 * 10**6, 3600 * 10**6) == (state, [])
    assert pause_ending(state, 94_000_000 + 3600 * 10**6, 3600 * 10**6)[1] == [(80_000_000, 94_000_000, 14.0)]
    # and a silence belongs to no stop
    gap = pd.DataFrame({"us": [0, 12_000_000, 12_000_000 + 3601 * 10**6, 12_000_000 + 3612 * 10**6], "x": [0.0] * 4})
    assert step(empty, gap)[1] == [(0, 12_000_000, 12.0)]


def test_live_gain():
    import pandas as pd

    from pacewright.streaming.live import NEVER, gain_step

    empty = (NEVER, 0.0, 0.0, 0.0, 0.0, 0, 0, 0)
    ele = [0.0, 2, 0, 2, 4, 6, 8, None, 5, 1, 1]
    rows = pd.DataFrame({"us": [i * 10_000_000 for i in range(11)], "ele": ele})
    state, once = gain_step(empty, rows)
    assert once[-1] == (10, 8.0, 7.0, 50.0, 30.0)  # the residual leaves zero upwards for 50 s, downwards for 30
    again, found = in_batches(gain_step, empty, rows, [0, 4, 5, 11])
    assert again == state and found[-1] == once[-1]


def test_queries_take_every_point(spark):
    from pacewright.plans.queries import Base, build

    folder = "/root/testdata/sf0.001"
    n = Base(spark, folder).points.count()
    assert build(spark, folder, "scan_detect_format").count() == n
    assert build(spark, folder, "landmark_label").count() == n


LONG = 50_000


@pytest.fixture(scope="module")
def long_track(spark):
    """One track of 50,000 points, with gaps and outliers."""
    d = spark.range(LONG).selectExpr("1L track_id", "cast(id as int) seq", "45 + id * 1e-4 lat", "7D lon", "if(id % 50 < 40, null, id % 7 * 1D) ele", "id * 3000 time_ms", "if(id % 100 < 90, null, 100D + id % 9) hr", "80D cad", "cast(null as double) power", "10D temp", "cast(null as double) speed")
    return track.cum_distance(d, 6).persist()


def test_long_tracks_are_linear(spark, long_track):
    import time

    from pacewright.operators import lookup

    began = time.time()
    filled = track.fill_ele_gaps(long_track)
    assert filled.filter("ele is null").count() == 0
    assert filled.filter("seq = 45 + 50 * 3 or seq = 20").select(F.sum("ele")).first()[0] == pytest.approx(195 % 7 + 40 % 7)
    v = long_track.withColumn("v", F.expr("if(seq % 5000 = 17, 1000D, seq % 10 * 1D)"))
    fixed = track.sigma_repair(v, "v", "fixed").filter("seq % 5000 = 17").select("fixed").distinct().collect()
    assert [r[0] for r in fixed] == [pytest.approx(7)]
    requests = long_track.filter("seq % 100 = 50").selectExpr("track_id", "seq k", "cum_dist d")
    found = lookup.bridge_interpolate(long_track, requests).filter("hr is not null")
    assert found.count() == LONG // 100 - 1
    walk = sector.sector_walk(long_track, whole(long_track))
    km = sector.fastest_slowest_km(walk).first()
    assert km["fastest_pace"] == pytest.approx(1000 / 11.12 * 3, rel=1e-3)
    assert time.time() - began < 120


def test_sectors_meet_only_their_points(spark, long_track):
    t = track.track_summary(long_track)
    parts = sector.split_by_length(t, 1000.0).unionByName(spark.createDataFrame([(1, 99_999, 100.0, 40_000.0)], "track_id long, sector_id int, start_m double, end_m double"))
    d = sector.sector_distance(sector.sector_walk(long_track, parts)).join(parts, ["track_id", "sector_id"])
    assert d.filter("abs(horizontal_m - (end_m - start_m)) > 1e-3").count() == 0 and d.count() == parts.count()


def test_one_pass_metrics_equal_the_parts(spark):
    p = east(spark, 400, step=0.0001, ele=lambda i: 5 * math.sin(i / 9), time_ms=lambda i: i * 4000 + (60_000 if i > 150 else 0), hr=lambda i: None if i % 11 == 3 else 100.0 + i % 30, cad=lambda i: 80.0 + i % 5, power=lambda i: 200.0 + i % 40, temp=lambda i: 20.0, speed=lambda i: None)
    walk = sector.sector_walk(p, whole(p))
    found = sector.sector_metrics(p, whole(p)).first().asDict()
    for part in (sector.sector_distance, sector.sector_gain_loss, sector.sector_grades, sector.vertical_rates, sector.sector_elevation, sector.moving_time, sector.avg_speed, sector.avg_gap, sector.max_speed, sector.fitness_stats, sector.temp_stats, sector.fastest_slowest_km):
        for k, v in part(walk).first().asDict().items():
            assert found[k] == (v if v is None else pytest.approx(v)), k
    top = sector.sector_speed_series(walk).agg(F.max("clean_speed")).first()[0]  # repaired outliers lie between their neighbours
    assert found["max_speed"] == pytest.approx(top)


def test_series_range_of_negative_values(spark):
    d = spark.createDataFrame([(1, "temp", -20.0, -10.0)], "track_id long, series string, lo double, hi double")
    r = track.series_range(d).first()
    assert r["y_max"] == pytest.approx(-10 + 0.8) and r["y_min"] == 0


def test_more_than_five_zones_are_an_error(spark):
    z = spark.createDataFrame([(k, 10.0 * k, None) for k in range(1, 7)], "zone int, lo double, hi double")
    with pytest.raises(ValueError, match="five rows"):
        zones.classify_hr_zone(spark.createDataFrame([(100.0,)], "hr double"), z)


def test_settings(spark):
    good = ("max", 190, 60, 170, [95, 114, 133, 152, 171], [125, 138, 151, 164, 177], [102, 119, 136, 153])
    cases = [(good, None)]
    for at, value, error in [(0, "power", "mode"), (0, None, "mode"), (1, 99, "max_hr"), (1, 261, "max_hr"), (1, None, "max_hr"), (2, 19, "rest_hr"), (2, 151, "rest_hr"), (3, 60, "lthr"), (3, 190, "lthr"), (4, [95, 114, 133, 152], "order"), (4, [0, 114, 133, 152, 171], "order"), (5, [125, 138, 151, 164, 261], "order"), (5, [125, 125, 151, 164, 177], "order"), (5, None, "order"), (6, [102, 119, 136, 170], "order"), (6, [102, None, 136, 153], "order")]:
        row = list(good)
        row[at] = value
        cases.append((tuple(row), error))
    cases.append((("max", 120, 130, 125, *good[4:]), "max_rest"))
    df = spark.createDataFrame([(k, *row) for k, (row, _) in enumerate(cases)], "k int, mode string, max_hr int, rest_hr int, lthr int, max_bounds array<int>, hrr_bounds array<int>, lthr_bounds array<int>")
    found = {r["k"]: r["error"] for r in zones.validate_hr_settings(df).collect()}
    assert found == {k: e for k, (_, e) in enumerate(cases)}


def test_elevation_tags(spark):
    from pacewright.operators.landmarks import parse_elevation_tag

    cases = [({"ele": "1234"}, 1234), ({"ele": " 1234.5 m "}, 1234.5), ({"ele": "+5"}, 5), ({"ele": ".5"}, 0.5), ({"ele": "5."}, None), ({"ele": "."}, None), ({"ele": "--5"}, None), ({"ele": "1-2"}, None), ({"ele": "1e3"}, None), ({"ele": "7\tft"}, 2.1336), ({"ele": "1d"}, None), ({"ele": "m"}, None), ({"ele": "1.2.3"}, None), ({"ele": "NaN"}, None), ({"ele": "-3 metres"}, -3), ({"ele": "100 Foot"}, 30.48), ({"ele": "100'"}, 30.48), ({"ele": "1,5"}, None), ({"ele": "1234 miles"}, None), ({"ele": ""}, None), ({"ele": "x", "ele:ft": "100"}, 30.48), ({"ele:ft": "100 ft"}, None), ({"ele:ft": "bad", "ele_ft": "100"}, None), ({"ele_ft": "100"}, 30.48), ({"ele": "10", "ele:ft": "100"}, 10), ({}, None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, tags map<string,string>")
    found = {r[0]: r[1] for r in df.select("k", parse_elevation_tag()).collect()}
    assert found == {k: (None if v is None else pytest.approx(v)) for k, (_, v) in enumerate(cases)}


def test_landmarks_from_json(spark):
    import json

    from pacewright.operators import landmarks as lm

    node = lambda **tags: {"type": "node", "lat": 1.0, "lon": 2.0, "tags": tags}
    elements = [node(natural="spring"), node(natural="peak"), node(natural="tree", waterway="waterfall"), node(waterway="weir"), {"type": "way", "tags": {"natural": "rock"}}, node(natural="waterfall"), node(natural="stone"), {"type": "node", "lat": 1.0, "tags": {"natural": "rock"}}]
    df = spark.createDataFrame([(1, json.dumps({"elements": elements})), (2, "no json"), (3, "{}")], "response_id long, json string")
    parsed = lm.parse_elements(df)
    assert [(r["pos"], r["class"]) for r in lm.scan_landmarks(parsed).orderBy("pos").collect()] == [(0, "spring"), (2, "waterfall"), (5, "waterfall"), (6, "stone")]
    assert [r["pos"] for r in lm.scan_landmarks(parsed, 3).orderBy("pos").collect()] == [0, 2]  # the cap is over elements, not over what is kept
    tiles = spark.createDataFrame([(1, "peak", "Point", 1.0, 2.0, 1), (2, "peak", "Point", 1.000001, 2.0, 3), (3, "cliff", "Point", 1.0, 2.0, 1), (4, "saddle", "LineString", 1.0, 2.0, 1), (5, "volcano", "Point", None, 2.0, 1), (6, "saddle", "Point", 1.0, 2.0, 0)], "pos long, class string, geometry string, lat double, lon double, rank int")
    assert {(r["pos"], r["rank"]) for r in lm.scan_tile_peaks(tiles).collect()} == {(1, 1), (6, 5)}
    gates = spark.createDataFrame([("peak", 2), ("peak", 3), ("volcano", 1), ("volcano", 5), ("saddle", 1), ("stone", 5), ("tree", 1)], "class string, rank int").withColumns(lm.landmark_gate())
    assert [tuple(r)[2:] for r in gates.collect()] == [("peak-major", 8, 10), ("peak", 11, 13), ("volcano-major", 8, 10), ("volcano", 10, 12.5), ("saddle", 12, 14), ("stone", 15.5, 16.5), ("tree", None, None)]


def test_nearest_place_of_far_probes(spark):
    from pacewright.operators.lookup import nearest_on_track

    p = east(spark, 50)
    probes = spark.createDataFrame([(1, 0, 0.0001, 0.0105, None), (1, 1, 0.02, 0.02, "a"), (1, 2, 3.0, 0.0301, "b"), (1, 3, -0.0001, 0.9, None)], "track_id long, wp_seq int, lat double, lon double, name string")
    found = {r["wp_seq"]: (r["dist"], r["off_track"]) for r in nearest_on_track(probes, p).collect()}
    near = {0: 10.5 * STEP, 1: 20 * STEP, 2: 30.1 * STEP, 3: 49 * STEP}
    assert set(found) == set(near) and all(found[k][0] == pytest.approx(d, abs=0.5) for k, d in near.items())
    assert found[2][1] == pytest.approx(3000 * STEP, rel=1e-3)


def test_split_by_grade_against_rescans(spark):
    import random

    def rescanned(starts, ends, classes, least):
        todo = [[a, b, c] for a, b, c in zip(starts, ends, classes, strict=True)]
        while len(todo) > 1:
            k = min(range(len(todo)), key=lambda j: (todo[j][1] - todo[j][0], j))
            if todo[k][1] - todo[k][0] >= least:
                break
            back, ahead = (todo[j][1] - todo[j][0] if 0 <= j < len(todo) else -1 for j in (k - 1, k + 1))
            other = todo[k - 1] if back >= ahead else todo[k + 1]
            other[:2] = min(other[0], todo[k][0]), max(other[1], todo[k][1])
            del todo[k]
            for j in range(len(todo) - 1, 0, -1):
                if todo[j][2] == todo[j - 1][2]:
                    todo[j - 1][1] = todo[j][1]
                    del todo[j]
        return [(a, b) for a, b, _ in todo]

    rng = random.Random(3)
    points, wanted = [], {}
    for t in range(400):
        at, starts, ends, classes = 0.0, [], [], []
        for k in range(rng.randint(1, 60)):
            classes.append(rng.choice([c for c in (-1, 0, 1) if not classes or c != classes[-1]]))
            starts.append(at)
            lengths = (0.0, 10.0, 50.0, 100.0, 450.0) if t % 3 else (10.0 * k + 5, 300.0 - 10 * k)  # ties, or ever longer and shorter ones
            ends.append(at + max(0.0, rng.choice(lengths) if t % 3 else lengths[t % 2]))
            at = ends[-1] + 10
        places = [(d, c) for a, b, c in zip(starts, ends, classes, strict=True) for d in (a, b)]
        points += [(t, k, d, c) for k, (d, c) in enumerate(places)]
        wanted[t] = rescanned(starts, ends, classes, 400.0)
    classed = spark.createDataFrame(points, "track_id long, seq int, cum_dist double, cls int")
    df, found = splits.split_by_grade(classed), {}
    for r in df.orderBy("track_id", "sector_id").collect():
        found.setdefault(r["track_id"], []).append((r["start_m"], r["end_m"]))
    assert found == wanted and "InPandas" not in df._jdf.queryExecution().toString()
    assert splits.split_by_grade(classed.limit(0)).isEmpty()
