"""Plans, sinks and lookups against plain versions: settings kept by track, tables laid out by track, sweeps, levels and blocks."""

import os
import random
import re
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacewright.operators import dual, export, lookup, sector, track, zones
from pacewright.plans.queries import Base
from pacewright.sources.layout import laid_by_track

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_zones_of_each_track(spark):
    z = spark.createDataFrame([(1, 1, 100.0, 120.0), (1, 2, 120.0, None), (2, 1, 90.0, 95.0), (2, 2, 95.0, 140.0), (2, 3, 150.0, None)], "track_id long, zone int, lo double, hi double")
    hr = spark.createDataFrame([(t, h) for t in (1, 2, 3) for h in (80.0, 95.0, 119.5, 120.0, 145.0, 150.0, None)], "track_id long, hr double")
    found = {(r["track_id"], r["hr"]): r["zone"] for r in zones.classify_hr_zone(hr, z).collect()}
    assert [found[1, h] for h in (80.0, 95.0, 119.5, 120.0, 150.0, None)] == [0, 0, 1, 2, 2, None]
    assert [found[2, h] for h in (80.0, 95.0, 119.5, 145.0, 150.0, None)] == [0, 2, 2, 0, 3, None]
    assert {found[3, h] for h in (80.0, 150.0, None)} == {None}


def test_sectors_read_points_once_and_stay_by_track(spark):
    b = Base(spark, SF)
    text = plan(sector.sector_walk(b.lay().points, b.sectors))
    # places at the ends of sectors are put among the points; all else reads buckets of tracks where they lie
    assert len(re.findall("FileScan", text)) <= 3 and len(re.findall(r"Exchange hashpartitioning\(track_id#\d+L?, \d+\)", text)) <= 1
    for df in (sector.effort_distance(b.walk), sector.sector_kind(b.walk), sector.fastest_slowest_km(b.walk), zones.hr_zone_time(b.zoned_walk)):
        assert len(re.findall("FileScan", plan(df))) <= 4
    assert "Exchange" not in plan(track.track_summary(b.points)) and "Exchange" not in plan(track.with_next(b.points))
    one, two = (laid_by_track(b.points.select("track_id", "seq", c), "side", 4) for c in ("hr", "cad"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in plan(one.join(two, ["track_id"]).groupBy("track_id").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_documents_of_several_lines_come_back_whole(spark, tmp_path):
    rows = [(t, s, f"first {t}\nsecond {s}\n\n  last") for t in range(3) for s in range(2)]
    documents = spark.createDataFrame(rows, "track_id long, sector_id int, text string")
    export.write_texts(documents, "text", str(tmp_path / "texts"), files=True)
    assert sorted(map(tuple, export.read_texts(spark, str(tmp_path / "texts"), files=True).collect())) == rows
    many = spark.range(3000).selectExpr("id % 50 track_id", "cast(id div 50 as int) sector_id", "concat('line ', id, '\nmore') text")
    export.write_texts(many, "text", str(tmp_path / "packed"))
    assert len([f for f in os.listdir(tmp_path / "packed") if f.endswith(".parquet")]) <= 8
    one = export.read_texts(spark, str(tmp_path / "packed")).filter("track_id = 7 and sector_id = 3")
    assert [r["value"] for r in one.collect()] == ["line 157\nmore"] and "EqualTo(sector_id,3)" in plan(one)
    long = spark.createDataFrame([(t, 0, k, f"label {k}", v) for t in (1, 2) for k, v in enumerate(['a "quoted", one', "two\nlines", "", f"of {t}"])], "track_id long, sector_id int, place int, label string, value string")
    export.write_metrics_csv(long, str(tmp_path / "csv"))
    found = {(r["track_id"], r["label"]): r["value"] for r in export.read_metrics_csv(spark, str(tmp_path / "csv")).collect()}
    assert found[1, "label 0"] == 'a "quoted", one' and found[2, "label 3"] == "of 2" and len(found) >= 8


def test_unavailable_zones_say_why(spark):
    b = Base(spark, SF)
    tracks = spark.createDataFrame([(1, False, True), (2, True, False)], "track_id long, has_hr boolean, has_time boolean")
    metrics = tracks.select("track_id", F.lit(0).alias("sector_id"), *[F.lit(None).cast("double").alias(c) for c in {m for _, _, m, _ in export.CATALOGUE}])
    times = zones.hr_zone_time(b.zoned_walk).limit(0)
    z = spark.createDataFrame([(t, k, 90.0 + k, 91.0 + k) for t in (1, 2) for k in range(1, 6)], "track_id long, zone int, lo double, hi double")
    found = {r["track_id"]: r["value"] for r in export.metrics_long(metrics, times, z, tracks).filter("label = 'Zone 1'").collect()}
    assert found == {1: export.NO_HR, 2: export.NO_TIME}


def test_pause_sweep(spark):
    rng = random.Random(2)
    spans, readings = [], []
    for t in range(3):
        at = 0.0
        for _ in range(40):
            at += rng.choice([0, 1, 5])
            end = at + rng.choice([1, 10])
            spans.append((t, 0, at, end))
            at = end
        readings += [(t, 0, float(ms), k) for k, ms in enumerate(range(-2, int(at) + 5))] + [(t, 0, None, -1)]
    r = spark.createDataFrame(readings, "track_id long, sector_id int, ms double, k int")
    s = spark.createDataFrame(spans, "track_id long, sector_id int, t0 double, t1 double")
    kept = sorted((x["track_id"], x["k"]) for x in lookup.pause_overlap(r, s).collect())
    assert kept == sorted((t, k) for t, _, ms, k in readings if ms is None or not any(t == u and a < ms <= b for u, _, a, b in spans))
    # one sector of very many readings and pauses
    many = spark.range(50_000).selectExpr("1L track_id", "0 sector_id", "cast(id as double) ms", "id k")
    stops = spark.range(2000).selectExpr("1L track_id", "0 sector_id", "cast(id * 25 as double) t0", "cast(id * 25 + 10 as double) t1")
    assert lookup.pause_overlap(many, stops).count() == 50_000 - 2000 * 10
    assert "NestedLoop" not in plan(lookup.pause_overlap(many, stops))


def plain_simplified(x, y, tolerance, most):
    def kept(limit):
        keep, spans = np.zeros(len(x), dtype=bool), [(0, len(x) - 1)]
        keep[[0, -1]] = True
        while spans:
            a, b = spans.pop()
            if b - a < 2:
                continue
            px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
            w = dx * dx + dy * dy
            t = np.clip((px * dx + py * dy) / w, 0, 1) if w > 0 else np.zeros(b - a - 1)
            off = np.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)
            k = int(off.argmax())
            if off[k] > limit:
                keep[a + 1 + k] = True
                spans += [(a, a + 1 + k), (a + 1 + k, b)]
        return keep

    for k in range(9):
        keep = kept(tolerance * 2**k)
        if keep.sum() <= most:
            break
    return np.flatnonzero(keep)


def test_simplified_tracks(spark):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for t, n in enumerate([1, 2, 3, 40, 300]):
        lat, lon = 45 + np.cumsum(rng.normal(0, 1e-4, n)), 7 + np.cumsum(rng.normal(0, 1e-4, n))
        lat[n // 2 :] = lat[n // 2] if t == 3 else lat[n // 2 :]
        rows += [(t, k * 2, float(a), float(o)) for k, (a, o) in enumerate(zip(lat, lon, strict=True))]
        metre = np.pi / 180 * 6371008.8
        want |= {(t, 2 * int(k)) for k in plain_simplified(lon * metre * np.cos(np.radians(lat.mean())), lat * metre, 1.5, 60)}
    found = track.simplify_dp(spark.createDataFrame(rows, "track_id long, seq int, lat double, lon double"), most=60)
    assert {tuple(r) for r in found.collect()} == want


@pytest.mark.parametrize("n, block", [(1_000_000, 40_000), (1000, 7)])
def test_distances_of_a_giant_track_by_blocks(spark, n, block):
    p = spark.range(0, n, 1, 8).selectExpr("1L track_id", "cast(id as int) seq", "45 + sin(id / 900.0) / 10 lat", "7 + id * 1e-6 lon")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        d = track.cum_distance_by_blocks(p, 6, block)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = track.cum_distance(p, 6).selectExpr("seq", "seg_m s1", "cum_dist c1")
    assert one.join(d, "seq").filter("s1 <> seg_m or abs(c1 - cum_dist) > 2e-6").count() == 0 and d.count() == n
    assert len(d.inputFiles()) >= 4  # written by as many tasks


def test_places_within_a_radius(spark):
    """Long segments: the nearest vertex is further off than the track."""
    p = track.cum_distance(spark.createDataFrame([(1, k, 45 + 0.004 * k, 7.0) for k in range(6)], "track_id long, seq int, lat double, lon double"))
    probes = spark.createDataFrame([(1, k, 45 + 0.001 * k, 7.0 + off) for k, off in enumerate([0.0002, 0.0006, 0.0007, 0.0, 0.01, 0.0003])], "track_id long, wp_seq int, lat double, lon double")
    every = {r["wp_seq"]: (round(r["dist"], 6), round(r["off_track"], 6)) for r in lookup.nearest_on_track(probes, p).collect()}
    for most in (20.0, 50.0, 1000.0):
        near = {r["wp_seq"]: (round(r["dist"], 6), round(r["off_track"], 6)) for r in lookup.nearest_on_track(probes, p, most).collect()}
        assert near == {k: v for k, v in every.items() if v[1] <= most}


def test_terrain_by_blocks(spark, tmp_path):
    """Places near the edges of blocks and tiles, missing pixels and tiles; only the needed tiles are read."""
    rng, px = random.Random(1), 512 * 4096 / 360
    far = [(200_000 + x, 900_000 + y) for x in range(3) for y in range(3)]
    pixels = {(1_100_000 // 512 * 512 + x, 1_000_000 // 32 * 32 + y): rng.randint(0, 3000) for x in range(-3, 40) for y in range(-3, 40) if rng.random() > 0.1}
    rows = [(x, y, (e + 32768) // 256, (e + 32768) % 256, 0) for (x, y), e in {**pixels, **{p: 5 for p in far}}.items()]
    terrain = lookup.write_terrain(spark.createDataFrame(rows, "gx long, gy long, r int, g int, b int"), str(tmp_path / "terrain"))
    x0, y0 = min(x for x, _ in pixels), min(y for _, y in pixels)
    points = []
    for k in range(300):
        fx, fy = x0 + rng.uniform(-1, 44), y0 + rng.uniform(-1, 44)
        lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * fy / 512 / 4096))))
        points.append((1, k, float(lat), fx / px - 180))
    points.append((1, 300, None, 7.0))
    df = spark.createDataFrame(points, "track_id long, seq int, lat double, lon double")
    found = lookup.dem_sample(df, terrain)
    assert "dynamicpruning" in plan(found)
    for r in found.collect():
        if r["lat"] is None:
            assert r["dem_ele"] is None
            continue
        fx = (r["lon"] + 180) * px
        fy = (1 - np.log(np.tan(np.radians(r["lat"])) + 1 / np.cos(np.radians(r["lat"]))) / np.pi) / 2 * 4096 * 512
        x, y = int(np.floor(fx)), int(np.floor(fy))
        a = pixels.get((x, y))
        if a is None:
            assert r["dem_ele"] is None
            continue
        b, c = pixels.get((x + 1, y), a), pixels.get((x, y + 1), a)
        d = pixels.get((x + 1, y + 1), b)
        top, low = a + (b - a) * (fx - x), c + (d - c) * (fx - x)
        assert r["dem_ele"] == pytest.approx(top + (low - top) * (fy - y), abs=0.01)


def test_ends_from_sketches(spark):
    """A sketch's values have ranks within 0.1 % of the asked ones; sorted input, ties and skewed values too."""
    rng = np.random.default_rng(6)
    values = {0: np.sort(rng.normal(0, 1, 200_000)), 1: np.floor(rng.pareto(1.5, 200_000) * 50), 2: rng.random(900)}
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/pairs.parquet"
    pd.DataFrame({"track_id": np.repeat(list(values), [len(v) for v in values.values()]), "sector_id": 0, "x": np.concatenate([*values.values()])}).to_parquet(path)
    pairs = spark.read.parquet(path).selectExpr("*", "-x as y", "0L vseq").repartition(16)
    for r in dual.sketched_ends(pairs).collect():
        v = np.sort(values[r["track_id"]])
        assert r["n"] == len(v)
        for value, share in ((r["x0"], 0.002), (r["x1"], 0.998), (-r["y1"], 0.002), (-r["y0"], 0.998)):
            low, high = np.searchsorted(v, value), np.searchsorted(v, value, side="right")
            assert low - 0.001 * len(v) - 1 <= share * len(v) <= high + 0.001 * len(v) + 1
    exact, near = ({r["track_id"]: r for r in dual.robust_domain(pairs, s).collect()} for s in (False, True))
    assert near[0]["x1"] == pytest.approx(exact[0]["x1"], abs=0.5) and near[2]["n"] == exact[2]["n"]
    assert dual.density_2d(pairs, sketched=True).count() > 100 and "Window" not in plan(dual.robust_domain(pairs, True))


def test_tables_between_steps_can_be_cleared(spark):
    from pacewright.sources import scratch

    kept = scratch.stored(spark.range(3), "kept")
    files, before = kept.inputFiles(), len(spark.catalog.listTables())
    laid_by_track(spark.range(5).selectExpr("id as track_id"), "side")
    assert len(spark.catalog.listTables()) == before + 1
    assert scratch.clear(spark) >= 2 and scratch.clear(spark) == 0
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert len(spark.catalog.listTables()) <= before
