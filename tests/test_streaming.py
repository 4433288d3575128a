"""Streams against one batch: a table arrives shuffled in many files with late rows, and what is given out is that of the batch."""

import functools
import random

import pandas as pd
import pytest

from pacewright.streaming import live

LATE_US, IDLE_US = 600 * 10**6, 1200 * 10**6
ZONES = [95.0, 114.0]


def readings(rng):
    """Rows (track_id, us, x, ele, hr, arrival): devices that move, stop, climb and fall silent; some rows come late."""
    rows = []
    for device in range(4):
        us, x, ele = device * 10**6, 0.0, 100.0
        for k in range(400):
            us += rng.choice([2, 5, 20]) * 10**6 + (2000 * 10**6 if device == 3 and k % 150 == 149 else 0)
            x += rng.choice([0.0, 0.0, 9.0, 12.0]) if k % 40 > 15 else 0.0
            ele += rng.choice([-2.0, -1.0, 0.0, 1.0, 2.5])
            late = rng.random() < 0.03
            arrival = us + (rng.randint(1500, 4000) if late else rng.randint(0, 400)) * 10**6
            rows.append((device, us, x, ele if k % 17 else None, 80.0 + k % 60 if k % 13 else None, arrival))
    return sorted(rows, key=lambda r: r[-1])


def replayed(spark, rows, folder, files):
    """The rows in ``files`` files by arrival; and those that a watermark leaves, up to where it comes at last."""
    size, mark, kept, dropped, seen = -(-len(rows) // files), 0, [], [], 0
    for k in range(files):
        part = rows[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        df = spark.createDataFrame([r[:5] for r in part], "track_id long, us long, x double, ele double, hr double").selectExpr("track_id", "timestamp_micros(us) ts", "x", "ele", "hr")
        df.coalesce(1).write.mode("append").parquet(folder)
        for r in part:
            (kept if r[1] > mark else dropped).append(r)
            seen = max(seen, r[1])
        mark = max(mark, seen // 1000 * 1000 - LATE_US)
    return df.schema, [r for r in kept if r[1] <= mark], dropped, mark


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("readings"))
    schema, kept, dropped, mark = replayed(spark, readings(random.Random(3)), f"{folder}/in", 7)
    assert dropped and len({r[0] for r in dropped}) > 1  # late rows there are, of several devices
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    frames = {}
    for r in sorted(kept):
        frames.setdefault(r[0], []).append(r)
    names = ["track_id", "us", "x", "ele", "hr", "arrival"]
    return stream, {k: pd.DataFrame(v, columns=names).astype({"x": object, "ele": object}) for k, v in frames.items()}, mark, folder


def batches(folder):
    """How many triggers gave out rows."""
    import os

    return len([f for f in os.listdir(f"{folder}-state/commits") if f.isdigit()])


def test_pauses_are_those_of_one_batch(replay):
    stream, devices, mark, folder = replay
    want = set()
    for k, rows in devices.items():
        state, found = live.pause_step((live.NEVER, 0.0, live.NEVER, 0.0), rows, IDLE_US)
        want |= {(k, *f) for f in [*found, *live.pause_ending(state, mark, IDLE_US)[1]]}
    found = [tuple(r) for r in live.run_available(live.stream_pauses(stream, "20 minutes"), f"{folder}/pauses").collect()]
    assert len(found) == len(want) > 20 and set(found) == want  # each once, and final
    assert batches(f"{folder}/pauses") >= 5


def test_gain_is_that_of_one_batch(replay):
    stream, devices, _, folder = replay
    want = {}
    for k, rows in devices.items():
        _, found = live.gain_step((live.NEVER, 0.0, 0.0, 0.0, 0.0, 0, 0, 0), rows)
        want[k] = found[-1]
    out = live.run_available(live.stream_gain(stream), f"{folder}/gain")
    last = {r["track_id"]: (r["n"], r["gain"], r["loss"]) for r in live.gain_totals(out).collect()}
    assert last == {k: v[:3] for k, v in want.items()}
    assert out.count() > len(want)  # totals come as the watermark goes on


def test_zone_time_is_that_of_one_batch(replay):
    stream, devices, _, folder = replay
    want = {}
    for k, rows in devices.items():
        last = None
        for us, hr in zip(rows["us"], rows["hr"], strict=True):
            zone = None if hr is None or hr != hr else sum(hr >= b for b in ZONES)
            seconds, n = want.get((k, us // 60_000_000 * 60, zone), (0, 0))
            want[k, us // 60_000_000 * 60, zone] = (seconds + (0 if last is None else us - last), n + 1)
            last = us
    found = live.zone_totals(live.run_available(live.stream_zone_time(stream, ZONES), f"{folder}/zones"))
    rows = found.selectExpr("track_id", "unix_seconds(start)", "zone", "cast(round(seconds * 1e6) as long)", "readings").collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == want and len(rows) == len(want)


def test_timers_wake_silent_devices():
    """Without any further reading of its own a device's stop is given out when the watermark has gone on."""
    step = functools.partial(live.pause_step, idle=IDLE_US)
    state, found = step((live.NEVER, 0.0, live.NEVER, 0.0), pd.DataFrame({"us": [0, 15 * 10**6], "x": [1.0, 1.0]}))
    assert not found and live.pause_ending(state, IDLE_US, IDLE_US)[1] == []
    state, found = live.pause_ending(state, 15 * 10**6 + IDLE_US, IDLE_US)
    assert found == [(0, 15 * 10**6, 15.0)] and live.pause_ending(state, 10**12, IDLE_US)[1] == []
