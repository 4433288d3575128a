"""Live telemetry: pauses, climb and zone time per device over streams of readings.

Readings are (track_id, ts, x, ele, hr): metres gone, elevation and heart rate. They are worked in order of time,
however they arrive: a device's readings wait in its state until the watermark has passed them, when timers wake
it, so what is given out is final and the same as of one batch. A reading that comes after the watermark has
passed its time is late and dropped. Readings of one moment count once, the one of least ``x``.

State lives in RocksDB, so what waits is bounded by disk and not by memory; at most ``LATE`` of a device's readings wait.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pacewright.functions.geo import MOVING_MPS, PAUSE_MIN_S

LATE = "10 minutes"
NEVER = -(1 << 62)
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Hands each device's readings to ``step(state, rows)`` -> (state, output rows) once the watermark has passed them, in
    order of time; ``ending(state, now)`` does the same without readings, ``idle`` microseconds after the last one.

    Timers wake a device at the first reading that waits, and at the end of its idle time.
    """

    def __init__(self, step: Callable, empty: tuple, fields: str, waiting: str, names: list[str], ending: Callable | None = None, idle: int = 0):
        self.step, self.empty, self.fields, self.waiting_fields, self.names, self.ending, self.idle = step, empty, fields, waiting, names, ending, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)
        self.waiting = handle.getListState("waiting", self.waiting_fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        columns = [f.split()[0] for f in self.waiting_fields.split(", ")]
        first = None
        for batch in rows:
            held = [tuple(None if v != v else v for v in r) for r in batch[columns].astype(object).itertuples(index=False) if r[0] > late]
            if held:
                self.waiting.appendList(held)
                earliest = min(r[0] for r in held)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(max(1, first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        columns = [f.split()[0] for f in self.waiting_fields.split(", ")]
        held = [tuple(r) for r in self.waiting.get()]
        due, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        state, found = (tuple(self.state.get()) if self.state.exists() else self.empty), []
        if due:
            rows = pd.DataFrame(due, columns=columns).sort_values(columns[:2], kind="stable")
            state, found = self.step(state, rows)
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if self.ending:
            state, more = self.ending(state, now)
            found += more
            if due:
                self.handle.registerTimer((state[0] + self.idle) // 1000 + 1)
        self.state.update(tuple(state))
        if rest:
            self.handle.registerTimer(max(1, min(r[0] for r in rest) // 1000))
        if found:
            yield pd.DataFrame([(key[0], *r) for r in found], columns=self.names)

    def close(self) -> None:
        pass


def _in_order(readings: DataFrame, step, empty: tuple, fields: str, waiting: str, out: str, **more) -> DataFrame:
    readings = readings.withWatermark("ts", LATE).filter("ts is not null").withColumn("us", F.unix_micros("ts"))
    processor = InOrder(step, empty, fields, waiting, [f.split()[0] for f in out.split(", ")], **more)
    return readings.groupBy("track_id").transformWithStateInPandas(processor, out, "Append", "EventTime")


def pause_step(state: tuple, rows, idle: int) -> tuple[tuple, list[tuple]]:
    """A stop of ten seconds or more is one pause; it is given out when movement goes on, or when the device has been
    silent for more than ``idle`` microseconds; a silence belongs to no stop. Readings without ``x`` say nothing."""
    last, last_x, since, stopped = state
    found = []
    for us, x in zip(rows["us"].tolist(), rows["x"].tolist(), strict=True):
        if us <= last or x is None or x != x:
            continue
        if last > NEVER:
            dt = (us - last) / 1e6
            if us - last > idle or abs(x - last_x) / dt >= MOVING_MPS:
                if stopped >= PAUSE_MIN_S:
                    found.append((since, last, stopped))
                since, stopped = NEVER, 0.0
            else:
                since, stopped = (last if since == NEVER else since), stopped + dt
        last, last_x = us, x
    return (last, last_x, since, stopped), found


def pause_ending(state: tuple, now: int, idle: int) -> tuple[tuple, list[tuple]]:
    """The stop of a device that has been silent for ``idle`` by the watermark."""
    last, last_x, since, stopped = state
    if since == NEVER or now < last + idle:
        return state, []
    return (last, last_x, NEVER, 0.0), [(since, last, stopped)] if stopped >= PAUSE_MIN_S else []


def gain_step(state: tuple, rows) -> tuple[tuple, list[tuple]]:
    """Gain and loss past a residual of 3 m, and the seconds of rising and falling trend (the residual's sign); one row
    per batch with the totals so far."""
    last, last_ele, residual, gain, loss, up, down, n = state
    for us, ele in zip(rows["us"].tolist(), rows["ele"].tolist(), strict=True):
        if us <= last or ele is None or ele != ele:
            continue
        if n:
            residual += ele - last_ele
            up, down = (up + us - last, down) if residual > 0 else (up, down + us - last) if residual < 0 else (up, down)
            if residual > 3:
                gain, residual = gain + residual, 0.0
            elif residual < -3:
                loss, residual = loss - residual, 0.0
        last, last_ele, n = us, ele, n + 1
    return (last, last_ele, residual, gain, loss, up, down, n), [(n, gain, loss, up / 1e6, down / 1e6)]


def stream_pauses(readings: DataFrame, idle: str = "1 hour") -> DataFrame:
    """(track_id, t0_us, t1_us, seconds) of pauses, each once, when it is over."""
    import functools

    import pandas as pd

    gap = int(pd.Timedelta(idle).value // 1000)
    step, ending = functools.partial(pause_step, idle=gap), functools.partial(pause_ending, idle=gap)
    return _in_order(readings, step, (NEVER, 0.0, NEVER, 0.0), "last long, last_x double, since long, stopped double", "us long, x double", "track_id long, t0_us long, t1_us long, seconds double", ending=ending, idle=gap)


def stream_gain(readings: DataFrame) -> DataFrame:
    """(track_id, n, gain, loss, climb_s, descend_s): the totals of each device up to where the watermark has come."""
    return _in_order(readings, gain_step, (NEVER, 0.0, 0.0, 0.0, 0.0, 0, 0, 0), "last long, last_ele double, residual double, gain double, loss double, up long, down long, n long", "us long, x double, ele double", "track_id long, n long, gain double, loss double, climb_s double, descend_s double")


def gain_totals(added: DataFrame) -> DataFrame:
    """(track_id, n, gain, loss, vam, vdm) of each device's last totals; rates in metres an hour of rising and falling trend."""
    last = added.groupBy("track_id").agg(F.max(F.struct("n", "gain", "loss", "climb_s", "descend_s")).alias("t")).select("track_id", "t.*")
    rate = lambda m, s: F.when((F.col(s) > 0) & (F.col(m) > 0), F.col(m) / (F.col(s) / 3600))
    return last.select("track_id", "n", "gain", "loss", rate("gain", "climb_s").alias("vam"), rate("loss", "descend_s").alias("vdm"))


def zone_step(state: tuple, rows) -> tuple[tuple, list[tuple]]:
    """Time since the last reading, added up by the window and zone of the reading that ends it."""
    (last,) = state
    sums: dict[tuple, list[int]] = {}
    for us, start, zone in zip(rows["us"].to_numpy().tolist(), rows["start_us"].to_numpy().tolist(), rows["zone"].to_numpy().tolist(), strict=True):
        found = sums.setdefault((start, zone), [0, 0])
        found[0] += us - last if NEVER < last < us else 0
        found[1] += 1
        last = max(last, us)
    return (last,), [(*k, *v) for k, v in sums.items()]


def stream_zone_time(readings: DataFrame, bounds: list[float], width: str = "1 minute") -> DataFrame:
    """(track_id, start, zone, micros, readings): what each batch adds to a device's tumbling windows; ``zone_totals``
    adds the batches up. A step counts by its end point, as in ``hr_zone_time``; zone is null without heart rate.

    A step is out when the watermark has passed its end, so a window's sums grow until then and never shrink.
    """
    zone = sum(((F.col("hr") >= b).cast("int") for b in bounds), F.lit(0))
    w = readings.filter("ts is not null").withColumn("zone", F.coalesce(zone, F.lit(-1)))
    w = w.withColumn("start_us", F.unix_micros(F.window("ts", width)["start"]))
    added = _in_order(w, zone_step, (NEVER,), "last long", "us long, x double, start_us long, zone int", "track_id long, start_us long, zone int, micros long, readings long")
    return added.select("track_id", F.timestamp_micros("start_us").alias("start"), F.when(F.col("zone") >= 0, F.col("zone")).alias("zone"), "micros", "readings")


def zone_totals(added: DataFrame) -> DataFrame:
    """(track_id, start, zone, seconds, readings) of each window, those still open too."""
    return added.groupBy("track_id", "start", "zone").agg((F.sum("micros") / 1e6).alias("seconds"), F.sum("readings").alias("readings"))


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is now into Parquet files at ``path`` and reads them."""
    spark = stream.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
