"""Heart-rate zones: settings, bounds and time in each zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacewright.operators.sector import SECTOR

# Lower bounds of the five zones for each way to set them (the last takes its top from the threshold).
DEFAULT_BOUNDS = {"max": [95, 114, 133, 152, 171], "hrr": [125, 138, 151, 164, 177], "lthr": [102, 119, 136, 153]}


def zone_bounds(settings: DataFrame) -> DataFrame:
    """(…, zone, lo, hi) of rows with an array ``bounds``; the fifth zone is open above."""
    keys = [c for c in settings.columns if c != "bounds"]
    d = settings.select(*keys, F.posexplode("bounds").alias("k", "lo"))
    hi = F.lead("lo").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("k"))
    return d.select(*keys, (F.col("k") + 1).alias("zone"), F.col("lo").cast("double").alias("lo"), hi.cast("double").alias("hi"))


def active_bounds(settings: DataFrame) -> DataFrame:
    """Adds ``bounds`` of the chosen mode; the threshold mode's fifth bound is the threshold itself."""
    lthr = F.concat("lthr_bounds", F.array("lthr"))
    return settings.withColumn("bounds", F.when(F.col("mode") == "max", F.col("max_bounds")).when(F.col("mode") == "hrr", F.col("hrr_bounds")).otherwise(lthr))


def zone_display_range(zones: DataFrame) -> DataFrame:
    return zones.withColumns({"shown_lo": F.ceil("lo"), "shown_hi": F.ceil("hi") - 1})


def zone_boundary_pct(zones: DataFrame) -> DataFrame:
    """Adds ``pct`` of each lower bound; rows carry ``mode``, ``max_hr``, ``rest_hr`` and ``lthr``."""
    share = F.when(F.col("mode") == "max", F.col("lo") / F.col("max_hr")).when(F.col("mode") == "hrr", (F.col("lo") - F.col("rest_hr")) / (F.col("max_hr") - F.col("rest_hr"))).otherwise(F.col("lo") / F.col("lthr"))
    return zones.withColumn("pct", share * 100)


def validate_hr_settings(settings: DataFrame) -> DataFrame:
    """Adds ``error``: the first rule that the settings break (mode, greatest, resting, both, threshold, bounds), or null."""

    def bounds(c: str, n: int) -> str:
        """n whole beats above 0 and up to 260, each over the one before."""
        pairs = f"forall(zip_with({c}, concat(array(0), slice({c}, 1, {n - 1})), (e, before) -> e is not null and e = floor(e) and e > before and e <= 260), x -> x)"
        return f"not coalesce(size({c}) = {n} and {pairs}, false)"

    whole = lambda c: f"({c} is null or {c} <> floor({c}) or {c} <= 0)"
    rules = [
        ("mode is null or mode not in ('max', 'hrr', 'lthr')", "mode"),
        (f"{whole('max_hr')} or max_hr not between 100 and 260", "max_hr"),
        (f"{whole('rest_hr')} or rest_hr not between 20 and 150", "rest_hr"),
        ("max_hr <= rest_hr", "max_rest"),
        (f"{whole('lthr')} or lthr <= rest_hr or lthr >= max_hr", "lthr"),
        *[(bounds(f"{c}_bounds", n), "order") for c, n in (("max", 5), ("hrr", 5), ("lthr", 4))],
        ("lthr_bounds[3] >= lthr", "order"),
    ]
    return settings.withColumn("error", F.expr("case " + " ".join(f"when {c} then '{n}'" for c, n in rules) + " end"))


def migrate_hr_settings(old: DataFrame) -> DataFrame:
    """Bounds stored as percentages become whole beats; rows that then break a rule get the defaults."""
    beats = "transform({0}_pcts, p -> cast(round({1}) as int))"
    d = old.withColumns(
        {
            "max_bounds": F.expr(beats.format("max", "p * max_hr / 100")),
            "hrr_bounds": F.expr(beats.format("hrr", "rest_hr + p * (max_hr - rest_hr) / 100")),
            "lthr_bounds": F.expr(beats.format("lthr", "p * lthr / 100")),
        }
    )
    d = validate_hr_settings(d)
    return d.withColumns({f"{c}_bounds": F.when(F.col("error").isNull(), F.col(f"{c}_bounds")).otherwise(F.array(*map(F.lit, b))) for c, b in DEFAULT_BOUNDS.items()})


def _keys(zones: DataFrame) -> list[str]:
    """What settings are kept by: all columns but those of a zone."""
    return [c for c in zones.columns if c not in ("zone", "lo", "hi")]


def _in_bounds(bounds: str, value: str) -> str:
    """SQL of the zone of ``value`` among ``bounds`` (lo, hi, zone) in rising order: the last that begins at or below it."""
    last = f"try_element_at({bounds}, greatest(1, size(filter({bounds}, b -> b.lo <= {value}))))"
    return f"if({value} is null or {bounds} is null, null, if({last}.lo <= {value} and ({last}.hi is null or {value} < {last}.hi), {last}.zone, 0))"


def classify_hr_zone(readings: DataFrame, zones: DataFrame, hr: str = "hr") -> DataFrame:
    """Adds ``zone``: 1 to 5, 0 below the first, null without a reading.

    A range join by key: zones have the columns of a zone (zone, lo, hi) and those that settings are kept by (the
    track, the athlete), which readings have too. The zones of a key become one sorted array, which meets the readings
    of that key in an equi-join and is searched there. Readings whose key has no settings have no zone. Zones without a
    key are one setting for all: five rows, more are an error.
    """
    keys = _keys(zones)
    if keys:
        each = zones.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "zone"))).alias("_bounds"))
        return readings.join(each, keys, "left").withColumn("zone", F.expr(_in_bounds("_bounds", f"`{hr}`"))).drop("_bounds")
    rows = zones.select("zone", "lo", "hi").limit(6).collect()
    if len(rows) > 5:
        raise ValueError("zones of one setting are five rows at most")
    found = [F.when((F.col(hr) >= z["lo"]) & (F.lit(z["hi"] is None) | (F.col(hr) < F.lit(z["hi"]))), z["zone"]) for z in rows]
    return readings.withColumn("zone", F.when(F.col(hr).isNotNull(), F.coalesce(*found, F.lit(0))))


def hr_zone_time(walk: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Seconds of each sector by the zone of a step's end point; outside pauses. A sector without readings gives no row.
    ``counted_s`` are those that shares are of: all outside pauses but those below the first zone.

    Where the walk's points were classified before, their zones are taken; else ``zones`` classify the walk.
    """
    nearest = lambda own, ahead: F.when((F.col("kind") != "end") | (F.col("end_t") < 0.5), F.col(own)).otherwise(F.col(ahead))
    d = walk.withColumn("hr", nearest("v_hr", "v_next_hr")).filter("timed")
    d = d.withColumn("had", F.max(F.col("hr").isNotNull()).over(Window.partitionBy(*SECTOR))).filter("had")
    d = classify_hr_zone(d, zones) if zones is not None else d.withColumn("zone", nearest("v_zone", "v_next_zone"))
    # milliseconds of a step are a difference of places on one grid, so their sums are exact in any order
    step = F.col("to_ms") - F.col("from_ms")
    out = F.when(~F.col("paused"), step)
    sums = {"moving_s": out, "paused_s": F.when(F.col("paused"), step), "no_hr_s": F.when(F.col("hr").isNull(), out), "below_s": F.when(F.col("zone") == 0, out)}
    sums |= {f"z{k}_s": F.when(F.col("zone") == k, out) for k in range(1, 6)}
    # a sum of its own: the difference of seconds moving and below would keep the rounding of both
    sums["counted_s"] = F.when(F.coalesce(F.col("zone") != 0, F.lit(True)), out)
    return d.groupBy(*SECTOR).agg(*[F.coalesce(F.sum(c) / 1000, F.lit(0.0)).alias(n) for n, c in sums.items()])


def zone_share_pct(times: DataFrame) -> DataFrame:
    counted = F.col("counted_s")
    return times.withColumns({f"z{k}_pct": F.when(counted > 0, F.round(F.col(f"z{k}_s") / counted * 100)).otherwise(F.lit(0.0)).cast("int") for k in range(1, 6)})
