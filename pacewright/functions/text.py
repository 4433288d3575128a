"""Column helpers for numbers, times and texts. Nulls stay null; only text sinks write a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pacewright.functions.geo import METRES_PER_FOOT

MILE, MPH = 1609.344, 2.2369362920544


def parse_number(c: Column) -> Column:
    """A finite number, or null for blank and other texts."""
    return finite(as_number(c))


def as_number(c: Column) -> Column:
    """The number that a text stands for, or null."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("double")


def finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def parse_iso_time(c: Column) -> Column:
    """Milliseconds since 1970 of an ISO text, or null."""
    return F.unix_millis(F.try_to_timestamp(F.trim(c)))


def to_feet(c: Column) -> Column:
    return c / METRES_PER_FOOT


def to_miles(c: Column) -> Column:
    return c / MILE


def to_kmh(c: Column) -> Column:
    return c * 3.6


def to_mph(c: Column) -> Column:
    return c * MPH


def to_pace_per_mile(c: Column) -> Column:
    return c * (MILE / 1000)


def to_fahrenheit(c: Column) -> Column:
    return c * 9 / 5 + 32


def _places(c: Column, digits: int) -> Column:
    """Up to ``digits`` decimals with grouped thousands, no trailing zeros."""
    t = F.format_number(F.round(c, digits), digits)
    return F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "") if digits else t


def _unit(c: Column, digits: int, unit: str) -> Column:
    return F.concat(_places(c, digits), F.lit(f" {unit}"))


def format_distance(c: Column, imperial: bool = False) -> Column:
    """Metres or feet, from a kilometre or mile on those, with two decimals up to a hundred of them and one beyond."""
    turn, long, short, names = (MILE, to_miles(c), to_feet(c), ("ft", "mi")) if imperial else (1000.0, c / 1000, c, ("m", "km"))
    far = F.when(c < 100 * turn, _unit(long, 2, names[1])).otherwise(_unit(long, 1, names[1]))
    return F.when(c >= 0, F.when(c < turn, _unit(short, 0, names[0])).otherwise(far))


def format_elevation(c: Column, imperial: bool = False) -> Column:
    return _unit(to_feet(c), 0, "ft") if imperial else _unit(c, 0, "m")


def format_signed_elevation(c: Column, imperial: bool = False) -> Column:
    return F.concat(F.when(c > 0, "+").when(c < 0, "−").otherwise(""), format_elevation(F.abs(c), imperial))


def format_grade(c: Column) -> Column:
    return F.concat(_places(c * 100, 1), F.lit("%"))


def format_speed(c: Column, imperial: bool = False) -> Column:
    return _unit(to_mph(c), 1, "mph") if imperial else _unit(to_kmh(c), 1, "km/h")


def format_duration(c: Column) -> Column:
    """Whole seconds as h:mm:ss, or m:ss under an hour."""
    s = F.round(c).cast("long")
    h, m, r = (s / 3600).cast("long"), ((s % 3600) / 60).cast("long"), s % 60
    long = F.format_string("%d:%02d:%02d", h, m, r)
    return F.when(c >= 0, F.when(h > 0, long).otherwise(F.format_string("%d:%02d", m, r)))


def format_pace(c: Column, imperial: bool = False) -> Column:
    shown = format_duration(to_pace_per_mile(c) if imperial else c)
    return F.when(c > 0, F.concat(shown, F.lit(" /mi" if imperial else " /km")))


def format_vam(c: Column, imperial: bool = False) -> Column:
    return _unit(to_feet(c), 0, "ft/h") if imperial else _unit(c, 0, "m/h")


def format_bpm(c: Column) -> Column:
    return _unit(c, 0, "bpm")


def format_power(c: Column) -> Column:
    return _unit(c, 0, "W")


def format_cadence(c: Column, factor: Column | None = None) -> Column:
    """Steps a minute where a track counts one leg (factor 2), else turns a minute."""
    return F.concat(_places(c, 0), F.lit(" rpm") if factor is None else F.when(factor == 2, " spm").otherwise(" rpm"))


def format_temp(c: Column, imperial: bool = False) -> Column:
    return _unit(to_fahrenheit(c), 0, "°F") if imperial else _unit(c, 1, "°C")


def format_percent(c: Column) -> Column:
    return F.concat(_places(c, 0), F.lit("%"))


def format_date_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd HH:mm")


def format_bpm_range(lo: Column, hi: Column) -> Column:
    return F.when(hi.isNull(), F.concat(_places(lo, 0), F.lit("+ bpm"))).otherwise(F.concat(_places(lo, 0), F.lit("–"), _places(hi, 0), F.lit(" bpm")))


def format_sector_range(start: Column, end: Column, imperial: bool = False) -> Column:
    """Both ends in the unit that the length calls for."""
    turn, long, short, names = (MILE, to_miles, to_feet, ("ft", "mi")) if imperial else (1000.0, lambda c: c / 1000, lambda c: c, ("m", "km"))
    one = lambda c: F.when(end - start < turn, _unit(short(c), 0, names[0])).otherwise(_unit(long(c), 2, names[1]))
    return F.when((start >= 0) & (end >= 0), F.concat(one(start), F.lit(" – "), one(end)))


def cadence_display(cad: Column, factor: Column) -> Column:
    return cad * factor
