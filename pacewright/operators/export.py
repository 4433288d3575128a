"""Text and table sinks for sectors and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewright.functions import text as T
from pacewright.operators.sector import SECTOR
from pacewright.operators.zones import zone_display_range, zone_share_pct

UNAVAILABLE, NO_HR, NO_TIME = "Unavailable", "No heart rate data", "No timestamp data"


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _tag(name: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))).otherwise("")


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def sector_gpx(points: DataFrame, sectors: DataFrame, factor: int = 1) -> DataFrame:
    """(track_id, sector_id, gpx): each sector's own points as one GPX 1.1 document on one line."""
    sensors = F.concat(_tag("gpxtpx:hr", F.col("hr")), _tag("gpxtpx:cad", F.col("cad") * factor), _tag("gpxtpx:atemp", F.col("temp")), _tag("gpxtpx:speed", F.col("speed")))
    more = F.concat(_tag("power", F.col("power")), F.when(sensors != "", F.concat(F.lit("<gpxtpx:TrackPointExtension>"), sensors, F.lit("</gpxtpx:TrackPointExtension>"))).otherwise(""))
    point = F.concat(F.format_string('<trkpt lat="%s" lon="%s">', F.col("lat").cast("string"), F.col("lon").cast("string")), _tag("ele", F.col("ele")), _tag("time", iso_time(F.col("time_ms"))), F.when(more != "", F.concat(F.lit("<extensions>"), more, F.lit("</extensions>"))).otherwise(""), F.lit("</trkpt>"))
    p = points.select("track_id", "seq", "cum_dist", point.alias("xml"))
    block = "cast(floor({} / 1000) as int)"  # sectors meet only the points of the kilometres they reach into
    s = sectors.select(*SECTOR, "start_m", "end_m", F.explode(F.expr(f"sequence({block.format('(start_m - 1e-6)')}, {block.format('(end_m + 1e-6)')})")).alias("block"))
    d = s.join(p.withColumn("block", F.expr(block.format("cum_dist"))), ["track_id", "block"]).filter("cum_dist between start_m - 1e-6 and end_m + 1e-6")
    d = d.groupBy(*SECTOR, "start_m", "end_m").agg(F.array_sort(F.collect_list(F.struct("seq", "xml"))).alias("ps"))
    head = '<gpx version="1.1" creator="pacewright" xmlns="http://www.topografix.com/GPX/1/1" xmlns:gpxtpx="http://www.garmin.com/xmlschemas/TrackPointExtension/v2">'
    name = F.concat(F.lit("<metadata><name>"), xml_escape(F.col("track_id").cast("string")), F.lit("</name><desc>"), xml_escape(T.format_sector_range(F.col("start_m"), F.col("end_m"))), F.lit("</desc></metadata>"))
    return d.select(*SECTOR, F.concat(F.lit(head), name, F.lit("<trk><trkseg>"), F.array_join("ps.xml", ""), F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def write_texts(documents: DataFrame, column: str, path: str, files: bool = False, dealt: bool = False) -> None:
    """Documents of sectors, packed: as many files as tasks, whatever the number of sectors.

    A file holds its documents whole, sorted by track and sector in groups of about 4 MB, and the range of keys of each
    group, so one document is read without the others. Tasks commit their files when they end; one that fails
    leaves none. With ``files`` every document becomes a text file in a folder named after its sector, for
    tools that want files; that is for as many sectors as a file system can hold. ``dealt`` says that the documents
    come by track already, as those of ``sector_gpx`` do.
    """
    d = documents.select(*SECTOR, F.col(column).alias("value"))
    d = (d if dealt else d.repartition("track_id")).sortWithinPartitions(*SECTOR)
    if files:
        d.write.partitionBy(*SECTOR).text(path)
    else:
        d.write.option("parquet.block.size", 4 << 20).parquet(path)


def read_texts(spark: SparkSession, path: str, files: bool = False) -> DataFrame:
    """(track_id, sector_id, value) of what ``write_texts`` wrote; filters on the keys reach the files."""
    if not files:
        return spark.read.parquet(path)
    return spark.read.text(path, wholetext=True).select(*SECTOR, F.regexp_replace("value", "\n$", "").alias("value"))


#: The rows of a report, in its order (group, label, metric, kind).
CATALOGUE = [
    ("Summary", "Distance", "horizontal_m", "distance"),
    ("Summary", "Distance 3D", "distance_3d", "distance"),
    ("Summary", "Effort distance", "effort_distance", "distance"),
    ("Summary", "Gain", "gain", "elevation"),
    ("Summary", "Loss", "loss", "elevation"),
    ("Summary", "Average grade", "avg_grade", "grade"),
    ("Summary", "Average pace", "avg_pace", "pace"),
    ("Summary", "Average GAP", "avg_gap", "pace"),
    ("Summary", "Average speed", "avg_speed", "speed"),
    ("Elevation", "Start", "ele_start", "elevation"),
    ("Elevation", "End", "ele_end", "elevation"),
    ("Elevation", "Minimum", "ele_min", "elevation"),
    ("Elevation", "Maximum", "ele_max", "elevation"),
    ("Elevation", "Net change", "net", "signed"),
    ("Gradient", "Maximum grade", "max_grade", "grade"),
    ("Gradient", "Minimum grade", "min_grade", "grade"),
    ("Speed", "Average speed", "avg_speed", "speed"),
    ("Speed", "Maximum speed", "max_speed", "speed"),
    ("Speed", "Fastest km", "fastest_pace", "pace"),
    ("Speed", "Slowest km", "slowest_pace", "pace"),
    ("Speed", "VAM", "vam", "vam"),
    ("Speed", "VDM", "vdm", "vam"),
    ("Time", "Elapsed time", "elapsed_s", "duration"),
    ("Time", "Moving time", "moving_s", "duration"),
    ("Time", "Start", "start_ms", "date"),
    ("Time", "End", "end_ms", "date"),
    ("Fitness", "Average heart rate", "avg_hr", "bpm"),
    ("Fitness", "Maximum heart rate", "max_hr", "bpm"),
    ("Fitness", "Average cadence", "avg_cad", "cadence"),
    ("Fitness", "Maximum cadence", "max_cad", "cadence"),
    ("Fitness", "Average power", "avg_power", "power"),
    ("Fitness", "Maximum power", "max_power", "power"),
    ("Fitness", "Average temperature", "avg_temp", "temp"),
    ("Fitness", "Minimum temperature", "min_temp", "temp"),
    ("Fitness", "Maximum temperature", "max_temp", "temp"),
]
ZONES = "Heart rate zones"


def _shown(v: Column, imperial: bool) -> dict[str, Column]:
    return {
        "distance": T.format_distance(v, imperial),
        "elevation": T.format_elevation(v, imperial),
        "signed": T.format_signed_elevation(v, imperial),
        "grade": T.format_grade(v),
        "pace": T.format_pace(v, imperial),
        "speed": T.format_speed(v, imperial),
        "vam": T.format_vam(v, imperial),
        "duration": T.format_duration(v),
        "date": T.format_date_time(v),
        "bpm": T.format_bpm(v),
        "cadence": T.format_cadence(v),
        "power": T.format_power(v),
        "temp": T.format_temp(v, imperial),
    }


def metrics_long(metrics: DataFrame, zone_times: DataFrame | None = None, zones: DataFrame | None = None, tracks: DataFrame | None = None, imperial: bool = False) -> DataFrame:
    """(track_id, sector_id, place, group, label, value): the rows of a report, null metrics as unavailable; with the
    times in zones (see zones.py) also a row for each zone: range, share and duration.

    ``zones`` are one setting for all or kept by track, as in ``classify_hr_zone``. Where a sector has no times in zones,
    their rows say why: no heart rate, or, by the flags of ``tracks`` if given, no time.
    """
    rows = [F.struct(F.lit(k + 1).alias("place"), F.lit(g).alias("group"), F.lit(n).alias("label"), F.lit(kind).alias("kind"), F.col(m).cast("double").alias("v")) for k, (g, n, m, kind) in enumerate(CATALOGUE)]
    # one row each first, so that a kind's format stands in the plan once
    shown = F.coalesce(*[F.when(F.col("kind") == kind, c) for kind, c in _shown(F.col("v"), imperial).items()], F.lit(UNAVAILABLE))
    long = metrics.select(*SECTOR, F.inline(F.array(*rows))).select(*SECTOR, "place", "group", "label", shown.alias("value"))
    if zone_times is None:
        return long
    keys = [c for c in zones.columns if c not in ("zone", "lo", "hi")]
    five = [F.max(F.when(F.col("zone") == k, F.struct("shown_lo", "shown_hi"))).alias(f"shown_{k}") for k in range(1, 6)]
    shown = zone_display_range(zones).groupBy(*keys).agg(*five)
    d = zone_share_pct(metrics.select(*SECTOR).join(zone_times, list(SECTOR), "left"))
    # one setting for all is one row
    d = d.join(shown, keys, "left") if keys else d.join(F.broadcast(shown))
    why = F.lit(NO_HR)
    if tracks is not None:
        d = d.join(tracks.select("track_id", "has_hr", "has_time"), "track_id", "left")
        why = F.when(F.col("has_hr") & ~F.col("has_time"), NO_TIME).otherwise(NO_HR)
    rows = []
    for k in range(1, 6):
        parts = F.concat_ws(", ", T.format_bpm_range(F.col(f"shown_{k}.shown_lo"), F.col(f"shown_{k}.shown_hi").cast("double")), T.format_percent(F.col(f"z{k}_pct")), T.format_duration(F.col(f"z{k}_s")))
        rows.append(F.struct(F.lit(len(CATALOGUE) + k).alias("place"), F.lit(ZONES).alias("group"), F.lit(f"Zone {k}").alias("label"), F.when(F.col("moving_s").isNull(), why).when(F.col(f"shown_{k}").isNull(), UNAVAILABLE).otherwise(parts).alias("value")))
    return long.unionByName(d.select(*SECTOR, F.inline(F.array(*rows))))


def metrics_text(long: DataFrame) -> DataFrame:
    """(track_id, sector_id, text): tab-separated lines of each sector."""
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat_ws("\t", "label", "value").alias("l"))))
    return long.groupBy(*SECTOR).agg(F.array_join(lines["l"], "\n").alias("text"))


def metrics_markdown(long: DataFrame) -> DataFrame:
    """(track_id, sector_id, text): one headed table for each group."""
    rows = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("| "), F.replace("label", F.lit("|"), F.lit("\\|")), F.lit(" | "), F.replace("value", F.lit("|"), F.lit("\\|")), F.lit(" |")).alias("l"))))
    d = long.groupBy(*SECTOR, "group").agg(F.min("place").alias("place"), F.array_join(rows["l"], "\n").alias("rows"))
    table = F.concat(F.lit("## "), "group", F.lit("\n\n| Metric | Value |\n| --- | --- |\n"), "rows")
    parts = F.array_sort(F.collect_list(F.struct("place", table.alias("t"))))
    return d.groupBy(*SECTOR).agg(F.array_join(parts["t"], "\n\n").alias("text"))


def write_metrics_csv(long: DataFrame, path: str) -> None:
    """The sector's key, label and value, in order, quoted by RFC 4180, lines ended by CR LF, without a header.

    A file holds the reports of many sectors, all of a track in one file; the first two columns tell them apart.
    """
    ordered = long.repartition("track_id").sortWithinPartitions(*SECTOR, "place")
    ordered.select(*SECTOR, "label", "value").write.option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


def read_metrics_csv(spark: SparkSession, path: str, key: str = "long") -> DataFrame:
    """(track_id, sector_id, label, value) of what ``write_metrics_csv`` wrote."""
    rows = spark.read.option("quote", '"').option("escape", '"').option("lineSep", "\r\n")
    return rows.schema(f"track_id {key}, sector_id int, label string, value string").csv(path)
