"""Reading activity files into points: GPX, TCX, KML, KMZ and decoded device records.

Every reader gives (doc, seq, lat, lon, ele, time_ms, hr, cad, power, temp, speed), where ``doc`` is the file's full
path, so files of one name or title stay apart; ``document_titles`` has the titles. Rows without a place are
dropped. Spark's XML source is given the element that stands for one point (or line), wherever it is nested, so a
file of any length is read through point by point; a file is never split, so row numbers keep its order. Values that
are no numbers become null.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pacewright.functions.text import as_number, finite, parse_iso_time, parse_number
from pacewright.operators.track import interpolated_gaps

POINT = ["lat", "lon", "ele", "time_ms", "hr", "cad", "power", "temp", "speed"]
GPX_POINT = "_lat string, _lon string, ele string, time string, speed string, name string, extensions string"
TCX_POINT = "Time string, Position struct<LatitudeDegrees: string, LongitudeDegrees: string>, AltitudeMeters string, HeartRateBpm struct<Value: string>, Cadence string, Extensions string"
KML_LINE, KML_TRACK = "coordinates string", "when array<string>, coord array<string>"
KML_MARK = "name string, description string, Point string, MultiGeometry string"
TITLES = {"gpx": ("metadata", "name string"), "tcx": ("Activity", "Id string"), "kml": ("Document", "name string")}


def detect_format(files: DataFrame) -> DataFrame:
    """Adds ``format`` to (path, content): by extension, else by the first bytes, else unsupported."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.lower(F.decode(F.substring("content", 1, 512), "ISO-8859-1"))
    has = lambda s: F.contains(head, F.lit(s))
    magic = (
        F.when(F.hex(F.substring("content", 1, 2)) == "504B", "kmz")
        .when(F.hex(F.substring("content", 9, 4)) == "2E464954", "fit")
        .when(has("<gpx"), "gpx")
        .when(has("<trainingcenterdatabase"), "tcx")
        .when(has("<kml"), "kml")
    )
    return files.withColumn("format", F.when(ext.isin("gpx", "fit", "tcx", "kml", "kmz"), ext).otherwise(F.coalesce(magic, F.lit("unsupported"))))


def _read(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    d = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).option("mode", "PERMISSIVE").schema(schema).load(path)
    return d.withColumn("doc", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())


def document_titles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(doc, title): what each file calls itself; files may share a title."""
    tag, schema = TITLES[kind]
    d = _read(spark, path, tag, schema)
    return d.groupBy("doc").agg(F.min_by(schema.split()[0], "_at").alias("title")).filter("title is not null")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with a place, numbered through in document order."""
    rows = rows.filter("lat is not null and lon is not null")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy(*order)) - 1).select("doc", "seq", *POINT)


def _inside(xml: Column, *names: str, otherwise: Column | None = None) -> Column:
    """The text of the first element of that local name, at any depth; of several names the first that occurs, and where
    none does ``otherwise``. What has no text is blank or null.

    Patterns are tried only on texts that hold the name; whether an empty element occurs matters only before another choice.
    """
    parts = []
    for k, n in enumerate(names):
        found, held = F.regexp_extract(xml, rf"<(?:[\w.-]+:)?{n}(?:\s[^>]*)?>([^<]*)</", 1), F.contains(xml, F.lit(n))
        if k + 1 < len(names) or otherwise is not None:
            held = held & F.regexp_like(xml, F.lit(rf"<(?:[\w.-]+:)?{n}[\s/>]"))
        parts.append(F.when(held, found))
    return F.coalesce(*parts, *([] if otherwise is None else [otherwise]))


def _parsed(d: DataFrame, columns: dict[str, Column], time: str, *more: Column) -> DataFrame:
    """(doc, _at, ...) with the finite numbers of texts, and the time. Texts, numbers and what is finite are projections of
    their own: each refers to the one before several times, and in one they would be searched and parsed again each time."""
    d = d.select("doc", "_at", F.col(time).alias("_time"), *[c.alias(n) for n, c in columns.items()], *more)
    kept = d.columns[3 + len(columns) :]
    d = d.select("doc", "_at", parse_iso_time(F.col("_time")).alias("time_ms"), *[as_number(F.col(n)).alias(n) for n in columns], *kept)
    return d.select("doc", "_at", *[finite(F.col(n)).alias(n) for n in columns], "time_ms", *kept)


def _gpx_points(spark: SparkSession, path: str, tag: str) -> DataFrame:
    x = F.col("extensions")
    columns = {"lat": F.col("_lat"), "lon": F.col("_lon"), "ele": F.col("ele"), "hr": _inside(x, "hr"), "cad": _inside(x, "cad"), "power": _inside(x, "power", "PowerInWatts", "Watts"), "temp": _inside(x, "atemp"), "speed": _inside(x, "speed", otherwise=F.col("speed"))}
    return _parsed(_read(spark, path, tag, GPX_POINT), columns, "time", F.nullif(F.trim("name"), F.lit("")).alias("name"))


def scan_gpx(spark: SparkSession, path: str) -> DataFrame:
    """All track points in document order, segments one after another."""
    return _numbered(_gpx_points(spark, path, "trkpt"), "_at")


def scan_gpx_route(spark: SparkSession, path: str) -> DataFrame:
    """Route points of documents without any usable track point."""
    return _numbered(_gpx_points(spark, path, "rtept"), "_at").join(scan_gpx(spark, path).select("doc").distinct(), "doc", "left_anti")


def scan_gpx_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """(doc, wp_seq, lat, lon, ele, time_ms, name)."""
    d = _gpx_points(spark, path, "wpt").withColumn("wp_seq", F.row_number().over(Window.partitionBy("doc").orderBy("_at")) - 1)
    return d.filter("lat is not null and lon is not null").select("doc", "wp_seq", "lat", "lon", "ele", "time_ms", "name")


def scan_tcx(spark: SparkSession, path: str) -> DataFrame:
    """Track points of all laps in document order; gaps of elevation filled."""
    d, x = _read(spark, path, "Trackpoint", TCX_POINT), F.col("Extensions")
    columns = {"lat": F.col("Position.LatitudeDegrees"), "lon": F.col("Position.LongitudeDegrees"), "ele": F.col("AltitudeMeters"), "hr": F.col("HeartRateBpm.Value"), "cad": F.coalesce("Cadence", _inside(x, "RunCadence")), "power": _inside(x, "Watts"), "temp": F.lit(None).cast("string"), "speed": _inside(x, "Speed")}
    points = _parsed(d, columns, "Time")
    return interpolated_gaps(_numbered(points, "_at"), "ele", "ele", ("doc",))


def _kml_points(lines: DataFrame, tracks: DataFrame) -> DataFrame:
    """Points of lines (doc, _at, coordinates), then of timed tracks (doc, _at, when, coord)."""
    blank = [F.lit(None).cast("double").alias(c) for c in ("hr", "cad", "power", "temp", "speed")]

    def placed(d: DataFrame, k: int, part: Column, time: Column) -> DataFrame:
        lon, lat, ele = (parse_number(F.get(part, F.lit(j))) for j in range(3))
        return d.select("doc", F.lit(k).alias("k"), "_at", "c", lat.alias("lat"), lon.alias("lon"), ele.alias("ele"), time.alias("time_ms"), *blank)

    lines = lines.select("doc", "_at", F.posexplode(F.split(F.trim("coordinates"), r"\s+")).alias("c", "t"))
    tracks = tracks.select("doc", "_at", F.posexplode(F.arrays_zip("coord", "when")).alias("c", "z")).filter("z.coord is not null")
    lines = placed(lines, 0, F.split("t", ","), F.lit(None).cast("long"))
    return _numbered(lines.unionByName(placed(tracks, 1, F.split(F.trim("z.coord"), r"\s+"), parse_iso_time(F.col("z.when")))), "k", "_at", "c")


def scan_kml(spark: SparkSession, path: str) -> DataFrame:
    """Points of all lines, then of all timed tracks, however they are nested."""
    return _kml_points(_read(spark, path, "LineString", KML_LINE), _read(spark, path, "Track", KML_TRACK))


def plain_description(c: Column) -> Column:
    """A description without markup, squeezed, 140 characters at most."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.nullif(F.when(F.length(t) > 140, F.concat(F.substring(t, 1, 139), F.lit("…"))).otherwise(t), F.lit(""))


def scan_kml_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """(doc, wp_seq, lat, lon, ele, name) of placemarks with a point; without a name the description serves."""
    d = _read(spark, path, "Placemark", KML_MARK).withColumn("wp_seq", F.row_number().over(Window.partitionBy("doc").orderBy("_at")) - 1)
    point = F.coalesce("Point", F.nullif(F.regexp_extract("MultiGeometry", r"(?s)<(?:[\w.-]+:)?Point[\s>].*", 0), F.lit("")))
    part = F.split(F.get(F.split(F.trim(_inside(point, "coordinates")), r"\s+"), F.lit(0)), ",")
    d = d.select("doc", "wp_seq", parse_number(F.get(part, F.lit(1))).alias("lat"), parse_number(F.get(part, F.lit(0))).alias("lon"), parse_number(F.get(part, F.lit(2))).alias("ele"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), plain_description(F.col("description"))).alias("name"))
    return d.filter("lat is not null and lon is not null")


def unpacked_kmz(files: DataFrame) -> DataFrame:
    """(path, kml, error) of (path, content): doc.kml if there is one, else the first KML file inside."""
    import pandas as pd

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    names = [n for n in archive.namelist() if n.lower().endswith(".kml")]
                    first = next((n for n in names if n.lower().rsplit("/", 1)[-1] == "doc.kml"), names[0] if names else None)
                    rows.append((path, archive.read(first).decode("utf-8", errors="replace"), None) if first else (path, None, "kmzNoKml"))
                except (zipfile.BadZipFile, NotImplementedError, OSError):
                    rows.append((path, None, "invalid"))
            yield pd.DataFrame(rows, columns=["path", "kml", "error"])

    return files.select("path", "content").mapInPandas(opened, "path string, kml string, error string")


def scan_kmz(files: DataFrame) -> DataFrame:
    """Points of the KML inside each archive of (path, content)."""
    d = unpacked_kmz(files).filter("kml is not null")

    def elements(tag: str, schema: str) -> DataFrame:
        found = F.regexp_extract_all("kml", F.lit(rf"(?s)<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?>.*?</(?:[\w.-]+:)?{tag}>"), F.lit(0))
        each = d.select(F.col("path").alias("doc"), F.posexplode(found).alias("_at", "x"))
        plain = F.regexp_replace("x", r"(</?)[\w.-]+:", "$1")  # prefixes are declared outside the piece
        return each.select("doc", "_at", F.from_xml(plain, schema).alias("x")).select("doc", "_at", "x.*")

    return _kml_points(elements("LineString", KML_LINE), elements("Track", KML_TRACK))


def scan_device_records(records: DataFrame) -> DataFrame:
    """Points of decoded device records (doc, seq, position_lat, ...): enhanced fields stand in; elevation gaps filled."""
    d = records.filter("position_lat is not null and position_long is not null")
    d = d.select("doc", "seq", F.col("position_lat").alias("lat"), F.col("position_long").alias("lon"), F.coalesce("altitude", "enhanced_altitude").alias("ele"), F.col("timestamp").alias("time_ms"), F.col("heart_rate").alias("hr"), F.col("cadence").alias("cad"), "power", F.col("temperature").alias("temp"), F.coalesce("speed", "enhanced_speed").alias("speed"))
    return interpolated_gaps(d, "ele", "ele", ("doc",))


ROOTS = {"gpx": "gpx", "tcx": "TrainingCenterDatabase", "kml": "kml"}


def ingest_errors(files: DataFrame, points: DataFrame) -> DataFrame:
    """(doc, error) of files (path, content) that give no track of two points (doc, ...) or more: unsupported, invalid
    (broken XML or archive), kmzNoKml, or noTrack."""
    d = detect_format(files)
    xml = F.decode("content", "UTF-8")
    broken = F.from_xml(xml, "_corrupt_record string, _n string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull()
    rooted = F.coalesce(*[F.when(F.col("format") == f, F.regexp_like(xml, F.lit(rf"(?i)<(?:[\w.-]+:)?{r}[\s>]"))) for f, r in ROOTS.items()])
    d = d.withColumn("error", F.when(F.col("format") == "unsupported", "unsupported").when(F.col("format").isin(*ROOTS), F.when(broken, "invalid").when(~rooted, "unsupported")))
    archives = unpacked_kmz(d.filter("format = 'kmz'")).select("path", F.col("error").alias("kmz_error"))
    d = d.select("path", "error").join(archives, "path", "left").join(points.groupBy(F.col("doc").alias("path")).agg(F.count("*").alias("n")), "path", "left")
    error = F.coalesce("error", "kmz_error", F.when(F.coalesce("n", F.lit(0)) < 2, "noTrack"))
    return d.select(F.col("path").alias("doc"), error.alias("error")).filter("error is not null")


def concat_segments(segments: DataFrame) -> DataFrame:
    """Points of (doc, part, place, ...) numbered through: parts one after another."""
    return segments.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("part", "place")) - 1)
