"""The registered queries: every operator over tracks, sectors and files derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewright.functions import geo, text
from pacewright.operators import dual, elevation, export, landmarks, lookup, sector, splits, track, zones
from pacewright.plans import fixtures
from pacewright.sources import activity
from pacewright.sources.layout import laid_by_track, sized, write_by_track
from pacewright.sources.scratch import own_folder
from pacewright.streaming import live


def r(c: Column | str, digits: int = 3) -> Column:
    """Rounded for comparison between engines, exact halves upwards; never minus zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + 1e-7, digits) + F.lit(0.0)


def places(column: str, digits: int) -> int:
    """Times in milliseconds are too large for decimals."""
    return 0 if column.endswith("_ms") or column in ("t0", "t1") else digits


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.select(*[r(c, places(c, digits)).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


class Base:
    """The tables that queries share, each made where a query asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def points(self) -> DataFrame:
        sized(self.spark, fixtures.point_count(self.spark, self.sf_dir))
        return track.cum_distance(fixtures.track_points(self.spark, self.sf_dir), 6)

    @cached_property
    def next(self) -> DataFrame:
        return track.with_next(self.points)

    @cached_property
    def tracks(self) -> DataFrame:
        return track.track_summary(self.points)

    @cached_property
    def sectors(self) -> DataFrame:
        """Kilometres, two parts by share, and a short one, of each track."""
        parts = [(1001, 0.10, 0.37), (1002, 0.37, 0.81), (1003, 0.50, 0.502)]
        more = [F.struct(F.lit(k).alias("sector_id"), (F.col("total_distance") * a).alias("start_m"), (F.col("total_distance") * b).alias("end_m")) for k, a, b in parts]
        return self.tracks.select("track_id", F.inline(F.concat(sector.length_sectors(1000.0, "fold"), F.array(*more))))

    def lay(self) -> Base:
        """From here on points are read from a table laid out by track."""
        self.points = laid_by_track(self.points, "points", dealt=True)
        return self

    @cached_property
    def walk(self) -> DataFrame:
        self.lay()
        return sector.sector_walk(self.points, self.sectors)

    @cached_property
    def stored_walk(self) -> DataFrame:
        return sector.laid_walk(self.walk)

    @cached_property
    def zoned_walk(self) -> DataFrame:
        self.lay()
        return sector.sector_walk(zones.classify_hr_zone(self.points, self.zones), self.sectors)

    @cached_property
    def requests(self) -> DataFrame:
        return self.tracks.select("track_id", F.inline(F.expr("transform(array(-1D, 0D, 0.123D, 0.5D, 0.777D, 1D, 2D), (f, k) -> named_struct('k', k, 'd', f * total_distance))")))

    @cached_property
    def waypoints(self) -> DataFrame:
        return fixtures.waypoints(self.points)

    @cached_property
    def resolved(self) -> DataFrame:
        return lookup.resolve_waypoints(self.waypoints, self.points)

    @cached_property
    def zones(self) -> DataFrame:
        return fixtures.zones(self.spark, self.sf_dir)

    @cached_property
    def gaps(self) -> DataFrame:
        """Points whose elevation is missing in runs, at both ends too."""
        return self.points.withColumn("ele", F.expr("if(seq < 3 or seq % 41 in (7, 8, 9) or seq > 520, null, ele)"))

    @cached_property
    def samples(self) -> DataFrame:
        return dual.analysis_samples(self.stored_walk)

    @cached_property
    def pairs(self) -> DataFrame:
        return dual.extract_pair(self.samples, "hr", "speed")

    @cached_property
    def terrain(self) -> DataFrame:
        return lookup.write_terrain(fixtures.terrain(self.points), self.folder("terrain"))

    @cached_property
    def dem(self) -> DataFrame:
        return lookup.dem_sample(self.points.withColumn("ele", F.expr("if(seq % 5 = 0, null, ele)")), self.terrain)

    @cached_property
    def elements(self) -> DataFrame:
        """Tagged map elements, one of each point; places repeat, and elevations are written in many ways."""
        kinds = "element_at(array('cave_entrance', 'spring', 'tree', 'rock', 'stone', 'peak'), cast(seq % 6 + 1 as int))"
        d = self.points.selectExpr("track_id as response_id", "seq as pos", "if(seq % 70 = 0, 'way', 'node') as type", "45 + (seq % 40) / 1000 as lat", "7 + track_id % 7 / 1000 as lon", f"{kinds} as natural", "seq", "cast(round(ele) as int) e")
        own = "case seq % 20 when 0 then concat(e, ' m') when 1 then concat(e, 'Metres') when 3 then concat('+', e, '.5 foot ') when 6 then concat('.', e, ' ft') when 7 then concat(e, ',5') when 9 then concat(e, ' miles') when 11 then '' when 13 then cast(e as string) end"
        feet = "case seq % 40 when 10 then cast(3 * e as string) when 30 then concat(e, ' ft') when 13 then '7' end"
        tags = f"map_filter(map('natural', natural, 'waterway', if(seq % 110 = 0, 'waterfall', null), 'name', if(seq % 30 = 0, '', concat('Hill ', seq)), 'name:en', if(seq % 50 = 0, concat('HILL ', seq), null), 'ele', {own}, 'ele:ft', {feet}, 'ele_ft', if(seq % 5 = 0, cast(2 * e as string), null)), (k, v) -> v is not null)"
        return d.withColumn("tags", F.expr(tags)).select("response_id", "pos", "type", "lat", "lon", "tags")

    @cached_property
    def responses(self) -> DataFrame:
        """The elements as JSON texts, one of each track."""
        each = F.struct("pos", F.struct("type", "lat", "lon", "tags").alias("e"))
        return self.elements.groupBy("response_id").agg(F.array_sort(F.collect_list(each), lambda a, b: a["pos"] - b["pos"]).alias("es")).select("response_id", F.to_json(F.struct(F.col("es.e").alias("elements"))).alias("json"))

    @cached_property
    def features(self) -> DataFrame:
        """Tile features, one of each point: peaks, saddles, volcanoes and cliffs; overlapping tiles repeat some."""
        kinds = "element_at(array('peak', 'saddle', 'volcano', 'cliff'), cast(seq % 4 + 1 as int))"
        return self.points.selectExpr("track_id * 10000 + seq as pos", f"{kinds} as class", "if(seq % 90 = 0, 'LineString', 'Point') as geometry", "45 + (seq % 300) / 1000 as lat", "7 + track_id % 7 / 1000 as lon", "cast(if(seq % 7 = 6, null, seq % 7) as int) as rank", "map('name', concat('Top ', seq % 300), 'ele', cast(seq as string)) as tags")

    @cached_property
    def marks(self) -> DataFrame:
        return landmarks.scan_landmarks(self.elements)

    @cached_property
    def shown(self) -> DataFrame:
        """Landmarks of both sources, each once."""
        poi = landmarks.dedup_landmarks(self.marks.withColumn("pos", F.col("response_id") * 10000 + F.col("pos")))
        columns = ["key", "class", "lat", "lon", "tags"]
        return poi.select(*columns, F.lit(5).alias("rank")).unionByName(landmarks.scan_tile_peaks(self.features).select(*columns, "rank"))

    @cached_property
    def series(self) -> DataFrame:
        """Points with clean speed, grade-adjusted speed and grade reading."""
        grades = track.grade_reading(track.grade_series(self.points)).select("track_id", "seq", "reading")
        return track.gap_speed_series(track.speed_series(self.next)).join(grades, ["track_id", "seq"])

    @cached_property
    def device(self) -> DataFrame:
        """Decoded device records: the walking speed and step length fix the cadence convention of each track."""
        step = "cast(if(track_id % 3 = 0, 500, if(track_id % 3 = 1, 1000, 2000)) as double)"
        return self.points.selectExpr("cast(track_id as string) doc", "track_id", "seq", "if(seq % 29 = 3, null, lat) position_lat", "lon position_long", "if(seq % 4 = 1, null, ele) altitude", "if(seq % 8 = 1, null, ele) enhanced_altitude", "time_ms timestamp", "hr heart_rate", "cad cadence", "power", "temp temperature", "speed", "cast(1.25 + seq % 3 * 0.1 as double) enhanced_speed", f"{step} step_length")

    @cached_property
    def whole(self) -> DataFrame:
        return self.tracks.select("track_id", F.lit(0).alias("sector_id"), F.lit(0.0).alias("start_m"), F.col("total_distance").alias("end_m"))

    def folder(self, name: str) -> str:
        return own_folder(self.spark, name)

    def lines(self, documents: DataFrame, name: str, packed: bool = True) -> str:
        """The folder of documents (key, text), one file each, compressed if ``packed``: a document is one row, whichever task has it."""
        path = self.folder(name)
        documents.toDF("file_key", "value").write.partitionBy("file_key").option("compression", "gzip" if packed else "none").text(path)
        return path

    def files(self, documents: DataFrame) -> DataFrame:
        """(path, content) of documents (doc, x)."""
        return documents.select(F.concat("doc", F.lit("")).alias("path"), F.col("x").cast("binary").alias("content"))

    @cached_property
    def readings(self) -> DataFrame:
        """The events replayed as a stream of readings from a folder of files: devices are users."""
        events, path = self.spark.read.parquet(f"{self.sf_dir}/events.parquet"), self.folder("events")
        events.write.parquet(path)
        stream = self.spark.readStream.schema(events.schema).parquet(path)
        return stream.selectExpr("user_id as track_id", "cast(ts as timestamp) ts", "value as x", "value % 50 as ele", "90 + value % 100 as hr")


def _joined(*parts: str) -> Column:
    """Text of literal parts and of columns (in braces)."""
    return F.concat(*[F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if p.startswith("{") else F.lit(p) for p in parts])


def _tagged(tag: str, column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"<{tag}>"), F.col(column).cast("string"), F.lit(f"</{tag}>"))).otherwise("")


def _documents(points: DataFrame, point: Column, head: str, tail: str) -> DataFrame:
    body = F.array_join(F.array_sort(F.collect_list(F.struct("seq", point.alias("x"))))["x"], "")
    # by the key that points lie by, so that texts are made where the points are
    return points.groupBy("track_id").agg(body.alias("b")).withColumn("doc", F.col("track_id").cast("string")).select("doc", F.concat(F.lit(head.split("{doc}")[0]), "doc", F.lit(head.split("{doc}")[1]), "b", F.lit(tail)).alias("x"))


def tcx_documents(points: DataFrame) -> DataFrame:
    d = points.withColumn("iso", export.iso_time(F.col("time_ms")))
    place = F.when(F.col("seq") % 31 == 4, F.lit("")).otherwise(_joined("<Position><LatitudeDegrees>", "{lat}", "</LatitudeDegrees><LongitudeDegrees>", "{lon}", "</LongitudeDegrees></Position>"))
    hr = F.when(F.col("hr").isNotNull(), _joined("<HeartRateBpm><Value>", "{hr}", "</Value></HeartRateBpm>")).otherwise("")
    more = F.concat(F.lit("<Extensions><ns3:TPX>"), _tagged("ns3:Speed", "speed"), _tagged("ns3:Watts", "power"), F.lit("</ns3:TPX></Extensions>"))
    point = F.concat(F.lit("<Trackpoint>"), _tagged("Time", "iso"), place, F.when(F.col("seq") % 7 != 3, _tagged("AltitudeMeters", "ele")).otherwise(""), hr, _tagged("Cadence", "cad"), more, F.lit("</Trackpoint>"))
    head = '<TrainingCenterDatabase xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2" xmlns:ns3="http://www.garmin.com/xmlschemas/ActivityExtension/v2"><Activities><Activity Sport="Running"><Id>{doc}</Id><Lap><Track>'
    return _documents(d, point, head, "</Track></Lap></Activity></Activities></TrainingCenterDatabase>")


def kml_documents(points: DataFrame) -> DataFrame:
    head = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{doc}</name><Placemark><name> Summit </name><description><![CDATA[<b>high</b>]]></description><Point><coordinates>7.5,45.5,1000</coordinates></Point></Placemark><Placemark><description>&lt;i&gt;a  place&lt;/i&gt;</description><Point><coordinates>7.25,45.25</coordinates></Point></Placemark><Folder><Folder><Placemark><MultiGeometry><LineString><coordinates>'
    return _documents(points, _joined("{lon}", ",", "{lat}", ",", "{ele}", " "), head, "</coordinates></LineString></MultiGeometry></Placemark></Folder></Folder></Document></kml>")


def route_documents(points: DataFrame) -> DataFrame:
    head = '<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>{doc}</name></metadata><wpt lat="45.5" lon="7.5"><ele>900</ele><name> Hut </name></wpt><wpt lat="x" lon="7.5"><name>bad</name></wpt><wpt lat="45.6" lon="7.6"><name> </name></wpt><rte>'
    return _documents(points, F.concat(_joined('<rtept lat="', "{lat}", '" lon="', "{lon}", '">'), _tagged("ele", "ele"), F.lit("</rtept>")), head, "</rte></gpx>")


def zipped(documents: DataFrame, name: str = "doc.kml") -> DataFrame:
    """(path, content): each document (doc, x) as one file in an archive."""
    import pandas as pd

    def packed(batches):
        import io
        import zipfile

        for batch in batches:
            rows = []
            for doc, x in zip(batch["doc"], batch["x"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(name, x)
                rows.append((f"{doc}.kmz", out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return documents.mapInPandas(packed, "path string, content binary")


def formatted(points: DataFrame, imperial: bool) -> DataFrame:
    """Every kind of value as text; values lie off the halves, where engines round apart."""
    m, i = F.col, imperial
    whole = lambda c: F.floor(c) + 0.26
    return points.select(
        "track_id",
        "seq",
        text.format_distance(whole("cum_dist"), i).alias("distance"),
        text.format_distance(whole("cum_dist") * 40, i).alias("far"),
        text.format_elevation(whole("ele"), i).alias("elevation"),
        text.format_signed_elevation(whole(m("ele")) - 1000, i).alias("signed"),
        text.format_speed(m("seq") / 32.0 + 0.013, i).alias("speed"),
        text.format_pace(F.floor("cad") * 5.0 + 0.26, i).alias("pace"),
        text.format_vam(m("cad") * 11 + 0.26, i).alias("vam"),
        text.format_temp(m("temp") + 0.26, i).alias("temp"),
        text.format_grade((m("seq") - 300) / 1000.0 + 0.00013).alias("grade"),
        text.format_bpm(m("hr")).alias("bpm"),
        text.format_power(m("power")).alias("power"),
        text.format_cadence(m("cad"), m("track_id") % 2 + 1).alias("cadence"),
    )


def _scalars(b: Base) -> dict[str, Callable[[], DataFrame]]:
    n = b.next
    seg = n.filter("dd is not null")
    m = F.col
    hr_rows = lambda: b.tracks.selectExpr("track_id", "case track_id % 3 when 0 then 'max' when 1 then 'hrr' else 'lthr' end mode", "cast(190 + track_id % 90 as int) max_hr", "cast(40 + track_id % 20 as int) rest_hr", "cast(165 + track_id % 40 as int) lthr", "transform(array(95, 114, 133, 152, 171), x -> if(track_id % 11 = 5, 114, x)) max_bounds", "array(125, 138, 151, 164, if(track_id % 13 = 3, 261, 177)) hrr_bounds", "if(track_id % 17 = 4, array(102, 119, 136), array(102, 119, 136, 153)) lthr_bounds")
    return {
        "haversine": lambda: seg.select("track_id", "seq", (geo.haversine(m("lat"), m("lon"), m("lat") + 0.01, m("lon") - 0.02)).alias("d")),
        "segment_3d": lambda: seg.select("track_id", "seq", (geo.segment_3d(m("dd"), m("dz"))).alias("d3")),
        "minetti_factor": lambda: seg.filter("dd > 0").select("track_id", "seq", (geo.minetti_factor(m("dz") / m("dd"))).alias("factor")),
        "speed_to_pace": lambda: b.points.select("track_id", "seq", (geo.speed_to_pace(m("speed"))).alias("pace")),
        "speed_implausible": lambda: n.select("track_id", "seq", geo.speed_implausible(m("speed"), m("dd"), m("dt")).alias("implausible")),
        "unit_convert": lambda: b.points.select("track_id", "seq", (text.to_feet(m("ele"))).alias("feet"), (text.to_miles(m("cum_dist"))).alias("miles"), (text.to_kmh(m("speed"))).alias("kmh"), (text.to_mph(m("speed"))).alias("mph"), (text.to_pace_per_mile(geo.speed_to_pace(m("speed")))).alias("pace_mile"), (text.to_fahrenheit(m("temp"))).alias("fahrenheit")),
        "format_metric": lambda: formatted(b.points, False),
        "format_imperial": lambda: formatted(b.points, True),
        "format_duration": lambda: b.points.select("track_id", "seq", text.format_duration((m("time_ms") - 1704067200000) / 1000 * 3 + 0.25).alias("duration")),
        "format_sector_range": lambda: b.sectors.select("track_id", m("sector_id").cast("long").alias("sector_id"), *[text.format_sector_range(F.floor("start_m") + 0.26, F.floor("end_m") + 0.26, i).alias(n) for n, i in (("range", False), ("imperial", True))]),
        "format_bpm_range": lambda: b.points.select("track_id", "seq", text.format_bpm_range(m("hr"), F.when(m("seq") % 3 > 0, m("hr") + 9)).alias("range"), text.format_percent(m("cad")).alias("percent")),
        "parse_iso_time": lambda: b.points.select("track_id", "seq", text.parse_iso_time(F.when(m("seq") % 9 == 4, "never").otherwise(export.iso_time(m("time_ms")))).alias("ms")),
        "parse_number": lambda: b.points.select("track_id", "seq", text.parse_number(F.when(m("seq") % 9 == 4, " ").when(m("seq") % 9 == 5, "x1").otherwise(F.concat(F.lit(" "), m("ele").cast("string"), F.lit(" ")))).alias("v")),
        "cadence_display": lambda: b.points.select("track_id", "seq", text.cadence_display(m("cad"), m("track_id") % 2 + 1).alias("cad")),
        "tile_fraction": lambda: b.points.select("track_id", "seq", (geo.tile_x(m("lon") + m("seq") * 3)).alias("x"), (geo.tile_y(m("lat") + m("seq") % 50)).alias("y")),
        "terrarium_decode": lambda: b.points.select("track_id", "seq", (geo.terrarium(m("cad") + m("seq") % 150, m("seq") % 256, m("track_id") % 256)).alias("e")),
        "parse_elevation_tag": lambda: b.elements.select("response_id", "pos", landmarks.parse_elevation_tag().alias("metres")),
        "localized_name": lambda: b.elements.select("response_id", "pos", landmarks.localized_name(m("tags")).alias("name")),
        "landmark_label": lambda: b.elements.select("response_id", "pos", landmarks.landmark_label().alias("label")),
        "landmark_gate": lambda: b.shown.withColumns(landmarks.landmark_gate()).select("key", "gate", "icon_zoom", "text_zoom"),
        "zone_bounds": lambda: zones.zone_bounds(zones.active_bounds(hr_rows()).select("track_id", "bounds")),
        "zone_display_range": lambda: zones.zone_display_range(zones.zone_bounds(zones.active_bounds(hr_rows()).select("track_id", "bounds")).withColumn("lo", m("lo") + 0.5)).select("track_id", "zone", "shown_lo", "shown_hi"),
        "zone_boundary_pct": lambda: zones.zone_boundary_pct(zones.zone_bounds(zones.active_bounds(hr_rows()).select("track_id", "mode", "max_hr", "rest_hr", "lthr", "bounds"))).select("track_id", "zone", "pct"),
        "validate_hr_settings": lambda: zones.validate_hr_settings(hr_rows()).select("track_id", "error"),
        "migrate_hr_settings": lambda: zones.migrate_hr_settings(hr_rows().selectExpr("track_id", "mode", "max_hr", "rest_hr", "lthr", "array(50, 60, 70, 80, 90) max_pcts", "array(50, 60, 70, 80, 90) hrr_pcts", "array(60, 70, 80, 90) lthr_pcts")).selectExpr("track_id", "error", "array_join(max_bounds, ',') b_max", "array_join(hrr_bounds, ',') b_hrr", "array_join(lthr_bounds, ',') b_lthr"),
        "normalize_sector": lambda: sector.normalize_sector(b.sectors.selectExpr("track_id", "sector_id", "end_m * 1.3 - 400 start_m", "start_m end_m"), b.tracks).select("track_id", "sector_id", "start_m", "end_m"),
        "is_entire_track": lambda: sector.is_entire_track(b.sectors.unionByName(b.whole.withColumn("sector_id", F.lit(5000)).withColumn("start_m", F.lit(0.25))), b.tracks).select("track_id", "sector_id", "entire"),
        "sector_context_window": lambda: sector.sector_context_window(b.sectors, b.tracks).select("track_id", "sector_id", "win_start", "win_end"),
    }


def _tracks(b: Base) -> dict[str, Callable[[], DataFrame]]:
    m = F.col
    speed = lambda: track.speed_series(b.next)
    grades = lambda: track.grade_series(b.points)
    return {
        "track_points": lambda: b.points.select("track_id", "seq", "lat", "lon", "ele", "time_ms", "hr", "cad", "power", "temp", "speed"),
        "cum_distance": lambda: b.points.select("track_id", "seq", "seg_m", "cum_dist"),
        "track_summary": lambda: b.tracks,
        "fill_ele_gaps": lambda: track.fill_ele_gaps(b.gaps).select("track_id", "seq", "ele"),
        "cadence_convention": lambda: track.cadence_convention(b.device.withColumn("speed", m("enhanced_speed"))),
        "speed_series": lambda: speed().select("track_id", "seq", "raw_speed", "clean_speed"),
        "smooth5": lambda: track.smooth5(b.points, "hr", "hr5").select("track_id", "seq", "hr5"),
        "sigma_repair": lambda: track.sigma_repair(b.next.withColumn("v", F.try_divide("dd", "dt")), "v", "fixed").select("track_id", "seq", "fixed"),
        "sigma_filter": lambda: track.sigma_filter(b.points.withColumn("v", m("power") * m("power")), "v").select("track_id", "seq"),
        "gap_speed_series": lambda: track.gap_speed_series(speed()).select("track_id", "seq", "gap_speed"),
        "grade_series": lambda: grades().select("track_id", "seq", "grade"),
        "grade_reading": lambda: track.grade_reading(grades()).select("track_id", "seq", "reading"),
        "elapsed_axis": lambda: track.elapsed_axis(b.points).select("track_id", "seq", "elapsed_ms"),
        "series_extremes": lambda: track.series_extremes(track.gap_speed_series(speed()), ["ele", "hr", "cad", "power", "temp", "clean_speed", "gap_speed"]),
        "series_range": lambda: track.series_range(track.series_extremes(speed(), ["ele", "hr", "cad", "clean_speed"])).select("track_id", "series", "y_min", "y_max"),
        "overlay_availability": lambda: track.overlay_availability(b.tracks),
        "thin_stride": lambda: track.thin_stride(b.points, 100).select("track_id", "seq"),
        "simplify_dp": lambda: track.simplify_dp(b.points.withColumn("lon", m("lon") + F.sin(m("seq") / 9.0) / 4000), most=40),
        "cum_distance_by_blocks": lambda: track.cum_distance_by_blocks(b.points.drop("seg_m", "cum_dist"), 6, 128).select("track_id", "seq", "seg_m", "cum_dist"),
        "concat_segments": lambda: activity.concat_segments(b.points.selectExpr("cast(track_id as string) doc", "3 - seq div 200 part", "seq place", "ele")).select("doc", "part", "place", "seq", "ele"),
        "point_at_distance": lambda: sector.point_at_distance(b.points, b.requests),
        "nearest_on_track": lambda: lookup.nearest_on_track(b.waypoints, b.points).select("track_id", "wp_seq", "dist", "off_track"),
        "resolve_waypoints": lambda: b.resolved.select("track_id", "wp_seq", "name", "dist"),
        "dem_sample": lambda: b.dem.select("track_id", "seq", "dem_ele"),
        "dem_tiles_needed": lambda: lookup.dem_tiles_needed(b.points),
        "probe_reading": lambda: lookup.probe_reading(b.series, b.requests, b.zones).select("track_id", "k", "ele", "hr", "zone", "cad", "power", "temp", "speed", "pace", "gap", "grade"),
        "bridge_interpolate": lambda: lookup.bridge_interpolate(b.points, b.requests.filter("d >= 0")).select("track_id", "k", "hr"),
        "dist_to_time": lambda: lookup.dist_to_time(b.points, b.requests).select("track_id", "k", "time_ms"),
        "time_to_dist": lambda: lookup.time_to_dist(b.points, b.requests.withColumn("ms", m("d") * 300 + 1704067200000)).select("track_id", "k", "dist_m"),
        "classify_hr_zone": lambda: zones.classify_hr_zone(b.points, b.zones).select("track_id", "seq", "zone"),
        "pair_filter": lambda: dual.pair_filter(b.points.selectExpr("track_id", "seq", "element_at(array('hr','power','cad','temp','grade','ele','speed','pace','gap'), cast(seq div 9 % 9 + 1 as int)) x_name", "element_at(array('hr','power','cad','temp','grade','ele','speed','pace','gap'), cast(seq % 9 + 1 as int)) y_name")).select("track_id", "seq", "x_name", "y_name"),
    }


def _sectors(b: Base) -> dict[str, Callable[[], DataFrame]]:
    m = F.col
    shared = [c for c in ("track_id", "sector_id")]
    metrics = lambda: sector.walk_metrics(b.stored_walk)
    spans = lambda: sector.pause_spans(b.stored_walk)

    def segments() -> DataFrame:
        b.lay()
        parts = splits.split_by_waypoint(b.resolved, b.tracks)
        walk = sector.laid_walk(sector.sector_walk(zones.classify_hr_zone(b.points, b.zones), parts))
        return sector.walk_metrics(walk).join(zones.hr_zone_time(walk).drop("moving_s", "counted_s"), shared, "left")

    return {
        "sector_walk": lambda: b.walk.filter("step > 0").select(*shared, "step", "to_dist", "to_ele", "to_ms", "seg_h", "d_ele", "dt"),
        "pause_spans": lambda: sector.pause_spans(b.walk),
        "pause_mask": lambda: b.walk.filter("kind = 'point'").select(*shared, "vseq", "paused"),
        "pause_overlap": lambda: lookup.pause_overlap(b.stored_walk.filter("kind <> 'end'").select(*shared, "vseq", F.when(m("kind") == "point", m("to_ms")).otherwise(-1.0).alias("ms")), spans()).select(*shared, "vseq"),
        "sector_distance": lambda: sector.sector_distance(b.walk),
        "sector_gain_loss": lambda: sector.sector_gain_loss(b.walk),
        "sector_elevation": lambda: sector.sector_elevation(b.walk),
        "sector_grades": lambda: sector.sector_grades(b.walk),
        "moving_time": lambda: sector.moving_time(b.walk),
        "avg_speed": lambda: sector.avg_speed(b.walk),
        "avg_gap": lambda: sector.avg_gap(b.walk),
        "max_speed": lambda: sector.max_speed(b.walk),
        "vertical_rates": lambda: sector.vertical_rates(b.walk),
        "fitness_stats": lambda: sector.fitness_stats(b.walk),
        "temp_stats": lambda: sector.temp_stats(b.walk),
        "fastest_slowest_km": lambda: sector.fastest_slowest_km(b.walk),
        "effort_distance": lambda: sector.effort_distance(b.walk),
        "segment_type": lambda: sector.sector_kind(b.walk),
        "sector_metrics": metrics,
        "track_stats": lambda: sector.track_stats(b.lay().points, b.tracks),
        "sector_leaderboard": lambda: sector.sector_leaderboard(metrics()),
        "hr_zone_time": lambda: zones.hr_zone_time(b.zoned_walk).drop("counted_s"),
        "zone_share_pct": lambda: zones.zone_share_pct(zones.hr_zone_time(b.zoned_walk)).select(*shared, *[f"z{k}_pct" for k in range(1, 6)]),
        "split_by_length": lambda: sector.split_by_length(b.tracks),
        "split_by_length_drop": lambda: sector.split_by_length(b.tracks, tail="drop"),
        "split_by_length_fold": lambda: sector.split_by_length(b.tracks, tail="fold"),
        "sector_totals": lambda: sector.sector_totals(metrics(), "segment_type"),
        "split_by_waypoint": lambda: splits.split_by_waypoint(b.resolved, b.tracks),
        "grade_class": lambda: splits.grade_class(b.points).select("track_id", "seq", "cls"),
        "grade_runs": lambda: splits.grade_runs(splits.grade_class(b.points)),
        "split_by_grade": lambda: splits.split_by_grade(splits.grade_class(b.points)),
        "segment_table": segments,
        "sector_grade_windows": lambda: dual.sector_grade_windows(b.walk),
        "analysis_samples": lambda: b.samples,
        "metric_availability": lambda: dual.metric_availability(b.samples),
        "extract_pair": lambda: b.pairs,
        "robust_domain": lambda: dual.robust_domain(b.pairs),
        "density_2d": lambda: dual.density_2d(b.pairs),
        "relative_density": lambda: dual.relative_density(dual.density_2d(b.pairs)),
    }


def _elevation(b: Base) -> dict[str, Callable[[], DataFrame]]:
    def near() -> DataFrame:
        points = b.lay().points
        marks = b.marks.select(F.col("response_id").alias("track_id"), F.col("pos").alias("wp_seq"), "class", "lat", "lon")
        return lookup.nearest_on_track(marks, points, 250.0).select("track_id", "wp_seq", "class", "dist", "off_track")

    return {
        "ele_fill": lambda: elevation.ele_fill(b.dem).select("track_id", "seq", "ele", "ele_original"),
        "ele_replace": lambda: elevation.ele_replace(b.dem).select("track_id", "seq", "ele", "ele_original"),
        "ele_restore": lambda: elevation.ele_restore(elevation.ele_replace(elevation.ele_fill(b.dem))).select("track_id", "seq", "ele"),
        "ele_apply": lambda: elevation.ele_apply(b.dem),
        "scan_landmarks": lambda: landmarks.scan_landmarks(landmarks.parse_elements(b.responses)).select("response_id", "pos", "class", "lat", "lon"),
        "scan_tile_peaks": lambda: landmarks.scan_tile_peaks(b.features).select("key", "pos", "class", "rank"),
        "dedup_landmarks": lambda: landmarks.dedup_landmarks(b.marks.withColumn("pos", F.col("response_id") * 10000 + F.col("pos"))).select("key", "pos"),
        "merge_landmarks": lambda: landmarks.merge_landmarks(*[landmarks.dedup_landmarks(b.marks.withColumn("pos", F.col("response_id") * 10000 + F.col("pos")).filter(f"response_id % 2 = {k}")).select("key", "class", "pos") for k in (0, 1)]),
        "landmark_features": lambda: landmarks.landmark_features(b.shown),
        "landmarks_near_track": near,
    }


def _files(b: Base) -> dict[str, Callable[[], DataFrame]]:
    scan = ["doc", "seq", *activity.POINT]
    gpx = lambda: export.sector_gpx(b.points, b.whole)
    own = lambda d: d.withColumn("doc", F.regexp_extract("doc", "file_key=([0-9]+)", 1))

    def long() -> DataFrame:
        b.lay()
        walk = sector.laid_walk(sector.sector_walk(zones.classify_hr_zone(b.points, b.zones), b.whole))
        return export.metrics_long(sector.walk_metrics(walk), zones.hr_zone_time(walk), b.zones, b.tracks)


    def mixed_files() -> DataFrame:
        x = F.expr("case seq % 6 when 0 then '<?xml?><GPX>' when 1 then 'PKzip' when 2 then '<kml>' when 3 then '<TrainingCenterDatabase>' when 4 then '12345678.FIT' else 'what' end")
        return b.points.select(F.concat(F.lit("f"), "track_id", F.lit("-"), "seq", F.when(F.col("seq") % 60 >= 30, ".TCX").otherwise("")).alias("path"), x.cast("binary").alias("content"))

    def csv() -> DataFrame:
        path = b.folder("csv")
        export.write_metrics_csv(long(), path)
        return export.read_metrics_csv(b.spark, path)

    def texts(documents: DataFrame, column: str, files: bool = False, dealt: bool = False) -> DataFrame:
        path = b.folder(column)
        export.write_texts(documents, column, path, files, dealt)
        return export.read_texts(b.spark, path, files).withColumnRenamed("value", column)

    def parquet() -> DataFrame:
        path = b.folder("table")
        return write_by_track(b.tracks.select("track_id", "point_count", "total_distance"), path.rsplit("/", 1)[1].replace("-", "_"), path, 8)

    def errors() -> DataFrame:
        """Files of six kinds: whole, unsupported, broken XML, one point, an archive without KML, a broken archive."""
        point = _joined('<trkpt lat="', "{lat}", '" lon="', "{lon}", '"/>')
        d = _documents(b.points.filter("track_id % 6 <> 3 or seq = 0"), point, '<gpx version="1.1"><metadata><name>{doc}</name></metadata><trk><trkseg>', "</trkseg></trk></gpx>")
        kind = F.col("doc").cast("int") % 6
        d = d.withColumn("x", F.when(kind == 1, "what").when(kind == 2, F.replace("x", F.lit("</trk>"), F.lit(""))).otherwise(F.col("x")))
        path = b.lines(d.filter(kind < 4), "mixed", packed=False)
        files = b.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
        archives = zipped(d.filter(kind == 4), "readme.txt").unionByName(d.filter(kind == 5).select(F.concat("doc", F.lit(".kmz")).alias("path"), F.lit("PK no archive").cast("binary").alias("content")))
        archives = archives.withColumn("path", F.concat(F.lit("file_key="), "path"))
        return own(activity.ingest_errors(files.unionByName(archives), activity.scan_gpx(b.spark, path)))

    stream = lambda f: live.run_available(f(b.readings), b.folder("stream"))
    return {
        "scan_detect_format": lambda: activity.detect_format(mixed_files()).select("path", "format"),
        "scan_gpx": lambda: own(activity.scan_gpx(b.spark, b.lines(gpx().select("track_id", "gpx"), "gpx"))).select(*scan),
        "scan_gpx_route": lambda: own(activity.scan_gpx_route(b.spark, b.lines(route_documents(b.points), "gpx"))).select("doc", "seq", "lat", "lon", "ele"),
        "scan_gpx_waypoints": lambda: own(activity.scan_gpx_waypoints(b.spark, b.lines(route_documents(b.points), "gpx"))).select("doc", "wp_seq", "lat", "lon", "ele", "name"),
        "scan_tcx": lambda: own(activity.scan_tcx(b.spark, b.lines(tcx_documents(b.points), "tcx"))).select(*scan),
        "scan_kml": lambda: own(activity.scan_kml(b.spark, b.lines(kml_documents(b.points), "kml"))).select("doc", "seq", "lat", "lon", "ele"),
        "scan_kml_waypoints": lambda: own(activity.scan_kml_waypoints(b.spark, b.lines(kml_documents(b.points), "kml"))),
        "scan_kmz": lambda: activity.scan_kmz(zipped(kml_documents(b.points))).select(F.replace("doc", F.lit(".kmz"), F.lit("")).alias("doc"), "seq", "lat", "lon", "ele"),
        "scan_device_records": lambda: activity.scan_device_records(b.device).select("doc", "seq", "lat", "lon", "ele", "hr", "cad", "speed"),
        "ingest_errors": errors,
        "sink_sector_gpx": lambda: texts(export.sector_gpx(b.lay().points, b.sectors), "gpx", dealt=True),
        "sink_metrics_long": long,
        "sink_metrics_csv": csv,
        "sink_metrics_txt": lambda: texts(export.metrics_text(long()), "text", files=True),
        "sink_metrics_md": lambda: texts(export.metrics_markdown(long()), "text"),
        "sink_parquet": parquet,
        "stream_pauses": lambda: stream(lambda s: live.stream_pauses(s, "1 day")),
        "stream_gain": lambda: live.gain_totals(stream(live.stream_gain)),
        "stream_zone_time": lambda: live.zone_totals(stream(lambda s: live.stream_zone_time(s, fixtures.ZONE_BOUNDS, "1 hour"))).select("track_id", F.unix_micros("start").alias("start_us"), "zone", "seconds", "readings"),
    }


#: The names of each group's queries; they are known without a session.
NAMES = {
    "_scalars": """
        haversine segment_3d minetti_factor speed_to_pace speed_implausible unit_convert
        format_metric format_imperial format_duration format_sector_range format_bpm_range parse_iso_time parse_number
        cadence_display tile_fraction terrarium_decode parse_elevation_tag localized_name landmark_label
        landmark_gate zone_bounds zone_display_range zone_boundary_pct validate_hr_settings migrate_hr_settings
        normalize_sector is_entire_track sector_context_window
    """.split(),
    "_tracks": """
        track_points cum_distance cum_distance_by_blocks track_summary fill_ele_gaps cadence_convention speed_series
        smooth5 sigma_repair sigma_filter gap_speed_series grade_series grade_reading
        elapsed_axis series_extremes series_range overlay_availability thin_stride simplify_dp
        concat_segments point_at_distance nearest_on_track resolve_waypoints dem_sample dem_tiles_needed
        probe_reading bridge_interpolate dist_to_time time_to_dist classify_hr_zone pair_filter
    """.split(),
    "_sectors": """
        sector_walk pause_spans pause_mask pause_overlap sector_distance sector_gain_loss
        sector_elevation sector_grades moving_time avg_speed avg_gap max_speed
        vertical_rates fitness_stats temp_stats fastest_slowest_km effort_distance segment_type
        sector_metrics track_stats sector_leaderboard hr_zone_time zone_share_pct split_by_length
        split_by_length_drop split_by_length_fold sector_totals split_by_waypoint grade_class grade_runs split_by_grade segment_table
        sector_grade_windows analysis_samples metric_availability extract_pair robust_domain density_2d
        relative_density
    """.split(),
    "_elevation": """
        ele_fill ele_replace ele_restore ele_apply scan_landmarks scan_tile_peaks dedup_landmarks
        merge_landmarks landmark_features landmarks_near_track
    """.split(),
    "_files": """
        scan_detect_format scan_gpx scan_gpx_route scan_gpx_waypoints scan_tcx scan_kml
        scan_kml_waypoints scan_kmz scan_device_records ingest_errors sink_sector_gpx sink_metrics_long
        sink_metrics_csv sink_metrics_txt sink_metrics_md sink_parquet stream_pauses stream_gain
        stream_zone_time
    """.split(),
}


#: Decimals compared where it is not three: terrain is steep against the rounding of pixel places.
DIGITS = {name: 1 for name in ("dem_sample", "ele_fill", "ele_replace", "ele_restore", "ele_apply", "landmarks_near_track")}


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    b = Base(spark, sf_dir)
    for group in (_scalars, _tracks, _sectors, _elevation, _files):
        if name in NAMES[group.__name__]:
            return rounded(group(b)[name](), DIGITS.get(name, 3))
    raise KeyError(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, name=name: build(spark, sf_dir, name) for names in NAMES.values() for name in names}
