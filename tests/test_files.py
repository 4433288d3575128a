"""Activity files as they come: nested sensors, folders in folders, files of one title, broken files and archives."""

import io
import zipfile

from pacewright.sources import activity

GPX = '<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1" xmlns:tpx="t" xmlns:px="p" xmlns:ns3="n"><metadata><name>Morning Run</name></metadata>{}</gpx>'
SENSORS = '<trkpt lat="1.5" lon="2"><ele>{ele}</ele><time>2024-01-01T00:00:01Z</time><speed>2</speed><extensions><tpx:TrackPointExtension><tpx:hr>120</tpx:hr><x><tpx:cad>80</tpx:cad></x><tpx:atemp>21.5</tpx:atemp></tpx:TrackPointExtension><px:PowerExtension><px:PowerInWatts>200</px:PowerInWatts></px:PowerExtension><ns3:speed>3</ns3:speed></extensions></trkpt>'


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def test_gpx(spark, tmp_path):
    track = "<trk><trkseg>" + SENSORS.format(ele="10") + '<trkpt lat="x" lon="2"/><trkpt lat="1.6" lon="2"><ele/></trkpt></trkseg><trkseg><trkpt lat="1.7" lon="2"/></trkseg></trk>'
    power = '<trk><trkseg><trkpt lat="3" lon="4"><extensions><power>150</power><ns3:Watts>9</ns3:Watts></extensions></trkpt><trkpt lat="3" lon="4"><extensions><ns3:Watts>170</ns3:Watts></extensions></trkpt></trkseg></trk>'
    route = '<wpt lat="1" lon="2"><name> Hut </name></wpt><rte><rtept lat="5" lon="6"/><rtept lat="5.1" lon="6"/></rte>'
    folder = put(tmp_path, a__1_dot_gpx=GPX.format(track), b__1_dot_gpx=GPX.format(power), b__2_dot_gpx=GPX.format(route))
    files = f"{folder}/*/*.gpx"
    rows = activity.scan_gpx(spark, files).orderBy("doc", "seq").collect()
    assert [(r["doc"].split("/")[-2], r["seq"], r["lat"]) for r in rows] == [("a", 0, 1.5), ("a", 1, 1.6), ("a", 2, 1.7), ("b", 0, 3.0), ("b", 1, 3.0)]
    first = rows[0]
    assert (first["hr"], first["cad"], first["temp"], first["power"], first["speed"], first["ele"], first["time_ms"]) == (120, 80, 21.5, 200, 3, 10, 1704067201000)
    assert rows[1]["ele"] is None and [r["power"] for r in rows[3:]] == [150, 170]
    assert {(r["doc"].split("/")[-2], r["title"]) for r in activity.document_titles(spark, files, "gpx").collect()} == {("a", "Morning Run"), ("b", "Morning Run")}
    assert [(r["doc"][-7:], r["lat"]) for r in activity.scan_gpx_route(spark, files).orderBy("seq").collect()] == [("b/2.gpx", 5.0), ("b/2.gpx", 5.1)]
    assert [(r["wp_seq"], r["name"]) for r in activity.scan_gpx_waypoints(spark, files).collect()] == [(0, "Hut")]


KML = '<kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="g"><Document><name>D</name><Folder><Folder><Placemark><name>A</name><MultiGeometry><MultiGeometry><LineString><coordinates>1,2,3 4,5\n6,x</coordinates></LineString></MultiGeometry><Point><coordinates>9,8</coordinates></Point></MultiGeometry></Placemark></Folder></Folder><Placemark><description><![CDATA[<b>a</b> <i>place</i>]]></description><Point><coordinates> 7,6,5 1,1 </coordinates></Point></Placemark><Placemark><gx:MultiTrack><gx:Track><when>2024-01-01T00:00:00Z</when><when>2024-01-01T00:00:01Z</when><gx:coord>1 2 3</gx:coord><gx:coord>1 3</gx:coord></gx:Track></gx:MultiTrack></Placemark></Document></kml>'
WANT = [(2.0, 1.0, 3.0, None), (5.0, 4.0, None, None), (2.0, 1.0, 3.0, 1704067200000), (3.0, 1.0, None, 1704067201000)]


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name.replace("_dot_", "."), text)
    return out.getvalue()


def test_kml_and_kmz(spark, tmp_path):
    path = put(tmp_path, a_dot_kml=KML)
    places = lambda d: [(r["lat"], r["lon"], r["ele"], r["time_ms"]) for r in d.orderBy("seq").collect()]
    assert places(activity.scan_kml(spark, path)) == WANT
    assert [(r["wp_seq"], r["lat"], r["lon"], r["ele"], r["name"]) for r in activity.scan_kml_waypoints(spark, path).orderBy("wp_seq").collect()] == [(0, 8.0, 9.0, None, "A"), (1, 6.0, 7.0, 5.0, "a place")]
    files = spark.createDataFrame([("x.kmz", bytearray(archive(other_dot_kml="<kml/>", doc_dot_kml=KML)))], "path string, content binary")
    assert places(activity.scan_kmz(files)) == WANT


def test_broken_files(spark):
    good = GPX.format('<trk><trkseg><trkpt lat="1" lon="2"/><trkpt lat="1" lon="2"/></trkseg></trk>')
    files = {
        "good.gpx": (good.encode(), 2, None),
        "cut.gpx": (good[:-20].encode(), 2, "invalid"),
        "other.gpx": (b"<html/>", 0, "unsupported"),
        "what.txt": (b"hello", 0, "unsupported"),
        "one.gpx": (good.encode(), 1, "noTrack"),
        "none.kmz": (archive(readme_dot_txt="x"), 0, "kmzNoKml"),
        "bad.kmz": (b"PK no archive", 0, "invalid"),
        "empty.gpx": (b"", 0, "invalid"),
    }
    df = spark.createDataFrame([(k, bytearray(c)) for k, (c, _, _) in files.items()], "path string, content binary")
    points = spark.createDataFrame([(k,) for k, (_, n, _) in files.items() for _ in range(n)], "doc string")
    found = {r["doc"]: r["error"] for r in activity.ingest_errors(df, points).collect()}
    assert found == {k: e for k, (_, _, e) in files.items() if e} | {"empty.gpx": found.get("empty.gpx")}
    assert found["empty.gpx"] in ("invalid", "unsupported")
