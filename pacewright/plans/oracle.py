"""DuckDB SQL for the registered queries: one chain of common table expressions, and a last SELECT for each."""

from __future__ import annotations

import re

from pacewright.operators.dual import PARTNERS
from pacewright.operators.export import CATALOGUE, NO_HR, UNAVAILABLE, ZONES
from pacewright.operators.landmarks import GATES, POI_CLASSES, TILE_CLASSES
from pacewright.plans.fixtures import TRACK_POINTS_SQL, ZONE_BOUNDS
from pacewright.plans.queries import DIGITS, places

W = "(PARTITION BY track_id ORDER BY seq)"
RUN = "(PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
WS = "(PARTITION BY track_id, sector_id ORDER BY step)"
RUNS = "(PARTITION BY track_id, sector_id ORDER BY step ROWS UNBOUNDED PRECEDING)"
SEC = "PARTITION BY track_id, sector_id"


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians({c} - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - ({b})) / 2), 2))))"


def minetti(g: str) -> str:
    g = f"greatest(-0.45, least(0.45, {g}))"
    return f"((155.4 * pow({g}, 5) - 30.4 * pow({g}, 4) - 43.3 * pow({g}, 3) + 46.3 * pow({g}, 2) + 19.5 * {g} + 3.6) / 3.6)"


def lerp(a: str, b: str, t: str) -> str:
    return f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE {a} + ({b} - {a}) * {t} END"


def located(requests: str, key: str) -> str:
    """Requests (track_id, key, d) with the point of the track there."""
    return f"""SELECT q.track_id, q.{key}, q.d, n.seq AS i, t,
      CASE WHEN n.next_cum IS NULL THEN n.cum_dist ELSE greatest(q.d, 0) END AS dist,
      CASE WHEN n.next_cum IS NULL THEN n.lat ELSE {lerp('n.lat', 'n.next_lat', 't')} END AS lat,
      CASE WHEN n.next_cum IS NULL THEN n.lon ELSE {lerp('n.lon', 'n.next_lon', 't')} END AS lon,
      CASE WHEN n.next_cum IS NULL THEN n.ele ELSE {lerp('n.ele', 'n.next_ele', 't')} END AS ele,
      CASE WHEN n.next_cum IS NULL THEN CAST(n.time_ms AS DOUBLE) ELSE {lerp('n.time_ms', 'n.next_ms', 't')} END AS time_ms
    FROM {requests} q JOIN pn n ON q.track_id = n.track_id AND ((q.d <= 0 AND n.seq = 0) OR (q.d > 0 AND n.cum_dist <= q.d AND (n.next_cum > q.d OR n.next_cum IS NULL))),
    LATERAL (SELECT CASE WHEN q.d > 0 AND n.next_cum > n.cum_dist THEN least(1.0, (q.d - n.cum_dist) / (n.next_cum - n.cum_dist)) ELSE 0.0 END AS t) l"""


def interpolated(rows: str, keys: str, by: str, value: str) -> str:
    """``fixed``: nulls of value on the line between their neighbours; at the ends the nearest value."""
    back, ahead = f"({keys} ORDER BY {by} ROWS UNBOUNDED PRECEDING)", f"({keys} ORDER BY {by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {value} IS NOT NULL THEN {by} END"
    return f"""SELECT *, CASE WHEN {value} IS NOT NULL THEN {value} WHEN _a IS NULL THEN _b WHEN _b IS NULL THEN _a ELSE _a + (_b - _a) * (({by} - _i) / CAST(_j - _i AS DOUBLE)) END AS fixed
    FROM (SELECT *, last_value({value} IGNORE NULLS) OVER {back} AS _a, last_value({at} IGNORE NULLS) OVER {back} AS _i, first_value({value} IGNORE NULLS) OVER {ahead} AS _b, first_value({at} IGNORE NULLS) OVER {ahead} AS _j FROM {rows})"""


def speeds(rows: str, keys: str, by: str) -> str:
    """``raw_speed`` and ``clean_speed`` of rows with speed, dd, dt and recorded."""
    w = f"({keys} ORDER BY {by})"
    raw = f"""SELECT *, CASE WHEN speed >= 0 AND lead({by}) OVER {w} IS NOT NULL AND dt > 0 AND dd >= 0 AND speed > 1.5 * dd / dt THEN NULL
        WHEN speed >= 0 THEN speed WHEN dt > 0 AND dd >= 0 THEN dd / dt END AS raw_speed FROM {rows}"""
    spread = f"SELECT *, avg(raw_speed) OVER ({keys}) AS mu, stddev_pop(raw_speed) OVER ({keys}) AS sg, count(raw_speed) OVER ({keys}) AS nn, avg(raw_speed) OVER ({keys} ORDER BY {by} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM ({raw})"
    off = f"SELECT *, coalesce(nn >= 3 AND sg > 0 AND abs(raw_speed - mu) > 3 * sg, false) AS isoff FROM ({spread})"
    kept = f"SELECT *, CASE WHEN NOT isoff THEN raw_speed END AS kept FROM ({off})"
    return f"SELECT *, CASE WHEN recorded THEN sm WHEN isoff THEN fixed ELSE raw_speed END AS clean_speed FROM ({interpolated(f'({kept})', keys, by, 'kept')})"


def repaired(rows: str, keys: str, by: str, value: str) -> str:
    """``fixed`` of rows with ``v``: values beyond three standard deviations on the line between their kept neighbours."""
    off = f"SELECT *, coalesce(count({value}) OVER ({keys}) >= 3 AND stddev_pop({value}) OVER ({keys}) > 0 AND abs({value} - avg({value}) OVER ({keys})) > 3 * stddev_pop({value}) OVER ({keys}), false) AS isoff FROM {rows}"
    kept = f"SELECT *, CASE WHEN NOT isoff THEN {value} END AS kept FROM ({off})"
    return f"SELECT * REPLACE (CASE WHEN isoff THEN fixed ELSE {value} END AS fixed) FROM ({interpolated(f'({kept})', keys, by, 'kept')})"


METRE = "(CAST(6371008.8 AS DOUBLE) * 3.141592653589793 / 180)"


def nearest(probes: str) -> str:
    """``dist`` and ``off_track`` of probes (track_id, wp_seq, lat, lon, ...): the nearest vertex, then its better segment."""
    place = lambda c: f"CASE WHEN {c}.cum_dist IS NOT NULL THEN {c} END"

    def onto(a: str, b: str) -> str:
        vx, vy = f"({b}.lon - {a}.lon) * sx", f"({b}.lat - {a}.lat) * {METRE}"
        px, py = f"(qlon - {a}.lon) * sx", f"(qlat - {a}.lat) * {METRE}"
        t = f"CASE WHEN ({vx}) * ({vx}) + ({vy}) * ({vy}) > 0 THEN least(1.0, greatest(0.0, (({px}) * ({vx}) + ({py}) * ({vy})) / (({vx}) * ({vx}) + ({vy}) * ({vy})))) ELSE 0.0 END"
        return f"{{'d2': pow({px} - {t} * {vx}, 2) + pow({py} - {t} * {vy}, 2), 'dist': {a}.d + {t} * ({b}.d - {a}.d), 'lat': {a}.lat + {t} * ({b}.lat - {a}.lat), 'lon': {a}.lon + {t} * ({b}.lon - {a}.lon)}}"

    pair = f"SELECT q.*, s.sx, n.p, n.b, n.a, pow((n.p.lon - q.lon) * s.sx, 2) + pow((n.p.lat - q.lat) * {METRE}, 2) AS d2, n.seq AS vseq FROM {probes} q JOIN scale s USING (track_id) JOIN vert n USING (track_id)"
    best = f"SELECT track_id, wp_seq, any_value(lat) AS qlat, any_value(lon) AS qlon, any_value(sx) AS sx, arg_min({{'p': p, 'b': b, 'a': a}}, (d2, vseq)) AS v FROM ({pair}) GROUP BY 1, 2"
    both = f"SELECT *, CASE WHEN v.b.d IS NOT NULL THEN {onto('v.b', 'v.p')} END AS rb, CASE WHEN v.a.d IS NOT NULL THEN {onto('v.p', 'v.a')} END AS ra FROM ({best})"
    one = f"SELECT *, CASE WHEN rb.d2 IS NOT NULL AND (ra.d2 IS NULL OR rb.d2 <= ra.d2) THEN rb ELSE ra END AS r FROM ({both})"
    return f"SELECT track_id, wp_seq, r.dist AS dist, {hav('qlat', 'qlon', 'r.lat', 'r.lon')} AS off_track FROM ({one})"


def num(v: str, digits: int = 0) -> str:
    """A number with grouped thousands and up to so many decimals."""
    if not digits:
        return f"format('{{:,}}', CAST(round({v}) AS BIGINT))"
    return f"regexp_replace(regexp_replace(format('{{:,.{digits}f}}', round(CAST({v} AS DOUBLE), {digits})), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def clock(v: str) -> str:
    s = f"CAST(round({v}) AS BIGINT)"
    return f"CASE WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) ELSE printf('%d:%02d', {s} // 60, {s} % 60) END"


def shown(kind: str, v: str, imperial: bool = False) -> str:
    """A value as text, by its kind."""
    feet, mile = f"({v}) / 0.3048", 1609.344
    if kind == "distance":
        turn, long, short, a, b = (mile, f"({v}) / {mile}", feet, "ft", "mi") if imperial else (1000, f"({v}) / 1000", v, "m", "km")
        return f"CASE WHEN {v} < {turn} THEN {num(short)} || ' {a}' WHEN {v} < 100 * {turn} THEN {num(long, 2)} || ' {b}' ELSE {num(long, 1)} || ' {b}' END"
    if kind == "signed":
        return f"CASE WHEN {v} > 0 THEN '+' WHEN {v} < 0 THEN '−' ELSE '' END || " + shown("elevation", f"abs({v})", imperial)
    if kind == "date":
        return f"strftime(make_timestamp(CAST({v} AS BIGINT) * 1000), '%Y-%m-%d %H:%M')"
    if kind == "duration":
        return clock(v)
    if kind == "pace":
        return f"CASE WHEN {v} > 0 THEN " + (clock(f"({v}) * 1.609344") + " || ' /mi'" if imperial else clock(v) + " || ' /km'") + " END"
    metric = {"elevation": (v, 0, " m"), "speed": (f"({v}) * 3.6", 1, " km/h"), "vam": (v, 0, " m/h"), "temp": (v, 1, " °C"), "grade": (f"({v}) * 100", 1, "%"), "bpm": (v, 0, " bpm"), "power": (v, 0, " W"), "cadence": (v, 0, " rpm")}
    own = {"elevation": (feet, 0, " ft"), "speed": (f"({v}) * 2.2369362920544", 1, " mph"), "vam": (feet, 0, " ft/h"), "temp": (f"({v}) * 9 / 5 + 32", 0, " °F")}
    value, digits, unit = (own.get(kind) if imperial else None) or metric[kind]
    return f"{num(value, digits)} || '{unit}'"


FOLD = """list_reduce(list_prepend({'d': CAST(0 AS DOUBLE), 'h': CAST(0 AS DOUBLE), 'e': e0, 'dt': CAST(0 AS DOUBLE), 'r': CAST(0 AS DOUBLE), 'g': CAST(0 AS DOUBLE), 'l': CAST(0 AS DOUBLE), 'up': CAST(0 AS DOUBLE), 'down': CAST(0 AS DOUBLE), 'acc': CAST(0 AS DOUBLE), 'we': e0, 'hi': CAST(NULL AS DOUBLE), 'lo': CAST(NULL AS DOUBLE)}, steps), lambda s, x: {
  'd': x.d, 'h': x.h, 'e': x.e, 'dt': x.dt,
  'r': CASE WHEN abs(s.r + x.d) > 3 THEN 0.0 ELSE s.r + x.d END,
  'g': s.g + CASE WHEN s.r + x.d > 3 THEN s.r + x.d ELSE 0.0 END,
  'l': s.l + CASE WHEN s.r + x.d < -3 THEN -(s.r + x.d) ELSE 0.0 END,
  'up': s.up + CASE WHEN s.r + x.d > 0 THEN x.dt ELSE 0.0 END,
  'down': s.down + CASE WHEN s.r + x.d < 0 THEN x.dt ELSE 0.0 END,
  'acc': CASE WHEN s.acc + x.h >= 50 THEN 0.0 ELSE s.acc + x.h END,
  'we': CASE WHEN s.acc + x.h >= 50 THEN x.e ELSE s.we END,
  'hi': CASE WHEN s.acc + x.h >= 50 THEN greatest(s.hi, (x.e - s.we) / (s.acc + x.h)) ELSE s.hi END,
  'lo': CASE WHEN s.acc + x.h >= 50 THEN least(s.lo, (x.e - s.we) / (s.acc + x.h)) ELSE s.lo END})"""

SPLIT = """SELECT track_id, k AS sector_id, k * 1000.0 AS start_m, CASE WHEN k = n - 1 THEN total_distance ELSE least(k * 1000.0 + 1000, total_distance) END AS end_m
  FROM (SELECT track_id, total_distance, n, unnest(range(n)) AS k FROM (SELECT *, greatest(1, CAST(ceil((total_distance - 200) / 1000.0) AS BIGINT)) AS n FROM tr))"""


SPLIT_DROP = """SELECT track_id, k AS sector_id, k * 1000.0 AS start_m, least(k * 1000.0 + 1000, total_distance) AS end_m
  FROM (SELECT track_id, total_distance, unnest(range(greatest(1, CAST(ceil((total_distance - 200) / 1000.0) AS BIGINT)))) AS k FROM tr)"""


def _cleaned(value: str, where: str, out: str) -> str:
    rows = f"SELECT *, {value} AS v FROM wk WHERE {where}"
    both = f"SELECT *, avg(v) OVER ({SEC} ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm, avg(v) OVER ({SEC}) AS mu, stddev_pop(v) OVER ({SEC}) AS sg FROM ({rows})"
    return f"SELECT track_id, sector_id, avg(CASE WHEN rec THEN sm WHEN abs(v - mu) <= 3 * sg THEN v END) AS {out} FROM ({both}) GROUP BY 1, 2"


GRADES = """list_reduce(list_prepend({'h': CAST(0 AS DOUBLE), 'e': e0, 'v': CAST(0 AS BIGINT), 'acc': CAST(0 AS DOUBLE), 'we': e0, 'o': [{'v': CAST(-1 AS BIGINT), 'g': CAST(0 AS DOUBLE)}]}, steps), lambda s, x: {
  'h': x.h, 'e': x.e, 'v': x.v, 'acc': CASE WHEN s.acc + x.h >= 50 THEN 0.0 ELSE s.acc + x.h END, 'we': CASE WHEN s.acc + x.h >= 50 THEN x.e ELSE s.we END,
  'o': CASE WHEN s.acc + x.h >= 50 THEN list_append(s.o, {'v': x.v, 'g': (x.e - s.we) / (s.acc + x.h)}) ELSE s.o END})"""

CHAIN = {
    "tp": TRACK_POINTS_SQL.format(lineitem="lineitem"),
    "p0": f"SELECT *, round(coalesce(CASE WHEN lag(lat) OVER {W} IS NOT NULL THEN {hav(f'lag(lat) OVER {W}', f'lag(lon) OVER {W}', 'lat', 'lon')} END, 0.0), 6) AS seg_m FROM tp",
    "p": f"SELECT *, round(sum(seg_m) OVER {RUN}, 6) AS cum_dist FROM p0",
    "pn": f"SELECT *, lead(seg_m) OVER w AS dd, (lead(time_ms) OVER w - time_ms) / 1000.0 AS dt, lead(ele) OVER w - ele AS dz, max(coalesce(speed >= 0, false)) OVER (PARTITION BY track_id) AS recorded, lead(cum_dist) OVER w AS next_cum, lead(lat) OVER w AS next_lat, lead(lon) OVER w AS next_lon, lead(ele) OVER w AS next_ele, lead(time_ms) OVER w AS next_ms, lead(hr) OVER w AS next_hr FROM p WINDOW w AS {W}",
    "tr": "SELECT track_id, count(*) AS point_count, max(cum_dist) AS total_distance, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon, bool_and(ele IS NOT NULL) AS has_elevation, bool_and(time_ms IS NOT NULL) AS has_time, bool_or(hr IS NOT NULL) AS has_hr, bool_or(cad IS NOT NULL) AS has_cad, bool_or(temp IS NOT NULL) AS has_temp, bool_or(power IS NOT NULL) AS has_power, bool_or(coalesce(speed >= 0, false)) AS has_recorded_speed, min(ele) AS ele_min, max(ele) AS ele_max FROM p GROUP BY 1",
    "wp": "SELECT track_id, seq AS wp_seq, lat, lon + 1e-4 * ((seq // 75 + track_id) % 9) AS lon, 'CP' || seq AS name FROM p WHERE seq % 75 IN (30, 36)",
    "scale": f"SELECT track_id, {METRE} * cos(radians((min(lat) + max(lat)) / 2)) AS sx FROM p GROUP BY 1",
    "vert": f"SELECT track_id, seq, {{'lon': lon, 'lat': lat, 'd': cum_dist}} AS p, {{'lon': lag(lon) OVER {W}, 'lat': lag(lat) OVER {W}, 'd': lag(cum_dist) OVER {W}}} AS b, {{'lon': lead(lon) OVER {W}, 'lat': lead(lat) OVER {W}, 'd': lead(cum_dist) OVER {W}}} AS a FROM p",
    "wpn": nearest("wp"),
    "rsv": "SELECT n.track_id, n.wp_seq, w.name, n.dist FROM wpn n JOIN wp w USING (track_id, wp_seq) WHERE n.off_track <= 50",
    "ws0": "SELECT track_id, total_distance AS total, list({'d': dist, 'n': name, 'o': [{'d': CAST(0 AS DOUBLE), 'n': CAST(NULL AS VARCHAR)}]} ORDER BY dist, wp_seq) AS steps FROM rsv JOIN tr USING (track_id) GROUP BY 1, 2",
    "ws1": "SELECT track_id, total, (list_reduce(list_prepend({'d': CAST(0 AS DOUBLE), 'n': CAST(NULL AS VARCHAR), 'o': [{'d': CAST(0 AS DOUBLE), 'n': CAST(NULL AS VARCHAR)}]}, steps), lambda s, x: {'d': x.d, 'n': x.n, 'o': CASE WHEN x.d - s.o[-1].d >= 100 AND total - x.d >= 100 THEN list_append(s.o, {'d': x.d, 'n': x.n}) ELSE s.o END})).o AS b FROM ws0",
    "wsec": "SELECT track_id, k - 1 AS sector_id, b[k].d AS start_m, coalesce(b[k + 1].d, total) AS end_m, b[k].n AS name FROM (SELECT *, unnest(range(1, len(b) + 1)) AS k FROM ws1 WHERE len(b) > 1)",
    "sec": f"{SPLIT} UNION ALL SELECT track_id, k, total_distance * a, total_distance * b FROM tr, (VALUES (1001, 0.10, 0.37), (1002, 0.37, 0.81), (1003, 0.50, 0.502)) v(k, a, b)",
    "ends": "SELECT track_id, sector_id * 2 AS e, start_m AS d FROM sec UNION ALL SELECT track_id, sector_id * 2 + 1, end_m FROM sec",
    "loc": located("ends", "e"),
    "w0": """SELECT a.track_id, a.e // 2 AS sector_id, n.seq AS vseq, a.i AS ai, b.i AS bi, b.t AS end_t, a.dist AS ad, a.ele AS ae, a.time_ms AS am, b.dist AS bd, b.ele AS be, b.time_ms AS bm,
        n.cum_dist, n.ele AS v_ele, CAST(n.time_ms AS DOUBLE) AS v_ms, n.hr AS v_hr, n.cad AS v_cad, n.power AS v_power, n.temp AS v_temp, n.speed AS v_speed, n.recorded AS rec, n.dd AS v_dd, n.dt AS v_dt, n.dz AS v_dz, n.next_hr
      FROM loc a JOIN loc b ON a.track_id = b.track_id AND b.e = a.e + 1 AND a.e % 2 = 0 JOIN pn n ON n.track_id = a.track_id AND n.seq BETWEEN a.i AND b.i""",
    "w1": "SELECT *, 'start' AS kind, 0 AS step, ad AS to_dist, ae AS to_ele, am AS to_ms FROM w0 WHERE vseq = ai UNION ALL SELECT *, 'point', vseq - ai, cum_dist, v_ele, v_ms FROM w0 WHERE vseq > ai UNION ALL SELECT *, 'end', vseq - ai + 1, bd, be, bm FROM w0 WHERE vseq = bi",
    "w2": f"SELECT *, greatest(0, to_dist - lag(to_dist) OVER {WS}) AS seg_h, to_ele - lag(to_ele) OVER {WS} AS d_ele, lag(to_ms) OVER {WS} AS from_ms, (to_ms - lag(to_ms) OVER {WS}) / 1000 AS dt FROM w1",
    "w3": f"SELECT *, coalesce(dt > 0, false) AS timed, coalesce(dt > 0 AND seg_h / dt >= 0.5 / 3.6, false) AS moving FROM w2",
    "w4": f"SELECT *, sum(CAST(moving AS INT)) OVER {RUNS} AS island FROM w3",
    "wk": f"SELECT *, timed AND NOT moving AND coalesce(sum(CASE WHEN timed AND NOT moving THEN dt END) OVER ({SEC}, island) >= 10, false) AS paused FROM w4",
    "dist": "SELECT track_id, sector_id, max(to_dist) - min(to_dist) AS horizontal_m, sum(sqrt(seg_h * seg_h + d_ele * d_ele)) AS distance_3d FROM wk GROUP BY 1, 2",
    "f0": "SELECT track_id, sector_id, list({'d': d_ele, 'h': seg_h, 'e': to_ele, 'dt': CASE WHEN timed AND NOT paused THEN dt ELSE 0.0 END, 'r': 0.0, 'g': 0.0, 'l': 0.0, 'up': 0.0, 'down': 0.0, 'acc': 0.0, 'we': 0.0, 'hi': 0.0, 'lo': 0.0} ORDER BY step) FILTER (WHERE step > 0) AS steps, max(CASE WHEN step = 0 THEN to_ele END) AS e0 FROM wk GROUP BY 1, 2",
    "f1": f"SELECT track_id, sector_id, {FOLD} AS f FROM f0",
    "fold": "SELECT track_id, sector_id, f.g AS gain, f.l AS loss, f.up AS climb_s, f.down AS descend_s, greatest(f.hi, CASE WHEN f.acc >= 20 THEN (f.e - f.we) / f.acc END) AS max_grade, least(f.lo, CASE WHEN f.acc >= 20 THEN (f.e - f.we) / f.acc END) AS min_grade FROM f1",
    "elev": "SELECT *, ele_end - ele_start AS net FROM (SELECT track_id, sector_id, max(CASE WHEN kind = 'start' THEN to_ele END) AS ele_start, max(CASE WHEN kind = 'end' THEN to_ele END) AS ele_end, min(least(to_ele, CASE WHEN kind <> 'end' THEN v_ele END)) AS ele_min, max(greatest(to_ele, CASE WHEN kind <> 'end' THEN v_ele END)) AS ele_max FROM wk GROUP BY 1, 2)",
    "mov": "SELECT track_id, sector_id, CASE WHEN m > 0 THEN m END AS moving_s, CASE WHEN b > a THEN (b - a) / 1000 END AS elapsed_s FROM (SELECT track_id, sector_id, sum(CASE WHEN timed AND NOT paused THEN dt END) AS m, max(CASE WHEN kind = 'start' THEN to_ms END) AS a, max(CASE WHEN kind = 'end' THEN to_ms END) AS b FROM wk GROUP BY 1, 2)",
    "spd": f"SELECT *, CASE WHEN avg_speed > 0 THEN 1000 / avg_speed END AS avg_pace FROM ({_cleaned('seg_h / dt', 'moving', 'avg_speed')})",
    "gapm": _cleaned(f"dt / seg_h * 1000 / {minetti('(d_ele / seg_h)')}", "moving AND seg_h > 0", "avg_gap"),
    "sv": "SELECT track_id, sector_id, vseq, v_speed AS speed, rec AS recorded, v_dd AS dd, v_dt AS dt, v_dz AS dz FROM wk WHERE kind <> 'end'",
    "ss": speeds("sv", SEC, "vseq"),
    "mx": "SELECT track_id, sector_id, CASE WHEN max(clean_speed) > 0 THEN max(clean_speed) END AS max_speed FROM ss GROUP BY 1, 2",
    "fit": "SELECT track_id, sector_id, vseq, metric, avg(raw) OVER (PARTITION BY track_id, sector_id, metric ORDER BY vseq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM (SELECT track_id, sector_id, vseq, unnest(['hr', 'cad', 'power']) AS metric, unnest([v_hr, v_cad, v_power]) AS raw FROM wk WHERE kind <> 'end' AND NOT (kind = 'point' AND paused)) WHERE raw IS NOT NULL",
    "fits": "SELECT track_id, sector_id, " + ", ".join(f"{f}(CASE WHEN metric = '{c}' THEN value END) AS {f}_{c}" for c in ("hr", "cad", "power") for f in ("avg", "max")) + " FROM fit GROUP BY 1, 2",
    "temps": "SELECT track_id, sector_id, avg(v_temp) AS avg_temp, min(v_temp) AS min_temp, max(v_temp) AS max_temp FROM wk WHERE kind <> 'end' GROUP BY 1, 2",
    "kp": f"SELECT track_id, sector_id, step, to_dist AS d, to_ms AS t, paused, sum(CASE WHEN paused THEN to_ms - from_ms ELSE 0 END) OVER {RUNS} AS p FROM wk",
    "kl": "SELECT *, lead(d) OVER w AS nd, lead(t) OVER w AS nt, lead(paused) OVER w AS np FROM kp WINDOW w AS (PARTITION BY track_id, sector_id ORDER BY step)",
    "km": """SELECT a.track_id, a.sector_id, a.step, a.d + 1000 AS dist,
        (l.t + CASE WHEN l.nd > l.d THEN (l.nt - l.t) * (a.d + 1000 - l.d) / (l.nd - l.d) ELSE 0 END - a.t - (l.p - a.p) - CASE WHEN l.np THEN CASE WHEN l.nd > l.d THEN (l.nt - l.t) * (a.d + 1000 - l.d) / (l.nd - l.d) ELSE 0 END ELSE 0 END) / 1000 AS pace
      FROM kp a JOIN kl l ON a.track_id = l.track_id AND a.sector_id = l.sector_id AND l.d < a.d + 1000 AND l.nd >= a.d + 1000""",
    "kms": "SELECT track_id, sector_id, arg_min(pace, (pace, step)) AS fastest_pace, arg_min(dist, (pace, step)) AS fastest_dist, arg_max(pace, (pace, -step)) AS slowest_pace, arg_max(dist, (pace, -step)) AS slowest_dist FROM km WHERE pace > 0 GROUP BY 1, 2",
    "typed": "SELECT track_id, sector_id, CASE WHEN gain + loss < 5 THEN 'flat' WHEN net > 0 AND gain >= 0.65 * (gain + loss) THEN 'climb' WHEN net < 0 AND loss >= 0.65 * (gain + loss) THEN 'descent' WHEN gain > loss * 1.4 AND net > 0 THEN 'climb' WHEN loss > gain * 1.4 AND net < 0 THEN 'descent' ELSE 'mixed' END AS segment_type FROM fold JOIN elev USING (track_id, sector_id)",
    "req": "SELECT track_id, k, f * total_distance AS d FROM tr, (VALUES (0, -1.0), (1, 0.0), (2, 0.123), (3, 0.5), (4, 0.777), (5, 1.0), (6, 2.0)) v(k, f)",
    "reqs": located("req", "k"),
    "gappy": "SELECT * REPLACE (CASE WHEN seq < 3 OR seq % 41 IN (7, 8, 9) OR seq > 520 THEN NULL ELSE ele END AS ele) FROM p",
    "zn": "SELECT track_id, k AS zone, lo + track_id % 4 * 7 AS lo FROM tr, (VALUES " + ", ".join(f"({k + 1}, {b})" for k, b in enumerate(ZONE_BOUNDS)) + ") v(k, lo)",
    "zt": "SELECT track_id, sector_id, dt, paused, h AS hr, (SELECT coalesce(max(zone), 0) FROM zn WHERE lo <= h AND zn.track_id = z.track_id) AS zone, max(h IS NOT NULL) OVER (PARTITION BY track_id, sector_id) AS had FROM (SELECT *, CASE WHEN kind <> 'end' OR end_t < 0.5 THEN v_hr ELSE next_hr END AS h FROM wk WHERE timed) z",
    "ztime": "SELECT track_id, sector_id, coalesce(sum(CASE WHEN NOT paused THEN dt END), 0) AS moving_s, coalesce(sum(CASE WHEN paused THEN dt END), 0) AS paused_s, coalesce(sum(CASE WHEN NOT paused AND hr IS NULL THEN dt END), 0) AS no_hr_s, coalesce(sum(CASE WHEN NOT paused AND hr IS NOT NULL AND zone = 0 THEN dt END), 0) AS below_s, " + ", ".join(f"coalesce(sum(CASE WHEN NOT paused AND hr IS NOT NULL AND zone = {k} THEN dt END), 0) AS z{k}_s" for k in range(1, 6)) + " FROM zt WHERE had GROUP BY 1, 2",
    "sp": speeds("pn", "PARTITION BY track_id", "seq"),
    "gw0": "SELECT track_id, sector_id, list({'h': seg_h, 'e': to_ele, 'v': vseq, 'acc': 0.0, 'we': 0.0, 'o': [{'v': CAST(-1 AS BIGINT), 'g': 0.0}]} ORDER BY step) FILTER (WHERE step > 0) AS steps, max(CASE WHEN step = 0 THEN to_ele END) AS e0 FROM wk GROUP BY 1, 2",
    "gw1": f"SELECT track_id, sector_id, {GRADES} AS f FROM gw0",
    "gw": "SELECT track_id, sector_id, g.v AS vseq, g.g AS grade FROM (SELECT track_id, sector_id, unnest(CASE WHEN f.acc >= 20 THEN list_append(list_filter(f.o, lambda y: y.v <> f.v OR f.acc = 0), {'v': f.v, 'g': (f.e - f.we) / f.acc}) ELSE f.o END) AS g FROM gw1) WHERE g.v >= 0",
    "samples": f"""SELECT s.track_id, s.sector_id, s.vseq, {', '.join(f"max(CASE WHEN fit.metric = '{c}' THEN fit.value END) AS {c}" for c in ('hr', 'power', 'cad'))}, any_value(w.v_temp) AS temp, any_value(gw.grade) AS grade, any_value(w.v_ele) AS ele, any_value(s.clean_speed) AS speed,
        any_value(CASE WHEN s.clean_speed > 0 THEN 1000 / s.clean_speed END) AS pace, any_value(CASE WHEN s.dd > 0 AND s.dz IS NOT NULL AND s.clean_speed > 0 THEN 1000 / (s.clean_speed / {minetti('(s.dz / s.dd)')}) END) AS gap
      FROM ss s JOIN wk w ON w.track_id = s.track_id AND w.sector_id = s.sector_id AND w.vseq = s.vseq AND w.kind <> 'end' LEFT JOIN fit ON fit.track_id = s.track_id AND fit.sector_id = s.sector_id AND fit.vseq = s.vseq LEFT JOIN gw ON gw.track_id = s.track_id AND gw.sector_id = s.sector_id AND gw.vseq = s.vseq GROUP BY 1, 2, 3""",
    "pairs": "SELECT track_id, sector_id, vseq, hr AS x, speed AS y FROM samples WHERE hr IS NOT NULL AND speed IS NOT NULL",
    "pr": f"SELECT *, count(*) OVER ({SEC}) AS n, row_number() OVER ({SEC} ORDER BY x, vseq) - 1 AS rx, row_number() OVER ({SEC} ORDER BY y, vseq) - 1 AS ry FROM pairs",
    "dom0": "SELECT track_id, sector_id, max(n) AS n, " + ", ".join(f"max(CASE WHEN r{c} = {at} THEN {c} END) AS {c}{k}" for c in "xy" for k, at in ((0, "floor(CAST(0.002 AS DOUBLE) * (n - 1))"), (1, "ceil((1 - CAST(0.002 AS DOUBLE)) * (n - 1))"))) + " FROM pr GROUP BY 1, 2",
    "dom": "SELECT track_id, sector_id, n, " + ", ".join(f"{c}0 - CASE WHEN {c}1 > {c}0 THEN ({c}1 - {c}0) * 0.04 ELSE greatest(abs({c}0) * 0.05, 0.5) END AS {c}0, {c}1 + CASE WHEN {c}1 > {c}0 THEN ({c}1 - {c}0) * 0.04 ELSE greatest(abs({c}0) * 0.05, 0.5) END AS {c}1" for c in "xy") + " FROM dom0",
    "dens": "SELECT p.track_id, p.sector_id, least(95, CAST(floor((x - x0) / (x1 - x0) * 96) AS BIGINT)) AS x_bin, least(63, CAST(floor((y - y0) / (y1 - y0) * 64) AS BIGINT)) AS y_bin, count(*) AS n FROM pairs p JOIN dom d ON p.track_id = d.track_id AND p.sector_id = d.sector_id WHERE d.n >= 10 AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2, 3, 4",
    "cls0": "SELECT *, min({'c': cum_dist, 's': seq, 'e': ele}) OVER w AS a, max({'c': cum_dist, 's': seq, 'e': ele}) OVER w AS b FROM p WINDOW w AS (PARTITION BY track_id ORDER BY cum_dist RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING)",
    "cls": "SELECT track_id, seq, cum_dist, CASE WHEN b.c - a.c >= 25 AND (b.e - a.e) / (b.c - a.c) > 0.025 THEN 1 WHEN b.c - a.c >= 25 AND (b.e - a.e) / (b.c - a.c) < -0.025 THEN -1 ELSE 0 END AS cls FROM cls0",
    "runs": f"SELECT track_id, run, any_value(cls) AS cls, min(cum_dist) AS start_m, max(cum_dist) AS end_m FROM (SELECT *, sum(new) OVER {RUN} AS run FROM (SELECT *, CASE WHEN cls <> lag(cls) OVER {W} THEN 1 ELSE 0 END AS new FROM cls)) GROUP BY 1, 2",
    # one merge of each track a step: the shortest run, k, joins the longer of its neighbours
    "merging": "SELECT track_id, list({'b': start_m, 'e': end_m, 'c': cls} ORDER BY run) AS s FROM runs GROUP BY 1 UNION ALL SELECT track_id, s[:lo - 1] || [{'b': s[lo].b, 'e': s[hi].e, 'c': s[joined].c}] || s[hi + 1:] FROM (SELECT *, CASE WHEN joined < k OR one THEN k - 1 ELSE k END AS lo, CASE WHEN joined > k OR one THEN k + 1 ELSE k END AS hi FROM (SELECT *, CASE WHEN k = 1 THEN 2 WHEN k = len(s) OR n[k - 1] >= n[k + 1] THEN k - 1 ELSE k + 1 END AS joined, k > 1 AND k < len(s) AND s[k - 1].c = s[k + 1].c AS one FROM (SELECT *, list_position(n, list_min(n)) AS k FROM (SELECT *, list_transform(s, lambda x: x.e - x.b) AS n FROM merging WHERE len(s) > 1)) WHERE n[k] < 400))",
    "tms": "SELECT track_id, sector_id, max(CASE WHEN kind = 'start' THEN to_ms END) AS start_ms, max(CASE WHEN kind = 'end' THEN to_ms END) AS end_ms FROM wk GROUP BY 1, 2",
    "gs0": "SELECT track_id, list({'s': CAST(seq AS BIGINT), 'h': seg_m, 'e': ele, 'run': CAST(0 AS DOUBLE), 'base': ele, 'o': [{'s': CAST(seq AS BIGINT), 'g': CAST(NULL AS DOUBLE)}]} ORDER BY seq) AS steps FROM p GROUP BY 1",
    "gs1": """SELECT track_id, (list_reduce(steps, lambda s, x: {'s': x.s, 'h': x.h, 'e': x.e, 'run': CASE WHEN s.run + x.h >= 50 THEN 0.0 ELSE s.run + x.h END, 'base': CASE WHEN s.run + x.h >= 50 THEN x.e ELSE s.base END,
        'o': list_append(s.o, {'s': x.s, 'g': CASE WHEN s.run + x.h >= 20 THEN (x.e - s.base) / (s.run + x.h) END})})).o AS o FROM gs0""",
    "gs": "SELECT track_id, g.s AS seq, g.g AS grade FROM (SELECT track_id, unnest(o) AS g FROM gs1)",
    "gr": """SELECT track_id, seq, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN seq - i <= j - seq THEN a ELSE b END AS reading FROM (SELECT *, last_value(grade IGNORE NULLS) OVER u AS a, last_value(CASE WHEN grade IS NOT NULL THEN seq END IGNORE NULLS) OVER u AS i, first_value(grade IGNORE NULLS) OVER v AS b, first_value(CASE WHEN grade IS NOT NULL THEN seq END IGNORE NULLS) OVER v AS j FROM gs
        WINDOW u AS (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "el0": "SELECT track_id AS response_id, seq AS pos, CASE WHEN seq % 70 = 0 THEN 'way' ELSE 'node' END AS type, 45 + CAST(seq % 40 AS DOUBLE) / 1000 AS lat, 7 + CAST(track_id % 7 AS DOUBLE) / 1000 AS lon, ['cave_entrance', 'spring', 'tree', 'rock', 'stone', 'peak'][seq % 6 + 1] AS nat, CASE WHEN seq % 110 = 0 THEN 'waterfall' END AS water, CASE WHEN seq % 30 = 0 THEN '' ELSE 'Hill ' || seq END AS name, CASE WHEN seq % 50 = 0 THEN 'HILL ' || seq END AS name_en, CAST(round(ele) AS INT) AS e FROM p",
    "el": """SELECT *, coalesce(water, nat) AS class, coalesce(name_en, nullif(name, '')) AS shown_name, coalesce(CASE WHEN pos % 20 IN (0, 1, 13) THEN CAST(e AS DOUBLE) WHEN pos % 20 = 3 THEN (e + 0.5) * 0.3048 WHEN pos % 20 = 6 THEN CAST('0.' || e AS DOUBLE) * 0.3048 END,
        CASE WHEN pos % 40 = 10 THEN 3 * e * 0.3048 WHEN pos % 40 = 30 THEN NULL WHEN pos % 40 = 13 THEN 7 * 0.3048 WHEN pos % 5 = 0 THEN 2 * e * 0.3048 END) AS metres FROM el0""",
    "marks": f"SELECT *, class || ':' || printf('%.5f,%.5f', lon, lat) AS key, response_id * 10000 + pos AS place FROM el WHERE type = 'node' AND class IN ({', '.join(repr(n) for n in POI_CLASSES)})",
    "xy": f"SELECT track_id, seq, (lon + sin(CAST(seq AS DOUBLE) / 9) / 4000) * {METRE} * cos(radians(avg(lat) OVER (PARTITION BY track_id))) AS x, lat * {METRE} AS y FROM p",
    # spans between kept points, each with the point that it came from and the least distance on the way there
    "dp": """SELECT track_id, min(seq) AS a, max(seq) AS b, CAST(NULL AS BIGINT) AS mid, CAST('inf' AS DOUBLE) AS reach FROM xy GROUP BY 1
      UNION ALL
      SELECT track_id, unnest([a, m.seq]), unnest([m.seq, b]), m.seq, least(reach, m.off)
      FROM (SELECT s.track_id, s.a, s.b, any_value(reach) AS reach, max({'off': off, 'n': -q.seq, 'seq': q.seq}) AS m
        FROM dp s JOIN xy e ON e.track_id = s.track_id AND e.seq = s.a JOIN xy f ON f.track_id = s.track_id AND f.seq = s.b JOIN xy q ON q.track_id = s.track_id AND q.seq > s.a AND q.seq < s.b,
          LATERAL (SELECT pow(f.x - e.x, 2) + pow(f.y - e.y, 2) AS w) l1,
          LATERAL (SELECT CASE WHEN w > 0 THEN least(1.0, greatest(0.0, ((q.x - e.x) * (f.x - e.x) + (q.y - e.y) * (f.y - e.y)) / w)) ELSE 0.0 END AS t) l2,
          LATERAL (SELECT sqrt(pow(q.x - e.x - t * (f.x - e.x), 2) + pow(q.y - e.y - t * (f.y - e.y), 2)) AS off) l3
        GROUP BY 1, 2, 3)
      WHERE m.off > 1.5""",
    "dpk": "SELECT DISTINCT track_id, mid AS seq, reach FROM dp WHERE mid IS NOT NULL UNION SELECT track_id, unnest([min(seq), max(seq)]), CAST('inf' AS DOUBLE) FROM xy GROUP BY 1",
    "dpn": "SELECT track_id, coalesce(min(lim) FILTER (n <= 40), 384.0) AS lim FROM (SELECT track_id, lim, count(*) FILTER (reach > lim) AS n FROM dpk, (SELECT 1.5 * pow(2, k) AS lim FROM range(9) t(k)) GROUP BY 1, 2) GROUP BY 1",
    "tiles0": "SELECT track_id * 10000 + seq AS pos, ['peak', 'saddle', 'volcano', 'cliff'][seq % 4 + 1] AS class, seq % 90 AS way, 45 + CAST(seq % 300 AS DOUBLE) / 1000 AS lat, 7 + CAST(track_id % 7 AS DOUBLE) / 1000 AS lon, CASE WHEN seq % 7 IN (0, 6) THEN 5 ELSE seq % 7 END AS rank, 'Top ' || seq % 300 AS name, CAST(seq AS DOUBLE) AS metres FROM p",
    "tiles": f"SELECT * FROM (SELECT *, class || ':' || printf('%.5f,%.5f', lon, lat) AS key, row_number() OVER (PARTITION BY class || ':' || printf('%.5f,%.5f', lon, lat) ORDER BY pos) AS k FROM tiles0 WHERE way <> 0 AND class IN ({', '.join(repr(n) for n in TILE_CLASSES)})) WHERE k = 1",
    "dedup": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place) AS k FROM marks) WHERE k = 1",
    "shown": f"SELECT *, CASE WHEN class IN ('peak', 'volcano') AND rank <= 2 THEN class || '-major' ELSE class END AS gate, concat_ws(chr(10), name1, CASE WHEN lower(name2) <> lower(name1) THEN name2 END, {shown('elevation', 'metres')}) AS label FROM (SELECT key, class, lat, lon, 5 AS rank, shown_name AS name1, nullif(name, '') AS name2, metres FROM dedup UNION ALL SELECT key, class, lat, lon, rank, name, name, metres FROM tiles)",
    "hs": "SELECT track_id, track_id % 3 AS md, 190 + track_id % 90 AS max_hr, 40 + track_id % 20 AS rest_hr, 165 + track_id % 40 AS lthr FROM tr",
    "hb": "SELECT *, CASE md WHEN 0 THEN CASE WHEN track_id % 11 = 5 THEN [114, 114, 114, 114, 114] ELSE [95, 114, 133, 152, 171] END WHEN 1 THEN [125, 138, 151, 164, CASE WHEN track_id % 13 = 3 THEN 261 ELSE 177 END] ELSE CASE WHEN track_id % 17 = 4 THEN [102, 119, 136, lthr] ELSE [102, 119, 136, 153, lthr] END END AS bounds FROM hs",
    "hz": "SELECT track_id, md, max_hr, rest_hr, lthr, k AS zone, CAST(bounds[k] AS DOUBLE) AS lo, CAST(bounds[k + 1] AS DOUBLE) AS hi FROM hb, range(1, 6) t(k) WHERE k <= len(bounds)",
    "mark": "SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 AS now FROM events",
    "ev": "SELECT user_id AS track_id, epoch_us(ts) AS us, value AS x, value % 50 AS ele, 90 + value % 100 AS hr, lag(epoch_us(ts)) OVER w AS before, lag(value) OVER w AS last_x FROM events, mark WHERE epoch_us(ts) <= now WINDOW w AS (PARTITION BY user_id ORDER BY ts)",
    "ev1": "SELECT *, coalesce((us - before) / 1e6, 0) AS dt, before IS NOT NULL AND abs(x - last_x) / ((us - before) / 1e6) >= 0.5 / 3.6 AS moving FROM ev",
    "ev2": "SELECT *, sum(CAST(moving OR dt > 86400 AS INT)) OVER (PARTITION BY track_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM ev1",
    "eg0": "SELECT track_id, list({'us': us, 'e': ele, 'r': CAST(0 AS DOUBLE), 'g': CAST(0 AS DOUBLE), 'l': CAST(0 AS DOUBLE), 'up': CAST(0 AS DOUBLE), 'down': CAST(0 AS DOUBLE), 'n': CAST(1 AS BIGINT)} ORDER BY us) AS steps FROM ev GROUP BY 1",
    "eg": """SELECT track_id, list_reduce(steps, lambda s, x: {'us': x.us, 'e': x.e, 'r': CASE WHEN abs(s.r + (x.e - s.e)) > 3 THEN 0.0 ELSE s.r + (x.e - s.e) END, 'g': s.g + CASE WHEN s.r + (x.e - s.e) > 3 THEN s.r + (x.e - s.e) ELSE 0.0 END, 'l': s.l - CASE WHEN s.r + (x.e - s.e) < -3 THEN s.r + (x.e - s.e) ELSE 0.0 END,
        'up': s.up + CASE WHEN s.r + (x.e - s.e) > 0 THEN (x.us - s.us) / 1e6 ELSE 0.0 END, 'down': s.down + CASE WHEN s.r + (x.e - s.e) < 0 THEN (x.us - s.us) / 1e6 ELSE 0.0 END, 'n': s.n + 1}) AS f FROM eg0""",
}

X12, Y12 = "((lon + 180) - 360 * floor((lon + 180) / 360)) / 360 * 4096", "(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793) / 2 * 4096"
CHAIN |= {
    "px": f"SELECT *, CAST(floor(fx) AS BIGINT) AS gx0, CAST(floor(fy) AS BIGINT) AS gy0 FROM (SELECT *, {X12} * 512 AS fx, {Y12} * 512 AS fy FROM p)",
    "corner": "SELECT track_id, seq, i, j, gx0 + i AS gx, gy0 + j AS gy FROM px, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j)",
    "dem": "SELECT gx, gy, CAST(1000 + (gx * 7 + gy * 13) % 200 AS DOUBLE) AS e FROM (SELECT DISTINCT gx, gy FROM corner) WHERE (gx + gy) % 11 <> 0",
    "four": "SELECT track_id, seq, max(CASE WHEN i = 0 AND j = 0 THEN e END) AS a, max(CASE WHEN i = 1 AND j = 0 THEN e END) AS b, max(CASE WHEN i = 0 AND j = 1 THEN e END) AS c, max(CASE WHEN i = 1 AND j = 1 THEN e END) AS d FROM corner JOIN dem USING (gx, gy) GROUP BY 1, 2",
    "ds": """SELECT track_id, seq, CASE WHEN seq % 5 = 0 THEN NULL ELSE ele END AS ele, a + (coalesce(b, a) - a) * dx + ((coalesce(c, a) + (coalesce(d, b, a) - coalesce(c, a)) * dx) - (a + (coalesce(b, a) - a) * dx)) * dy AS dem_ele
      FROM (SELECT x.track_id, x.seq, x.ele, fx - floor(fx) AS dx, fy - floor(fy) AS dy, a, b, c, d FROM px x LEFT JOIN four USING (track_id, seq))""",
}

KEYS = "track_id, sector_id"
RATE = "CASE WHEN {s} > 0 AND {m} > 0 THEN {m} / ({s} / 3600) END AS {n}"
METRICS = f"""SELECT {KEYS}, horizontal_m, distance_3d, gain, loss, max_grade, min_grade, ele_start, ele_end, ele_min, ele_max, net, moving_s, elapsed_s, start_ms, end_ms, avg_speed, avg_pace, avg_gap, max_speed, avg_hr, max_hr, avg_cad, max_cad, avg_power, max_power, avg_temp, min_temp, max_temp, fastest_pace, fastest_dist, slowest_pace, slowest_dist,
  horizontal_m + gain * 10 AS effort_distance, CASE WHEN horizontal_m > 0 AND NOT (gain = 0 AND loss > 0) THEN gain / horizontal_m END AS avg_grade, {RATE.format(s='climb_s', m='gain', n='vam')}, {RATE.format(s='descend_s', m='loss', n='vdm')}, segment_type
  FROM dist LEFT JOIN fold USING ({KEYS}) LEFT JOIN elev USING ({KEYS}) LEFT JOIN mov USING ({KEYS}) LEFT JOIN tms USING ({KEYS}) LEFT JOIN spd USING ({KEYS}) LEFT JOIN gapm USING ({KEYS}) LEFT JOIN mx USING ({KEYS}) LEFT JOIN fits USING ({KEYS}) LEFT JOIN temps USING ({KEYS}) LEFT JOIN kms USING ({KEYS}) LEFT JOIN typed USING ({KEYS})"""

PAIRS = ", ".join(f"('{x}', '{y}')" for x, ys in PARTNERS.items() for y in ys)
SHARES = ", ".join(f"CASE WHEN moving_s - below_s > 0 THEN CAST(round(z{k}_s / (moving_s - below_s) * 100) AS BIGINT) ELSE 0 END AS z{k}_pct" for k in range(1, 6))
ZONE_ROWS = ", ".join(f"{{'place': {len(CATALOGUE) + k}, 'group': '{ZONES}', 'label': 'Zone {k}', 'value': CASE WHEN z.moving_s IS NULL THEN '{NO_HR}' ELSE {int(lo)} + m.track_id % 4 * 7 || '" + (f"–' || {int(ZONE_BOUNDS[k]) - 1} + m.track_id % 4 * 7 || '" if k < 5 else "+") + f" bpm, ' || CASE WHEN z.moving_s - z.below_s > 0 THEN CAST(round(z.z{k}_s / (z.moving_s - z.below_s) * 100) AS BIGINT) ELSE 0 END || '%, ' || {clock(f'z.z{k}_s')} END}}" for k, lo in enumerate(ZONE_BOUNDS, 1))
METRIC_ROWS = ", ".join(f"{{'place': {k + 1}, 'group': '{g}', 'label': '{n}', 'value': coalesce({shown(kind, 'm.' + c)}, '{UNAVAILABLE}')}}" for k, (g, n, c, kind) in enumerate(CATALOGUE))
LONG = f"SELECT track_id, sector_id, r.place AS place, r.group AS \"group\", r.label AS label, r.value AS value FROM (SELECT m.track_id, m.sector_id, unnest([{METRIC_ROWS}, {ZONE_ROWS}]) AS r FROM ({METRICS}) m LEFT JOIN ztime z ON z.track_id = m.track_id AND z.sector_id = m.sector_id)"
FORMATS = {"distance": ("distance", "floor(cum_dist) + 0.26"), "far": ("distance", "(floor(cum_dist) + 0.26) * 40"), "elevation": ("elevation", "floor(ele) + 0.26"), "signed": ("signed", "floor(ele) + 0.26 - 1000"), "speed": ("speed", "CAST(seq AS DOUBLE) / 32 + 0.013"), "pace": ("pace", "floor(cad) * 5.0 + 0.26"), "vam": ("vam", "cad * 11 + 0.26"), "temp": ("temp", "temp + 0.26"), "grade": ("grade", "CAST(seq - 300 AS DOUBLE) / 1000 + 0.00013"), "bpm": ("bpm", "hr"), "power": ("power", "power")}


def formats(imperial: bool) -> str:
    columns = ", ".join(f"{shown(kind, v, imperial)} AS {n}" for n, (kind, v) in FORMATS.items())
    return f"SELECT track_id, seq, {columns}, CAST(cad AS INT) || CASE WHEN track_id % 2 = 1 THEN ' spm' ELSE ' rpm' END AS cadence FROM p"


def sector_ends(imperial: bool, a: str = "floor(start_m) + 0.26", b: str = "floor(end_m) + 0.26") -> str:
    turn = 1609.344 if imperial else 1000
    short = lambda v: num(f"({v}) / 0.3048") + " || ' ft'" if imperial else num(v) + " || ' m'"
    long = lambda v: num(f"({v}) / {turn}", 2) + (" || ' mi'" if imperial else " || ' km'")
    return f"CASE WHEN {b} - ({a}) < {turn} THEN {short(a)} || ' – ' || {short(b)} ELSE {long(a)} || ' – ' || {long(b)} END"


def tagged(tag: str, v: str) -> str:
    return f"coalesce('<{tag}>' || {v} || '</{tag}>', '')"


SENSORS = " || ".join(tagged(f"gpxtpx:{t}", c) for t, c in (("hr", "hr"), ("cad", "cad"), ("atemp", "temp"), ("speed", "speed")))
INSIDE = tagged("power", "power") + f" || CASE WHEN {SENSORS} <> '' THEN '<gpxtpx:TrackPointExtension>' || {SENSORS} || '</gpxtpx:TrackPointExtension>' ELSE '' END"
GPX = f"""SELECT track_id, sector_id, '<gpx version="1.1" creator="pacewright" xmlns="http://www.topografix.com/GPX/1/1" xmlns:gpxtpx="http://www.garmin.com/xmlschemas/TrackPointExtension/v2"><metadata><name>' || track_id || '</name><desc>' || {sector_ends(False, 'start_m', 'end_m')} || '</desc></metadata><trk><trkseg>' || string_agg(xml, '' ORDER BY seq) || '</trkseg></trk></gpx>' AS gpx
  FROM sec JOIN (SELECT track_id, seq, cum_dist, '<trkpt lat="' || lat || '" lon="' || lon || '">' || {tagged('ele', 'ele')} || '<time>' || strftime(make_timestamp(time_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z</time>' || CASE WHEN {INSIDE} <> '' THEN '<extensions>' || {INSIDE} || '</extensions>' ELSE '' END || '</trkpt>' AS xml FROM p) USING (track_id)
  WHERE cum_dist BETWEEN start_m - 1e-6 AND end_m + 1e-6 GROUP BY track_id, sector_id, start_m, end_m"""
WHOLE = {"sec": "SELECT track_id, 0 AS sector_id, CAST(0 AS DOUBLE) AS start_m, total_distance AS end_m FROM tr"}
#: Tables of the chain that a query has otherwise.
INSTEAD = {
    **{n: WHOLE for n in ("track_stats", "sink_metrics_long", "sink_metrics_csv", "sink_metrics_txt", "sink_metrics_md")},
    "segment_table": {"sec": "SELECT track_id, sector_id, start_m, end_m FROM wsec"},
}

QUANT = ["hr", "power", "cad", "temp", "grade", "ele", "speed", "pace", "gap"]

#: name: last SELECT
FINAL: dict[str, str] = {
    "haversine": f"SELECT track_id, seq, {hav('lat', 'lon', 'lat + 0.01', 'lon - 0.02')} AS d FROM pn WHERE dd IS NOT NULL",
    "segment_3d": "SELECT track_id, seq, sqrt(dd * dd + dz * dz) AS d3 FROM pn WHERE dd IS NOT NULL",
    "minetti_factor": f"SELECT track_id, seq, {minetti('(dz / dd)')} AS factor FROM pn WHERE dd > 0",
    "speed_to_pace": "SELECT track_id, seq, CASE WHEN speed > 0 THEN 1000 / speed END AS pace FROM p",
    "speed_implausible": "SELECT track_id, seq, coalesce(dt > 0 AND dd >= 0 AND speed > 1.5 * dd / dt, false) AS implausible FROM pn",
    "unit_convert": "SELECT track_id, seq, ele / 0.3048 AS feet, cum_dist / 1609.344 AS miles, speed * 3.6 AS kmh, speed * 2.2369362920544 AS mph, CASE WHEN speed > 0 THEN 1000 / speed END * 1.609344 AS pace_mile, temp * 9 / 5 + 32 AS fahrenheit FROM p",
    "cadence_display": "SELECT track_id, seq, cad * (track_id % 2 + 1) AS cad FROM p",
    "tile_fraction": f"SELECT track_id, seq, {X12.replace('lon', '(lon + seq * 3)')} AS x, CASE WHEN lat + seq % 50 <= 85.0511287 THEN {Y12.replace('lat', '(lat + seq % 50)')} END AS y FROM p",
    "terrarium_decode": "SELECT track_id, seq, CASE WHEN e BETWEEN -12000 AND 9000 THEN e END AS e FROM (SELECT *, (cad + seq % 150) * 256 + seq % 256 + (track_id % 256) / 256.0 - 32768 AS e FROM (SELECT track_id, seq, cad FROM p))",
    "parse_iso_time": "SELECT track_id, seq, CASE WHEN seq % 9 <> 4 THEN time_ms END AS ms FROM p",
    "parse_number": "SELECT track_id, seq, CASE WHEN seq % 9 NOT IN (4, 5) THEN ele END AS v FROM p",
    "format_duration": "SELECT track_id, seq, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration FROM (SELECT track_id, seq, CAST(floor((time_ms - 1704067200000) / 1000 * 3 + 0.25) AS BIGINT) AS s FROM p)",
    "format_bpm_range": "SELECT track_id, seq, CASE WHEN hr IS NULL THEN NULL WHEN seq % 3 > 0 THEN CAST(hr AS INT) || '–' || CAST(hr + 9 AS INT) || ' bpm' ELSE CAST(hr AS INT) || '+ bpm' END AS range, CAST(cad AS INT) || '%' AS percent FROM p",
    "zone_bounds": "SELECT track_id, zone, lo, hi FROM hz",
    "zone_display_range": "SELECT track_id, zone, CAST(ceil(lo + 0.5) AS BIGINT) AS shown_lo, CAST(ceil(hi) - 1 AS BIGINT) AS shown_hi FROM hz",
    "zone_boundary_pct": "SELECT track_id, zone, 100 * CASE md WHEN 0 THEN lo / max_hr WHEN 1 THEN (lo - rest_hr) / (max_hr - rest_hr) ELSE lo / lthr END AS pct FROM hz",
    "validate_hr_settings": "SELECT track_id, CASE WHEN max_hr > 260 THEN 'max_hr' WHEN lthr >= max_hr THEN 'lthr' WHEN track_id % 11 = 5 OR track_id % 13 = 3 OR track_id % 17 = 4 THEN 'order' END AS error FROM hs",
    "normalize_sector": "SELECT track_id, sector_id, CASE WHEN b - a < 5 THEN greatest(0, least(a, least(a + 5, t) - 5)) ELSE a END AS start_m, CASE WHEN b - a < 5 THEN least(a + 5, t) ELSE b END AS end_m FROM (SELECT track_id, sector_id, total_distance AS t, greatest(0, least(least(end_m * 1.3 - 400, start_m), total_distance)) AS a, greatest(0, least(greatest(end_m * 1.3 - 400, start_m), total_distance)) AS b FROM sec JOIN tr USING (track_id))",
    "is_entire_track": "SELECT track_id, sector_id, start_m <= 0.5 AND end_m >= total_distance - 0.5 AS entire FROM (SELECT * FROM sec UNION ALL SELECT track_id, 5000, 0.25, total_distance FROM tr) JOIN tr USING (track_id)",
    "sector_context_window": "SELECT track_id, sector_id, CASE WHEN w < t THEN s END AS win_start, CASE WHEN w < t THEN s + w END AS win_end FROM (SELECT *, least(greatest((start_m + end_m) / 2 - w / 2, 0), t - w) AS s FROM (SELECT *, total_distance AS t, least(greatest((end_m - start_m) / 0.82, 100), total_distance) AS w FROM sec JOIN tr USING (track_id)))",
    "parse_elevation_tag": "SELECT response_id, pos, metres FROM el",
    "localized_name": "SELECT response_id, pos, shown_name AS name FROM el",
    "landmark_label": f"SELECT response_id, pos, concat_ws(chr(10), shown_name, CASE WHEN lower(nullif(name, '')) <> lower(shown_name) THEN name END, {shown('elevation', 'metres')}) AS label FROM el",
    "landmark_gate": "SELECT key, gate, z[1] AS icon_zoom, z[2] AS text_zoom FROM (SELECT *, CASE gate " + " ".join(f"WHEN '{g}' THEN [CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)]" for g, (a, b) in GATES.items()) + " END AS z FROM shown)",
    "landmark_features": """SELECT key, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']},"properties":{"class":"' || class || '","label":"' || replace(label, chr(10), '\\n') || '","gate":"' || gate || '","sort":' || CASE gate """ + " ".join(f"WHEN '{g}' THEN {k + 1}" for k, g in enumerate(GATES)) + " END || '}}' AS feature FROM shown",
    "scan_landmarks": "SELECT response_id, pos, class, lat, lon FROM marks",
    "scan_tile_peaks": "SELECT key, pos, class, rank FROM tiles",
    "dedup_landmarks": "SELECT key, place AS pos FROM dedup",
    "merge_landmarks": "WITH h AS (SELECT key, class, min(place) AS pos FROM marks WHERE response_id % 2 = 0 GROUP BY 1, 2) SELECT key, class, pos FROM h UNION ALL SELECT key, class, min(place) FROM marks WHERE response_id % 2 = 1 AND key NOT IN (SELECT key FROM h) GROUP BY 1, 2",
    "landmarks_near_track": f"SELECT n.track_id, n.wp_seq, m.class, n.dist, n.off_track FROM ({nearest('(SELECT response_id AS track_id, pos AS wp_seq, lat, lon FROM marks)')}) n JOIN marks m ON m.response_id = n.track_id AND m.pos = n.wp_seq WHERE n.off_track <= 250",
    "format_metric": formats(False),
    "format_imperial": formats(True),
    "format_sector_range": f"SELECT track_id, sector_id, {sector_ends(False)} AS range, {sector_ends(True)} AS imperial FROM sec",
    "migrate_hr_settings": """SELECT track_id, error, array_to_string(CASE WHEN error IS NULL THEN list_transform([50, 60, 70, 80, 90], lambda p: CAST(round(p * max_hr / 100.0) AS INT)) ELSE [95, 114, 133, 152, 171] END, ',') AS b_max, array_to_string(CASE WHEN error IS NULL THEN list_transform([50, 60, 70, 80, 90], lambda p: CAST(round(rest_hr + p * (max_hr - rest_hr) / 100.0) AS INT)) ELSE [125, 138, 151, 164, 177] END, ',') AS b_hrr, array_to_string(CASE WHEN error IS NULL THEN list_transform([60, 70, 80, 90], lambda p: CAST(round(p * lthr / 100.0) AS INT)) ELSE [102, 119, 136, 153] END, ',') AS b_lthr
      FROM (SELECT *, CASE WHEN max_hr > 260 THEN 'max_hr' WHEN lthr >= max_hr THEN 'lthr' END AS error FROM hs)""",
    "sigma_repair": f"SELECT track_id, seq, fixed FROM ({repaired('(SELECT *, dd / dt AS v FROM pn)', 'PARTITION BY track_id', 'seq', 'v')})",
    "grade_series": "SELECT track_id, seq, grade FROM gs",
    "grade_reading": "SELECT track_id, seq, reading FROM gr",
    "nearest_on_track": "SELECT track_id, wp_seq, dist, off_track FROM wpn",
    "resolve_waypoints": "SELECT track_id, wp_seq, name, dist FROM rsv",
    "split_by_waypoint": "SELECT * FROM wsec",
    "track_stats": METRICS,
    "segment_table": f"SELECT * FROM ({METRICS}) LEFT JOIN (SELECT * EXCLUDE (moving_s) FROM ztime) USING ({KEYS})",
    "sector_totals": f"SELECT segment_type, count(*) AS sectors, sum(horizontal_m) AS horizontal_m, sum(gain) AS gain, sum(loss) AS loss, sum(moving_s) AS moving_s, GROUPING(segment_type) AS level, sum(moving_s) / sum(horizontal_m) * 1000 AS pace FROM ({METRICS}) GROUP BY ROLLUP (segment_type)",
    "time_to_dist": "SELECT q.track_id, k, CASE WHEN n.next_ms IS NULL THEN n.cum_dist ELSE n.cum_dist + (n.next_cum - n.cum_dist) * (q.ms - n.time_ms) / (n.next_ms - n.time_ms) END AS dist_m FROM (SELECT *, d * 300 + 1704067200000 AS ms FROM req) q LEFT JOIN pn n ON n.track_id = q.track_id AND n.time_ms <= q.ms AND (n.next_ms > q.ms OR n.next_ms IS NULL)",
    "bridge_interpolate": "SELECT track_id, k, CASE WHEN a.x = d THEN a.v WHEN b.x IS NOT NULL THEN a.v + (b.v - a.v) * (d - a.x) / (b.x - a.x) END AS hr FROM (SELECT q.track_id, q.k, any_value(q.d) AS d, arg_max({'x': p.cum_dist, 'v': p.hr}, p.seq) FILTER (WHERE p.cum_dist <= q.d) AS a, arg_min({'x': p.cum_dist, 'v': p.hr}, p.seq) FILTER (WHERE p.cum_dist > q.d) AS b FROM req q JOIN p ON p.track_id = q.track_id AND p.hr IS NOT NULL WHERE q.d >= 0 GROUP BY 1, 2)",
    "split_by_length_drop": SPLIT_DROP,
    "split_by_length_fold": SPLIT,
    "scan_detect_format": "SELECT 'f' || track_id || '-' || seq || CASE WHEN seq % 60 >= 30 THEN '.TCX' ELSE '' END AS path, CASE WHEN seq % 60 >= 30 THEN 'tcx' ELSE ['gpx', 'kmz', 'kml', 'tcx', 'fit', 'unsupported'][seq % 6 + 1] END AS format FROM p",
    "scan_device_records": f"SELECT CAST(track_id AS VARCHAR) AS doc, seq, lat, lon, fixed AS ele, hr, cad, v AS speed FROM ({interpolated('(SELECT * REPLACE (CASE WHEN seq % 8 <> 1 THEN ele END AS ele), coalesce(speed, 1.25 + seq % 3 * 0.1) AS v FROM p WHERE seq % 29 <> 3)', 'PARTITION BY track_id', 'seq', 'ele')})",
    "sink_sector_gpx": GPX,
    "sink_metrics_long": LONG,
    "sink_metrics_csv": f"SELECT track_id, sector_id, label, value FROM ({LONG})",
    "sink_metrics_txt": f"SELECT track_id, sector_id, string_agg(label || chr(9) || value, chr(10) ORDER BY place) AS text FROM ({LONG}) GROUP BY 1, 2",
    "sink_metrics_md": f"""SELECT track_id, sector_id, string_agg('## ' || g || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '| --- | --- |' || chr(10) || rows, chr(10) || chr(10) ORDER BY place) AS text FROM (SELECT track_id, sector_id, "group" AS g, min(place) AS place, string_agg('| ' || label || ' | ' || value || ' |', chr(10) ORDER BY place) AS rows FROM ({LONG}) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "stream_pauses": "SELECT track_id, min(before) AS t0_us, max(us) AS t1_us, sum(dt) AS seconds FROM (SELECT *, max(island) OVER (PARTITION BY track_id) AS latest FROM ev2), mark WHERE before IS NOT NULL AND NOT moving AND dt <= 86400 GROUP BY track_id, island, latest, now HAVING sum(dt) >= 10 AND (island < latest OR max(us) + 86400000000 <= now)",
    "stream_gain": f"SELECT track_id, f.n AS n, f.g AS gain, f.l AS loss, {RATE.format(s='f.up', m='f.g', n='vam')}, {RATE.format(s='f.down', m='f.l', n='vdm')} FROM eg",
    "stream_zone_time": f"SELECT track_id, us // 3600000000 * 3600000000 AS start_us, {' + '.join(f'CAST(hr >= {b} AS INT)' for b in ZONE_BOUNDS)} AS zone, sum(dt) AS seconds, count(*) AS readings FROM ev1 GROUP BY 1, 2, 3",
    "track_points": "SELECT track_id, seq, lat, lon, ele, time_ms, hr, cad, power, temp, speed FROM p",
    "cum_distance": "SELECT track_id, seq, seg_m, cum_dist FROM p",
    "track_summary": "SELECT * FROM tr",
    "fill_ele_gaps": f"SELECT track_id, seq, fixed AS ele FROM ({interpolated('gappy', 'PARTITION BY track_id', 'seq', 'ele')})",
    "cadence_convention": "SELECT track_id, CASE WHEN n < 30 OR greatest(s, d) < 0.55 THEN 'unknown' WHEN s >= d THEN 'single' ELSE 'double' END AS convention, CASE WHEN n >= 30 AND greatest(s, d) >= 0.55 AND s >= d THEN 2 ELSE 1 END AS factor FROM (SELECT track_id, count(*) AS n, avg(CASE WHEN k BETWEEN 1.6 AND 2.4 THEN 1.0 ELSE 0 END) AS s, avg(CASE WHEN k BETWEEN 0.7 AND 1.4 THEN 1.0 ELSE 0 END) AS d FROM (SELECT track_id, CAST(1.25 + seq % 3 * 0.1 AS DOUBLE) * 60 / ([500, 1000, 2000][track_id % 3 + 1] / 1000.0) / cad AS k FROM p WHERE cad > 0) GROUP BY 1)",
    "speed_series": "SELECT track_id, seq, raw_speed, clean_speed FROM sp",
    "smooth5": f"SELECT track_id, seq, avg(hr) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hr5 FROM p",
    "sigma_filter": "SELECT track_id, seq FROM (SELECT *, power * power AS v, avg(power * power) OVER (PARTITION BY track_id) AS mu, stddev_pop(power * power) OVER (PARTITION BY track_id) AS sg FROM p) WHERE abs(v - mu) <= 3 * sg",
    "gap_speed_series": f"SELECT track_id, seq, CASE WHEN dd > 0 AND dz IS NOT NULL THEN clean_speed / {minetti('(dz / dd)')} END AS gap_speed FROM sp",
    "elapsed_axis": f"SELECT track_id, seq, greatest(0, time_ms - first_value(time_ms) OVER {W}) AS elapsed_ms FROM p",
    "series_extremes": f"SELECT track_id, series, min(v) AS lo, max(v) AS hi FROM (SELECT track_id, unnest(['ele', 'hr', 'cad', 'power', 'temp', 'clean_speed', 'gap_speed']) AS series, unnest([ele, hr, cad, power, temp, clean_speed, CASE WHEN dd > 0 AND dz IS NOT NULL THEN clean_speed / {minetti('(dz / dd)')} END]) AS v FROM sp) GROUP BY 1, 2",
    "series_range": "SELECT track_id, series, CASE WHEN series = 'ele' THEN lo - greatest(0.08 * (hi - lo), 4) ELSE greatest(0, lo - pad) END AS y_min, CASE WHEN series = 'ele' THEN hi + greatest(0.08 * (hi - lo), 4) WHEN series = 'clean_speed' THEN hi ELSE hi + pad END AS y_max FROM (SELECT *, CASE WHEN greatest(0.08 * (hi - lo), 0.04 * abs(hi + lo) / 2) > 0 THEN greatest(0.08 * (hi - lo), 0.04 * abs(hi + lo) / 2) ELSE 1 END AS pad FROM (SELECT track_id, series, min(v) AS lo, max(v) AS hi FROM (SELECT track_id, unnest(['ele', 'hr', 'cad', 'clean_speed']) AS series, unnest([ele, hr, cad, clean_speed]) AS v FROM sp) GROUP BY 1, 2))",
    "overlay_availability": "SELECT track_id, has_hr AS hr, has_cad AS cad, has_power AS power, has_temp AS temp, has_time OR has_recorded_speed AS speed, (has_time OR has_recorded_speed) AND has_elevation AS gap, has_elevation AS grade FROM tr",
    "thin_stride": "SELECT track_id, seq FROM (SELECT track_id, seq, count(*) OVER (PARTITION BY track_id) AS n FROM p) WHERE seq % CAST(ceil(n / 100.0) AS BIGINT) = 0 OR seq = n - 1",
    "concat_segments": "SELECT CAST(track_id AS VARCHAR) AS doc, 3 - seq // 200 AS part, seq AS place, row_number() OVER (PARTITION BY track_id ORDER BY 3 - seq // 200, seq) - 1 AS seq, ele FROM p",
    "point_at_distance": "SELECT track_id, k, d, i, t, lat, lon, ele, time_ms, dist FROM reqs",
    "probe_reading": f"SELECT q.track_id, k, q.ele, n.hr, CASE WHEN n.hr IS NOT NULL THEN (SELECT coalesce(max(zone), 0) FROM zn WHERE lo <= n.hr AND zn.track_id = q.track_id) END AS zone, n.cad, n.power, n.temp, n.clean_speed AS speed, CASE WHEN n.clean_speed > 0 THEN 1000 / n.clean_speed END AS pace, CASE WHEN n.dd > 0 AND n.clean_speed > 0 THEN 1000 / (n.clean_speed / {minetti('(n.dz / n.dd)')}) END AS gap, g.reading AS grade FROM reqs q LEFT JOIN sp n ON n.track_id = q.track_id AND n.seq = q.i + CASE WHEN q.t < 0.5 THEN 0 ELSE 1 END LEFT JOIN gr g ON g.track_id = n.track_id AND g.seq = n.seq",
    "dist_to_time": "SELECT track_id, k, time_ms FROM reqs",
    "classify_hr_zone": "SELECT track_id, seq, CASE WHEN hr IS NOT NULL THEN (SELECT coalesce(max(zone), 0) FROM zn WHERE lo <= hr AND zn.track_id = p.track_id) END AS zone FROM p",
    "pair_filter": f"SELECT * FROM (SELECT track_id, seq, {QUANT}[seq // 9 % 9 + 1] AS x_name, {QUANT}[seq % 9 + 1] AS y_name FROM p) WHERE (x_name, y_name) IN ({PAIRS})",
    "dem_sample": "SELECT track_id, seq, dem_ele FROM ds",
    "dem_tiles_needed": "SELECT DISTINCT gx // 512 AS tx, gy // 512 AS ty FROM corner",
    "ele_fill": "SELECT track_id, seq, coalesce(ele, dem_ele) AS ele, ele AS ele_original FROM ds",
    "ele_replace": "SELECT track_id, seq, coalesce(dem_ele, ele) AS ele, ele AS ele_original FROM ds",
    "ele_restore": "SELECT track_id, seq, ele FROM ds",
    "ele_apply": "SELECT *, CASE WHEN candidates = 0 THEN 'nothing-to-fill' WHEN applied = 0 THEN 'failed-all' ELSE 'applied' END AS status FROM (SELECT track_id, sum(CASE WHEN ele IS NULL THEN 1 ELSE 0 END) AS candidates, sum(CASE WHEN ele IS NULL AND dem_ele IS NOT NULL THEN 1 ELSE 0 END) AS applied, sum(CASE WHEN ele IS NULL AND dem_ele IS NULL THEN 1 ELSE 0 END) AS failed, bool_and(coalesce(ele, dem_ele) IS NOT NULL) AS has_elevation, CASE WHEN bool_and(coalesce(ele, dem_ele) IS NOT NULL) THEN min(coalesce(ele, dem_ele)) END AS ele_min, CASE WHEN bool_and(coalesce(ele, dem_ele) IS NOT NULL) THEN max(coalesce(ele, dem_ele)) END AS ele_max FROM ds GROUP BY 1)",
    "sector_walk": "SELECT track_id, sector_id, step, to_dist, to_ele, to_ms, seg_h, d_ele, dt FROM wk WHERE step > 0",
    "pause_spans": "SELECT track_id, sector_id, min(from_ms) AS t0, max(to_ms) AS t1 FROM wk WHERE paused GROUP BY track_id, sector_id, island",
    "pause_mask": "SELECT track_id, sector_id, vseq, paused FROM wk WHERE kind = 'point'",
    "pause_overlap": "SELECT track_id, sector_id, vseq FROM wk WHERE kind <> 'end' AND NOT (kind = 'point' AND paused)",
    "sector_distance": "SELECT * FROM dist",
    "sector_gain_loss": "SELECT track_id, sector_id, gain, loss FROM fold",
    "sector_elevation": "SELECT * FROM elev",
    "sector_grades": "SELECT track_id, sector_id, max_grade, min_grade FROM fold",
    "moving_time": "SELECT * FROM mov",
    "avg_speed": "SELECT * FROM spd",
    "avg_gap": "SELECT * FROM gapm",
    "max_speed": "SELECT * FROM mx",
    "vertical_rates": f"SELECT track_id, sector_id, {RATE.format(s='climb_s', m='gain', n='vam')}, {RATE.format(s='descend_s', m='loss', n='vdm')} FROM fold",
    "fitness_stats": "SELECT * FROM fits",
    "temp_stats": "SELECT * FROM temps",
    "fastest_slowest_km": "SELECT * FROM kms",
    "effort_distance": "SELECT track_id, sector_id, horizontal_m + gain * 10 AS effort_distance, CASE WHEN horizontal_m > 0 AND NOT (gain = 0 AND loss > 0) THEN gain / horizontal_m END AS avg_grade FROM dist JOIN fold USING (track_id, sector_id)",
    "segment_type": "SELECT track_id, sector_id, segment_type AS kind FROM typed",
    "sector_metrics": METRICS,
    "sector_leaderboard": f"SELECT segment_type, place, track_id, sector_id, avg_pace FROM (SELECT *, row_number() OVER (PARTITION BY segment_type ORDER BY avg_pace, track_id, sector_id) AS place FROM spd JOIN typed USING (track_id, sector_id) WHERE avg_pace IS NOT NULL) WHERE place <= 3",
    "hr_zone_time": "SELECT * FROM ztime",
    "zone_share_pct": f"SELECT track_id, sector_id, {SHARES} FROM ztime",
    "split_by_length": SPLIT_DROP,
    "grade_class": "SELECT track_id, seq, cls FROM cls",
    "grade_runs": "SELECT * FROM runs",
    "split_by_grade": "SELECT track_id, unnest(range(len(s))) AS sector_id, unnest(s).b AS start_m, unnest(s).e AS end_m FROM merging WHERE len(s) = 1 OR list_min(list_transform(s, lambda x: x.e - x.b)) >= 400",
    "simplify_dp": "SELECT track_id, seq FROM dpk JOIN dpn USING (track_id) WHERE reach > lim",
    "cum_distance_by_blocks": "SELECT track_id, seq, seg_m, cum_dist FROM p",
    "sector_grade_windows": "SELECT * FROM gw",
    "analysis_samples": "SELECT * FROM samples",
    "metric_availability": "SELECT track_id, sector_id, " + ", ".join(f"count({q}) > 0 AS has_{q}" for q in QUANT) + " FROM samples GROUP BY 1, 2",
    "extract_pair": "SELECT * FROM pairs",
    "robust_domain": "SELECT * FROM dom",
    "density_2d": "SELECT * FROM dens",
    "relative_density": f"SELECT *, n / CAST(max(n) OVER ({SEC}) AS DOUBLE) AS share FROM dens",
    "scan_gpx": "SELECT CAST(track_id AS VARCHAR) AS doc, seq, lat, lon, ele, time_ms, hr, cad, power, temp, speed FROM p",
    "scan_gpx_route": "SELECT CAST(track_id AS VARCHAR) AS doc, seq, lat, lon, ele FROM p",
    "scan_gpx_waypoints": "SELECT CAST(track_id AS VARCHAR) AS doc, k AS wp_seq, lat, lon, CAST(ele AS DOUBLE) AS ele, name FROM (SELECT DISTINCT track_id FROM p), (VALUES (0, 45.5, 7.5, 900, 'Hut'), (2, 45.6, 7.6, NULL, NULL)) v(k, lat, lon, ele, name)",
    "scan_kml": "SELECT CAST(track_id AS VARCHAR) AS doc, seq, lat, lon, ele FROM p",
    "scan_kmz": "SELECT CAST(track_id AS VARCHAR) AS doc, seq, lat, lon, ele FROM p",
    "scan_kml_waypoints": "SELECT CAST(track_id AS VARCHAR) AS doc, k AS wp_seq, lat, lon, CAST(ele AS DOUBLE) AS ele, name FROM (SELECT DISTINCT track_id FROM p), (VALUES (0, 45.5, 7.5, 1000, 'Summit'), (1, 45.25, 7.25, NULL, 'a place')) v(k, lat, lon, ele, name)",
    "scan_tcx": f"SELECT CAST(track_id AS VARCHAR) AS doc, k AS seq, lat, lon, fixed AS ele, time_ms, hr, cad, power, CAST(NULL AS DOUBLE) AS temp, speed FROM ({interpolated('(SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS k, lat, lon, CASE WHEN seq % 7 <> 3 THEN ele END AS ele, time_ms, hr, cad, power, speed FROM p WHERE seq % 31 <> 4)', 'PARTITION BY track_id', 'k', 'ele')})",
    "sink_parquet": "SELECT track_id, point_count, total_distance FROM tr",
    "ingest_errors": "SELECT CAST(track_id AS VARCHAR) AS doc, ['unsupported', 'invalid', 'noTrack', 'kmzNoKml', 'invalid'][track_id % 6] AS error FROM tr WHERE track_id % 6 > 0",
}


#: Queries whose chain refers to itself; elsewhere tables that are read twice are to be made once.
RECURSIVE = {"simplify_dp", "split_by_grade"}


def _chain(query: str, instead: dict[str, str]) -> str:
    """The tables that a query reads, directly or over others, in order."""
    tables, wanted = {**CHAIN, **instead}, set()
    todo = [query]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = [n for n in tables if n in words and n not in wanted]
        wanted.update(new)
        todo += [tables[n] for n in new]
    return ",\n".join(f"{n} AS ({q})" for n, q in tables.items() if n in wanted)


def oracle_sql() -> dict[str, str]:
    import duckdb

    out = {}
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_extendedprice DOUBLE, l_quantity DOUBLE, l_shipdate DATE)")
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE)")
    for name, query in FINAL.items():
        digits = DIGITS.get(name, 3)
        start = "WITH RECURSIVE" if name in RECURSIVE else "WITH"
        sql = f"{start} {_chain(query, INSTEAD.get(name, {}))}\n{query}" if not query.startswith("WITH ") else f"{start} {_chain(query, {})},\n{query[5:]}"
        kinds = con.execute(f"DESCRIBE {sql}").fetchall()
        real = lambda t: t in ("DOUBLE", "FLOAT") or t.startswith("DECIMAL")
        shown_as = [f'round(CAST("{c}" AS DOUBLE) + 1e-7, {places(c, digits)}) + CAST(0 AS DOUBLE) AS "{c}"' if real(t) else f'CAST("{c}" AS BIGINT) AS "{c}"' if "INT" in t else f'"{c}"' for c, t, *_ in kinds]
        out[name] = f"SELECT {', '.join(shown_as)} FROM ({sql})"
    return out
