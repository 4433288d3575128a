"""Tracks, sectors, waypoints, terrain and zones derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewright.functions.geo import TILE_PIXELS, tile_x, tile_y

#: The telemetry view; the same text runs in DuckDB.
TRACK_POINTS_SQL = """
SELECT track_id, seq,
       CAST(450000000 + sum(step7) OVER w AS DOUBLE) / 1e7 AS lat, CAST(7.0 AS DOUBLE) AS lon,
       CAST(10000 + sum(dz) OVER w AS DOUBLE) / 10 AS ele,
       CAST(1704067200000 + sum(dt_ms) OVER w AS BIGINT) AS time_ms,
       CASE WHEN seq % 17 = 5 THEN NULL ELSE CAST(90 + 2 * k AS DOUBLE) END AS hr,
       CAST(70 + k % 30 AS DOUBLE) AS cad,
       CASE WHEN seq % 23 = 7 THEN NULL ELSE CAST(v % 400 AS DOUBLE) END AS power,
       CAST(15 + floor(seq / 60.0) AS DOUBLE) AS temp,
       CASE WHEN track_id % 2 = 1 AND dt_ms > 0
            THEN CAST(step7 AS DOUBLE) * 11.1195 / dt_ms * CASE WHEN seq % 53 = 0 THEN 3 ELSE 1 END END AS speed
FROM (
  SELECT *, CASE WHEN seq = 0 OR seq % 97 BETWEEN 40 AND 45 OR ok % 13 = 0 THEN 0 ELSE 300 + v % 1200 END AS step7,
         CASE WHEN seq = 0 THEN 0 ELSE 1000 * (1 + k % 5) END AS dt_ms,
         CASE WHEN seq = 0 THEN 0 ELSE v % 61 - 30 + CASE WHEN floor(seq / 40.0) % 2 = 0 THEN 6 ELSE -6 END END AS dz
  FROM (
    SELECT l_suppkey AS track_id,
           CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS INT) AS seq,
           l_orderkey AS ok, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, CAST(l_quantity AS INT) AS k
    FROM {lineitem}) b) s
WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

ZONE_BOUNDS = [95.0, 114.0, 133.0, 152.0, 171.0]


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key has its later name from the start: Spark takes a renamed one for another, and would deal all rows out again
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_suppkey", "track_id")
    return spark.sql(TRACK_POINTS_SQL.replace("l_suppkey AS track_id", "track_id").replace("l_suppkey", "track_id"), lineitem=d)


def point_count(spark: SparkSession, sf_dir: str) -> int:
    """From the ends of the files, without reading a row."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def waypoints(points: DataFrame) -> DataFrame:
    side = F.lit(1e-4) * ((F.floor(F.col("seq") / 75) + F.col("track_id")) % 9)
    return points.filter("seq % 75 in (30, 36)").select("track_id", F.col("seq").alias("wp_seq"), "lat", (F.col("lon") + side).alias("lon"), F.concat(F.lit("CP"), "seq").alias("name"))


def terrain(points: DataFrame) -> DataFrame:
    """Coded pixels (gx, gy, r, g, b) around the points, some of them missing."""
    gx, gy = F.floor(tile_x(F.col("lon")) * TILE_PIXELS), F.floor(tile_y(F.col("lat")) * TILE_PIXELS)
    corners = F.array(*[F.struct((gx + i).alias("gx"), (gy + j).alias("gy")) for i in (0, 1) for j in (0, 1)])
    pixels = points.select(F.inline(corners)).distinct().filter("(gx + gy) % 11 <> 0")
    code = F.expr("1000 + (gx * 7 + gy * 13) % 200 + 32768")
    return pixels.select("gx", "gy", (code / 256).cast("int").alias("r"), (code % 256).cast("int").alias("g"), F.lit(0).alias("b"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, zone, lo, hi): each track's own zones, four settings in turn; the last zone is open."""
    from pacewright.operators.zones import zone_bounds

    tracks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("track_id")).distinct()
    return zone_bounds(tracks.select("track_id", F.array(*[F.lit(b) + F.col("track_id") % 4 * 7 for b in ZONE_BOUNDS]).alias("bounds")))
