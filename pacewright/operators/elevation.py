"""Elevation correction from terrain; rows carry ``ele`` and ``dem_ele``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(points: DataFrame) -> DataFrame:
    """``ele_original`` holds what was recorded, however often corrections run."""
    return points if "ele_original" in points.columns else points.withColumn("ele_original", F.col("ele"))


def ele_fill(points: DataFrame) -> DataFrame:
    """Terrain only where no elevation was recorded."""
    d = _kept(points)
    return d.withColumn("ele", F.coalesce("ele_original", "dem_ele"))


def ele_replace(points: DataFrame) -> DataFrame:
    """Terrain wherever there is any."""
    d = _kept(points)
    return d.withColumn("ele", F.coalesce("dem_ele", "ele_original"))


def ele_restore(points: DataFrame) -> DataFrame:
    return points.withColumn("ele", F.col("ele_original")).drop("ele_original")


def ele_apply(points: DataFrame, mode: str = "fill") -> DataFrame:
    """One row per track: candidates, how many were applied or failed, the status, and the track's elevation flags after
    the correction (the rows themselves come from ``ele_fill`` and ``ele_replace``)."""
    wanted = F.col("ele").isNull() if mode == "fill" else F.lit(True)
    has = F.col("dem_ele").isNotNull()
    after = (ele_fill if mode == "fill" else ele_replace)(points.withColumn("_was", F.col("ele"))).withColumnsRenamed({"ele": "_ele", "_was": "ele"})
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("candidates", wanted), ("applied", wanted & has), ("failed", wanted & ~has))]
    counts = after.groupBy("track_id").agg(*sums, F.bool_and(F.col("_ele").isNotNull()).alias("has_elevation"), F.min("_ele").alias("ele_min"), F.max("_ele").alias("ele_max"))
    status = F.when(F.col("candidates") == 0, "nothing-to-fill").when(F.col("applied") == 0, "failed-all").otherwise("applied")
    return counts.withColumns({c: F.when(F.col("has_elevation"), F.col(c)) for c in ("ele_min", "ele_max")}).withColumn("status", status)
