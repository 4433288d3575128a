"""Tables laid out by track: bucketed and sorted, so that windows and joins by track read them without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pacewright.sources.scratch import own_folder

BY = "track_id"
POINTS_A_TASK = 80_000  # a task's sorts and arrays over so many points stay under about 500 MB
READ_AT_ONCE = "4m"  # of shuffled bytes that one task takes


def sized(spark: SparkSession, points: int) -> int:
    """Partitions of the session's shuffles and buckets, so many at least that a task's share does not grow with the input.

    Adaptive execution puts small partitions together up to ``READ_AT_ONCE`` and no further. Larger numbers
    that the session has already stay. Rows that lie by track stay there in joins by track and more columns
    (blocks, places); what is to be dealt out by more columns says so.
    """
    need, has = -(-points // POINTS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if need > has:
        spark.conf.set("spark.sql.shuffle.partitions", need)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", READ_AT_ONCE)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # folders are listed by as many tasks, not by one for each folder
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", max(need, has))
    return max(need, has)


def write_by_track(df: DataFrame, table: str, path: str, buckets: int, order: tuple[str, ...] = ("seq",), by: tuple[str, ...] = (BY,), dealt: bool = False) -> DataFrame:
    """``df`` as the table ``table`` at ``path``: one file for each bucket of tracks, sorted by track and ``order``.

    Rows are dealt out by the function that buckets go by, so every bucket is written by one task. Plans over
    the table take a bucket for a partition; two tables with as many buckets join by track where they lie.
    ``dealt`` says that ``df`` ends in windows over ``by``, which have dealt its rows out that way already. Buckets may
    go by more columns than the track (``by``).
    """
    order = tuple(c for c in order if c in df.columns)
    d = df if dealt else df.repartition(buckets, *by)
    d.write.bucketBy(buckets, *by).sortBy(*by, *order).option("path", path).option("compression", "zstd").saveAsTable(table)
    return df.sparkSession.table(table)


def laid_by_track(df: DataFrame, name: str, buckets: int | None = None, **how) -> DataFrame:
    """``df`` laid out in the shared folder for the queries of this session."""
    spark, own = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    return write_by_track(df, own, own_folder(spark, name, own), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), **how)
