"""What the operators of this subpackage have in common: the shared folder, tables and columns."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewright.sources.scratch import removed, shared_folder
from pacewright.sources.scratch import stored as written

__all__ = ["bounded_batches", "hand_back", "in_python", "lean", "only", "released", "shared_folder", "table", "written"]

#: Bytes of a batch of rows on its way to Python, in the executor's JVM and in its worker.
BATCH_BYTES = 4 << 20


def hand_back() -> None:
    """Gives memory that was freed back to the system; Arrow and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(step: Callable) -> Callable:
    """A step over batches whose worker hands freed memory back when it ends: workers are used again for other steps,
    and what one of them once held would stay with it."""

    @functools.wraps(step)
    def run(batches: Iterator) -> Iterator:
        yield from step(batches)
        hand_back()

    return run


def bounded_batches(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_python(df: DataFrame, step: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, however long the texts are, by workers that keep nothing."""
    bounded_batches(df)
    return df.mapInArrow(lean(step), schema)


def released(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            removed(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns under internal names, whatever else ``df`` holds."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
