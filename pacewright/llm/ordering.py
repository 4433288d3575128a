"""Training-order materialisation: token sequences written in a keyed random order as fixed-stride shards.

Texts are encoded once: each input partition's sequences of ``stride`` ids are written in compressed blocks,
whose numbers of sequences number all of them through (the partitions' totals are summed on the driver, one
number a partition). A keyed Feistel permutation of the numbers, with cycle-walking onto 0..n-1, gives every
sequence its slot in training order; it needs no table and can be undone. Blocks are then dealt to ranges of
slots, without sorting: a shard is a range of slots and holds its sequences at ``stride`` ids each, so slot s
lies in shard s // per_shard at a known byte, a task puts each sequence where it belongs, and reading can
go on from any slot. The blocks are deleted once the shards are written.

Ids are little-endian unsigned 16-bit numbers if the vocabulary allows, else 32-bit. A shard is written
under a temporary name and then moved, so a task that is run again only writes the same file again; a shard
that lacks a sequence is an error.

All texts of a partition are laid end to end, each closed by the end id, and cut at ``stride``; a
partition's last sequence is filled up with the end id. A null text is empty (its end id only). Repeated rows
are written as often as they come; other columns are ignored. An empty table gives no sequences and no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewright.llm.shared import in_python, only, released, shared_folder, written
from pacewright.llm.textgrid import mixed
from pacewright.llm.tokens import TextEncoder

STRIDE, PER_SHARD, ROUNDS = 1024, 8192, 6
#: Sequences of a stored block and of a dealt buffer, and the level at which both are compressed.
BLOCK, HELD, LEVEL = 256, 8192, 6


class Permutation:
    """A keyed permutation of 0..n-1 and its inverse."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (mixed(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mixed(right + k) & self.mask)
        return (left << shift) | right

    def _walked(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, dtype=np.uint64), keys, back)
        while (out := np.flatnonzero(x >= self.n)).size:
            x[out] = self._once(x[out], keys, back)
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walked(numbers, self.keys, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walked(slots, self.keys[::-1], True)


def _store(path: str) -> tuple:
    """The file system of a path, and the path there."""
    from pyarrow import fs

    scheme, _, rest = path.rpartition("file:")  # Spark writes local names with any number of slashes
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "" and "://" not in rest else fs.FileSystem.from_uri(path)


def _encoded(given: DataFrame, model: str, end_id: int, kind: str, stride: int) -> DataFrame:
    """(part, at, count, ids): the sequences of each input partition in blocks, compressed; ``at`` numbers a block's first one."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, compress = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=LEVEL).compress
        encoder, end, total, made = TextEncoder(model), np.array([end_id], dtype=kind), 0, 0
        held: list[np.ndarray] = []

        def block(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            count = len(ids) // stride
            made += count
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([made - count]), pa.array([count]), pa.array([compress(ids.tobytes())])], names=["part", "at", "count", "ids"])

        for batch in batches:
            for ids in encoder.texts(batch.column(0)):
                held += [ids.astype(kind), end]
                total += len(ids) + 1
                if total >= BLOCK * stride:
                    stream = np.concatenate(held)
                    whole = len(stream) // stride * stride
                    yield block(stream[:whole])
                    held, total = [stream[whole:]], len(stream) - whole
        if total:
            stream = np.concatenate(held)
            yield block(np.append(stream, np.full(-len(stream) % stride, end_id, dtype=kind)))

    return in_python(given, encoded, "part long, at long, count long, ids binary")


def _dealt(encoded: DataFrame, first: dict[int, int], order: Permutation, kind: str, stride: int, per_shard: int) -> DataFrame:
    """(shard, slots, ids): what some blocks hold for one shard, compressed; slots are little-endian 64-bit numbers."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, compress = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=LEVEL).compress
        slots: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flushed() -> pa.RecordBatch:
            at, rows = np.concatenate(slots), np.concatenate(ids)
            by_slot = np.argsort(at)
            at = at[by_slot]
            cuts = [0, *(np.flatnonzero(np.diff(at // per_shard)) + 1).tolist(), len(at)]
            found = [(int(at[a]) // per_shard, at[a:b].astype("<i8").tobytes(), compress(rows[by_slot[a:b]].tobytes())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            slots.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["shard", "slots", "ids"])

        for batch in batches:
            for part, at, count, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                slots.append(order.slots(first[part] + at + np.arange(count)))
                ids.append(np.frombuffer(expand(raw, count * stride * np.dtype(kind).itemsize), dtype=kind).reshape(count, stride))
                if sum(map(len, slots)) >= HELD:
                    yield flushed()
        if slots:
            yield flushed()

    return in_python(encoded, dealt, "shard long, slots binary, ids binary")


def materialised(df: DataFrame, folder: str, key: int, text_column: str = "text", model: str = "byte_bpe_50k.json", end_id: int = 0, stride: int = STRIDE, per_shard: int = PER_SHARD, kind: str = "<u2") -> tuple[DataFrame, int]:
    """Writes the shards of all texts of ``df`` to ``folder``; returns a table of (shard, first_slot, sequences) and the
    number of sequences."""
    spark = df.sparkSession
    encoded = written(_encoded(only(df, text=text_column), model, end_id, kind, stride), "encoded")
    # one row for each input partition
    counts = {r["part"]: r["n"] for r in encoded.groupBy("part").agg(F.sum("count").alias("n")).collect()}
    parts = sorted(counts)
    first = dict(zip(parts, accumulate([0, *(counts[p] for p in parts)]), strict=False))
    n = sum(counts.values())
    shards = -(-n // per_shard)
    if not n:
        return spark.createDataFrame([], "shard long, first_slot long, sequences long"), 0

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        expand, now, held, done = zstandard.ZstdDecompressor().decompress, -1, None, 0

        def close() -> pa.RecordBatch:
            if done != len(held):
                raise ValueError(f"shard {now} has {done} of {len(held)} sequences")
            temporary = f"{root}/.{now}-{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(memoryview(held).cast("B"))
            store.move(temporary, f"{root}/{now:010d}.ids")
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([now * per_shard]), pa.array([done])], names=["shard", "first_slot", "sequences"])

        for batch in batches:
            for shard, slots, raw in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if shard != now:
                    if held is not None:
                        yield close()
                    now, done = shard, 0
                    held = np.empty((min(per_shard, n - shard * per_shard), stride), dtype=kind)
                at = np.frombuffer(slots.as_buffer(), dtype="<i8") - shard * per_shard
                held[at] = np.frombuffer(expand(raw.as_buffer(), len(at) * stride * held.itemsize), dtype=kind).reshape(-1, stride)
                done += len(at)
        if held is not None:
            yield close()

    # each task writes one range of slots: some neighbouring shards
    ranges = min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = _dealt(encoded, first, Permutation(n, key), kind, stride, per_shard)
    dealt = dealt.repartitionById(ranges, F.expr(f"cast(shard * {ranges} div {shards} as int)")).sortWithinPartitions("shard")
    made = written(in_python(dealt, filled, "shard long, first_slot long, sequences long"), "shards")
    released(encoded)
    return made, n


def _read(spark: SparkSession, folder: str, stride: int, per_shard: int, kind: str, from_slot: int, made_of: Callable, schema: str) -> DataFrame:
    """``made_of(slots, shard, ids)`` -> batch, over the shards in ``folder`` from a slot on, read through in runs of sequences."""
    size = stride * np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)  # names only, no content
    files = files.select("path", F.regexp_extract("path", r"(\d+)\.ids$", 1).cast("long").alias("shard")).filter(F.col("shard") >= from_slot // per_shard)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _store(path)
                at = max(from_slot, shard * per_shard)
                with store.open_input_file(name) as file:
                    file.seek((at - shard * per_shard) * size)
                    while raw := file.read(BLOCK * size):
                        ids = np.frombuffer(raw, dtype=kind).reshape(-1, stride)
                        yield made_of(np.arange(at, at + len(ids)), shard, ids)
                        at += len(ids)

    return in_python(files, read, schema)


def read_in_order(spark: SparkSession, folder: str, stride: int = STRIDE, per_shard: int = PER_SHARD, kind: str = "<u2", from_slot: int = 0) -> DataFrame:
    """(slot, shard, ids) of the shards in ``folder`` from a slot on; ids as they are in the files."""

    def rows(slots: np.ndarray, shard: int, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(slots), shard)), pa.array([x.tobytes() for x in ids])], names=["slot", "shard", "ids"])

    return _read(spark, folder, stride, per_shard, kind, from_slot, rows, "slot long, shard long, ids binary")


def training_order(df: DataFrame, key: int = 20240601, text_column: str = "text", model: str = "byte_bpe_50k.json") -> DataFrame:
    """Writes all texts of ``df`` in training order and reads the shards back: (slot, shard, sequence, ids_crc32)
    of every sequence, where ``sequence`` is its number before the permutation."""
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/order-{uuid.uuid4().hex}"
    schema = "slot long, shard long, sequence long, ids_crc32 long"
    n = materialised(df, folder, key, text_column, model)[1]
    if not n:
        return spark.createDataFrame([], schema)
    order = Permutation(n, key)

    def described(slots: np.ndarray, shard: int, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(slots), shard)), pa.array(order.numbers(slots)), pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["slot", "shard", "sequence", "ids_crc32"])

    return _read(spark, folder, STRIDE, PER_SHARD, "<u2", 0, described, schema)
