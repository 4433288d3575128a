"""Packing documents into fixed windows: bounded-space online best fit.

Every input partition is packed as it is read, with a fixed number of open windows. A document's ids,
closed by an end id, go into the open window they leave least room in; where none has room, the fullest
window is filled with a first part of them and emitted, so no emitted window holds padding. Windows
still open at a partition's end are merged: those of a group of neighbouring partitions are packed again
in one bounded task. Only what is open at the end of a group is emitted short and padded, unless its
length is a power of two.

A null text counts as empty (its only id is the end id); an empty table gives no piece; repeated rows
are packed as often as they come; a document of any length is cut into as many windows as it needs. Null ids are
kept as they are: their pieces are known by sequence and offset. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pacewright.llm.shared import in_python, only, written
from pacewright.llm.tokens import TextEncoder

WINDOW, OPEN_WINDOWS, MERGED_PARTITIONS = 1024, 64, 32
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Open windows of ``size`` ids; pieces are (key, start, ids, tokens of the whole document)."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.open: list[list[tuple]] = []
        self.room: list[int] = []

    def add(self, key, start: int, ids: np.ndarray, total: int) -> Iterator[tuple[int, list[tuple]]]:
        """Places one run of ids; yields windows that became full, as (sequence id, pieces)."""
        while len(ids):
            if len(ids) >= self.size:
                yield self._emit([(key, start, ids[: self.size], total)])
                start, ids = start + self.size, ids[self.size :]
                continue
            fitting = [(r, k) for k, r in enumerate(self.room) if r >= len(ids)]
            if not fitting and len(self.open) < self.most:
                self.open.append([])
                self.room.append(self.size)
                fitting = [(self.size, len(self.open) - 1)]
            room, k = min(fitting) if fitting else min(zip(self.room, range(self.most), strict=True))
            put = ids[:room]
            self.open[k].append((key, start, put, total))
            self.room[k] -= len(put)
            start, ids = start + len(put), ids[len(put) :]
            if not self.room[k]:
                del self.room[k]
                yield self._emit(self.open.pop(k))

    def _emit(self, pieces: list[tuple]) -> tuple[int, list[tuple]]:
        self.next_id += 1
        return self.next_id - 1, pieces

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        for pieces in self.open:
            yield self._emit(pieces)


def _batch(schema: pa.Schema, windows: list[tuple[int, list[tuple]]], keep_ids: bool, group: int | None) -> pa.RecordBatch:
    rows: list[list] = [[] for _ in range(9)]
    for sequence, pieces in windows:
        offset = 0
        for key, start, ids, total in pieces:
            raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
            for column, value in zip(rows, (key, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if keep_ids else None, group), strict=True):
                column.append(value)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)


def _arrow_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("id", kind), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary()), ("part", pa.int64())])


def packed(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = "byte_bpe_50k.json", end_id: int = 0, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian
    unsigned 32-bit) if ``keep_ids``."""
    given = only(df, id=id_column, text=text_column)
    id_type = given.schema["id"].dataType.simpleString()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, packer, schema = TextEncoder(model), Packer(window, open_windows, part << 32), None
        done: list = []
        for batch in batches:
            schema = schema or _arrow_schema(batch.schema.field(0).type)
            for key, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1)), strict=True):
                done += packer.add(key, 0, np.append(ids, np.uint32(end_id)), len(ids) + 1)
                if len(done) >= 512:
                    yield _batch(schema, done, keep_ids, None)
                    done = []
        if schema:
            yield _batch(schema, done, keep_ids, None)
            yield _batch(schema, list(packer.rest()), True, part)

    first = written(in_python(given, first_pass, f"id {id_type}, {_PIECE}, part long"), "packed")

    def merge(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        schema = _arrow_schema(pieces.schema.field("id").type)
        group = pieces.column("part")[0].as_py() // MERGED_PARTITIONS
        packer = Packer(window, open_windows, (1 << 62) + (group << 32))
        done: list = []
        for key, start, raw, total in zip(*(pieces.column(c).to_pylist() for c in ("id", "start", "ids", "doc_tokens")), strict=True):
            done += packer.add(key, start, np.frombuffer(raw, dtype="<u4"), total)
        # what is still open is laid end to end: at most one short window is left of a group
        last = Packer(window, 1, packer.next_id)
        for piece in (p for _, pieces in packer.rest() for p in pieces):
            done += last.add(*piece)
        done += last.rest()
        return pa.Table.from_batches([_batch(schema, done, keep_ids, group)]).select(schema.names[:8])

    left = first.filter("part is not null")
    merged = left.groupBy((F.col("part") / MERGED_PARTITIONS).cast(LongType())).applyInArrow(merge, f"id {id_type}, {_PIECE}")
    out = first.filter("part is null").drop("part").unionByName(merged)
    return (out if keep_ids else out.drop("ids")).withColumnRenamed("id", id_column)
