"""Secret scans by a trigram inverted index: rules say which trigrams their matches must hold, postings are
intersected, and only the texts that are left are searched.

The index is laid out in segments of about a megabyte of text: a row for each trigram of a segment with the ordinals of
its texts that hold it, and one row with the hashes of those texts. A rule's condition (``trigrams``) becomes an
expression over a segment's postings, intersections for "and", unions for "or"; no posting list reaches over a
segment, so common trigrams are no hot keys. Texts found are named by hash and marked in a bit table of fixed size
(4 MiB) that is sent to all tasks, which go over the texts once: rules without a condition search every text, the
others the marked ones. Two texts in one slot cost a search, never a result; once a corpus has more candidates
than slots, ever more texts are searched for nothing.

An index of all trigrams serves any rules that come later (``trigram_index``); without one, only the trigrams of the
rules at hand are indexed.

Null texts hold nothing; texts are searched whole; spans are code points. Rows are independent of each other:
repeated rows, null ids and further columns change nothing, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewright.llm.shared import in_python, only, released, written
from pacewright.llm.textgrid import text_slices
from pacewright.llm.trigrams import trigram_condition, trigrams_of

SEGMENT_BYTES, MARK_BITS = 1 << 20, 25
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern (ASCII classes), found leftmost and without overlaps; then matches go whose ``group`` has fewer than
    ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @cached_property
    def condition(self):
        return trigram_condition(self.pattern)

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # runs of 32 and more; a shorter run holds no match, so it need not be found first
    Rule("hex", r"[0-9a-f]{32,}"),
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{20,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    Rule("login", r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]{4,}@"),
]


def trigram_index(df: DataFrame, text_column: str = "text", trigrams: set[int] | None = None) -> DataFrame:
    """(segment, gram, docs, texts): for each trigram of a segment the ordinals of the texts that hold it; under gram -1 the
    hashes of the segment's texts, by ordinal.

    Texts are lower-cased (A-Z). With ``trigrams`` only those are indexed.
    """
    given = only(df, text=text_column).filter("text is not null").select("text", F.xxhash64("text").alias("hash"))
    wanted = None if trigrams is None else np.array(sorted(trigrams), dtype=np.int64)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        if wanted is not None:
            table = np.zeros(1 << 24, dtype=bool)
            table[wanted] = True
        for batch in batches:
            for row, data, bounds in text_slices(batch.column(0), SEGMENT_BYTES):
                d = _LOWER[data].astype(np.int64)
                grams = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
                of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                use = of[:-2] == of[2:]  # not over the edge of two texts
                if wanted is not None:
                    use &= table[grams]
                both = np.unique((grams[use] << 20) | of[:-2][use])
                gram, docs = both >> 20, both & 0xFFFFF
                first = np.flatnonzero(np.diff(gram, prepend=-1))
                n = len(first)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(docs)), pa.int32()), pa.array(docs, pa.int32()))
                names = ["segment", "gram", "docs", "texts"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, segment)), pa.array(gram[first].astype(np.int32)), lists, pa.nulls(n, pa.list_(pa.int64()))], names=names)
                hashes = pa.array([batch.column(1).slice(row, len(bounds) - 1).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([-1], pa.int32()), pa.nulls(1, pa.list_(pa.int32())), hashes], names=names)
                segment += 1

    return written(in_python(given, indexed, "segment long, gram int, docs array<int>, texts array<long>"), "index")


def _found(condition) -> Column:
    """The ordinals of a segment's texts that meet a condition, from its postings."""
    if isinstance(condition, int):
        return F.coalesce(F.try_element_at("postings", F.lit(condition)), F.array().cast("array<int>"))
    how = F.array_intersect if condition[0] == "and" else F.array_union
    found = _found(condition[1])
    for c in condition[2:]:
        found = how(found, _found(c))
    return found


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(hash) of the texts that meet the condition of one of the rules that have any, each once."""
    conditions = [r.condition for r in rules if r.condition is not None]
    if not conditions:
        return index.select(F.explode("texts").alias("hash")).limit(0)
    grams = sorted(set().union(*map(trigrams_of, conditions)))
    rows = index.filter(F.col("gram").isin([-1, *grams]))
    entries = F.collect_list(F.when(F.col("gram") >= 0, F.struct("gram", "docs")))
    segments = rows.groupBy("segment").agg(F.map_from_entries(entries).alias("postings"), F.first("texts", True).alias("texts"))
    found = segments.select("texts", F.explode(_found(("or", *conditions))).alias("doc"))
    return found.select(F.expr("texts[doc]").alias("hash")).distinct()


def _marks(found: DataFrame) -> np.ndarray:
    """The bit table of hashes, in words of 32 bits."""
    slots = found.select(F.pmod("hash", F.lit(1 << MARK_BITS)).alias("slot"))
    bits = slots.selectExpr("cast(slot div 32 as int) w", "shiftleft(1L, cast(slot % 32 as int)) bit")
    table = np.zeros(1 << (MARK_BITS - 5), dtype=np.int64)
    for row in bits.groupBy("w").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        table[row["w"]] = row["bits"]
    return table.astype(np.uint32)


def secret_spans(df: DataFrame, rules: list[Rule], id_column: str = "doc_id", text_column: str = "text", index: DataFrame | None = None) -> DataFrame:
    """One row per row of ``df``: its id and ``spans``, an array of (kind, start, end) by start and then by the order of the rules.

    ``index`` is a ``trigram_index`` of the same texts, or of more.
    """
    own = index is None and any(r.condition is not None for r in rules)
    if own:
        index = trigram_index(df, text_column, set().union(*[trigrams_of(r.condition) for r in rules]))
    marks = df.sparkSession.sparkContext.broadcast(_marks(candidates(index, rules)) if index is not None else np.zeros(1 << (MARK_BITS - 5), dtype=np.uint32))
    if own:
        released(index)
    given = only(df, id=id_column, text=text_column)
    given = given.select("id", "text", F.pmod(F.xxhash64("text"), F.lit(1 << MARK_BITS)).alias("slot"))
    everywhere = [(k, r) for k, r in enumerate(rules) if r.condition is None]
    every = list(enumerate(rules))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            marked = ((table[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1).astype(bool)
            spans = []
            for text, mark in zip(batch.column(1), marked.tolist(), strict=True):
                text = text.as_py() or ""
                found = sorted((start, k, end) for k, r in (every if mark else everywhere) for start, end in r.spans(text))
                spans.append([{"kind": rules[k].kind, "start": start, "end": end} for start, k, end in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

    out = in_python(given, searched, f"id {given.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_column)


def secret_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", more_rules: list[Rule] = MORE_RULES) -> DataFrame:
    """One row per row of ``df``: its id, n_assign, n_access, n_hex, base_sha256 (of the spans of these three) and spans (all of them, as text)."""
    found = secret_spans(df, [*BASE_RULES, *more_rules], id_column, text_column)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = [r.kind for r in BASE_RULES]
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in kinds]
    base = F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256)
    return found.select(id_column, *counts, base.alias("base_sha256"), text(F.col("spans")).alias("spans"))
