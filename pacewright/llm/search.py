"""Ranked lexical search for many items at once: shared sums of terms are made once for all items that hold them.

Items (the queries) come in blocks of bounded size. For a block the sets of terms that several items share are
mined: the pair of terms (or of sets found before) that most items hold becomes a node, and takes the pair's place
in each of them, until no pair is shared. What is left is a graph: terms at the bottom, shared sets above, items on
top. Documents are worked in blocks too: every term's share of every document's score is one row of an array of
accumulators, every node's row is the sum of its two, made once, and an item's scores are the sum of the rows it
kept. So a set that a hundred items share is added up once and not a hundred times.

A first pass reads the texts and writes, for each document, its length and the block's terms in it; lengths and
document frequencies are counted from there, over all documents, and the scoring pass reads it again. Each task keeps its best
documents of each item, which meet in two steps, so no item gathers more than a share of them in one task. Nothing
is dealt out by term, so common terms are no hot keys. Sums are 64-bit integers and do not depend on their order.

Terms are maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased, told apart by 64-bit hashes. Null and empty texts
have no terms: such documents are never found and not counted, such items find nothing. Of documents with equal
scores the one of smaller id comes first, those without id last; repeated rows each take a rank. Items that share
an id are ranked each on their own. Texts are taken whole. Further columns are ignored; no documents or no items give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacewright.llm.shared import in_python, only, written
from pacewright.llm.textgrid import text_slices, word_hashes

ITEMS, ITEM_TERMS = 256, 50_000  # of a block; an item of more terms is a block of its own
ACCUMULATORS = 1 << 21  # entries of the array that a task works in, about 16 MB
SHARDS = 64
_BETWEEN = np.zeros(256, dtype=bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _BETWEEN[_a : _b + 1] = True


@dataclass
class SharingGraph:
    """``pairs``: the two nodes that each shared node adds up, in an order in which they can be made; nodes are numbered
    after the ``leaves`` first ones. ``tops``: the nodes that each item adds up."""

    leaves: int
    pairs: list[tuple[int, int]]
    tops: list[list[int]]


def sharing_graph(leaves: int, sets: list[set[int]]) -> SharingGraph:
    """Mines the sets of leaves that items share, the pair that most items share first."""
    sets = [set(s) for s in sets]
    holders: dict[int, set[int]] = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, set()).add(k)
    shared = {x for x, held in holders.items() if len(held) > 1}
    counts = Counter(pair for s in sets for pair in combinations(sorted(s & shared), 2))
    heap = [(-n, pair) for pair, n in counts.items() if n > 1]
    heapq.heapify(heap)
    pairs: list[tuple[int, int]] = []
    while heap:
        n, (a, b) = heapq.heappop(heap)
        both = holders[a] & holders[b]
        if len(both) < -n:  # some of them have taken another pair since
            if len(both) > 1:
                heapq.heappush(heap, (-len(both), (a, b)))
            continue
        node = leaves + len(pairs)
        pairs.append((a, b))
        holders[node] = both
        holders[a], holders[b] = holders[a] - both, holders[b] - both
        beside: Counter = Counter()
        for k in both:
            sets[k] -= {a, b}
            beside.update(x for x in sets[k] if len(holders[x]) > 1)
            sets[k].add(node)
        for x, m in beside.items():
            if m > 1:
                heapq.heappush(heap, (-m, (x, node)))
    return SharingGraph(leaves, pairs, [sorted(s) for s in sets])


@dataclass
class ItemBlock:
    """Some items: their ids, the terms they hold (hashes in rising order), and leaves (term, times) with the graph above them."""

    ids: list
    terms: np.ndarray
    leaf_terms: np.ndarray
    leaf_times: np.ndarray
    graph: SharingGraph


def _hashed(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the terms of each text, in their order."""
    for _, data, bounds in text_slices(texts):
        hashes, at = word_hashes(data, bounds, _BETWEEN)
        yield from (hashes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _block(items: list[tuple]) -> ItemBlock:
    terms = np.unique(np.concatenate([h for _, h in items]))
    leaves: dict[tuple[int, int], int] = {}
    sets = []
    for _, h in items:
        different, times = np.unique(h, return_counts=True)
        each = zip(np.searchsorted(terms, different).tolist(), times.tolist(), strict=True)
        sets.append({leaves.setdefault(leaf, len(leaves)) for leaf in each})
    named = np.array(list(leaves), dtype=np.int64).reshape(-1, 2)
    return ItemBlock([k for k, _ in items], terms, named[:, 0], named[:, 1], sharing_graph(len(leaves), sets))


def item_blocks(items: DataFrame) -> Iterator[ItemBlock]:
    """Blocks of the items (id, text) that hold any term, one after the other."""
    held: list[tuple] = []
    size = 0
    for row in items.toLocalIterator():
        h = next(iter(_hashed(pa.array([row["text"]], pa.large_string()))))
        if len(h):
            if held and (len(held) == ITEMS or size + len(h) > ITEM_TERMS):
                yield _block(held)
                held, size = [], 0
            held.append((row["id"], h))
            size += len(h)
    if held:
        yield _block(held)


def _term_table(documents: DataFrame, terms: np.ndarray) -> DataFrame:
    """(id, n, places, times) of each document: its number of terms, and which of ``terms`` occur how often."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in text_slices(batch.column(1)):
                hashes, at = word_hashes(data, bounds, _BETWEEN)
                place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                known = np.flatnonzero(terms[place] == hashes)
                of = np.searchsorted(at, known, side="right") - 1
                both, times = np.unique((of.astype(np.int64) << 32) | place[known], return_counts=True)
                ends = pa.array(np.searchsorted(both >> 32, np.arange(len(at))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (both & 0xFFFFFFFF, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(at) - 1), pa.array(np.diff(at), pa.int64()), *lists], names=["id", "n", "places", "times"])

    return in_python(documents, counted, "id long, n long, places array<int>, times array<int>")


def accumulated(graph: SharingGraph, leaves: np.ndarray) -> np.ndarray:
    """The sums (items x documents) over rows of leaves (leaves x documents); every shared node is added up once."""
    rows = np.empty((graph.leaves + len(graph.pairs), leaves.shape[1]), dtype=np.int64)
    rows[: graph.leaves] = leaves
    for k, (a, b) in enumerate(graph.pairs, graph.leaves):
        np.add(rows[a], rows[b], out=rows[k])
    return np.stack([rows[top].sum(axis=0) for top in graph.tops])


class Best:
    """The ``most`` best documents of each item so far: by score, then by id, rows without id last."""

    def __init__(self, items: int, most: int):
        self.most, self.least = most, np.ones(items, dtype=np.int64)
        self.item, self.score, self.id, self.absent = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        new = (item, scores[item, doc], ids[doc], absent[doc])
        columns = [np.concatenate(c) for c in zip((self.item, self.score, self.id, self.absent), new, strict=True)]
        order = np.lexsort((columns[2], columns[3], -columns[1], columns[0]))
        columns = [c[order] for c in columns]
        items = np.arange(len(self.least))
        first, end = np.searchsorted(columns[0], items), np.searchsorted(columns[0], items, side="right")
        full = end - first >= self.most
        self.least[full] = columns[1][first[full] + self.most - 1]
        keep = np.arange(len(order)) - first[columns[0]] < self.most
        self.item, self.score, self.id, self.absent = (c[keep] for c in columns)


def _scored(table: DataFrame, block: ItemBlock, weights: np.ndarray, documents: int, length: int, most: int) -> DataFrame:
    """(item, id, score, shard): the best documents of each task for each item of the block, by its place there."""
    at_once = max(16, ACCUMULATORS // (block.graph.leaves + len(block.graph.pairs) + len(block.ids)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = Best(len(block.ids), most)
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                n = part.column(1).to_numpy().astype(np.int64)
                m = 100 - 25 + (25 * n * documents) // length
                places, times = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(n)), part.column(2).value_lengths().to_numpy())
                share = np.zeros((len(block.terms), len(n)), dtype=np.int64)
                share[places, doc] = weights[places] * ((1_000_000_000 * times) // (1000 * times + 12 * m[doc]))
                scores = accumulated(block.graph, share[block.leaf_terms] * block.leaf_times[:, None])
                ids = part.column(0)
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        shard = np.full(len(best.item), TaskContext.get().partitionId() % SHARDS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.id, mask=best.absent), pa.array(best.score), pa.array(shard)], names=["item", "id", "score", "shard"])

    return in_python(table, scored, "item int, id long, score long, shard int")


def ranked_documents(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", most: int = 20) -> DataFrame:
    """The ``most`` best documents of each item with a score above 0: item_id, rank from 1, doc_id and score.

    Scores are sums over an item's terms, repeats included, of a term's weight times a share that grows with its
    occurrences and falls with the document's length, in whole numbers: with N documents that have terms, L terms in
    all of them, df documents that hold a term, n terms of the document and tf of them the term,
    weight = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25nN div L, share = 1000000000tf div (1000tf + 12m).
    """
    spark = documents.sparkSession
    given = only(documents, id=id_column, text=text_column).withColumn("id", F.col("id").cast("long"))
    wanted = only(items, id=item_column, text=item_text_column)
    id_type = wanted.schema["id"].dataType.simpleString()
    found = []
    for block in item_blocks(wanted):
        table = written(_term_table(given, block.terms), "terms")
        total = table.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
        if not total["documents"]:
            break
        held = np.zeros(len(block.terms), dtype=np.int64)
        for row in table.select(F.explode("places").alias("place")).groupBy("place").count().collect():  # one row per term of the block
            held[row["place"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * df + 1))) for df in held.tolist()], dtype=np.int64)
        best = _scored(table, block, weights, total["documents"], total["length"], most)
        for keys in (("item", "shard"), ("item",)):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
            best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, name {id_type}")
        found.append(best.join(names, "item").select(F.col("name").alias(item_column), "rank", F.col("id").alias(id_column), "score"))
    empty = spark.createDataFrame([], f"{item_column} {id_type}, rank int, {id_column} long, score long")
    return reduce(DataFrame.unionByName, found) if found else empty
