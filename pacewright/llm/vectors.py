"""Near duplicates among embeddings: cross-polytope hashing after fast Hadamard rotations.

Vectors are scaled to unit length in double precision; equal vectors are one class, which counts with all
its members. Each of several tables hashes a vector by some rotations: signs are flipped at random and a
fast Hadamard transform applied, three times, and the vertex of the cross-polytope nearest to the result
is the hash; a second bucket is probed for every rotation with the second-nearest vertex in its place.
The number of rotations grows with the logarithm of the number of classes, and the number of tables with the
rotations, so the share of pairs found stays the same at every size. The members of a bucket are
verified by their cosine against its first member; in buckets that are not in one component then, those
outside the largest one are verified against all members, in blocks of bounded size. The components of
these links are compared once more in full, block against block, so each link inside a component is
counted exactly once; that is the part that grows with the square of a component, at one product of vectors a pair.

Vectors that are null, zero, or hold null or non-finite numbers link with nothing, as do rows without id and
vectors of other lengths. Rows that repeat a vector are linked with each other, those that repeat an id too: every row
is a vector of its own. Vectors are told apart by 64-bit hashes. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewright.llm.components import components
from pacewright.llm.shared import in_python, only, released, written
from pacewright.llm.textgrid import mixed

#: The chance that a pair right at the threshold shares no bucket, on which the number of tables depends.
MISSED = 1e-3
#: Members of a block whose links are sought, of one whose links are counted, rows hashed and rows compared at once.
BLOCK, COUNT_BLOCK, ROWS, STEP = 1024, 4096, 4096, 256


def tables_for(rotations: int, missed: float = MISSED) -> int:
    """The tables needed: one of r rotations brings vectors of cosine 0.95 into a shared bucket with a chance of about
    0.92 * 0.83 ** (r - 1) or more (measured on random pairs: 0.92, 0.81, 0.67, 0.54, 0.42)."""
    return ceil(log(missed) / log(1 - 0.92 * 0.83 ** (rotations - 1)))



def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each vector length that occurs."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    begins = column.offsets.to_numpy()[:-1]
    out = []
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        x = flat[begins[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def _rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of sign flips and the fast Hadamard transform; the width is a power of two."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
            h *= 2
    return x


def bucket_codes(x: np.ndarray, tables: int, rotations: int, seed: int = 20240401) -> np.ndarray:
    """The buckets of unit vectors, tables x (1 + rotations) for each: the own bucket and the probed ones."""
    n, d = x.shape
    width = 1 << max(0, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng = np.random.default_rng([seed, d])
    codes = np.empty((n, tables, 1 + rotations), dtype=np.uint64)
    for t in range(tables):
        first, second = np.empty((2, n, rotations), dtype=np.uint64)
        for k in range(rotations):
            y = _rotated(x, rng.choice([-1.0, 1.0], size=(3, width)))
            size = np.abs(y)
            a = size.argmax(axis=1)
            rows = np.arange(n)
            size[rows, a] = -1
            b = size.argmax(axis=1)
            first[:, k], second[:, k] = 2 * a + (y[rows, a] < 0), 2 * b + (y[rows, b] < 0)
        for p in range(1 + rotations):
            code = np.full(n, np.uint64(d * 4096 + t))
            for k in range(rotations):
                code = mixed(code + (second if k == p - 1 else first)[:, k] + np.uint64(1))
            codes[:, t, p] = code
    return codes.reshape(n, -1)


def _hashed(classes: DataFrame, tables: int, rotations: int) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in _matrix(batch.column(1)):
                for a in range(0, len(rows), ROWS):
                    codes = bucket_codes(x[a : a + ROWS], tables, rotations)
                    own = np.repeat(ids[rows[a : a + ROWS]], codes.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(codes.ravel().view(np.int64)), pa.array(own)], names=["bucket", "cid"])

    return in_python(classes.select("cid", "v"), hashed, "bucket long, cid long").distinct()


def _in_blocks(members: DataFrame, group: str) -> DataFrame:
    """Members (group, size, cid) dealt to pairs of blocks: (g, side, cid); a pair of blocks holds 2 * COUNT_BLOCK members or so."""
    parts = members.withColumn("parts", F.ceil(F.col("size") / COUNT_BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return parts.select(F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")).alias("g"), F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), "cid")


def _by_group(rows: DataFrame, of_group, schema: str) -> DataFrame:
    """``of_group(cids, sides, weights, unit vectors)`` for each run of rows of one group, one group in memory at a time."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> list[tuple]:
            whole = pa.Table.from_batches(held).combine_chunks()
            cids, sides, weights = (whole.column(c).to_numpy() for c in ("cid", "side", "m"))
            found: list[tuple] = []
            for rows_, x in _matrix(whole.column("v").chunk(0)):
                if len(rows_) > 1:
                    found += of_group(cids[rows_], sides[rows_], weights[rows_], x)
            held.clear()
            return found

        out: list[tuple] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and b > a and held[-1].column(0)[0].as_py() != g[a]:
                    out += done()
                if b > a:
                    held.append(batch.slice(a, b - a))
            if len(out) > ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if held:
            out += done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return in_python(rows.select("g", "side", "cid", "m", "v").repartition("g").sortWithinPartitions("g", "cid"), grouped, schema)


def _near(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose cosine is ``least`` or more."""
    ends = [vectors.select(F.col("cid").alias(c), F.col("v").alias(f"v{c}")) for c in "ab"]
    rows = pairs.join(ends[0], "a").join(ends[1], "b").filter("size(va) = size(vb)").select("a", "b", "va", "vb")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column(2)), _matrix(batch.column(3))
            for (rows_, u), (_, v) in zip(x, y, strict=True):
                keep = rows_[np.einsum("ij,ij->i", u, v) >= least]
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return in_python(rows, near, "a long, b long")


def _unsettled(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(g, side, cid) of buckets (bucket, size, cid) that are not in one component yet, dealt to groups.

    Only members outside a bucket's largest component are new to anyone: blocks of these meet blocks of
    all members, so a bucket's work is its size times the number of those outside, not its square.
    """
    d = members.join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    roots = d.groupBy("bucket", "root").agg(F.count("*").alias("k")).groupBy("bucket")
    largest = roots.agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"), F.sum("k").alias("all")).filter("roots > 1 and all > 2")
    largest = largest.selectExpr("bucket", "top.root as top", "cast(ceil(all / %d) as int) as parts" % BLOCK, "cast(ceil((all - top.k) / %d) as int) as rest_parts" % BLOCK)
    d = d.select("bucket", "cid", "root").join(largest, "bucket").withColumn("h", F.xxhash64("cid"))
    every = d.select("bucket", "cid", F.pmod("h", F.col("parts")).alias("j"), F.explode(F.expr("sequence(0, rest_parts - 1)")).alias("i"))
    rest = d.filter("root <> top").select("bucket", "cid", F.explode(F.expr("sequence(0, parts - 1)")).alias("j"), F.pmod("h", F.col("rest_parts")).alias("i"))
    return every.unionByName(rest).select(F.xxhash64("bucket", F.col("i").cast("int"), F.col("j").cast("int")).alias("g"), F.lit(2).alias("side"), "cid").distinct()


def linked_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least: float = 0.95, missed: float = MISSED) -> DataFrame:
    """One row per row of ``df``: its id, n_links, component_id and kept."""
    given = only(df, id=id_column, v=vector_column).withColumn("v", F.col("v").cast("array<double>"))
    usable = "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    given = given.withColumn("usable", F.expr(f"coalesce({usable}, false)")).withColumn("cid", F.when(F.col("usable"), F.xxhash64("v")))
    classes = written(given.filter("usable").groupBy("cid", "v").agg(F.min("id").alias("first"), F.count("*").alias("m")).dropDuplicates(["cid"]), "vectors")
    n = classes.count()

    def links_of(cids, sides, weights, x) -> list[tuple]:
        near = x @ x.T >= least
        label = np.arange(len(x))
        while True:  # the least member each is linked with, over and over
            lower = np.where(near, label, len(x)).min(axis=1)
            lower = np.minimum(lower, label)
            if (lower == label).all():
                break
            label = lower
        moved = np.flatnonzero(label != np.arange(len(x)))
        return list(zip(cids[moved].tolist(), cids[label[moved]].tolist(), strict=True))

    def counts_of(cids, sides, weights, x) -> list[tuple]:
        """(class, vectors linked): of pairs within the one block, or across the two."""
        own = sides[0] == 2
        a, b = (slice(None), slice(None)) if own else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
        xa, xb, wa, wb = x[a], x[b], weights[a].astype(float), weights[b].astype(float)
        of_a, of_b = np.zeros(len(xa)), np.zeros(len(xb))
        for k in range(0, len(xa), STEP):
            near = (xa[k : k + STEP] @ xb.T >= least).astype(float)
            if own:
                np.fill_diagonal(near[:, k:], 0)
            of_a[k : k + STEP] = near @ wb
            of_b += wa[k : k + STEP] @ near
        found = ((cids[a], of_a),) if own else ((cids[a], of_a), (cids[b], of_b))
        return [(c, n) for ids, links in found for c, n in zip(ids[links > 0].tolist(), links[links > 0].astype(np.int64).tolist(), strict=True)]

    rotations = max(1, ceil(log(max(n, 2)) / log(2 * 64)))
    entries = _hashed(classes, tables_for(rotations, missed), rotations)
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("cid").alias("lead")).filter("size > 1")
    members = written(entries.join(shared, "bucket"), "entries")
    vectors = classes.select("cid", "m", "v")
    stars = members.filter("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")).distinct()
    edges = written(_near(stars, vectors, least), "edges")
    open_members = _unsettled(members, components(edges))
    linked = components(edges.unionByName(_by_group(open_members.join(vectors, "cid"), links_of, "a long, b long")))
    released(members, edges)

    sizes = linked.groupBy("root").agg(F.count("*").alias("size"))
    members = linked.withColumnRenamed("node", "cid").join(sizes, "root")
    counts = _by_group(_in_blocks(members, "root").join(vectors, "cid"), counts_of, "a long, b long").groupBy("a").agg(F.sum("b").alias("links"))

    ends = classes.join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")).select("cid", "first", "m", "root")
    least_ids = ends.groupBy("root").agg(F.min("first").alias("component_id"))
    ends = ends.join(least_ids, "root").join(counts.withColumnRenamed("a", "cid"), "cid", "left").select("cid", "component_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = given.join(ends, "cid", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return found.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
