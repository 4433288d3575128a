"""N-gram Jaccard join of whole texts: a size-aware heavy-light join, exact at its threshold.

A document's set is its distinct five-word shingles. Documents of equal sets are one class, and one
member stands for it. Two sets of at least 3/4 similarity share most of their elements, so under any
fixed order of all elements they also share one of their first n/4+1, and two of their first n/4+2.

- Small (light) sets enumerate all 2-subsets of those first elements as keys.
- Large (heavy) sets, and small ones near the boundary, enter the inverted list of each first element.

The boundary is where enumerating subsets begins to cost more than scanning lists, by the mean length
of lists measured on the input. The order puts rare elements first: elements are counted exactly
(by a 40-bit part of their hash) over all documents, in as many groups as the input has partitions, and tables of
fixed size made from the counts are sent to the tasks: one bit for elements that occur in several documents, and a
level for the most common ones, as many as fill a quarter of their table at every size of the corpus. Those tables
only steer the order and save work; a wrong entry (two elements in
one slot) costs time, never a result. Elements of one document only have no partner and are left out,
and a set with under 3/4 of its elements elsewhere can have no link and gives no key. Once a corpus has more repeated
elements than the bit table has slots, it rules out less.

Of a pair's shared keys the first one bounds what it can share: nothing before it, and no more than what
either set has from there on. A pair that this bound rules out at one key is left out there; its first
shared key decides.

Lists are not expanded into pairs. Each member is compared with one leader of its list; lists whose
members are then all in one component are done. Others get a leader out of their smallest component,
some times over. What is still open then (texts of one template, say, that share much and yet not enough) is
compared by sketches: a set's sketch has a bit for each of 4096 ranges of hashes, and every bit that one sketch
has more than the other stands for an element that is not shared, so two sketches bound what two sets can share. Members
are dealt into blocks of about 256, each pair of blocks is a group of its own, and only pairs that the bound
leaves are handed on. Lists that overlap are taken together where that makes fewer pairs than one by one. Every
comparison of the pairs handed on counts the shared shingles.

Ids are whole numbers (others fail as Spark's cast does). Null ids link with nothing (component null); texts without
words have an empty set and link with nothing. Documents are told apart by their sets, not their ids, so rows that
share an id but not a text each have their own links. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewright.llm.components import components, joined_components
from pacewright.llm.shared import hand_back, in_python, only, released, written
from pacewright.llm.textgrid import mixed, set_hash, shingle_sets
from pacewright.sources.layout import laid_by_track

FLUSH, SEEN, COUNTED_BITS = 1 << 20, 200_000, 40
REPEATED_BITS, COMMON_BITS, COMMON_FROM, WANTED_BITS, MOST_GROUP_BITS = 26, 21, 64, 24, 20
STAR_ROUNDS = 1
SKETCH_BITS, BLOCK = 12, 256


def _packed(numbers: np.ndarray) -> bytes:
    """Rising numbers below 2^40 as the bytes of their steps, all lowest ones first: the highest ones are zeros side by side,
    which compress to nothing, so a million hashes take about three bytes each."""
    return np.diff(numbers, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    steps = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    steps[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(5, -1).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _frequencies(given: DataFrame, bucket_bits: int) -> DataFrame:
    """For each range of hashes: which slots hold elements of two documents or more, how common they are,
    and the sums of counts and of their squares over elements that are not common."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flushed() -> pa.RecordBatch:
            different, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = (different >> np.uint64(64 - bucket_bits)).astype(np.int64)
            at = np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1)).tolist()
            rest = (different << np.uint64(bucket_bits)) >> np.uint64(bucket_bits + 64 - COUNTED_BITS)
            counts = np.minimum(counts, 65535).astype("<u2")
            rows = [(k, _packed(rest[a:b]), counts[a:b].tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "hashes", "counts"])

        for batch in batches:
            for s in shingle_sets(batch.column(1)):
                if len(s):
                    held.append(s)
                    n += len(s)
                if n >= FLUSH:
                    yield flushed()
                    held, n = [], 0
        if n:
            yield flushed()

    def summed(rows: pa.Table) -> pa.Table:
        hashes = np.concatenate([_unpacked(x) for x in rows.column("hashes").to_pylist()])
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), dtype="<u2").astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        total = np.add.reduceat(counts, first)
        hashes, total = hashes[first][total > 1], total[total > 1]
        repeated = np.zeros(1 << (REPEATED_BITS - bucket_bits), dtype=bool)
        repeated[hashes >> np.uint64(COUNTED_BITS - REPEATED_BITS)] = True
        common = np.zeros(1 << (COMMON_BITS - bucket_bits), dtype=np.uint8)
        many = total >= COMMON_FROM
        most = max(1, len(common) // 4)
        if many.sum() > most:
            many &= total > np.partition(total, -most - 1)[-most - 1]
        level = 1 + np.floor(np.log2(total[many] / COMMON_FROM)).astype(np.uint8)
        np.maximum.at(common, hashes[many] >> np.uint64(COUNTED_BITS - COMMON_BITS), level)
        few = total[~many].astype(np.float64)
        one = [rows.column("bucket")[0].as_py(), np.packbits(repeated).tobytes(), common.tobytes(), float(few.sum()), float((few * few).sum())]
        return pa.Table.from_arrays([pa.array([x], pa.int32() if k == 0 else None) for k, x in enumerate(one)], names=["bucket", "repeated", "common", "total", "squares"])

    return in_python(given, counted, "bucket int, hashes binary, counts binary").groupBy("bucket").applyInArrow(summed, "bucket int, repeated binary, common binary, total double, squares double")


def _first_keys(s: np.ndarray, repeated: np.ndarray, common: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The keys of a set (its distinct elements in rising order), each with the place of its first element in
    the order of rareness; None if it can have no link."""
    n = len(s)
    slot = s >> np.uint64(64 - REPEATED_BITS)
    elsewhere = (repeated[slot >> np.uint64(3)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1
    if 4 * int(elsewhere.sum()) < 3 * n:
        return None
    level = np.where(elsewhere, 1 + common[s >> np.uint64(64 - COMMON_BITS)].astype(np.int64), 0)
    s = s[np.argsort(level, kind="stable")]
    rare = n - int(elsewhere.sum())  # these come first and have no partner
    keys, places = [], []
    if n > boundary or 4 * n > 3 * boundary:
        keys.append(s[rare : n // 4 + 1])
        places.append(np.arange(rare, rare + len(keys[0])))
    if n <= boundary:
        light = s[rare : min(n, n // 4 + 2)]
        i, j = np.triu_indices(len(light), 1)
        a, b = np.minimum(light[i], light[j]), np.maximum(light[i], light[j])
        keys.append(mixed(a * np.uint64(0x9E3779B97F4A7C15) + mixed(b)))
        places.append(rare + i)
    found = np.concatenate(keys)
    return (found, np.concatenate(places)) if len(found) else None


def _documents(given: DataFrame, send: Broadcast, boundary: int) -> DataFrame:
    """(id, body, class, n, keys, places): keys only for the first member with an id of a class that a task meets, if it can
    have links; ``body`` is a hash of the text."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(b, dtype=np.uint8) for b in send.value]
        seen: set[int] = set()
        for batch in batches:
            kinds, sizes, keys, places, row = [], [], [], [], 0

            def flushed(batch=batch) -> pa.RecordBatch:
                ids = batch.column(0).slice(row, len(sizes))
                return pa.RecordBatch.from_arrays([ids, batch.column(2).slice(row, len(sizes)), pa.array(kinds, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["id", "body", "class", "n", "keys", "places"])

            held = 0
            for s, absent in zip(shingle_sets(batch.column(1)), batch.column(0).is_null().to_pylist(), strict=True):
                kind = set_hash(s)
                kinds.append(kind)
                sizes.append(len(s))
                if absent or len(s) < 3 or kind in seen:
                    keys.append(None)
                    places.append(None)
                else:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(kind)
                    found = _first_keys(s, *tables, boundary)
                    keys.append(None if found is None else found[0].view(np.int64))
                    places.append(None if found is None else found[1].astype(np.int32))
                    held += 0 if found is None else len(found[0])
                if held > FLUSH:
                    yield flushed()
                    row += len(sizes)
                    kinds, sizes, keys, places, held = [], [], [], [], 0
            yield flushed()

    return in_python(given, described, "id long, body long, class long, n long, keys array<long>, places array<int>")


def _slot() -> Column:
    return F.pmod(F.xxhash64("id", "body"), F.lit(1 << WANTED_BITS))


def sketch(s: np.ndarray) -> bytes:
    """One bit for each range of hashes that the set has an element in."""
    bits = np.zeros(1 << SKETCH_BITS, dtype=bool)
    bits[s >> np.uint64(64 - SKETCH_BITS)] = True
    return np.packbits(bits).tobytes()


def _sets(given: DataFrame, send: Broadcast) -> DataFrame:
    """(id, body, class, elements, sketch) of the documents whose slot is wanted."""
    slots = given.withColumn("slot", _slot())

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = send.value
        for batch in batches:
            slot = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(((table[slot >> 5] >> (slot & 31)) & 1).astype(bool)))
            held, kinds, elements, sketches, row = 0, [], [], [], 0

            def flushed(batch=batch) -> pa.RecordBatch:
                own = [batch.column(k).slice(row, len(elements)) for k in (0, 2)]
                return pa.RecordBatch.from_arrays([*own, pa.array(kinds, pa.int64()), pa.array(elements, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "body", "class", "elements", "sketch"])

            for s in shingle_sets(batch.column(1)):
                kinds.append(set_hash(s))
                sketches.append(sketch(s))
                elements.append(s.view(np.int64))
                held += len(s)
                if held > FLUSH:
                    yield flushed()
                    row += len(elements)
                    held, kinds, elements, sketches = 0, [], [], []
            yield flushed()

    return in_python(slots, chosen, "id long, body long, class long, elements array<long>, sketch binary")


def open_pairs(rest: DataFrame, leaders: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): of the members (key, id, n, p, root) of open lists the pairs of different components that sizes, places and
    sketches leave; ``leaders`` (key, other) ties members of a list together.

    A unit of work is a list, or all lists that hang together if comparing their members once makes fewer pairs;
    then places say nothing, since they belong to a key.
    """
    tied = components(rest.join(leaders, "key").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "id", "root": "tie"})
    rest = written(rest.select("key", "id", "n", "p", "root").join(tied, "id"), "open")
    per_list = rest.groupBy("key", "tie").agg((F.count("*") * F.count("*")).alias("pairs"))
    together = per_list.groupBy("tie").agg(F.sum("pairs").alias("apart")).join(rest.groupBy("tie").agg(F.countDistinct("id").alias("m")), "tie").filter("m * m <= apart").select("tie")
    whole = rest.join(together, "tie", "left_semi").groupBy("tie", "id").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    whole = whole.select(F.lit(True).alias("tied"), F.col("tie").alias("unit"), "id", "n", F.lit(0).alias("p"), "root")
    members = whole.unionByName(rest.join(together, "tie", "left_anti").select(F.lit(False).alias("tied"), F.col("key").alias("unit"), "id", "n", "p", "root"))
    members = written(members.join(sets.select("id", "sketch"), "id"), "members")
    sizes = members.groupBy("tied", "unit").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(sizes, ["tied", "unit"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with")})

    def left(rows: pa.Table) -> pa.Table:
        ids, n, p, root, own = (rows.column(c).to_numpy() for c in ("id", "n", "p", "root", "own"))
        words = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
        bits = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        one, two = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        found: list[np.ndarray] = []
        for i in one.tolist():
            other = two[ids[two] > ids[i]] if lo == hi else two
            other = other[root[other] != root[i]]
            both = n[other] + n[i]
            other = other[7 * np.minimum(n[other] - p[other], n[i] - p[i]) >= 3 * both]
            common = np.bitwise_count(words[other] & words[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[i] - (bits[i] - common), n[other] - (bits[other] - common))
            other = other[7 * most >= 3 * (n[other] + n[i])]
            found.append(np.stack([np.full(len(other), ids[i]), ids[other]]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("tied", "unit", "lo", "hi").applyInArrow(left, "a long, b long").distinct()


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, na, nb) for pairs (a, b)."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long").alias("shared")
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", shared, F.size("x").cast("long").alias("na"), F.size("y").cast("long").alias("nb"))


# Sizes a link allows; and, where the key is the first element that the two share, enough elements from there on
_POSSIBLE = "4 * least(na, nb) >= 3 * greatest(na, nb) and 7 * least(na - pa, nb - pb) >= 3 * (na + nb)"
_LINKED = "7 * shared >= 3 * (na + nb)"  # shared / (na + nb - shared) >= 3/4
_PAIR = ("least(id, other) a", "greatest(id, other) b")


def _grouped(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, body, n, root, component_id) per row of ``df``; ``root`` names the component, null for empty sets and null ids."""
    spark = df.sparkSession
    given = only(df, id=id_column, text=text_column).select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("body"))
    bucket_bits = min(MOST_GROUP_BITS, max(6, (2 * given.rdd.getNumPartitions() - 1).bit_length()))
    repeated = np.zeros((1 << bucket_bits, 1 << (REPEATED_BITS - bucket_bits - 3)), dtype=np.uint8)
    common = np.zeros((1 << bucket_bits, 1 << (COMMON_BITS - bucket_bits)), dtype=np.uint8)
    total, squares = 0.0, 0.0
    # ten megabytes at every size, so one job brings them; one by one they would be a job for each partition
    for row in _frequencies(given, bucket_bits).toArrow().to_pylist():
        repeated[row["bucket"]] = np.frombuffer(row["repeated"], dtype=np.uint8)
        common[row["bucket"]] = np.frombuffer(row["common"], dtype=np.uint8)
        total, squares = total + row["total"], squares + row["squares"]
    scanned = squares / total if total else 0.0
    boundary = 4 * int(1 + 2 * scanned) - 1  # subsets p(p+1)/2 against p lists of this length, p = n/4+1
    tables = spark.sparkContext.broadcast((repeated.tobytes(), common.tobytes()))
    del repeated, common
    documents = written(_documents(given, tables, boundary), "documents")
    tables.destroy()
    del tables
    hand_back()  # the driver held some copies of the tables

    keyed = documents.filter("keys is not null and id is not null")
    # keys are moved once, to the class they belong to
    one = F.min_by(F.struct("id", "body", "n", "keys", "places"), F.struct("id", "body")).alias("m")
    members = written(keyed.groupBy("class").agg(one).select("class", "m.*"), "members")
    # from here on a class stands for its members, under the name ``id``
    lists = members.select(F.col("class").alias("id"), F.col("id").alias("first"), "n", F.inline(F.arrays_zip("keys", "places"))).withColumnsRenamed({"keys": "key", "places": "p"})
    lists = laid_by_track(lists, "lists", by=("key",), order=("id",))  # leaders and lists meet where they lie

    # the document of least id leads: what others were copied from mostly comes before them
    lead = F.min(F.struct("first", "id", "n", "p"))
    leaders = lists.groupBy("key").agg(lead.alias("m"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    leaders = leaders.select("key", F.col("m.id").alias("other"), F.col("m.n").alias("nb"), F.col("m.p").alias("pb"))
    candidates = lists.join(leaders, "key").filter("id <> other").withColumnsRenamed({"n": "na", "p": "pa"}).filter(_POSSIBLE)
    candidates = written(candidates.selectExpr(*_PAIR).distinct(), "candidates")

    wanted = np.zeros(1 << (WANTED_BITS - 5), dtype=np.int64)
    slots = members.withColumn("slot", _slot())
    bits = slots.selectExpr("cast(slot div 32 as int) w", "shiftleft(1L, cast(slot % 32 as int)) bit")
    found = bits.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^19 rows at most
    wanted[found["w"].to_numpy()] = found["bits"].to_numpy()
    chosen = spark.sparkContext.broadcast(wanted)
    own = members.select("class", F.struct("id", "body").alias("own"))
    # elements are moved once, to the class they belong to, and every comparison reads them there; an equation would be
    # one more key of the join, and they would be moved by that and then by the class
    sets = _sets(given, chosen).join(own, "class").filter("own <= struct(id, body) and own >= struct(id, body)").dropDuplicates(["class"])
    sets = laid_by_track(sets.select(F.col("class").alias("id"), "elements", "sketch"), "sets", by=("id",), dealt=True)
    chosen.destroy()

    compared = written(_compared(candidates, sets), "compared")
    linked = components(compared.filter(_LINKED))
    to_leader = leaders.select("key", "other")
    open_lists, done = lists, [candidates, compared]
    for turn in range(STAR_ROUNDS + 1):
        # members of lists of at least three that are not all in one component, without the leader they were compared with
        labelled = open_lists.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        undone = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
        rest = labelled.join(undone, "key", "left_semi").join(leaders.select("key", F.col("other").alias("id")), ["key", "id"], "left_anti")
        rest = written(rest, "open")
        done.append(rest)
        if rest.isEmpty():
            break
        known = compared.select("a", "b")
        if turn < STAR_ROUNDS:
            smallest = rest.groupBy("key", "root").agg(F.count("*").alias("m"), lead.alias("of"))
            smallest = smallest.groupBy("key").agg(F.min(F.struct("m", "of", "root")).alias("s"), F.count("*").alias("roots")).filter("roots > 1")
            leaders = smallest.select("key", F.col("s.of.id").alias("other"), F.col("s.of.n").alias("nb"), F.col("s.of.p").alias("pb"), F.col("s.root").alias("other_root"))
            pairs = rest.join(leaders, "key").filter("root <> other_root").withColumnsRenamed({"n": "na", "p": "pa"}).filter(_POSSIBLE)
            leaders = written(leaders, "leaders")
            done.append(leaders)
        else:
            pairs = open_pairs(rest, to_leader, sets).withColumnsRenamed({"a": "id", "b": "other"})
        pairs = pairs.selectExpr(*_PAIR).distinct().join(known, ["a", "b"], "left_anti")
        more = written(_compared(pairs, sets), "compared")
        done.append(more)
        compared = compared.unionByName(more)
        linked = joined_components(linked, more.filter(_LINKED).select("a", "b"))
        open_lists = rest.select("id", "first", "n", "key", "p")

    released(lists, sets, members, *done)
    rows = documents.select("id", "body", "class", "n")
    classes = rows.filter("n > 0 and id is not null").groupBy("class").agg(F.min("id").alias("first"))
    classes = classes.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rows.join(classes.join(least, "root").select("class", "root", "component_id"), "class", "left")
    inside = (F.col("n") > 0) & F.col("id").isNotNull()
    return found.select("id", "body", "n", F.when(inside, F.col("root")).alias("root"), F.when(inside, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def jaccard_components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, n_shingles and component_id (the smallest id reachable by links)."""
    return _grouped(df, id_column, text_column).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``df`` without the documents that are linked, directly or over others, with one that comes before, by id (and by a
    hash of the text where ids are the same).

    Of rows that repeat id and text one stays; rows without an id stay.
    """
    found = _grouped(df, id_column, text_column).filter("id is not null")
    firsts = found.filter("root is not null").groupBy("root").agg(F.min(F.struct("id", "body")).alias("m")).select("m.*")
    alone = found.filter("root is null").select("id", "body").distinct()
    body = f"b{uuid.uuid4().hex}"  # a name that no column of df has
    kept = firsts.unionByName(alone).withColumnsRenamed({"id": id_column, "body": body})
    rows = df.withColumn(body, F.xxhash64(F.col(f"`{text_column}`")))
    whole = rows.join(kept, [id_column, body], "left_semi").dropDuplicates([id_column, body])
    return whole.unionByName(rows.filter(F.col(f"`{id_column}`").isNull())).drop(body)
