"""A Merkle manifest of a dataset by bitmap-rank indexing, in DataFrame operations only.

Every row is a leaf, the hash of its columns. The leaves of a group (a language) stand in the order of their ids,
and nothing is sorted to find their places: for each group and each range of 4096 ids a bitmap holds the ids that
occur. Bitmaps are merged by group and range, trimmed to the bytes in use, and carry a directory of bit counts.
The place (slot) of an id is the number of rows in the ranges before, plus the set bits before its own: two counts
from directories and one over at most 64 bytes.

Slots then key the tree. 256 neighbouring slots make one array, which is folded in place through eight levels; the
arrays' roots are the next round's leaves under a 256th of their slots, until each group is one node. The groups'
nodes are folded the same way, and the paths to the root go back down array by array. An array has at most
256 entries and a range at most 4096, so no group, however large, meets in one task.

Ids that occur several times: their rows follow each other, by leaf; a range lists how many rows more than ids it
has at which place. Rows of such ids are numbered through a range-dealt order, equal rows too, so one id may hold any
share of the rows. A null id comes before all others of its group; a null group before all other groups. Null
columns are marked as such in the leaf, texts are hashed whole. Further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewright.llm.ranges import with_totals_before
from pacewright.llm.shared import only, released, written

RANGE_BITS, ARRAY_BITS, BLOCK_BYTES = 12, 8, 64


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def _leaves(df: DataFrame, columns: dict[str, str], tampered: Column | None) -> DataFrame:
    """(id, g, leaf, changed): the hash of each row, and that of its tampered form, if it has one."""
    d = only(df, **columns)
    leaf = lambda size: F.sha2(F.concat(*[_field(size if c == "size" else F.col(c)) for c in columns]), 256)
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered & F.col("size").isNotNull(), leaf(F.col("size") + 1))
    group = F.when(F.col("group").isNull(), "").otherwise(F.concat(F.lit("="), F.col("group").cast("string")))
    return d.select(F.col("id").cast("long").alias("id"), group.alias("g"), leaf(F.col("size")).alias("leaf"), changed.alias("changed"))


def rank_directory(rows: DataFrame) -> DataFrame:
    """(g, range, n_rows, n_ids, bits, base, blocks, more, before) of rows (g, id): for each range of ids of each group its
    bitmap from byte ``base`` on, the set bits before each block of 64 bytes, the places of repeated ids with the rows they
    have more than one, and the rows of all ranges before (of all groups)."""
    ids = rows.groupBy("g", F.shiftright("id", RANGE_BITS).alias("range"), "id").agg(F.count("*").alias("n"))
    ids = ids.withColumn("place", F.col("id").bitwiseAND(F.lit((1 << RANGE_BITS) - 1)))
    # dealt out by range first, else every task would make a bitmap of each range it has an id of
    ranges = ids.repartition("g", "range").groupBy("g", "range").agg(
        F.sum("n").alias("n_rows"),
        F.count("id").alias("n_ids"),
        F.bitmap_construct_agg("place").alias("bits"),
        (F.min("place") / 8).cast("int").alias("base"),
        (F.max("place") / 8).cast("int").alias("end"),
        F.sort_array(F.collect_list(F.when((F.col("n") > 1) & F.col("id").isNotNull(), F.struct(F.col("place"), (F.col("n") - 1).alias("rows"))))).alias("more"),
    )
    ranges = ranges.withColumn("bits", F.expr("substring(bits, base + 1, end - base + 1)")).drop("end")
    ranges = ranges.withColumn("blocks", F.expr(f"transform(sequence(0, coalesce(octet_length(bits), 0) div {BLOCK_BYTES}), j -> bitmap_count(substring(bits, 1, {BLOCK_BYTES} * j)))"))
    return with_totals_before(ranges, [F.col("g"), F.asc_nulls_first("range")], "n_rows")


_BYTE = "(place div 8 - base)"
#: Rows of the range that come before the id at ``place``.
_RANK = f"""blocks[cast({_BYTE} div {BLOCK_BYTES} as int)]
    + bitmap_count(substring(bits, cast({BLOCK_BYTES} * ({_BYTE} div {BLOCK_BYTES}) + 1 as int), cast({_BYTE} % {BLOCK_BYTES} as int)))
    + bit_count(cast(conv(hex(substring(bits, cast({_BYTE} + 1 as int), 1)), 16, 10) as int) & (shiftleft(1, cast(place % 8 as int)) - 1))
    + aggregate(filter(more, m -> m.place < place), 0L, (n, m) -> n + m.rows)"""


def _slotted(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with their ``slot`` in the group; and (g, n) of each group."""
    directory = written(rank_directory(leaves), "directory")
    groups = written(directory.groupBy("g").agg(F.sum("n_rows").alias("n"), F.min("before").alias("first")), "groups")
    d = leaves.withColumn("range", F.shiftright("id", RANGE_BITS)).withColumn("place", F.col("id").bitwiseAND(F.lit((1 << RANGE_BITS) - 1)))
    found = directory.join(groups, "g").select(F.col("g").alias("dg"), F.col("range").alias("dr"), (F.col("before") - F.col("first")).alias("start"), "bits", "base", "blocks", "more")
    d = d.join(found, F.expr("g = dg and range <=> dr")).withColumn("slot", F.col("start") + F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.expr(_RANK)))
    columns = ["g", "id", "leaf", "changed", "slot"]
    if directory.filter("n_rows > n_ids").isEmpty():
        return d.select(*columns), groups
    d = written(d.select(*columns, F.expr("id is null or exists(more, m -> m.place = place)").alias("several")), "several")
    # equal rows are told apart by where they lie in the written table
    rows = d.filter("several").drop("several").withColumn("row", F.monotonically_increasing_id())
    rows = written(with_totals_before(rows, [F.col("g"), F.asc_nulls_first("id"), F.col("leaf"), F.col("row")], name="at"), "several")
    firsts = rows.groupBy("g", "slot").agg(F.min("at").alias("first"))
    rows = rows.join(firsts, ["g", "slot"]).withColumn("slot", F.col("slot") + F.col("at") - F.col("first"))
    return d.filter("not several").select(*columns).unionByName(rows.select(*columns)), groups


def _levels(n: str) -> str:
    """SQL of all levels of an array ``hashes`` of a group that has ``n`` nodes at its lowest level."""
    pairs = "transform(sequence(0, (size(element_at(a, -1)) - 1) div 2), i -> sha2(concat(element_at(a, -1)[2 * i], coalesce(get(element_at(a, -1), 2 * i + 1), '')), 256))"
    return f"aggregate(sequence(0, {ARRAY_BITS - 1}), array(hashes), (a, j) -> if({n} > shiftleft(1L, j), array_append(a, {pairs}), a))"


def slot_arrays(nodes: DataFrame, counts: DataFrame, most: int) -> list[DataFrame]:
    """The rounds of the tree over ``nodes`` (g, slot, hash, further columns), lowest first; the last has one row a group.

    ``counts`` (g, n) has the nodes of each group, ``most`` the largest of them. A round's rows: g, slot (the array's, in
    the round above), nodes (structs in order of their slots), levels (arrays of hashes from the leaves to the root), hash
    (the root)."""
    rounds: list[DataFrame] = []
    while not rounds or most > 1:
        own = [c for c in nodes.columns if c not in ("g", "slot", "hash")]
        each = F.sort_array(F.collect_list(F.struct("slot", "hash", *own)))
        d = nodes.groupBy("g", F.shiftright("slot", ARRAY_BITS).alias("up")).agg(each.alias("nodes")).withColumnRenamed("up", "slot")
        d = d.withColumn("hashes", F.col("nodes.hash")).join(counts, "g")
        rounds.append(written(d.select("g", "slot", F.transform("nodes", lambda x: x.dropFields("hash")).alias("nodes"), F.expr(_levels("n")).alias("levels")), "arrays"))
        nodes = rounds[-1].select("g", "slot", F.expr("element_at(levels, -1)[0] hash"))
        most = -(-most // (1 << ARRAY_BITS))
        counts = counts.withColumn("n", F.ceil(F.col("n") / (1 << ARRAY_BITS)))
    return rounds


#: The sibling at each level of an array, from leaf ``o`` upwards: L or R for its side and its hash; N where a node stands alone.
_SIBLINGS = """transform(sequence(1, greatest(1, size(levels) - 1)), j -> if(size(levels) = 1, null,
    concat(if(get(levels[j - 1], shiftright(o, j - 1) ^ 1) is null, 'N', if(shiftright(o, j - 1) & 1 = 1, 'L', 'R')), coalesce(get(levels[j - 1], shiftright(o, j - 1) ^ 1), ''))))"""


def paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest round with ``hash`` and ``path``, their siblings up to the root; ``tops`` (g, path) has how each group goes on."""
    above = tops.withColumn("slot", F.lit(0).cast("long"))
    for arrays in reversed(rounds):
        d = arrays.join(above, ["g", "slot"])
        each = F.expr(f"transform(nodes, (x, o) -> named_struct('x', x, 'hash', levels[0][o], 'path', concat(filter({_SIBLINGS}, s -> s is not null), path)))")
        above = d.select("g", F.inline(each)).select("g", "x.*", "hash", "path")
    return above


def merkle_manifest(df: DataFrame, id_column: str = "doc_id", source_column: str = "source", group_column: str = "lang", size_column: str = "n_chars", text_column: str = "text", tampered: Column | None = None) -> DataFrame:
    """One row per row of ``df``: its id, leaf, subroot of its group, root, proof_sha256 (the hash of its siblings), folded_root
    (from the leaf, or from that of the tampered row, along the siblings) and verified.

    ``tampered``: a condition on ``id``; rows for which it holds are folded as if their size were one more, unless it
    is null.
    """
    leaves = written(_leaves(df, {"id": id_column, "source": source_column, "group": group_column, "size": size_column, "text": text_column}, tampered), "leaves")
    slotted, groups = _slotted(leaves)
    most = groups.agg(F.max("n").alias("n")).first()["n"] or 0
    rounds = slot_arrays(slotted.withColumnRenamed("leaf", "hash"), groups.select("g", "n"), most)
    subroots = written(with_totals_before(rounds[-1].select("g", F.expr("element_at(levels, -1)[0] subroot")), [F.col("g")], name="slot"), "subroots")
    n = subroots.count()
    over = slot_arrays(subroots.select(F.lit("").alias("g"), "slot", F.col("subroot").alias("hash"), F.col("g").alias("group")), df.sparkSession.createDataFrame([("", n)], "g string, n long"), n)
    root = over[-1].select(F.expr("element_at(levels, -1)[0] root")).first()
    start = df.sparkSession.createDataFrame([("", [])], "g string, path array<string>")
    tops = paths(over, start).select(F.col("group").alias("g"), "path")
    released(leaves)
    fold = "aggregate(path, coalesce(changed, hash), (h, s) -> sha2(if(startswith(s, 'L'), concat(substring(s, 2), h), concat(h, substring(s, 2))), 256))"
    found = paths(rounds, tops).join(subroots.select("g", "subroot"), "g")
    found = found.select(F.col("id").alias(id_column), F.col("hash").alias("leaf"), "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), F.sha2(F.array_join(F.transform("path", lambda s: F.substring(s, 2, 64)), ""), 256).alias("proof_sha256"), F.expr(fold).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
