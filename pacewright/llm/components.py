"""Connected components of a table of links, by random contraction.

Each round every node goes to the node of least hash within two steps (itself, if its own is least),
links are redrawn between the nodes gone to, and those inside one node drop out. A star shrinks to one
node in one round and a chain by a constant factor, however its nodes are numbered. Nothing is gathered per
node but minima, so a node with very many links is as cheap as its links are many. Each round is written
to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewright.llm.shared import released, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's smallest node.

    Null ends and links of a node with itself are ignored; repeated links count once; no links give
    an empty table.
    """
    edge = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    links = written(links.filter("a <> b").select(*edge).distinct(), "links")
    gone: list[DataFrame] = []
    while not gone or not links.isEmpty():
        salt = F.lit(len(gone))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("p"))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("p"))).alias("m")).select("a", F.least("m", own).alias("m"))
        over = both.join(near.select(F.col("a").alias("b"), F.col("m").alias("n")), "b").groupBy("a").agg(F.min("n").alias("n"))
        gone.append(written(over.join(near, "a").select("a", F.least("m", "n")["p"].alias("p")), "gone"))
        to = gone[-1]
        redrawn = (
            links.join(to.withColumnRenamed("p", "pa"), "a")
            .join(to.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
            .filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct()
        )
        before, links = links, written(redrawn, "links")
        released(before)

    def onward(reached: DataFrame, step: DataFrame) -> DataFrame:
        step = step.select(F.col("a").alias("p"), F.col("p").alias("q"))
        return reached.join(step, "p", "left").select("a", F.coalesce("q", "p").alias("p"))

    ends = reduce(onward, gone[1:], gone[0])
    roots = ends.groupBy("p").agg(F.min("a").alias("root"))
    found = written(ends.join(roots, "p").select(F.col("a").alias("node"), "root"), "components")
    released(links, *gone)
    return found


def joined_components(linked: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``linked`` (node, root) after further links (a, b)."""
    at = linked.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    links = links.join(at, "a", "left").join(at.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left")
    between = components(links.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    new = links.filter("ra is null").select("a").union(links.filter("rb is null").select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    moved = between.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(linked.unionByName(new).join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "components")
