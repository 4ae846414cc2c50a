"""Distributed union-find on a table of links.

Each round every node points to its smallest neighbour (a minimum, combined before the shuffle),
pointers are followed once more, and links are rewritten to the nodes pointed at.  Rewriting halves at
least the nodes that still have links, so rounds grow with the logarithm of the largest component.  No
group is ever collected; a hub only adds rows to a join whose other side has one row per node, which
adaptive execution may split.  Every round is written to the shared folder.  All joins name their kind:
links and nodes grow with the input, so no side is broadcast by Spark's estimates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.durable import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node of its component.

    Links may repeat and point either way; links of a node to itself and nulls are dropped; no links
    give an empty table.
    """
    e = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    roots = None
    while not e.isEmpty():
        ends = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialize(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "pointers")
        jump = materialize(to.join(to.select(F.col("node").alias("to"), F.col("to").alias("far")).hint("merge"), "to").select("node", F.col("far").alias("to")), "jumps")
        hop = jump.withColumnsRenamed({"node": "a", "to": "na"})
        hop2 = jump.withColumnsRenamed({"node": "b", "to": "nb"})
        short = e.join(hop.hint("merge"), "a").join(hop2.hint("merge"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).filter("a < b")
        left = materialize(short.distinct(), "links")
        if roots is None:
            new = jump.withColumnRenamed("to", "root")
        else:
            new = roots.join(jump.withColumnRenamed("node", "root").hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        new = materialize(new, "roots")
        discard(e, to, jump, *([roots] if roots is not None else []))
        e, roots = left, new
    if roots is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
