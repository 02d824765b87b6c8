"""Connected components of a graph of links, by large-star and small-star rounds.

Each round is a grouped minimum and a join on the node, so hubs are pre-aggregated
before they are shuffled and no task ever holds a component.  Every round
turns the links into flatter stars; the number of rounds grows with the logarithm of the
longest chain.  Links between rounds live in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

MAX_ROUNDS = 60


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``links`` has columns a and b (any orderable type); returns (node, component), one row per linked node.

    ``component`` is the least node that can be reached.  Self links, repeated links and
    links with a null end are ignored; no links give no rows.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = scratch.write(ordered, f"{name}-0")
    for round_ in range(1, MAX_ROUNDS + 1):
        # Large star: a node's larger neighbours point to the least of its neighbours and itself.
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # Small star: a node and its smaller neighbours point to the least of these.
        small = large.join(_least(large), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        current = scratch.write(small, f"{name}-{round_}")
        scratch.drop(f"{name}-{round_ - 1}")
        counts = current.agg(F.count("*").alias("links"), F.count_distinct("u").alias("nodes")).first()
        # Stars only: every node has one link, and no centre has a link of its own.
        if counts.links == counts.nodes and not current.join(current.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count():
            centres = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _least(links: DataFrame) -> DataFrame:
    """The least ``v`` of each ``u``.

    The key is wrapped while grouping, so that the join that follows has exchanges
    of its own on both sides: adaptive execution can then split the rows of a hub.
    """
    return links.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select("k.u", "m")
