"""Connected components of links between nodes, by contraction.

Every round, each node hooks to the neighbour (or itself) that comes first in an order of the round, nodes that
hooked together become one, and links inside them vanish. Only minima and distinct pairs are computed, with map-side
combine, so a node with very many links is no large group anywhere. Rounds take turns: the first order is that of the
nodes themselves, which ends a star around its smallest node at once (a random one halves it), the next one is random.
A constant share of the nodes goes in every random round, whatever their numbers, so the rounds are logarithmic; each
leaves its tables in the shared folder, and the tables shrink with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.storage import settled


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "component") -> DataFrame:
    """`node` and `component` of every node that a link names: the smallest node that can be reached.

    Links have no direction; repeated ones, loops and null ends change nothing (a node that only has a loop is a
    component alone). An empty frame gives an empty frame.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = settled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"{label}-nodes")
    left = settled(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-links")
    rounds, number = [], 0
    while not left.isEmpty():
        dice = lambda node: F.xxhash64(node, F.lit(number)) if number % 2 else F.lit(0).cast("bigint")  # noqa: E731, B023
        order = lambda node: F.struct(dice(node).alias("dice"), F.col(node).alias("node"))
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(order("b")), F.min(order("a")))["node"].alias("to"))
        hook = settled(hook, f"{label}-hooks")
        rounds.append(hook)
        ends = [hook.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in ("a", "b")]
        met = left.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to")
        left = settled(met.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), f"{label}-links")
        number += 1
    placed = nodes.select("node", F.col("node").alias("root"))
    for hook in rounds:
        placed = (placed.join(hook.select(F.col("node").alias("root"), "to"), "root", "left")
                  .select("node", F.coalesce("to", "root").alias("root")))
    if not rounds:
        return placed.select("node", F.col("root").alias("component"))
    placed = settled(placed, f"{label}-roots")
    first = placed.groupBy("root").agg(F.min("node").alias("component"))
    return placed.join(first, "root").select("node", "component")
