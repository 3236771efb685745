"""Parent pointers of any depth, by pointer doubling.

After round k every row knows its ancestor at distance 2^k, so a chain of depth
d takes log2(d) joins instead of d. Rows whose pointer never ends lie on, or
below, a cycle: once the number of unfinished rows stays the same from one
round to the next, no deeper chain can be left, because depths have no gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.checkpoints import cut
from fleetlens.plans.joins import join_null_safe


def _links(df: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """One row a node. A node that occurs several times (a session with several requests) hangs below one of its
    parents, the smallest; a row of it without a parent changes nothing."""
    up = F.when((F.col(parent) > 0) & (F.col(parent) != F.col(node)), F.col(parent))
    return df.where(F.col(node).isNotNull()).groupBy(*keys, F.col(node).alias("node")).agg(F.min(up).alias("up"))


def paths_from_roots(df: DataFrame, keys: Sequence[str], node: str, parent: str) -> DataFrame:
    """keys, node, path: the nodes from the root down to the node. Rows that no
    root reaches (cycles, unknown parents) are left out."""
    keys = list(keys)
    now = cut(_links(df, keys, node, parent).withColumn("path", F.array("node")))
    open_before = None
    while True:
        still_open = now.where(F.col("up").isNotNull()).count()
        if still_open in (0, open_before):
            return now.where(F.col("up").isNull()).select(*keys, "node", "path")
        open_before = still_open
        above = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        done = now.where(F.col("up").isNull())
        # an unknown parent has no row above: the inner join ends such a chain
        moved = join_null_safe(now.where(F.col("up").isNotNull()), above, [*keys, "up"]).select(*keys, "node", F.col("up2").alias("up"), F.concat("path2", "path").alias("path"))
        now = cut(done.unionByName(moved))


def descendant_counts(df: DataFrame, keys: Sequence[str], node: str, parent: str) -> DataFrame:
    """keys, node, descendants: how many rows lie below each row; every row of a
    cycle lies below every other one."""
    keys = list(keys)
    links = _links(df, keys, node, parent)
    known = links.select(*keys, F.col("node").alias("up"))
    rooted = join_null_safe(links.where(F.col("up").isNotNull()), known, [*keys, "up"], "left_semi")
    free = links.where(F.col("up").isNull()).select(*keys, "node", "up").unionByName(
        join_null_safe(links.where(F.col("up").isNotNull()), known, [*keys, "up"], "left_anti").select(*keys, "node", F.lit(None).cast("bigint").alias("up")))
    now = cut(rooted.select(*keys, "node", "up").unionByName(free).withColumn("below", F.lit(0).cast("bigint")))
    shape_before = None
    while True:
        row = now.where(F.col("up").isNotNull()).groupBy(*keys, "up").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count(F.lit(1))).first()
        shape = (row[0] or 0, row[1])
        if shape[0] == 0:
            return now.select(*keys, "node", F.col("below").alias("descendants"))
        if shape == shape_before:
            return _with_cycles(now, links, keys)
        shape_before = shape
        handed = now.where(F.col("up").isNotNull()).groupBy(*keys, F.col("up").alias("node")).agg(F.sum(F.col("below") + 1).alias("more"))
        above = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"))
        now = cut(join_null_safe(join_null_safe(now, above, [*keys, "up"], "left"), handed, [*keys, "node"], "left").select(
            *keys, "node", F.col("up2").alias("up"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")))


def _with_cycles(now: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    # at this point the pointers of all unfinished rows end on cycle rows
    looped = now.where(F.col("up").isNotNull())
    ring = looped.select(*keys, F.col("up").alias("node")).distinct()
    label = cut(join_null_safe(ring, links, [*keys, "node"]).withColumn("label", F.col("node")))
    rounds, size = 0, label.count()
    while 2**rounds < size:
        above = label.select(*keys, F.col("node").alias("up"), F.col("up").alias("up2"), F.col("label").alias("label2"))
        label = cut(join_null_safe(label, above, [*keys, "up"]).select(*keys, "node", F.col("up2").alias("up"), F.least("label", "label2").alias("label")))
        rounds += 1
    ring_label = label.select(*keys, "node", "label")
    sizes = looped.groupBy(*keys, F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    sizes = join_null_safe(sizes, ring_label, [*keys, "node"]).groupBy(*keys, "label").agg((F.sum("n") - 1).alias("ring_below"))
    on_ring = join_null_safe(ring_label, sizes, [*keys, "label"]).select(*keys, "node", "ring_below")
    return join_null_safe(now, on_ring, [*keys, "node"], "left").select(*keys, "node", F.coalesce("ring_below", "below").alias("descendants"))
