"""Parent-child links to full hierarchies: path, depth, root, descendants and rings of every node.

Every node has at most one parent, the dst of its latest row. Level by level, a frontier of placed nodes is joined to the
children of its nodes. What no frontier from a root reaches hangs on a ring: repeated squaring of the parent map shrinks
the unreached nodes to those on rings, and the frontier goes on from these.

Defined cases: an empty table gives no rows. A NULL src or dst names no node, the other end of such a row is a node
without this link. NULL fetched_at counts as older than any time. Of equal times the larger dst wins. A node that is its
own parent is a ring of one. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canzona.session import HOT_ROWS, cut, hot_keys, replicated, salted, small

#: Levels of the frontier that one job takes.
LEVELS = 3


def parent_map(edges: DataFrame) -> DataFrame:
    """node, parent: one row for each id in src or dst; parent is NULL at a root."""
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("parent"), F.col("fetched_at").alias("at"))
    both = (
        links.filter("node is not null")
        .withColumn("rank", F.when(F.col("parent").isNotNull(), F.struct(F.coalesce("at", F.lit(float("-inf"))).alias("at"), "parent")))
        .select("node", "rank")
        .unionByName(links.filter("parent is not null").select(F.col("parent").alias("node")).distinct(), allowMissingColumns=True)
    )
    return both.groupBy("node").agg(F.max("rank").alias("rank")).select("node", F.col("rank.parent").alias("parent"))


def _descend(start: DataFrame, children: DataFrame, hot: DataFrame, paths: bool) -> DataFrame:
    """start and all that hangs below it, one join a level; children: node, parent, salt.

    LEVELS joins share one job, in which the shuffles of the children and of each frontier are made once and reused.
    """
    reached, frontier = [start], start
    while True:
        batch = []
        for _ in range(LEVELS):
            up = replicated(frontier.select(F.col("node").alias("parent"), "root", "depth", *(["path"] if paths else [])), hot, "parent")
            frontier = children.join(up, ["parent", "salt"]).select(
                "node", "root", (F.col("depth") + 1).alias("depth"), *([F.concat("path", F.array("node")).alias("path")] if paths else [])
            )
            batch.append(frontier)
        done = cut(reduce(DataFrame.unionByName, batch))
        reached.append(done)
        low = done.agg(F.max("depth")).first()[0]
        frontier = done.filter(F.col("depth") == low)
        if low is None or low < LEVELS * (len(reached) - 1):
            return reduce(DataFrame.unionByName, reached)


def _rings(unreached: DataFrame) -> DataFrame:
    """node, root: the nodes of unreached (node, parent) that lie on a ring, with the smallest id of the ring."""
    jump, left = unreached, -1
    while True:
        image = jump.select(F.col("parent").alias("node")).distinct()
        now = image.count()
        if now == left:
            break
        left = now
        step = jump.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
        jump = cut(jump.join(step, "parent").select("node", F.col("far").alias("parent")))
    state = cut(unreached.join(cut(image), "node", "left_semi").select("node", "parent", F.col("node").alias("root")))
    while True:
        other = state.select(F.col("node").alias("parent"), F.col("parent").alias("far"), F.col("root").alias("theirs"))
        state = cut(
            state.join(other, "parent").select(
                "node", F.col("far").alias("parent"), F.least("root", "theirs").alias("root"), (F.col("theirs") < F.col("root")).alias("moved")
            )
        )
        if not state.filter("moved").limit(1).count():
            return state.select("node", "root")


def hierarchy(edges: DataFrame, paths: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """node, root, depth, status (tree, cycle, below_cycle) and, on request, path (array of ids from root to node)."""
    nodes = cut(parent_map(edges))
    links = nodes.filter("parent is not null")
    hot = cut(hot_keys(links, "parent", hot_rows))
    children = cut(salted(links, small(hot, hot.count()), "parent", F.col("node")))
    first = [F.array("node").alias("path")] if paths else []
    roots = nodes.filter("parent is null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *first)
    trees = cut(_descend(roots, children, hot, paths))
    unreached = cut(links.join(trees.select("node"), "node", "left_anti"))
    placed = trees.withColumn("status", F.lit("tree"))
    if unreached.limit(1).count():
        rings = cut(_rings(unreached))
        ring_start = rings.select("node", "root", F.lit(0).alias("depth"), *first)
        outside = children.join(rings.select("node"), "node", "left_anti")
        under = _descend(ring_start, cut(outside), hot, paths)
        placed = placed.unionByName(under.withColumn("status", F.when(F.col("depth") == 0, "cycle").otherwise("below_cycle")))
    return placed.select("node", "root", "depth", "status", *(["path"] if paths else []))


def descendants(placed: DataFrame) -> DataFrame:
    """ancestor, node, distance: every pair of a node and one above it, from hierarchy(paths=True)."""
    return placed.select("node", F.posexplode("path").alias("at", "ancestor"), F.size("path").alias("n")).filter(
        F.col("at") < F.col("n") - 1
    ).select("ancestor", "node", (F.col("n") - 1 - F.col("at")).alias("distance"))
