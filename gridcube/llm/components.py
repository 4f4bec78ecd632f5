"""Connected components of a link table, by alternating star contraction.

Every step is an aggregate or an equi-join on distinct node pairs, so a node
with very many links is pre-aggregated map-side and its join partition can be
split by adaptive execution; nothing is gathered per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import counted


#: Links (16 bytes each) a task takes at least: a small table has few tasks, and
#: a single one needs no exchange in the steps between two checkpoints.
LINKS_A_TASK = 200_000


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.withColumnRenamed("m", "v")).coalesce(tasks).distinct()


def _settled(links: DataFrame) -> tuple[DataFrame, tuple]:
    """``links`` computed once, and what changes when any of them does."""
    links, seen = counted(links, mark=F.bit_xor(F.xxhash64("u", "v")))
    return links, (seen["n"], seen["mark"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the component is
    the smallest node reachable. Self-links and repeated links are harmless;
    links with a null end are ignored; without links the result is empty."""
    now, mark = _settled(links.where(F.col("a") != F.col("b"))
                         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while mark[0] and mark != before:
        before, tasks = mark, -(-mark[0] // LINKS_A_TASK)
        now, mark = _settled(_small_star(_large_star(now, tasks), tasks))
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def spanning_links(pairs) -> list[tuple]:
    """A forest over the pairs of one task: (root, member) for every member
    that is not a root. It connects what the pairs connect, with fewer rows."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(find(x), x) for x in parent if find(x) != x]
