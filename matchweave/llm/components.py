"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step hangs the neighbours of a node on the smallest of them; the edges
shrink to one star for each component in few rounds.  Minima are aggregated before
they are shuffled, and the joins are plain ones between written tables, so that
adaptive execution can split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.shared import Workspace


def _print(edges: DataFrame) -> tuple:
    """Count and hash sum of a set of edges: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _hang(space: Workspace, edges: DataFrame, name: str, large: bool) -> DataFrame:
    """One star step; ``edges``: (a, b) with a > b."""
    sides = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = space.table(sides.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
    joined = sides.join(least, "a")
    if large:
        made = joined.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        made = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return space.table(made.filter("a > b").distinct(), name)


def connected(space: Workspace, edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): component is the smallest id that it reaches.

    Repeated edges, loops and either direction are fine; edges with a null end are left out.
    """
    turned = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = space.table(turned, f"{name}-0")
    seen, rounds = _print(now), 0
    while seen[0]:
        large = _hang(space, now, f"{name}-{rounds}-large", True)
        after = _hang(space, large, f"{name}-{rounds}-small", False)
        mark = _print(after)
        now, seen, same = after, mark, mark == seen
        rounds += 1
        if same:
            break
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
