"""Bipartite association graphs: matching, degrees, nesting."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.operators.lean import lean


def matching(edges) -> dict:
    """A maximum matching {left: right} of (left, right) pairs, the same for any order of them.

    Phases of shortest augmenting paths: a breadth-first layering, then paths
    along the layers with an explicit stack, so long paths need no deep recursion.
    """
    near: dict = {}
    for l, r in sorted(set(edges)):
        near.setdefault(l, []).append(r)
    left: dict = {}
    right: dict = {}
    while True:
        layer = {l: 0 for l in near if l not in left}
        queue, reached = deque(layer), False
        while queue:
            l = queue.popleft()
            for r in near[l]:
                owner = right.get(r)
                if owner is None:
                    reached = True
                elif owner not in layer:
                    layer[owner] = layer[l] + 1
                    queue.append(owner)
        if not reached:
            return left
        tried = {l: 0 for l in layer}
        for root in [l for l in near if l not in left]:
            path = [root]
            while path:
                l = path[-1]
                if tried[l] == len(near[l]):
                    path.pop()
                    continue
                r = near[l][tried[l]]
                tried[l] += 1
                owner = right.get(r)
                if owner is None:
                    for x in reversed(path):
                        taken = left.get(x)
                        left[x], right[r] = r, x
                        r = taken
                    break
                if layer.get(owner) == layer[l] + 1:
                    path.append(owner)


def max_matching(edges: DataFrame, group: list[str], left: str = "left_idx", right: str = "right_idx") -> DataFrame:
    """(group, left, right) of a maximum matching of each group's edges; a group is one task's work."""

    def run(table: pa.Table) -> pa.Table:
        found = sorted(matching(zip(table.column(left).to_pylist(), table.column(right).to_pylist(), strict=True)).items())
        head = {g: table.column(g).take(pa.array([0] * len(found), pa.int64())) for g in group}
        kinds = table.schema.field(left).type, table.schema.field(right).type
        return pa.table(head | {left: pa.array([a for a, _ in found], kinds[0]), right: pa.array([b for _, b in found], kinds[1])})

    chosen = edges.select(*group, left, right)
    return chosen.groupBy(*group).applyInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema))


def degree_prior(edges: DataFrame, q: float = 0.3) -> DataFrame:
    """Edge probability from the degrees of its ends in the graph as it is."""
    degree = lambda c: F.count("*").over(Window.partitionBy("pair_idx", c))
    return edges.withColumn("p", 0.5 * (F.lit(q) / degree("left_idx") + F.lit(q) / degree("right_idx")))


def node_mass(edges: DataFrame, delta: float = 0.01) -> DataFrame:
    """Mass of each end's edges and its weight ``1 / (max(1 - mass, 1e-9) * delta)``."""
    for side, c in (("left", "left_idx"), ("right", "right_idx")):
        mass = F.sum("p").over(Window.partitionBy("pair_idx", c))
        edges = edges.withColumn(f"{side}_mass", mass).withColumn(f"{side}_c", 1 / (F.greatest(1 - F.col(f"{side}_mass"), F.lit(1e-9)) * delta))
    return edges


def degree_weights(edges: DataFrame, keys: tuple[str, ...] = ("pair_idx",)) -> DataFrame:
    """``1 / left degree + 1 / right degree`` of each edge among the given rows."""
    degree = lambda c: F.count("*").over(Window.partitionBy(*keys, c))
    return edges.withColumn("weight", 1 / degree("left_idx") + 1 / degree("right_idx"))


def nested(edges: DataFrame, most: int) -> DataFrame:
    """The family of graphs E_1 to E_most: each edge once for each K from its own k on."""
    return edges.withColumn("target_k", F.explode(F.sequence(F.col("k"), F.lit(most))))


def progressive_degree_cap(edges: DataFrame, most: int, order: str = "ordinal") -> DataFrame:
    """In passes with caps 1, 2, ..., the edges in their order whose ends are both below the cap, until ``most`` are taken or none is left."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by(order)
        pairs = list(zip(rows.column("left_idx").to_pylist(), rows.column("right_idx").to_pylist(), strict=True))
        left: dict = {}
        right: dict = {}
        taken: list[int] = []
        open_, limit = list(range(len(pairs))), 1
        while open_ and len(taken) < most:
            later = []
            for i in open_:
                a, b = pairs[i]
                if len(taken) < most and left.get(a, 0) < limit and right.get(b, 0) < limit:
                    left[a], right[b] = left.get(a, 0) + 1, right.get(b, 0) + 1
                    taken.append(i)
                else:
                    later.append(i)
            open_, limit = later, limit + 1
        return rows.take(sorted(taken))

    return edges.groupBy("pair_idx").applyInArrow(lean(run), edges.schema)


def endpoint_degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct undirected edges without loops."""
    return edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()


def induced(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str = "node") -> DataFrame:
    """The edges whose ends are both among the nodes."""
    for c in (a, b):
        edges = edges.join(nodes.select(F.col(node).alias(c)).distinct(), c, "left_semi")
    return edges.select(a, b)
