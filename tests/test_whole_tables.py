"""Queries that SQL cannot express, over all of the smallest tables, against plain programs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave import plans
from matchweave.operators import gridfilter
from matchweave.plans import association
from matchweave.sources import adapters

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    """pair -> its association edges in their order."""
    out = {}
    for r in plans.QUERIES["mutual_knn_progressive"](spark, FOLDER).collect():
        out.setdefault(r.pair_idx, []).append(r)
    return {p: sorted(e, key=lambda r: (r.k, -r.similarity, r.left_idx, r.right_idx)) for p, e in out.items()}


def largest_matching(edges) -> int:
    """One augmenting path after the other."""
    near, owner = {}, {}
    for l, r in set(edges):
        near.setdefault(l, []).append(r)

    def place(l, seen):
        for r in near[l]:
            if r not in seen:
                seen.add(r)
                if r not in owner or place(owner[r], seen):
                    owner[r] = l
                    return True
        return False

    return sum(place(l, set()) for l in near)


def test_bipartite_max_matching(spark, graph):
    found = {}
    for r in plans.QUERIES["bipartite_max_matching"](spark, FOLDER).collect():
        found.setdefault(r.pair_idx, []).append((r.left_idx, r.right_idx))
    for pair, edges in graph.items():
        every = {(e.left_idx, e.right_idx) for e in edges}
        assert set(found[pair]) <= every and len(found[pair]) == largest_matching(every)
        assert len({l for l, _ in found[pair]}) == len({r for _, r in found[pair]}) == len(found[pair])
    assert set(found) == set(graph) and len(graph) > 3


def test_progressive_degree_cap(spark, graph):
    found = {}
    for r in plans.QUERIES["progressive_degree_cap"](spark, FOLDER).collect():
        found.setdefault(r.pair_idx, set()).add((r.left_idx, r.right_idx))
    for pair, edges in graph.items():
        taken, degree = [], {}
        for cap in range(1, len(edges) + 1):
            for e in edges:
                ends = ("l", e.left_idx), ("r", e.right_idx)
                if len(taken) < 100 and e not in taken and all(degree.get(x, 0) < cap for x in ends):
                    taken.append(e)
                    for x in ends:
                        degree[x] = degree.get(x, 0) + 1
        assert found[pair] == {(e.left_idx, e.right_idx) for e in taken}


def test_mcm_rerank(spark):
    edges, scored = association._scored(spark, FOLDER)
    scores = {(r.pair_idx, r.hid): r.hcm for r in plans.QUERIES["hcm_score"](spark, FOLDER).collect()}
    inliers = {}
    for r in scored.filter("inlier").select("pair_idx", "hid", "left_idx", "right_idx").collect():
        inliers.setdefault((r.pair_idx, r.hid), []).append((r.left_idx, r.right_idx))
    got = {r.pair_idx: r for r in plans.QUERIES["mcm_rerank"](spark, FOLDER).collect()}
    for pair, row in got.items():
        pool = sorted((s, h) for (p, h), s in scores.items() if p == pair)[:3]
        ranked = sorted((-largest_matching(inliers.get((pair, h), [])), s, place, h) for place, (s, h) in enumerate(pool, 1))
        assert (-row.cardinality, row.hid, row.place) == (ranked[0][0], ranked[0][3], ranked[0][2])
    assert {p for p, _ in scores} == set(got)


def plain_filter(edges, grid, factor, scale, turn):
    """The inliers of one setting, cell by cell."""
    ring = [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]
    other, good = int(grid * scale), set()
    if other < 1:
        return good
    for sx, sy in ((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)):
        cells, points = {}, {}
        for e in edges:
            x, y, u, v = math.floor(e[2] * grid + sx), math.floor(e[3] * grid + sy), math.floor(e[4] * other), math.floor(e[5] * other)
            if (x >= (sx > 0) and y >= (sy > 0) and x < grid and y < grid) and (0 <= u < other and 0 <= v < other):
                cells.setdefault(((x, y), (u, v)), set()).add((e[0], e[1]))
                points.setdefault((x, y), set()).add(e[0])
        size = {c: largest_matching(m) for c, m in cells.items()}
        for left in points:
            rights = [(-size[left, r], r[0] + r[1] * other, r) for l, r in size if l == left]
            right = min(rights)[2]
            score = total = n = 0
            for i, ((a, b), (c, d)) in enumerate([((0, 0), (0, 0)), *zip(ring, ring[-turn:] + ring[:-turn] if turn else ring, strict=True)]):
                l, r = (left[0] + a, left[1] + b), (right[0] + c, right[1] + d)
                if 0 <= l[0] < grid and 0 <= l[1] < grid and 0 <= r[0] < other and 0 <= r[1] < other:
                    score, total, n = score + size.get((l, r), 0), total + len(points.get(l, ())), n + 1
            if score >= factor * math.sqrt(total // n):
                good |= {e[:2] for e in edges if (e[0], e[1]) in cells[left, right]}
    return good


def test_grid_filter_exact(spark):
    left, right = adapters.sides(spark, FOLDER)
    at = {r.idx: r.raw for side in (left, right) for r in side.select("idx", "raw").collect()}
    unit = lambda v: tuple((x + 1) / 2 for x in v[:2])
    edges = {}
    for r in plans.QUERIES["mutual_knn_progressive"](spark, FOLDER).collect():
        edges.setdefault(r.pair_idx, []).append((r.left_idx, r.right_idx, *unit(at[r.left_idx]), *unit(at[r.right_idx])))
    found = {}
    for r in plans.QUERIES["grid_filter_exact"](spark, FOLDER).collect():
        found.setdefault(r.pair_idx, set()).add((r.left_idx, r.right_idx))
    for pair, rows in edges.items():
        best = set()
        for scale in gridfilter.SCALES:
            for turn in range(8):
                now = plain_filter(rows, association.GRID, 0.7, scale, turn)
                if len(now) > len(best):
                    best = now
        assert found.get(pair, set()) == best


def test_grid_filter_files(spark, graph):
    """Every pair against the plain filter on the unit squares of its area, renumbered as the rows that are left name their ends."""
    left, right = adapters.sides(spark, FOLDER)
    at = {r.idx: (np.float32(r.x), np.float32(r.y)) for side in (left, right) for r in side.select("idx", "x", "y").collect()}
    found = {}
    for r in plans.QUERIES["grid_filter_files"](spark, FOLDER).collect():
        found.setdefault(r.pair_idx, []).append((r.k, r.similarity, r.left_idx, r.right_idx))
    grid, checked = 8, 0
    for pair, rows in graph.items():
        points = np.array([[*at[r.left_idx], *at[r.right_idx]] for r in rows], float)
        margin = math.ceil((points.max(0) - points.min(0)).max() / (2 * (grid - 1)))
        size = np.floor((points.max(0) + margin) - (points.min(0) - margin)) + 1
        unit = (points - (points.min(0) - margin)) / size
        edges = [(r.left_idx, r.right_idx, *map(float, u)) for r, u in zip(rows, unit, strict=True)]
        best = set()
        for scale in gridfilter.SCALES:
            for turn in range(8):
                now = plain_filter(edges, grid, 0.7, scale, turn)
                if len(now) > len(best):
                    best = now
        numbers, want = ({}, {}), []
        for r in rows:
            if (r.left_idx, r.right_idx) in best:
                ids = [n.setdefault(i, len(n)) for n, i in zip(numbers, (r.left_idx, r.right_idx), strict=True)]
                want.append((r.k, round(r.similarity, 6), *ids))
        assert sorted(found.get(pair, [])) == sorted(want)
        checked += len(want)
    assert checked > 20


def test_partition_and_selection(spark):
    """Whole objects: every image has a side, halves differ by one at most, and selections hold their targets within the degrees."""
    parts = plans.QUERIES["partition_search"](spark, FOLDER).collect()
    sides = {}
    for r in parts:
        sides.setdefault(r.object, []).append(r.side)
    assert all(abs(2 * sum(s) - len(s)) <= 1 for s in sides.values()) and len(sides) > 5
    chosen = {}
    for r in plans.QUERIES["low_degree_edges"](spark, FOLDER).collect():
        chosen.setdefault(r.object, []).append(r)
    for rows in chosen.values():
        degree = {}
        for r in rows:
            for x in (r.low, r.high):
                degree[x] = degree.get(x, 0) + 1
        assert max(degree.values()) == rows[0].max_degree <= 12 and sum(d * d for d in degree.values()) == rows[0].squares


def test_ransac_pose(spark, graph):
    """Each pair's pose is as good as the best of many poses that a plain loop takes from samples of its own, and what is told of it is so."""
    from matchweave.operators import ransac, relpose, scoring

    got = {r.pair_idx: r for r in plans.QUERIES["ransac_pose"](spark, FOLDER).collect()}
    assert set(got) == set(graph)
    scored = scoring.with_prior(association._graph(spark, FOLDER)).toPandas()
    assert len(scored) == sum(map(len, graph.values())) and not scored["x1"].isna().any()
    estimated = 0
    for pair, r in got.items():
        assert r.n_edges == len(graph[pair])
        if r.status != "success":
            assert r.message in ("not_enough_matches", "proposal_graph_not_enough_o2o", "ransac_failed")
            continue
        estimated += 1
        mine = scored[scored["pair_idx"] == pair].sort_values(["left_idx", "right_idx"])
        x, y = relpose.homogeneous(mine[["x1", "y1"]].to_numpy()), relpose.homogeneous(mine[["x2", "y2"]].to_numpy())

        def inliers(q, t, x=x, y=y):
            """By the definition: the squared residual of each edge, and two positive depths by least squares."""
            rot = ransac._matrix(np.array(q))
            e = np.cross(np.eye(3), t).T @ rot
            fine = []
            for a, b in zip(x, y, strict=True):
                line, back = e @ a, e.T @ b
                depth = np.linalg.lstsq(np.stack([rot @ a, -b], 1), -np.array(t), rcond=None)[0]
                fine.append((b @ line) ** 2 < 0.01**2 * (line[0] ** 2 + line[1] ** 2 + back[0] ** 2 + back[1] ** 2) and (depth > 0.01).all())
            return np.array(fine)

        q, t = [r.qw, r.qx, r.qy, r.qz], [r.tx, r.ty, r.tz]
        assert abs(np.dot(q, q) - 1) < 1e-9 and abs(np.linalg.norm(t) - 1) < 1e-9 and r.cardinality <= r.n_inliers <= r.n_edges and r.iterations >= 1000
        pairs = mine[["left_idx", "right_idx"]].to_numpy()
        assert largest_matching(map(tuple, pairs[inliers(q, t)].tolist())) >= 0.8 * r.cardinality  # the polish may move single edges over the threshold
        rng, best = np.random.default_rng(pair), 0
        for _ in range(60):
            chosen = rng.permutation(len(mine))[:5]
            for rot, move, _ in zip(*relpose.sample_poses(x[None, chosen, :2], y[None, chosen, :2]), strict=True):
                best = max(best, largest_matching(map(tuple, pairs[inliers(ransac._quaternion(rot), move)].tolist())))
        assert r.cardinality >= best
    assert estimated >= 5
