"""Grid motion statistics: edges that many edges of the neighbouring cells support.

Points fall into cells of a left grid, shifted by half a cell in four ways, and
of an unshifted right grid.  A left cell's best right cell is accepted if the
3x3 neighbourhoods of the two hold enough edges between matching cells.

Points outside a grid are dropped (an index beyond the right grid has no defined meaning otherwise).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.geometry import finite
from matchweave.operators.graph import matching
from matchweave.operators.knn import ordinal, renumbered
from matchweave.operators.lean import lean

#: Ratio of the right grid to the left one, in the order in which they are tried.
SCALES = (1.0, 1.0 / 2, 1.0 / math.sqrt(2.0), math.sqrt(2.0), 2.0)
_RING = ((-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0))


def neighbours(turn: int) -> list[tuple[int, int, int, int]]:
    """(dx, dy) of the nine left cells with (dx, dy) of the right cell that belongs to each when the right ring is turned by so many eighths."""
    return [(0, 0, 0, 0)] + [(*left, *_RING[(i - turn) % 8]) for i, left in enumerate(_RING)]


_AREA = [f"{c}{s}" for s in "12" for c in "xy"]


def bounds(edges: DataFrame, grid: int = 20) -> DataFrame:
    """Per pair the area of each side that its points take: ``<c>_from`` and ``<c>_size`` in whole pixels.

    The margin is that of the pair, half a cell of the widest of its four spans, so that a shift by half a cell leaves no point outside.
    """
    low, high = ({c: f(c) for c in _AREA} for f in (F.min, F.max))
    margin = F.ceil(F.greatest(*(high[c] - low[c] for c in _AREA)) / (2 * (grid - 1)))
    sizes = [F.greatest(F.floor((high[c] + margin) - (low[c] - margin)) + 1, F.lit(1)).alias(f"{c}_size") for c in _AREA]
    return edges.groupBy("pair_idx").agg(*((low[c] - margin).cast("double").alias(f"{c}_from") for c in _AREA), *sizes)


def image_sizes(cameras: DataFrame) -> DataFrame:
    """(pair_idx, x1_size, y1_size, x2_size, y2_size) of cameras (pair_idx, cx1, cy1, cx2, cy2): twice the principal point, one pixel at least.
    A camera with a number that is missing gives no size."""
    whole = cameras.filter(" AND ".join(f"c{c} IS NOT NULL AND NOT isnan(c{c})" for c in _AREA))
    return whole.select("pair_idx", *(F.greatest(F.round(2.0 * F.col(f"c{c}")).cast("long"), F.lit(1)).alias(f"{c}_size") for c in _AREA))


def image_areas(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per pair the area of each side that its image takes, from the origin on (columns of ``bounds``): the size of ``image_sizes``, or as far as the points reach
    if that is more; pairs without sizes take the latter."""
    reach = edges.groupBy("pair_idx").agg(*(F.greatest(F.floor(F.max(c)) + 1, F.lit(1)).alias(f"_{c}") for c in _AREA))
    both = reach.join(sizes, "pair_idx", "left")
    return both.select("pair_idx", *(F.lit(0.0).alias(f"{c}_from") for c in _AREA), *(F.greatest(F.coalesce(f"{c}_size", F.lit(0)), F.col(f"_{c}")).alias(f"{c}_size") for c in _AREA))


def _cell(x: Column, y: Column, shift_x: bool, shift_y: bool, width: int, height: int) -> Column:
    cx, cy = F.floor(x * width + 0.5 * shift_x).cast("int"), F.floor(y * height + 0.5 * shift_y).cast("int")
    return F.when((cx >= int(shift_x)) & (cx < width) & (cy >= int(shift_y)) & (cy < height), cx + cy * width)


def cells(edges: DataFrame, grid: int = 20, scale: float = 1.0) -> DataFrame:
    """Edges (pair_idx, left_idx, right_idx, x1..y2 in [0, 1)) once for each of the four shifts in which both ends have a cell."""
    right = int(grid * scale)
    shifts = F.array(*(F.struct(F.lit(n).alias("shift"), _cell(F.col("x1"), F.col("y1"), n in (2, 4), n in (3, 4), grid, grid).alias("left_cell")) for n in (1, 2, 3, 4)))
    placed = edges.withColumn("right_cell", _cell(F.col("x2"), F.col("y2"), False, False, right, right)).filter("right_cell IS NOT NULL").withColumn("s", F.explode(shifts))
    return placed.select("pair_idx", "left_idx", "right_idx", "s.shift", "s.left_cell", "right_cell").filter("left_cell IS NOT NULL")


def cell_statistics(placed: DataFrame) -> DataFrame:
    """Per shift and cell pair: an upper bound of the one-to-one edges, and the distinct left points of the left cell.

    The bound is the smaller number of distinct ends; ``filter_exact`` uses the maximum matching itself.
    """
    stat = placed.groupBy("pair_idx", "shift", "left_cell", "right_cell").agg(F.least(F.countDistinct("left_idx"), F.countDistinct("right_idx")).alias("stat"))
    points = placed.groupBy("pair_idx", "shift", "left_cell").agg(F.countDistinct("left_idx").alias("points"))
    return stat.join(points, ["pair_idx", "shift", "left_cell"])


def supported_cells(stats: DataFrame, grid: int = 20, scale: float = 1.0, turn: int = 0, factor: float = 6.0) -> DataFrame:
    """Each left cell's best right cell with the support of its neighbourhood and whether that is enough."""
    right = int(grid * scale)
    keys = ["pair_idx", "shift"]
    best = stats.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "left_cell").orderBy(F.desc("stat"), "right_cell"))).filter("_n = 1").select(*keys, "left_cell", "right_cell")
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("a", "b", "c", "d"), n, strict=True))) for n in neighbours(turn)))).alias("o")
    near = best.select("*", around)
    lx, ly = F.col("left_cell") % grid + F.col("o.a"), F.floor(F.col("left_cell") / grid) + F.col("o.b")
    rx, ry = F.col("right_cell") % right + F.col("o.c"), F.floor(F.col("right_cell") / right) + F.col("o.d")
    inside = (lx >= 0) & (lx < grid) & (ly >= 0) & (ly < grid) & (rx >= 0) & (rx < right) & (ry >= 0) & (ry < right)
    near = near.filter(inside).select(*keys, "left_cell", "right_cell", (lx + ly * grid).cast("int").alias("nl"), (rx + ry * right).cast("int").alias("nr"))
    stat = stats.select(*keys, F.col("left_cell").alias("nl"), F.col("right_cell").alias("nr"), "stat")
    points = stats.select(*keys, F.col("left_cell").alias("nl"), "points").distinct()
    joined = near.join(stat, [*keys, "nl", "nr"], "left").join(points, [*keys, "nl"], "left")
    total = joined.groupBy(*keys, "left_cell", "right_cell").agg(F.coalesce(F.sum("stat"), F.lit(0)).alias("score"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.count("*").alias("cells"))
    return total.withColumn("accepted", F.col("score") >= factor * F.sqrt(F.floor(F.col("points") / F.col("cells"))))


def inliers(placed: DataFrame, supported: DataFrame) -> DataFrame:
    """Edges (pair_idx, left_idx, right_idx, inlier): accepted under at least one shift."""
    good = supported.filter("accepted").select("pair_idx", "shift", "left_cell", "right_cell", F.lit(True).alias("good"))
    joined = placed.join(good, ["pair_idx", "shift", "left_cell", "right_cell"], "left")
    return joined.groupBy("pair_idx", "left_idx", "right_idx").agg(F.max(F.coalesce("good", F.lit(False))).alias("inlier"))


def _mask(left, right, a, b, grid: int, scale: float, turns, factor: float):
    """Inlier masks of one pair's edges for each turn, with exact matchings; a, b: (n, 2) in [0, 1)."""
    g = int(grid * scale)
    if g < 1:
        return [np.zeros(len(left), bool) for _ in turns]
    rc = np.floor(b * g).astype(int)
    right_ok = ((rc >= 0) & (rc < g)).all(1)
    rcell = rc[:, 0] + rc[:, 1] * g
    masks = [np.zeros(len(left), bool) for _ in turns]
    for sx, sy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        lc = np.floor(a * grid + 0.5 * np.array([sx, sy])).astype(int)
        ok = right_ok & ((lc >= [sx, sy]) & (lc < grid)).all(1)
        lcell = lc[:, 0] + lc[:, 1] * grid
        edges: dict = {}
        points: dict = {}
        for i in np.flatnonzero(ok).tolist():
            edges.setdefault((lcell[i], rcell[i]), set()).add((left[i], right[i]))
            points.setdefault(lcell[i], set()).add(left[i])
        stat = {k: len(matching(v)) for k, v in edges.items()}
        best: dict = {}
        for (l, r), n in sorted(stat.items()):
            if l not in best or n > stat[l, best[l]]:
                best[l] = r
        for mask, turn in zip(masks, turns, strict=True):
            good = set()
            for l, r in best.items():
                score = total = cells_ = 0
                for dx, dy, ex, ey in neighbours(turn):
                    x, y, u, v = l % grid + dx, l // grid + dy, r % g + ex, r // g + ey
                    if 0 <= x < grid and 0 <= y < grid and 0 <= u < g and 0 <= v < g:
                        score += stat.get((x + y * grid, u + v * g), 0)
                        total += len(points.get(x + y * grid, ()))
                        cells_ += 1
                if score >= factor * math.sqrt(total // cells_):
                    good.add((l, r))
            for i in np.flatnonzero(ok).tolist():
                mask[i] |= (lcell[i], rcell[i]) in good
    return masks


def filter_exact(edges: DataFrame, grid: int = 20, factor: float = 6.0, with_scale: bool = False, with_rotation: bool = False) -> DataFrame:
    """The edges (pair_idx, left_idx, right_idx, x1, y1, x2, y2 in [0, 1), ...) of the scale and rotation with strictly most inliers, scales first; none if all have none."""

    def run(table: pa.Table) -> pa.Table:
        left, right = table.column("left_idx").to_pylist(), table.column("right_idx").to_pylist()
        a, b = (np.stack([table.column(f"{c}{s}").to_numpy() for c in "xy"], 1) for s in "12")
        best, most = np.zeros(len(left), bool), 0
        for scale in SCALES if with_scale else SCALES[:1]:
            for mask in _mask(left, right, a, b, grid, scale, range(8 if with_rotation else 1), factor):
                if mask.sum() > most:
                    best, most = mask, int(mask.sum())
        return table.filter(pa.array(best))

    return edges.groupBy("pair_idx").applyInArrow(lean(run), edges.schema)


def first_seen(edges: DataFrame, order: str = "ordinal") -> DataFrame:
    """Edges with the coordinates of each point's first row: a point that is named with several places keeps the one it came with first."""
    out = edges
    for side, s in (("left", "1"), ("right", "2")):
        first = out.groupBy("pair_idx", f"{side}_idx").agg(F.min_by(F.struct(F.col(f"x{s}").cast("float").alias("x"), F.col(f"y{s}").cast("float").alias("y")), order).alias("_p"))
        out = out.drop(f"x{s}", f"y{s}").join(first, ["pair_idx", f"{side}_idx"]).withColumns({f"x{s}": F.col("_p.x").cast("double"), f"y{s}": F.col("_p.y").cast("double")}).drop("_p")
    return out


def in_frame(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Whether a point is a place in an image at all (finite, not negative), and whether it lies on its pixels."""
    valid = finite(x) & finite(y) & (x >= 0) & (y >= 0)
    return F.coalesce(valid, F.lit(False)), F.coalesce(valid & (x <= width - 1) & (y <= height - 1), F.lit(False))


def filter_files(edges: DataFrame, grid: int = 20, factor: float = 6.0, with_scale: bool = False, with_rotation: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """The whole filter on association rows (pair_idx, left_idx, right_idx, x1, y1, x2, y2 in pixels, k, similarity): places of first rows, points in
    the unit square of each side's area (of the images with ``sizes``, see ``image_sizes``; else of the points alone), the exact filter, and ids
    renumbered in the order of the rows that are left.  Rows with a coordinate that is no place are dropped with their edge."""
    valid = in_frame(F.col("x1"), F.col("y1"), F.lit(float("inf")), F.lit(float("inf")))[0] & in_frame(F.col("x2"), F.col("y2"), F.lit(float("inf")), F.lit(float("inf")))[0]
    placed = first_seen(edges.filter(valid).withColumn("ordinal", ordinal()))
    area = bounds(placed, grid) if sizes is None else image_areas(placed, sizes)
    square = placed.join(area, "pair_idx").withColumns({f"u{c}": (F.col(c) - F.col(f"{c}_from")) / F.col(f"{c}_size") for c in _AREA})
    names = {f"u{c}{s}": f"{c}{s}" for c in "xy" for s in "12"}
    kept = filter_exact(square.select("pair_idx", "left_idx", "right_idx", *(F.col(u).alias(c) for u, c in names.items())), grid, factor, with_scale, with_rotation).select("pair_idx", "left_idx", "right_idx")
    left = placed.join(kept, ["pair_idx", "left_idx", "right_idx"], "left_semi")
    return renumbered(left, "ordinal")
