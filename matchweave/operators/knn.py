"""Similarity joins and mutual nearest neighbours between the two sides of each pair.

The kernel meets two blocks of bounded size of a pair's sides in one task, multiplies them
and returns only ranked candidates: rows out grow with K, the number of
vectors and of blocks, not with the product of the sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.vector import dot
from matchweave.operators.lean import lean

#: Rows and columns of a matrix product, a tile; rows of a side that one task takes.
BLOCK, WIDTH, SIDE = 256, 512, 16_384
#: Cells of one array in products of whole rows.
CELLS = 1 << 17


def similarity_join(left: DataFrame, right: DataFrame, pair: str = "pair_idx") -> DataFrame:
    """All (left_idx, right_idx, similarity) inside a pair, relationally: as many rows as the product of the sides, so for small ones and
    further joins.  ``similarity_summary`` and ``ranked_candidates`` do without these rows."""
    l, r = left.select(pair, F.col("idx").alias("left_idx"), F.col("v").alias("lv")), right.select(pair, F.col("idx").alias("right_idx"), F.col("v").alias("rv"))
    return l.join(r, pair).select(pair, "left_idx", "right_idx", dot(F.col("lv"), F.col("rv")).alias("similarity"))


def similarity_summary(left: DataFrame, right: DataFrame, pair: str = "pair_idx", most: int = 16_384) -> DataFrame:
    """(pair, left_idx, n, best, mean) of each left vector's similarities to all right ones of its pair, in cells of two blocks."""

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        (li, a), (_, b) = _side(l), _side(r)
        best, total = np.zeros(len(li)), np.zeros(len(li))
        step = max(1, CELLS // max(1, len(b)))
        for low in range(0, len(li), step) if len(b) else ():
            s = a[low : low + step] @ b.T
            best[low : low + step], total[low : low + step] = s.max(1), s.sum(1)
        keep = len(li) if len(b) else 0
        name = l.column(pair).take(pa.array([0] * keep, pa.int64()))
        return pa.table({pair: name, "left_idx": pa.array(li[:keep], pa.int64()), "n": pa.array([len(b)] * keep, pa.int64()), "best": pa.array(best[:keep], pa.float64()), "total": pa.array(total[:keep], pa.float64())})

    kind = left.schema[pair].dataType.simpleString()
    l, r, _ = dealt(*(x.select(F.col(pair).alias(pair), F.col("idx").cast("long").alias("idx"), F.col("v").alias("v")) for x in (left, right)), pair, most)
    cell = [pair, "bl", "br"]
    parts = l.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(lean(run), f"{pair} {kind}, left_idx long, n long, best double, total double")
    return parts.groupBy(pair, "left_idx").agg(F.sum("n").alias("n"), F.max("best").alias("best"), (F.sum("total") / F.sum("n")).alias("mean"))


class _Lists:
    """The k best of each of n rows: value descending, then place ascending.  Tiles of values are offered in the order of their places, so
    what equals a full list's last value comes too late for it."""

    def __init__(self, n: int, k: int):
        self.value, self.place = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)

    def offer(self, s: np.ndarray, at: int, first: int) -> None:
        """Values of the rows from ``at`` on at the places from ``first`` on."""
        value, place = self.value[at : at + len(s)], self.place[at : at + len(s)]
        k, held = value.shape[1], place >= 0
        near = (s > value[:, -1:]) | ~held[:, -1:]
        if near.sum() > 2 * k * len(s) and s.shape[1] > k:  # no more than k of a row can stay, of equal ones the first
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
            near &= s >= least
            if near.sum() > k * len(s):
                above, equal = s > least, near & (s == least)
                near = near & above | equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k - (near & above).sum(1, dtype=np.int32)[:, None])
        row, column = np.nonzero(near)
        if not len(row):
            return
        old = np.nonzero(held & near.any(1)[:, None])
        rows, values, places = np.concatenate((old[0], row)), np.concatenate((value[old], s[row, column])), np.concatenate((place[old], column + first))
        order = np.lexsort((places, -values, rows))
        rows, values, places = rows[order], values[order], places[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        value[rows[keep], rank[keep]], place[rows[keep], rank[keep]] = values[keep], places[keep]

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, value, rank from 1 on) of all that the lists hold."""
        row, n = np.nonzero(self.place >= 0)
        return row, self.place[row, n], self.value[row, n], n + 1


def _ranks(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row of a, row of b, similarity, rank for a, rank for b) of the k best of each row of either side; a rank is 0 beyond k.

    Similarities come tile by tile and are looked at from both sides, so memory is that of the lists and of a tile.  One that is no number counts as
    larger than all others, as in an ORDER BY.
    """
    left, right = _Lists(len(a), min(k, len(b))), _Lists(len(b), min(k, len(a)))
    odd = not (np.isfinite(a).all() and np.isfinite(b).all())
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), WIDTH):
            s = a[i : i + BLOCK] @ b[j : j + WIDTH].T
            if odd:
                s[np.isnan(s)] = np.inf
            left.offer(s, i, j)
            right.offer(s.T, j, i)
    (li, lj, lv, lr), (rj, ri, rv, rr) = left.listed(), right.listed()
    key, of = np.unique(np.concatenate((li * len(b) + lj, ri * len(b) + rj)), return_inverse=True)
    value, ranks = np.empty(len(key)), np.zeros((2, len(key)), np.int32)
    value[of[: len(li)]], value[of[len(li) :]] = lv, rv
    ranks[0, of[: len(li)]], ranks[1, of[len(li) :]] = lr, rr
    row, column = np.divmod(key, max(1, len(b)))
    if odd:
        again = np.isinf(value)
        value[again] = (a[row[again]] * b[column[again]]).sum(1)
    return row, column, value, *ranks


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """idx and vectors in the order of idx: each batch's rows go to their places, so beside the table there is one array and no joined copy."""
    idx = table.column("idx").to_numpy()
    if not len(idx):
        return idx, np.zeros((0, 1))
    order = np.argsort(idx, kind="stable")
    place, low, v = np.empty(len(idx), np.int64), 0, None
    place[order] = np.arange(len(idx))
    for batch in table.column("v").chunks:
        if not len(batch):
            continue
        rows = batch.flatten().to_numpy().reshape(len(batch), -1)
        if v is None:
            v = np.empty((len(idx), rows.shape[1]))
        if rows.shape[1] != v.shape[1]:
            raise ValueError("vectors of a pair differ in length")
        v[place[low : low + len(batch)]] = rows
        low += len(batch)
    return idx[order], v


def dealt(left: DataFrame, right: DataFrame, pair: str, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides of each pair in blocks of about ``most`` rows, each block of one side once for each block of the other: columns ``bl`` and ``br``
    name a cell; a side without another is cut too.  The last value tells whether any pair has several cells; if none has, the sides come back as
    they are, in one cell each."""
    rows = left.select(pair, F.lit(1).alias("nl"), F.lit(0).alias("nr")).unionByName(right.select(pair, F.lit(0).alias("nl"), F.lit(1).alias("nr")))
    whole = rows.groupBy(F.col(pair).alias("_pair")).agg(*(F.greatest(F.ceil(F.sum(n) / most), F.lit(1).cast("long")).alias(n) for n in ("nl", "nr")))
    largest = whole.agg(F.greatest(F.max("nl"), F.max("nr"))).first()[0] or 1
    if largest <= 1:
        return *(x.withColumns({"bl": F.lit(0).cast("long"), "br": F.lit(0).cast("long")}) for x in (left, right)), False
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda n: F.pmod(F.xxhash64("idx"), F.col(n))
    sized = lambda x: x.join(whole, F.col(pair).eqNullSafe(F.col("_pair")))
    l = sized(left).withColumn("bl", block("nl")).withColumn("br", every("nr")).drop("_pair", "nl", "nr")
    r = sized(right).withColumn("br", block("nr")).withColumn("bl", every("nl")).drop("_pair", "nl", "nr")
    return l, r, True


def ranked_candidates(left: DataFrame, right: DataFrame, k: int, pair: str = "pair_idx", most: int = SIDE) -> DataFrame:
    """(pair, left_idx, right_idx, similarity, rank_lr, rank_rl): the k best of each vector in both directions; a rank is null beyond k.

    ``left`` and ``right``: (pair, idx long, v array<double>), all vectors of a pair of one length.  A pair whose sides are within ``most`` rows is one
    task; larger ones are cut into cells of two blocks, whose own best k are ranked again over all cells.
    """

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        (li, a), (ri, b) = _side(l), _side(r)
        row, column, value, *ranks = _ranks(a, b, k) if len(li) and len(ri) else [np.zeros(0, int)] * 5
        name = (l if len(l) else r).column(pair).take(pa.array(np.zeros(len(row), np.int64)))
        lr, rl = (pa.array(x, pa.int32(), mask=x == 0) for x in ranks)
        return pa.table({pair: name, "left_idx": pa.array(li[row], pa.int64()), "right_idx": pa.array(ri[column], pa.int64()), "similarity": pa.array(value, pa.float64()), "rank_lr": lr, "rank_rl": rl})

    kind = left.schema[pair].dataType.simpleString()
    # both sides may come from one table: aliases give each its own columns
    sides = [x.select(F.col(pair).alias(pair), F.col("idx").cast("long").alias("idx"), F.col("v").alias("v")) for x in (left, right)]
    l, r, several = dealt(*sides, pair, most)
    cell = [pair, "bl", "br"]
    found = l.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(lean(run), f"{pair} {kind}, left_idx long, right_idx long, similarity double, rank_lr int, rank_rl int")
    if not several:
        return found
    # of each cell's best the best of all: a pair that is among a vector's k best is among them in its cell too
    again = lambda own, other, has: F.when(F.col(has).isNotNull(), F.row_number().over(Window.partitionBy(pair, own).orderBy(F.col(has).isNull(), F.desc("similarity"), other)))
    ranks = found.withColumns({"_lr": again("left_idx", "right_idx", "rank_lr"), "_rl": again("right_idx", "left_idx", "rank_rl")})
    within = ranks.select(pair, "left_idx", "right_idx", "similarity", *(F.when(F.col(f"_{n}") <= k, F.col(f"_{n}")).cast("int").alias(f"rank_{n}") for n in ("lr", "rl")))
    return within.filter("rank_lr IS NOT NULL OR rank_rl IS NOT NULL")


def topk(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    return ranked_candidates(left, right, k).filter("rank_lr IS NOT NULL").select("pair_idx", "left_idx", "right_idx", "similarity", F.col("rank_lr").alias("rank"))


def mutual_entry(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Forward candidates with the k at which they become mutual, k + 1 if they never do."""
    entry = F.when(F.col("rank_rl").isNotNull(), F.greatest("rank_lr", "rank_rl")).otherwise(k + 1)
    return ranked_candidates(left, right, k).filter("rank_lr IS NOT NULL").select("pair_idx", "left_idx", "right_idx", "similarity", "rank_lr", entry.cast("int").alias("entry_k"))


def mutual_knn(left: DataFrame, right: DataFrame, k: int, most: int = 0) -> DataFrame:
    """Progressive mutual nearest neighbours (pair_idx, left_idx, right_idx, similarity, k): k is the first list length at
    which both sides list each other; ``most`` keeps the first edges of each pair by (k, similarity descending, ids)."""
    edges = ranked_candidates(left, right, k).filter("rank_lr IS NOT NULL AND rank_rl IS NOT NULL").select("pair_idx", "left_idx", "right_idx", "similarity", F.greatest("rank_lr", "rank_rl").alias("k"))
    return cap(edges, most) if most > 0 else edges


def ordinal() -> Column:
    """An edge's place in its pair: by k, similarity descending, ids."""
    return F.row_number().over(Window.partitionBy("pair_idx").orderBy("k", F.desc("similarity"), "left_idx", "right_idx"))


def cap(edges: DataFrame, most: int) -> DataFrame:
    return edges.withColumn("_place", ordinal()).filter(F.col("_place") <= most).drop("_place")


def compact_by_value(edges: DataFrame) -> DataFrame:
    """Ids renumbered from 0 in the order of their values, in each pair."""
    number = lambda c: (F.dense_rank().over(Window.partitionBy("pair_idx").orderBy(c)) - 1).alias(c)
    return edges.select("pair_idx", *(F.struct(F.col(c).alias("was"), number(c).alias("now")).alias(c) for c in ("left_idx", "right_idx")), "k")


def compact_by_appearance(edges: DataFrame) -> DataFrame:
    """Ids renumbered from 0 in the order in which the edges (by ``ordinal``) name them first."""
    placed = edges.withColumn("_place", ordinal())
    for c in ("left_idx", "right_idx"):
        placed = placed.withColumn(f"_{c}", F.min("_place").over(Window.partitionBy("pair_idx", c)))
    number = lambda c: (F.dense_rank().over(Window.partitionBy("pair_idx").orderBy(f"_{c}")) - 1).alias(c)
    return placed.select("pair_idx", *(F.struct(F.col(c).alias("was"), number(c).alias("now")).alias(c) for c in ("left_idx", "right_idx")), "k")


def renumbered(edges: DataFrame, order: str) -> DataFrame:
    """Edges with both ids numbered from 0 in the order in which the rows that are left name them."""
    out = edges
    for c in ("left_idx", "right_idx"):
        out = out.withColumn(f"_{c}", F.min(order).over(Window.partitionBy("pair_idx", c)))
        out = out.withColumn(c, (F.dense_rank().over(Window.partitionBy("pair_idx").orderBy(f"_{c}")) - 1).cast("long")).drop(f"_{c}")
    return out


def bilinear_rows(x: Column, y: Column, patch: int, columns: int, rows: int) -> tuple[Column, Column]:
    """(inside, four corners (gx, gy, weight)) of a point on a grid of patch centres."""
    gx, gy = x / patch - 0.5, y / patch - 0.5
    inside = (gx >= 0) & (gx <= columns - 1) & (gy >= 0) & (gy <= rows - 1)
    x0, y0 = F.floor(gx), F.floor(gy)
    corner = lambda dx, dy: F.struct(F.least(x0 + dx, F.lit(columns - 1)).alias("gx"), F.least(y0 + dy, F.lit(rows - 1)).alias("gy"), ((gx - x0 if dx else 1 - (gx - x0)) * (gy - y0 if dy else 1 - (gy - y0))).alias("weight"))
    return inside, F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))


def _nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each point of ``a`` (n x 3) to the nearest of ``b``, some rows and one coordinate at a time."""
    best, step = np.full(len(a), np.inf), max(1, CELLS // max(1, len(b)))
    for low in range(0, len(a), step) if len(b) else ():
        square = np.zeros((len(a[low : low + step]), len(b)))
        for i in range(3):
            d = a[low : low + step, i, None] - b[None, :, i]
            d *= d
            square += d
        best[low : low + step] = np.sqrt(square.min(1))
    return best


def nearest_error(left: DataFrame, right: DataFrame, pair: str = "pair_idx", most: int = SIDE) -> DataFrame:
    """Per left point (idx, x, y, z; one row for each idx) the distance to the nearest right point; infinite if the pair has none.

    Tasks hold two blocks of at most ``most`` rows and return one row for each left point, never the pairs.
    """

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        a, b = (np.stack([np.asarray(t.column(c), np.float64) for c in "xyz"], 1) for t in (l, r))
        return pa.table({pair: l.column(pair), "idx": l.column("idx"), "min_error": pa.array(_nearest(a, b), pa.float64())})

    kind, idx = (left.schema[c].dataType.simpleString() for c in (pair, "idx"))
    sides = [x.select(F.col(pair).alias(pair), F.col("idx").alias("idx"), *(F.col(c).cast("double").alias(c) for c in "xyz")) for x in (left, right)]
    l, r, several = dealt(*sides, pair, most)
    cell = [pair, "bl", "br"]
    found = l.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(lean(run), f"{pair} {kind}, idx {idx}, min_error double")
    return found.groupBy(pair, "idx").agg(F.min("min_error").alias("min_error")) if several else found
