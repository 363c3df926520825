"""Stratified selection with stable hashes: quotas, orientations, partitions.

Objects (the strata of a split) are few, some tens to thousands: tables with one row for each of them may be ordered as a whole.  Tables of edges never are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.text import stable_hash


#: Bits of a hash by which rows are counted before any are ordered.
PREFIX = 16


def balanced_flip(rows: DataFrame, stratum: Sequence[str], seed: str, tokens: Sequence[str], bonus: int = 0) -> DataFrame:
    """``flip`` for the first half of each stratum in hash order (with ``bonus`` more in odd ones).

    A stratum is not ordered: rows are counted by the first bits of their hash, the counts tell in which of these buckets the half ends, and only that
    bucket's rows are ordered.
    """
    keyed = rows.withColumn("_h", stable_hash(seed, *(F.col(t) for t in tokens))).withColumn("_p", F.floor(F.col("_h") / F.lit(1 << (64 - PREFIX)).cast("decimal(20,0)")).cast("int"))
    whole = Window.partitionBy(*stratum)
    counts = keyed.groupBy(*stratum, "_p").agg(F.count("*").alias("_c"))
    up_to = F.sum("_c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"_n": F.sum("_c").over(whole), "_before": F.coalesce(up_to, F.lit(0))}).withColumn("_half", F.floor(F.col("_n") / 2) + F.when(F.col("_n") % 2 == 1, bonus).otherwise(0))
    # buckets that lie within the half, the one that it ends in, and all others
    split = (F.col("_before") < F.col("_half")) & (F.col("_before") + F.col("_c") > F.col("_half"))
    known = counts.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(stratum)), F.col("_p").alias("_q"), split.alias("_split"), (F.col("_before") + F.col("_c") <= F.col("_half")).alias("_in"), (F.col("_half") - F.col("_before")).alias("_left"))
    on = keyed["_p"] == known["_q"]
    for i, c in enumerate(stratum):
        on = on & keyed[c].eqNullSafe(known[f"_s{i}"])
    placed = keyed.join(known, on)
    place = F.row_number().over(Window.partitionBy(*stratum, "_p").orderBy("_h", *tokens))
    ordered = placed.filter("_split").withColumn("flip", place <= F.col("_left"))
    return placed.filter("NOT _split").withColumn("flip", F.col("_in")).unionByName(ordered).select(*rows.columns, "flip")


def quotas(objects: DataFrame, bins: Sequence[str], total: int, name: str = "object") -> DataFrame:
    """(object, bin, quota): ``total`` per bin spread evenly; the extras walk a ring of objects in hash order, each bin going on where the last one stopped."""
    ranked = objects.select(name).distinct().withColumn("_h", stable_hash("quota", F.col(name)))
    ranked = ranked.withColumns({"place": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", name)) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    wide = ranked.withColumn("b", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(b).alias("bin")) for i, b in enumerate(bins)))))
    base, extras = F.floor(F.lit(total) / F.col("n")), F.lit(total) % F.col("n")
    ahead = F.pmod(F.col("place") - F.col("b.i") * extras, F.col("n"))
    return wide.select(name, F.col("b.bin").alias("bin"), (base + (ahead < extras).cast("int")).cast("long").alias("quota"))


def half_sizes(objects: DataFrame, size: str = "size", name: str = "object") -> DataFrame:
    """Half of each object's size, rounded so that the halves add up to half of all: odd objects in hash order get the larger part first."""
    one = Window.partitionBy(F.lit(0))
    missing = F.floor(F.sum(size).over(one) / 2) - F.sum(F.floor(F.col(size) / 2)).over(one)
    odd = F.col(size) % 2 == 1
    place = F.row_number().over(one.orderBy(F.when(odd, 0).otherwise(1), "_h", name))
    keyed = objects.withColumn("_h", stable_hash("larger-side", F.col(name)))
    return keyed.withColumns({"_p": place, "_m": missing}).select(name, size, (F.floor(F.col(size) / 2) + (odd & (F.col("_p") <= F.col("_m"))).cast("int")).cast("long").alias("half"))


def sub_quotas(bins: DataFrame, target: Column | int, strict: bool = True) -> DataFrame:
    """(object, bin, sub_bin, raw, capacity, allocated): ``target`` units of each (object, bin) in proportion to raw, within what both sides hold.

    ``bins``: object, bin, sub_bin, raw, and the edges that either side offers, left and right.  A sub-bin's unit number j (from 0) is due at
    ``j * total - target * raw``, where total is the raw count of the bin; the units that are due first are given, of equal ones the lowest
    sub-bin's.  As a sub-bin's own units follow each other in this order, nothing is dealt one by one.  With ``strict`` a bin that cannot hold
    its target is an error, else it gets what it holds.
    """
    keys, target = ["object", "bin"], F.lit(target) if isinstance(target, int) else target
    per = Window.partitionBy(*keys)
    rows = bins.withColumn("capacity", F.least("left", "right")).withColumns({"_total": F.sum("raw").over(per), "_room": F.sum("capacity").over(per), "_target": target.cast("long")})
    if strict:
        problem = F.format_string("%s/%s: %d edges for a quota of %d", *(F.col(c).cast("string") for c in keys), "_room", "_target")
        rows = rows.withColumn("_target", F.when(F.col("_room") < F.col("_target"), F.raise_error(problem).cast("long")).otherwise(F.col("_target")))
    numbers = F.sequence(F.lit(0).cast("long"), F.least("capacity", "_target") - 1)
    units = rows.filter(F.least("capacity", "_target") > 0).select(*keys, "sub_bin", "raw", "_total", "_target", F.explode(numbers).alias("unit"))
    due = F.row_number().over(per.orderBy(F.col("unit") * F.col("_total") - F.col("_target") * F.col("raw"), "sub_bin"))
    given = units.withColumn("_n", due).filter(F.col("_n") <= F.col("_target")).groupBy(*keys, "sub_bin").agg(F.count("*").alias("allocated"))
    return rows.select(*keys, "sub_bin", "raw", "capacity", "_target").join(given, [*keys, "sub_bin"], "left").select(*keys, "sub_bin", "raw", "capacity", F.when(F.col("_target") >= 0, F.coalesce("allocated", F.lit(0))).cast("long").alias("allocated"))


def capacity_report(edges: DataFrame, sides: DataFrame, quotas: DataFrame, allocated: DataFrame) -> DataFrame:
    """Per object and bin: quota, raw edges, edges inside each side, images of each side, and the sub-bins' quotas in order, joined by ``;``.

    edges: object, bin, low, high.  sides: object, image, side (0 or 1).  quotas: object, bin, quota.  allocated: object, bin, sub_bin, allocated.
    """
    a, b = (sides.select("object", F.col("image").alias(c), F.col("side").alias(f"{c}_side")) for c in ("low", "high"))
    inside = lambda s: F.sum(((F.col("low_side") == s) & (F.col("high_side") == s)).cast("long"))
    counts = edges.join(a, ["object", "low"]).join(b, ["object", "high"]).groupBy("object", "bin").agg(F.count("*").alias("raw_edges"), inside(0).alias("edges_0"), inside(1).alias("edges_1"))
    images = sides.groupBy("object").agg(*(F.sum((F.col("side") == s).cast("long")).alias(f"images_{s}") for s in (0, 1)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sub_bin", "allocated"))), lambda x: x["allocated"].cast("string"))  # as many as a bin has sub-bins
    parts = allocated.groupBy("object", "bin").agg(F.array_join(ordered, ";").alias("sub_bin_quotas"))
    return quotas.join(counts, ["object", "bin"], "left").join(images, "object", "left").join(parts, ["object", "bin"], "left").fillna(0, ["raw_edges", "edges_0", "edges_1", "images_0", "images_1"])


def _seed(*tokens) -> int:
    return int.from_bytes(hashlib.sha256(":".join(map(str, tokens)).encode()).digest()[:8], "big")


def _own(rows: DataFrame, *names: str) -> DataFrame:
    """Columns of a side by aliases of their own, as both sides may come from one table."""
    return rows.select(*(F.col(n).alias(n) for n in names))


class Unfeasible(ValueError):
    pass


def _take(low: np.ndarray, high: np.ndarray, target: int, own: np.ndarray, total: np.ndarray, rng: np.random.Generator) -> list[int]:
    """``target`` of some edges, one after the other the one whose ends are used least: by the larger degree in the bin (``own``), the larger
    in all bins (``total``), then the squares of both, then by chance.  Both counts are updated."""
    open_, chosen = np.ones(len(low), bool), []
    for _ in range(target):
        at = np.flatnonzero(open_)
        (a, b), (c, d) = ((x[low[at]] + 1, x[high[at]] + 1) for x in (own, total))
        keys = np.stack((np.maximum(a, b), np.maximum(c, d), a * a + b * b, c * c + d * d))
        for n in range(len(keys)):
            best = keys[n] == keys[n].min()
            at, keys = at[best], keys[:, best]
        pick = int(at[rng.integers(len(at))])
        open_[pick] = False
        chosen.append(pick)
        for x in (own, total):
            x[low[pick]] += 1
            x[high[pick]] += 1
    return chosen


#: Trials of a block, one task's work.
BLOCK = 256


def _in_blocks(rows: DataFrame, trials: int, size: int) -> DataFrame:
    """Every object's rows once for each block of its trials."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((trials - 1) // size))))


def _tie(*tokens) -> bytes:
    """A hash whose bytes are in the order of its number."""
    return _seed(*tokens).to_bytes(8, "big")


def low_degree_edges(edges: DataFrame, quotas: DataFrame, trials: int = 192, most_in_bin: int = 4, most: int = 6, seed: str = "edges", every: bool = False, size: int = 24) -> DataFrame:
    """Selections of edges of small degree: (object, candidate, bin, sub_bin, low, high, max_bin_degree, max_degree, bin_squares, squares, unused).

    edges: object, bin, sub_bin, low, high.  quotas: object, bin, sub_bin, target.  In each seeded trial the sub-bins take their edges in
    turn, scarce ones first.  Selections that use an image more than ``most_in_bin`` times in a bin or ``most`` times in all
    are not feasible; ``every`` returns all feasible ones (equal ones once), else the one with the smallest degrees, then hash.  A sub-bin
    with fewer edges than its target, and an object without a feasible selection, are errors.

    A task makes ``size`` trials of one object, each from its own seed; what they find meets as rows (score, hash, edges by number).
    """

    def prepared(pdf: pd.DataFrame, wanted: pd.DataFrame, name) -> tuple:
        pdf = pdf.drop_duplicates(["bin", "sub_bin", "low", "high"]).sort_values(["bin", "sub_bin", "low", "high"], ignore_index=True)
        images = pd.Index(pd.unique(pd.concat([pdf["low"], pdf["high"]]))).sort_values()
        bins = {b: i for i, b in enumerate(sorted(set(pdf["bin"]) | set(wanted["bin"])))}
        cells = pdf.groupby(["bin", "sub_bin"]).indices
        groups = []
        for b, s, target in wanted.sort_values(["bin", "sub_bin"])[["bin", "sub_bin", "target"]].itertuples(index=False):
            here = np.sort(cells.get((b, s), np.zeros(0, np.int64)))
            if len(here) < target:
                raise Unfeasible(f"{name}, bin {b}, sub-bin {s}: the quota is {target}, edges are {len(here)}")
            if target:
                groups.append((len(here) / target, bins[b], int(target), here))
        return pdf, images.get_indexer(pdf["low"]), images.get_indexer(pdf["high"]), len(bins), len(images), groups

    def tried(key, pdf: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        _, low, high, n_bins, n_images, groups = prepared(pdf, wanted, key[0])
        found = {}
        for trial in range(int(key[1]) * size, min(trials, (int(key[1]) + 1) * size)):
            rng = np.random.default_rng(_seed(seed, key[0], trial))
            own, total, chosen = np.zeros((n_bins, n_images), np.int64), np.zeros(n_images, np.int64), []
            for i in np.lexsort((rng.random(len(groups)), [g[0] for g in groups])).tolist():
                _, b, target, here = groups[i]
                chosen += here[_take(low[here], high[here], target, own[b], total, rng)].tolist()
            degrees = own.max(initial=0), total.max(initial=0), (own * own).sum(), (total * total).sum(), (total == 0).sum()
            found[tuple(sorted(chosen))] = tuple(map(int, degrees))
        rows = [(key[0], *degrees, _tie(seed, "tie", key[0], *chosen), list(chosen)) for chosen, degrees in found.items()]
        return pd.DataFrame(rows, columns=["object", *_DEGREES, "tie", "chosen"])

    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("object", "bin", "sub_bin", "low", "high")}
    own_edges, own_quotas = _own(edges, "object", "bin", "sub_bin", "low", "high"), _own(quotas, "object", "bin", "sub_bin", "target")
    sides = (_in_blocks(x, trials, size).groupBy("object", "block") for x in (own_edges, own_quotas))
    degrees = ", ".join(f"{d} long" for d in _DEGREES)
    found = next(sides).cogroup(next(sides)).applyInPandas(tried, f"object {kinds['object']}, {degrees}, tie binary, chosen array<long>").distinct()
    fine = (F.col("max_bin_degree") <= most_in_bin) & (F.col("max_degree") <= most)
    score = F.struct(*_DEGREES, "tie", "chosen")
    if every:
        kept = found.filter(fine).withColumn("candidate", F.row_number().over(Window.partitionBy("object").orderBy(*_DEGREES, "tie")) - 1)
    else:
        best = found.groupBy("object").agg(F.min(F.when(fine, score)).alias("best"), F.min(score).alias("any"))
        none = F.raise_error(F.concat(F.col("object").cast("string"), F.lit(": no selection within the degree bounds; the best has "), F.to_json(F.struct(*(f"any.{d}" for d in _DEGREES)))))
        kept = best.select("object", F.when(F.col("best").isNull(), none.cast(found.select(score).schema[0].dataType)).otherwise(F.col("best")).alias("best")).select("object", "best.*", F.lit(0).alias("candidate"))
    # edges by the numbers that the trials gave them
    number = F.row_number().over(Window.partitionBy("object").orderBy("bin", "sub_bin", "low", "high")) - 1
    numbered = own_edges.distinct().withColumn("number", number.cast("long"))
    rows = kept.select("object", F.col("candidate").cast("long").alias("candidate"), *_DEGREES, F.explode("chosen").alias("number"))
    return rows.join(numbered, ["object", "number"]).select("object", "candidate", "bin", "sub_bin", "low", "high", *_DEGREES)


_DEGREES = ("max_bin_degree", "max_degree", "bin_squares", "squares", "unused")
#: Terms of a partition's score, in the order in which they count; all are integers, smaller is better.
SCORE = ("deficit", "support_deficit", "shortfall", "split_imbalance", "size_imbalance", "camera_imbalance", "imbalance", "deviation")


def partition_scores(side: np.ndarray, low: np.ndarray, high: np.ndarray, cell: np.ndarray, bin_of_cell: np.ndarray, quota: np.ndarray, strata: Sequence[np.ndarray], slack: int = 4) -> np.ndarray:
    """SCORE of many partitions at once: ``side`` is (trials, images) with True for the first side.

    low, high: image numbers of the edges; cell: their number of (bin, sub-bin); bin_of_cell: each cell's bin; quota: of each bin;
    strata: for each of the three attributes the images' class numbers.
    """
    n_cells, n_bins, million = len(bin_of_cell), len(quota), 1_000_000
    to_cell, to_bin = np.eye(n_cells, dtype=np.int64)[cell].reshape(-1, n_cells), np.eye(n_bins, dtype=np.int64)[bin_of_cell].reshape(-1, n_bins)
    first, second = ((x[:, low] & x[:, high]).astype(np.int64) @ to_cell for x in (side, ~side))
    a, b, common = first @ to_bin, second @ to_bin, np.minimum(first, second) @ to_bin
    total = to_cell.sum(0) @ to_bin
    short = lambda want, have: np.maximum(0, want - have).sum(1)
    support = short(quota, common)
    part = lambda x: x * million // np.maximum(total, 1)
    balance = [np.abs((2 * side.astype(np.int64) - 1) @ np.eye(s.max(initial=-1) + 1, dtype=np.int64)[s]).sum(1) for s in strata]
    terms = [
        short(quota + slack, a) + short(quota + slack, b) + support, support, short(quota + slack + 1, a) + short(quota + slack + 1, b), *balance,
        part(np.abs(a - b)).sum(1), part(np.abs(4 * a - total) + np.abs(4 * b - total)).sum(1),
    ]
    return np.stack(terms, 1)


def partition_search(edges: DataFrame, halves: DataFrame, quotas: DataFrame, images: DataFrame, trials: int = 4096, slack: int = 4, seed: str = "partition", strict: bool = True) -> DataFrame:
    """(object, image, side, SCORE): of many seeded partitions of each object's images into ``half`` and the rest, the one with the smallest score, then hash.

    edges: object, bin, sub_bin, low, high.  halves: object, half.  quotas: object, bin, quota.  images: object, image, split, height,
    width, camera.  The first partition takes the first images by name.  With ``strict`` an object whose best deficit is not 0 is an error.
    A task scores a block of an object's partitions, whose random orders follow one seed of the object; the best of the blocks meet as rows.
    """

    def run(key, pdf: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        about = about.sort_values("image", ignore_index=True)
        names = pd.Index(about["image"])
        low, high = names.get_indexer(pdf["low"]), names.get_indexer(pdf["high"])
        cells = pd.MultiIndex.from_frame(pdf[["bin", "sub_bin"]])
        cell, kinds = cells.factorize()
        bins = pdf[["bin", "quota"]].drop_duplicates().sort_values("bin", ignore_index=True)
        bin_of_cell = pd.Index(bins["bin"]).get_indexer([b for b, _ in kinds])
        strata = [pd.MultiIndex.from_frame(about[list(c)]).factorize()[0] for c in (("split",), ("height", "width"), ("camera",))]
        half, rng, at = int(pdf["half"].iloc[0]), np.random.default_rng(_seed(seed, key[0])), int(key[1]) * BLOCK
        for _ in range(1, at):  # the orders of the blocks before
            rng.permutation(len(names))
        side = np.zeros((min(BLOCK, trials - at), len(names)), bool)
        for t in range(len(side)):
            side[t, np.arange(half) if at + t == 0 else rng.permutation(len(names))[:half]] = True
        scores = partition_scores(side, low, high, cell, bin_of_cell, bins["quota"].to_numpy(np.int64), strata, slack)
        least = min(map(tuple, scores.tolist()))
        tie, t = min((_tie(seed, "tie", key[0], *names[side[t]]), t) for t in np.flatnonzero((scores == least).all(1)).tolist())
        taken = pd.Series([names[side[t]].tolist()])
        return pd.DataFrame({"object": [key[0]], **{c: [v] for c, v in zip(SCORE, least, strict=True)}, "tie": [tie]}).assign(first=taken)

    name, image = (images.schema[c].dataType.simpleString() for c in ("object", "image"))
    whole = edges.select("object", "bin", "sub_bin", "low", "high").join(halves.select("object", "half"), "object").join(quotas.select("object", "bin", "quota"), ["object", "bin"])
    whole, about = _own(whole, "object", "bin", "sub_bin", "low", "high", "half", "quota"), _own(images, "object", "image", "split", "height", "width", "camera")
    terms = ", ".join(f"{t} long" for t in SCORE)
    sides = (_in_blocks(x, trials, BLOCK).groupBy("object", "block") for x in (whole, about))
    found = next(sides).cogroup(next(sides)).applyInPandas(run, f"object {name}, {terms}, tie binary, first array<{image}>")
    best = found.groupBy("object").agg(F.min(F.struct(*SCORE, "tie", "first")).alias("best"))
    if strict:
        bad = F.raise_error(F.concat(F.col("object").cast("string"), F.lit(": the best partition has the score "), F.to_json(F.struct(*(f"best.{t}" for t in SCORE)))))
        best = best.select("object", F.when(F.col(f"best.{SCORE[0]}") > 0, bad.cast(best.schema["best"].dataType)).otherwise(F.col("best")).alias("best"))
    taken = best.select("object", F.explode("best.first").alias("image"), F.lit(1).alias("side"))
    every = about.join(best.select("object", *(F.col(f"best.{t}").alias(t) for t in SCORE)), "object").join(taken, ["object", "image"], "left")
    return every.select("object", "image", F.coalesce("side", F.lit(0)).cast("int").alias("side"), *SCORE)


def partition_score(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """Per object: edges inside each side, cut edges, common capacity and imbalance."""
    a, b = (sides.select("object", F.col("image").alias(c), F.col("side").alias(f"{c}_side")) for c in ("low", "high"))
    joined = edges.join(a, ["object", "low"]).join(b, ["object", "high"])
    inside = lambda s: F.sum(((F.col("low_side") == s) & (F.col("high_side") == s)).cast("long"))
    counts = joined.groupBy("object").agg(inside(0).alias("inside_0"), inside(1).alias("inside_1"), F.sum((F.col("low_side") != F.col("high_side")).cast("long")).alias("cut"))
    return counts.withColumns({"common": F.least("inside_0", "inside_1"), "imbalance": F.abs(F.col("inside_0") - F.col("inside_1"))})


def joint_choice(left: DataFrame, right: DataFrame, score: Sequence[str], name: str = "object") -> DataFrame:
    """The pair of candidates of each object with the lexicographically least summed scores (then names)."""
    l, r = (x.select(name, F.col("candidate").alias(f"{s}_candidate"), *(F.col(c).alias(f"{s}_{c}") for c in score)) for x, s in ((left, "left"), (right, "right")))
    joined = l.join(r, name)
    key = F.struct(*((F.col(f"left_{c}") + F.col(f"right_{c}")).alias(c) for c in score), "left_candidate", "right_candidate")
    return joined.groupBy(name).agg(F.min(key).alias("best")).select(name, "best.*")


def ring_shuffle(rows: DataFrame, seed: str, tokens: Sequence[str], buckets: int = 1024) -> DataFrame:
    """Rows with a number from 1 in an order that only the seed decides.

    The hash's leading part deals the rows to buckets, which are ordered each by itself; a bucket's first number is the count of the rows in
    those before it, so no task sees all rows.
    """
    keyed = rows.withColumn("_h", stable_hash(seed, *(F.col(t) for t in tokens)))
    keyed = keyed.withColumn("_b", F.floor(F.col("_h").cast("double") / 2.0**64 * buckets).cast("int"))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    ahead = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_ahead"))  # one row for each bucket
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *tokens))
    return keyed.withColumn("_place", place).join(F.broadcast(ahead), "_b").withColumn("ordinal", F.col("_ahead") + F.col("_place")).drop("_h", "_b", "_place", "_ahead")
