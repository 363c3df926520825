"""Audits of a split: which of its promises are broken, degrees, roles and camera pairs.

Relations:

* ``selected``: family, bin, object, image_1, image_2, distance (text as in the source)
* ``source``: object, image_1, image_2, distance, the undirected edges with the orientation they came in
* ``sides``: image, family
* ``quotas``: object, bin, quota
* ``images``: image, camera

Each audit returns rows; none is empty by accident, as every expected (family, bin) is listed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions.geometry import angle_bin, sub_bin
from matchweave.operators.graph import endpoint_degrees


def guarded_edges(edges: DataFrame, low: float, high: float, a: str = "image_1", b: str = "image_2", distance: str = "distance") -> DataFrame:
    """An edge list's rows with ``problem``: distances outside ``[low, high)`` or not finite, loops, undirected edges that occur twice; null if fine."""
    d = F.col(distance).cast("double")
    pair = [F.least(a, b), F.greatest(a, b)]
    copies = edges.groupBy(pair[0].alias("_low"), pair[1].alias("_high")).agg(F.count("*").alias("_copies"))
    joined = edges.withColumns({"_low": pair[0], "_high": pair[1]}).join(copies, ["_low", "_high"])
    inside = F.coalesce((d >= low) & (d < high), F.lit(False))
    problem = F.when(F.col(a) == F.col(b), "loop").when(~inside, "distance out of range").when(F.col("_copies") > 1, "duplicate edge")
    return joined.withColumn("problem", problem).drop("_low", "_high", "_copies")


def camera_pair(first: Column, second: Column) -> Column:
    """The two classes of an edge's ends without an order."""
    return F.struct(F.least(first, second).alias("first"), F.greatest(first, second).alias("second"))


def with_cameras(selected: DataFrame, images: DataFrame) -> DataFrame:
    """``selected`` with its unordered camera pair and whether both are the same."""
    out = selected
    for s in "12":
        out = out.join(images.select(F.col("image").alias(f"image_{s}"), F.col("camera").alias(f"_c{s}")), f"image_{s}", "left")
    return out.withColumns({"cameras": camera_pair(F.col("_c1"), F.col("_c2")), "same_camera": F.col("_c1") == F.col("_c2")}).drop("_c1", "_c2")


def by_bin(selected: DataFrame, keys: Sequence[str] = ("family", "bin")) -> DataFrame:
    """Selected edges numbered from 1 inside each family and bin, in the order of object and ends: the rows of the split's files."""
    from pyspark.sql import Window

    return selected.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("object", "image_1", "image_2", "distance")))


def bin_statistics(selected: DataFrame, source: DataFrame, images: DataFrame) -> DataFrame:
    """Per family and bin: pairs, images, the largest degree, rows turned against the source, pairs of one camera."""
    keys = ["family", "bin"]
    degree = selected.select(*keys, F.explode(F.array("image_1", "image_2")).alias("image")).groupBy(*keys, "image").agg(F.count("*").alias("degree"))
    reuse = degree.groupBy(*keys).agg(F.count("*").alias("images"), F.max("degree").alias("max_degree"))
    oriented = source.select("image_1", "image_2", "distance").distinct().withColumn("_as_is", F.lit(1))
    rows = with_cameras(selected, images).join(oriented, ["image_1", "image_2", "distance"], "left")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("pairs"), F.sum(F.col("_as_is").isNull().cast("long")).alias("turned"), F.sum(F.coalesce(F.col("same_camera"), F.lit(False)).cast("long")).alias("same_camera"))
    return counts.join(reuse, keys)


def camera_balance(selected: DataFrame, images: DataFrame, families: Sequence[str]) -> DataFrame:
    """Per bin the difference of two families in pairs of one camera, and the L1 distance of their camera pairs: the sums over
    objects, the largest, and the object that has it (of equal ones the last by name)."""
    rows = with_cameras(selected, images)
    side = lambda f: F.sum(F.when(F.col("family") == f, 1).otherwise(0))
    histogram = rows.groupBy("bin", "object", "cameras").agg(*(side(f).alias(n) for f, n in zip(families, "ab", strict=True)), F.first("same_camera").alias("same"))
    per = histogram.groupBy("bin", "object").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("l1"), *(F.sum(F.when(F.col("same"), F.col(n)).otherwise(0)).alias(f"same_{n}") for n in "ab"))
    per = per.withColumn("same", F.abs(F.col("same_a") - F.col("same_b")))
    worst = lambda c: F.max(F.struct(F.col(c).alias("value"), F.col("object").alias("object")))
    out = per.groupBy("bin").agg(F.sum("same_a").alias("same_a"), F.sum("same_b").alias("same_b"), F.sum("same").alias("same_sum"), worst("same").alias("s"), F.sum("l1").alias("l1_sum"), worst("l1").alias("l"))
    return out.select("bin", "same_a", "same_b", "same_sum", F.col("s.value").alias("same_max"), F.col("s.object").alias("same_object"), "l1_sum", F.col("l.value").alias("l1_max"), F.col("l.object").alias("l1_object"))


def split_problems(selected: DataFrame, source: DataFrame, sides: DataFrame, quotas: DataFrame, images: DataFrame, bins: Mapping[str, tuple[float, float]], pairs: int, width: float = 5.0, most_in_bin: int = 4, most: int = 6) -> DataFrame:
    """(check, violations) of every promise of a split, also those that hold.

    images in one family only; ``pairs`` pairs for each family and bin; quotas of each object; no edge twice; every edge from the source, with its
    distance, whatever its direction; distances in the edge's bin; both ends in the edge's family; as many rows turned as not; degrees
    within bounds in a bin and in a family; the same histogram of ``width`` wide distances in all families.
    """
    names = list(bins)
    families = sides.select("family").distinct()
    cells = families.select("family", F.explode(F.array(*map(F.lit, names))).alias("bin"))
    d = F.col("distance").cast("double")
    count = lambda rows, name: rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    shared = sides.groupBy("image").agg(F.countDistinct("family").alias("n")).filter("n > 1")
    sizes = cells.join(selected.groupBy("family", "bin").agg(F.count("*").alias("n")), ["family", "bin"], "left").filter(F.coalesce("n", F.lit(0)) != pairs)
    wanted = quotas.join(F.broadcast(families)).filter("quota > 0")  # the families are two or three
    have = selected.groupBy("family", "object", "bin").agg(F.count("*").alias("n"))
    quota = wanted.join(have, ["family", "object", "bin"], "full").filter(~F.col("n").eqNullSafe(F.col("quota").cast("long")))
    twice = selected.groupBy("family", "bin", "image_1", "image_2").count().filter("count > 1")
    undirected = lambda rows: rows.withColumns({"low": F.least("image_1", "image_2"), "high": F.greatest("image_1", "image_2")})
    absent = undirected(selected).join(undirected(source).select("low", "high", "distance").distinct(), ["low", "high", "distance"], "left_anti")
    bounds = reduce(lambda a, b: a | b, ((F.col("bin") == n) & (d >= lo) & (d < hi) for n, (lo, hi) in bins.items()))
    misplaced = selected.filter(~F.coalesce(bounds, F.lit(False)))
    ends = selected.select("family", "bin", F.explode(F.array("image_1", "image_2")).alias("image"))
    owner = sides.select("image", F.col("family").alias("owner")).distinct()
    crossing = ends.join(owner, "image", "left").filter(~F.col("owner").eqNullSafe(F.col("family")))
    stats = bin_statistics(selected, source, images)
    unbalanced = cells.join(stats, ["family", "bin"], "left").filter(F.coalesce("turned", F.lit(0)) != pairs // 2)
    reused = ends.groupBy("family", "bin", "image").count().filter(F.col("count") > most_in_bin)
    reused_in_all = ends.groupBy("family", "image").count().filter(F.col("count") > most)
    low = reduce(lambda a, b: F.when(F.col("bin") == b[0], F.lit(float(b[1][0]))).otherwise(a), bins.items(), F.lit(None).cast("double"))
    fine = selected.groupBy("object", "bin", sub_bin(d, low, width).alias("sub_bin"), "family").agg(F.count("*").alias("n"))
    uneven = families.select("family").crossJoin(fine.select("object", "bin", "sub_bin").distinct()).join(fine, ["object", "bin", "sub_bin", "family"], "left").groupBy("object", "bin", "sub_bin").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.max(F.coalesce("n", F.lit(0))).alias("most")).filter("least < most")
    found = [
        count(shared, "images in several families"), count(sizes, "pairs of a bin"), count(quota, "quotas"), count(twice, "duplicate edges"), count(absent, "edges outside the source"), count(misplaced, "distance outside the bin"),
        count(crossing, "ends in another family"), count(unbalanced, "roles out of balance"), count(reused, "degree in a bin"), count(reused_in_all, "degree in a family"), count(uneven, "distance histograms differ"),
    ]
    return reduce(DataFrame.unionByName, found)


def object_bins(edges: DataFrame, bins: Mapping[str, tuple[float, float]], width: float = 5.0, distance: str = "distance") -> DataFrame:
    """Edges with bin (name) and sub_bin of their distance; edges in no bin are dropped."""
    d, names, limits = F.col(distance).cast("double"), list(bins), list(bins.values())
    number = angle_bin(d, [lo for lo, _ in limits] + [limits[-1][1]])
    low = F.get(F.array(*(F.lit(float(lo)) for lo, _ in limits)), number)
    return edges.withColumns({"bin": F.get(F.array(*map(F.lit, names)), number), "sub_bin": sub_bin(d, low, width)}).filter("bin IS NOT NULL")


def degree_summary(edges: DataFrame, nodes: DataFrame, a: str, b: str, node: str = "node") -> DataFrame:
    """One row: the largest degree, nodes with an edge, the sum of squared degrees, and nodes without one."""
    degrees = endpoint_degrees(edges, a, b)
    whole = nodes.select(F.col(node).alias("node")).distinct().join(degrees, "node", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return whole.agg(F.max("degree").alias("max_degree"), F.sum((F.col("degree") > 0).cast("long")).alias("nodes"), F.sum(F.col("degree") * F.col("degree")).alias("squares"), F.sum((F.col("degree") == 0).cast("long")).alias("unused"))
