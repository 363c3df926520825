"""Descriptors at keypoints: a four-corner gather from grids of patch vectors.

A point lies between the centres of four patches.  Its corners become rows (image, gx, gy, weight) and meet the patches of their image by an
equi-join, so an image's points and patches are spread over tasks by cell, and a map is never held whole.  The weighted vectors of a point are added per dimension and
brought to unit length.

maps: image, patch_size, grid_h, grid_w and, for resized frames, source_h, source_w, resized_h, resized_w.
points: image, kp_idx, x, y.  patches: image, gx, gy, v.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.functions.vector import as_double, let, normalize

FRAMES = ("native", "resized")


def on_grid(frame: str) -> tuple[Column, Column]:
    """A point's place on the grid of patch centres, from the columns of its map.

    ``native``: the point is in pixels of the map.  ``resized``: it is in pixels of the source image, which was resized to the
    map with pixel centres at half numbers.
    """
    if frame == "native":
        return F.col("x") / F.col("patch_size") - 0.5, F.col("y") / F.col("patch_size") - 0.5
    place = lambda c, size: (F.col(c) + 0.5) * (F.col(f"resized_{size}") / F.col(f"source_{size}")) / F.col("patch_size") - 0.5
    return place("x", "w"), place("y", "h")


def map_problem(frame: str) -> Column:
    """Why a map cannot be sampled, null if it can."""
    sizes = ["patch_size", *(["source_h", "source_w", "resized_h", "resized_w"] if frame == "resized" else [])]
    bad = F.lit(False)
    for c in sizes:
        bad = bad | F.coalesce(F.col(c) <= 0, F.lit(True))
    problem = F.when(bad, "sizes must be positive")
    if frame == "resized":
        differs = (F.col("resized_h") != F.col("grid_h") * F.col("patch_size")) | (F.col("resized_w") != F.col("grid_w") * F.col("patch_size"))
        problem = problem.when(differs, "the resized frame differs from the grid")
    return problem


def corners(points: DataFrame, maps: DataFrame, frame: str = "native") -> DataFrame:
    """(image, kp_idx, x, y, corner, gx, gy, weight) of the points whose place is on the grid, on its border too.

    Corners beyond the border are those on it; a corner without weight is left out.  A map with a ``map_problem`` is an error when it is read.
    """
    if frame not in FRAMES:
        raise ValueError(f"frame must be one of {FRAMES}")
    problem = map_problem(frame)
    sound = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), F.col("image").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    u, v = on_grid(frame)
    placed = points.select("image", "kp_idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(maps.filter(sound), "image")
    placed = placed.select("image", "kp_idx", "x", "y", (F.col("grid_w") - 1).alias("right"), (F.col("grid_h") - 1).alias("bottom"), u.alias("u"), v.alias("v"))
    inside = placed.filter("u >= 0 AND u <= right AND v >= 0 AND v <= bottom").withColumns({"u0": F.floor("u"), "v0": F.floor("v")}).withColumns({"du": F.col("u") - F.col("u0"), "dv": F.col("v") - F.col("v0")})

    def corner(number: int) -> Column:
        across, down = number % 2, number // 2
        weight = (F.col("du") if across else 1 - F.col("du")) * (F.col("dv") if down else 1 - F.col("dv"))
        return F.struct(F.lit(number).alias("corner"), F.least(F.col("u0") + across, F.col("right")).cast("int").alias("gx"), F.least(F.col("v0") + down, F.col("bottom")).cast("int").alias("gy"), weight.alias("weight"))

    return inside.select("image", "kp_idx", "x", "y", F.explode(F.array(*map(corner, range(4)))).alias("c")).select("image", "kp_idx", "x", "y", "c.*").filter("weight > 0")


def descriptors_at(points: DataFrame, maps: DataFrame, patches: DataFrame, frame: str = "native") -> DataFrame:
    """(image, kp_idx, x, y, v): the unit descriptor at every point on the grid of its image; x and y are those of the point, in its own frame.

    A corner whose patch is missing from ``patches`` is an error when it is read, since a grid is complete.  A vector of zeros stays zeros.
    """
    found = corners(points, maps, frame).join(patches.select("image", F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), F.col("v").alias("patch")), ["image", "gx", "gy"], "left")
    vector = F.when(F.col("patch").isNull(), F.raise_error(F.concat(F.lit("no patch at "), F.concat_ws(", ", "image", "gx", "gy"))).cast("array<double>")).otherwise(as_double(F.col("patch")))
    # at most four rows a point; sorted, so that sums are added in one order whatever the tasks did
    weighed = found.groupBy("image", "kp_idx", "x", "y").agg(F.array_sort(F.collect_list(F.struct("corner", "weight", vector.alias("v")))).alias("c"))
    scaled = F.transform("c", lambda c: F.transform(c["v"], lambda x: x * c["weight"]))
    total = let(scaled, lambda rows: F.aggregate(F.slice(rows, 2, 3), F.element_at(rows, 1), lambda s, r: F.zip_with(s, r, lambda a, b: a + b)))
    return weighed.select("image", "kp_idx", "x", "y", normalize(total).alias("v"))


def maps_of(archives: DataFrame) -> DataFrame:
    """The maps of descriptor archives (``archives.descriptors``): one row for each path, as image; the processed size is the resized frame of the original."""
    one = lambda c, name: F.first(c, ignorenulls=True).alias(name)
    return archives.filter("problem IS NULL").groupBy(F.col("path").alias("image")).agg(
        one("patch_size", "patch_size"), one("grid_h", "grid_h"), one("grid_w", "grid_w"), one("orig_h", "source_h"), one("orig_w", "source_w"), (F.first("grid_h") * F.first("patch_size")).alias("resized_h"), (F.first("grid_w") * F.first("patch_size")).alias("resized_w")
    )
