"""From archives to association graphs in one call, stage by stage, each stored and done once.

A stage's folder is named by a digest of its parameters and of the stages before it, down to the names, sizes and times of the archives.  A stage
whose folder is complete is read; so a second call computes nothing, a call with another K only matches again, and a run that broke goes on at
the stage where it broke.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions.vector import as_double, dot, let, normalize
from matchweave.operators import gather, knn
from matchweave.sources import archives, datasets


class Chain:
    """Stages below a folder; ``made`` names those that this object computed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []
        self.digests: dict[str, str] = {}

    def _complete(self, path: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def stage(self, name: str, make: Callable[[], DataFrame], after: Sequence[str] = (), **parameters) -> DataFrame:
        """The table of a stage: read if it is complete, else made of the stages ``after`` which it comes."""
        about = json.dumps([name, [self.digests[a] for a in after], parameters], sort_keys=True, default=str)
        self.digests[name] = hashlib.sha256(about.encode()).hexdigest()[:20]
        path = f"{self.folder}/{name}-{self.digests[name]}"
        if not self._complete(path):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


def listing(spark: SparkSession, path: str) -> str:
    """A digest of the archives below a path: their names, sizes and times, whatever order they are listed in."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.lower("path").endswith(".npz"))
    row = found.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h"), F.bit_xor(F.col("h").cast("long"))).first()
    return "/".join(map(str, row))


def image_of(path: Column) -> Column:
    """An archive's image: its file name without the suffix."""
    return F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)


def without_bases(vectors: DataFrame, bases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit vectors (column v) without the directions of the basis that their keys have (comp, u); all of them where there is none for the keys."""
    held = bases.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("comp", "u"))), lambda b: b["u"]).alias("_basis"))  # rank rows of a key
    joined = vectors.join(held, list(keys), "left")
    left = F.aggregate(F.coalesce("_basis", F.array().cast("array<array<double>>")), as_double(F.col("v")), lambda v, u: let(dot(v, u), lambda c: F.zip_with(v, u, lambda a, b: a - c * b)))
    return joined.withColumn("v", let(left, normalize)).drop("_basis")


def match_archives(spark: SparkSession, descriptors: str, keypoints: str, pairs: DataFrame, folder: str, k: int = 5, most: int = 0, rank: int = 0, frame: str = "resized", patch_size: int = 16) -> tuple[DataFrame, Chain]:
    """(association graph pair_idx, left_idx, right_idx, similarity, k; the chain) of pairs (pair_idx, image_1, image_2) of images.

    descriptors, keypoints: folders of archives whose file names are the images' names.  Stages: ``patches`` and ``maps`` (read), ``bases`` (fitted for each
    size of map, if ``rank`` is above 0), ``points`` (read), ``sampled`` (descriptors at points), ``cleaned`` (without the bases), ``edges`` (mutual neighbours).
    Archives that cannot be read have no points and no patches: their pairs have no edges.
    """
    chain = Chain(spark, folder)
    source = listing(spark, descriptors)
    read = lambda: archives.descriptors(spark, descriptors, patch_size).filter("problem IS NULL").withColumn("path", image_of(F.col("path")))
    whole = chain.stage("descriptors", read, files=source, path=descriptors, patch_size=patch_size)
    maps = chain.stage("maps", lambda: gather.maps_of(whole.withColumn("problem", F.lit(None).cast("string"))), ["descriptors"])
    patches = whole.select(F.col("path").alias("image"), "gx", "gy", "v")
    points = chain.stage("points", lambda: archives.keypoints(spark, keypoints).filter("problem IS NULL AND kp_idx IS NOT NULL").select(image_of(F.col("path")).alias("image"), "kp_idx", "x", "y"), files=listing(spark, keypoints), path=keypoints)
    sampled = chain.stage("sampled", lambda: gather.descriptors_at(points, maps, patches, frame), ["descriptors", "maps", "points"], frame=frame)
    sized = lambda rows: rows.join(maps.select("image", F.lit(0).alias("layer"), F.col("grid_h").alias("height"), F.col("grid_w").alias("width")), "image")
    ready = sampled
    if rank > 0:
        bases = chain.stage("bases", lambda: datasets.fit_bases(sized(patches).select("layer", "height", "width", as_double(F.col("v")).alias("v")), rank), ["descriptors", "maps"], rank=rank)
        ready = chain.stage("cleaned", lambda: without_bases(sized(sampled), bases, ["layer", "height", "width"]).select("image", "kp_idx", "x", "y", "v"), ["sampled", "bases"])
    ids = pairs.select("pair_idx", "image_1", "image_2")
    mark = ids.select(F.xxhash64("pair_idx", "image_1", "image_2").alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    side = lambda n: ids.select("pair_idx", F.col(f"image_{n}").alias("image")).join(ready, "image").select("pair_idx", F.col("kp_idx").cast("long").alias("idx"), "v")
    edges = chain.stage("edges", lambda: knn.mutual_knn(side(1), side(2), k, most), ["cleaned" if rank > 0 else "sampled"], k=k, most=most, pairs="/".join(map(str, mark)))
    return edges, chain
