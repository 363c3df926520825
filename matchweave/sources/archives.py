"""Feature archives (NPZ) as relations, and back: descriptor maps, keypoints, ranked shards.

An archive is one image's or one pair's arrays, so it is read whole by the task that holds its path.  What is wrong with one
archive is in its ``problem``; the others are read all the same.  At rest between jobs the relations are Parquet.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchweave.sources import npz

def files(spark: SparkSession, path: str, suffixes: Iterable[str] = (), content: bool = False) -> DataFrame:
    """All files below a folder (path, length, and content if asked), with these suffixes in any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if suffixes:
        found = found.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*(s.lower() for s in suffixes)))
    return found.select("path", "length", *["content"] * content)


def content_ids(spark: SparkSession, path: str, suffixes: Iterable[str] = ()) -> DataFrame:
    """(path, sha256) of the files' contents."""
    return files(spark, path, suffixes, content=True).select("path", F.sha2("content", 256).alias("sha256"))


def images(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"))


# ---------------------------------------------------------------- reading
DESCRIPTORS, KEYPOINTS = npz.SCHEMAS["descriptors"], npz.SCHEMAS["keypoints"]


def _read(spark: SparkSession, path: str, kind: str, patch_size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield npz.batch(kind, name, raw.as_py(), patch_size)

    return files(spark, path, (".npz",), content=True).select("path", "content").mapInArrow(run, npz.SCHEMAS[kind])


def descriptors(spark: SparkSession, path: str, patch_size: int = 16) -> DataFrame:
    """Descriptor archives as one row for each patch inside the processed size (DESCRIPTORS).  ``patch_size`` stands in where an old archive has none.
    Read through Spark's own file systems; ``npz.FeatureArchives`` is the data source with planned partitions."""
    return _read(spark, path, "descriptors", patch_size)


def keypoints(spark: SparkSession, path: str) -> DataFrame:
    """Keypoint archives as one row for each point (KEYPOINTS); an archive without points has one row with a null kp_idx."""
    return _read(spark, path, "keypoints", 0)


def write_archives(rows: DataFrame, key: str, columns: Mapping[str, str], order: str) -> DataFrame:
    """One NPZ for each key, as rows (key, content): ``columns`` names the arrays and the columns they come from, in the order of ``order``.

    As (name, content) they go to the sink ``npz.FeatureArchives``, which publishes all of them or none; nothing goes to a local disk here.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        out = io.BytesIO()
        np.savez_compressed(out, **{name: np.array(table.column(c).to_pylist()) for name, c in columns.items()})
        return pa.table({key: table.column(key).take([0]), "content": pa.array([out.getvalue()], pa.binary())})

    chosen = rows.select(key, order, *(c for c in dict.fromkeys(columns.values()) if c not in (key, order)))
    return chosen.groupBy(key).applyInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")


# ---------------------------------------------------------------- provenance
def stale(meta: Column, expected: Mapping[str, str], allow_missing: bool = False) -> Column:
    """Why an archive's metadata (a map of text) cannot be used, null if it can: the first key that is missing (unless allowed) or differs."""
    out = F.lit(None).cast("string")
    for key, want in reversed(list(expected.items())):
        have = F.element_at(meta, key)
        missing = F.lit(None).cast("string") if allow_missing else F.lit(f"missing {key}")
        rest = out
        out = F.when(have.isNull(), F.coalesce(missing, rest)).when(have != F.lit(want), F.concat(F.lit(f"{key} is "), have)).otherwise(rest)
    return out


def cache_policy(wanted: DataFrame, cached: DataFrame, key: str, reason: Column, allow_legacy: bool = False, compute: bool = True) -> DataFrame:
    """What to do about each wanted key: ``hit``, ``legacy`` (an old archive, where these are allowed), ``compute``, or ``fail``.

    cached: key, legacy and what ``reason`` (see ``stale``) looks at.
    """
    held = cached.select(key, F.lit(True).alias("_held"), "legacy", reason.alias("_reason")).dropDuplicates([key])
    joined = wanted.select(key).distinct().join(held, key, "left")
    missing = F.when(F.lit(compute), "compute").otherwise("fail")
    action = F.when(F.col("_held").isNull(), missing).when(F.col("_reason").isNotNull(), missing).when(F.col("legacy"), F.when(F.lit(allow_legacy), "legacy").otherwise(missing)).otherwise("hit")
    return joined.select(key, action.alias("action"), F.coalesce("_reason", F.when(F.col("legacy") & F.lit(not allow_legacy), "legacy archive")).alias("why"))


# ---------------------------------------------------------------- ranked shards
def complete_patches(grids: DataFrame, patch: int) -> DataFrame:
    """Patches that lie inside the resized image (image, grid_w, resized_h, resized_w): (image, patch_idx)."""
    rows, columns = F.floor(F.col("resized_h") / patch), F.floor(F.col("resized_w") / patch)
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    inside = F.flatten(F.transform(numbers(rows), lambda y: F.transform(numbers(columns), lambda x: y * F.col("grid_w") + x)))
    return grids.filter((rows > 0) & (columns > 0)).select("image", F.explode(inside).alias("patch_idx"))


def shard_problems(candidates: DataFrame, minimum: DataFrame, counts: DataFrame, complete: DataFrame, objects: DataFrame, images_of: DataFrame, max_k: int) -> DataFrame:
    """(pair_idx, check, violations) of every rule that a pair's ranked candidates break.

    candidates: pair_idx, layer, rank, direction, source, target, cosine, cand_rank, entry_k, is_object, has_depth, error.  minimum: pair_idx,
    direction, source, min_error.  counts: pair_idx, layer, rank, k, matches.  complete, objects: image, patch_idx.  images_of: pair_idx,
    direction, source_image, target_image.
    """
    query = ["pair_idx", "layer", "rank", "direction", "source"]
    order = Window.partitionBy(*query).orderBy("cand_rank")
    flags = candidates.join(images_of, ["pair_idx", "direction"])
    for side, image in (("source", "source_image"), ("target", "target_image")):
        for name, table in (("complete", complete), ("object", objects)):
            known = table.select(F.col("image").alias(image), F.col("patch_idx").alias(side), F.lit(True).alias(f"_{side}_{name}")).distinct()
            flags = flags.join(known, [image, side], "left")
    flags = flags.join(minimum, ["pair_idx", "direction", "source"], "left").withColumn("_before", F.lag("cosine").over(order))
    infinite = F.col("error") == float("inf")
    unknown = lambda c: F.coalesce(c, F.lit(True))
    rules = {
        "source touches padding": F.col("_source_complete").isNull(),
        "source outside the object": F.col("_source_object").isNull(),
        "target touches padding": F.col("_target_complete").isNull(),
        "object flag disagrees": F.col("is_object") != F.col("_target_object").isNotNull(),
        "cosine out of range or rising": unknown(F.isnan("cosine") | (F.abs("cosine") > 1.00001)) | F.coalesce(F.col("cosine") - F.col("_before") > 1e-6, F.lit(False)),
        "error is not a distance": unknown(F.isnan("error") | (F.col("error") < 0)),
        "depth flag disagrees with the error": unknown(F.col("has_depth") == infinite),
        "entry out of range": unknown((F.col("entry_k") < 1) | (F.col("entry_k") > max_k + 1)),
        "entry before the rank": (F.col("entry_k") <= max_k) & (F.col("entry_k") < F.col("cand_rank")),
        "minimum is not a distance": unknown(F.isnan("min_error") | (F.col("min_error") < 0)),
        "minimum above a candidate": F.col("is_object") & F.col("has_depth") & (F.col("min_error") > F.col("error") + 1e-12),
    }
    broken = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))).alias("check")
    rows = flags.select("pair_idx", broken)
    per_query = candidates.groupBy(*query).agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"), F.countDistinct("cand_rank").alias("ranks"), F.max("cand_rank").alias("last"))
    twice = per_query.filter("targets < n").select("pair_idx", F.lit("target twice").alias("check"))
    gaps = per_query.filter((F.col("ranks") < F.col("n")) | (F.col("last") != F.col("n")) | (F.col("n") != max_k)).select("pair_idx", F.lit("ranks incomplete").alias("check"))
    grid = complete.groupBy("image").agg(F.count("*").alias("patches"))
    bound = images_of.filter("direction = 'a_to_b'").join(grid.select(F.col("image").alias("source_image"), F.col("patches").alias("a")), "source_image").join(grid.select(F.col("image").alias("target_image"), F.col("patches").alias("b")), "target_image").select("pair_idx", F.least("a", "b").alias("least"))
    steps = Window.partitionBy("pair_idx", "layer", "rank").orderBy("k")
    counted = counts.withColumn("_before", F.lag("matches").over(steps)).join(bound, "pair_idx", "left")
    falling = counted.filter("matches < 0 OR matches < _before").select("pair_idx", F.lit("matches not cumulative").alias("check"))
    many = counted.filter(F.col("matches") > F.col("least") * F.col("k")).select("pair_idx", F.lit("more matches than the graph can hold").alias("check"))
    return rows.unionByName(twice).unionByName(gaps).unionByName(falling).unionByName(many).groupBy("pair_idx", "check").agg(F.count("*").alias("violations"))


def read_rank_shards(spark: SparkSession, path: str, schema: str, bins: Iterable[str], layers: Iterable[int], pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shards, problems): the stored long form with an explicit schema, and the (bin, layer, pair_idx) that are missing from the rectangle or do not belong to it."""
    shards = spark.read.schema(schema).parquet(path)
    have = shards.select("bin", "layer", "pair_idx").distinct()
    cells = F.explode(F.array(*(F.struct(F.lit(b).alias("bin"), F.lit(n).cast(shards.schema["layer"].dataType).alias("layer")) for b in bins for n in layers))).alias("c")
    want = pairs.select("pair_idx").distinct().select("pair_idx", cells).select("c.bin", "c.layer", "pair_idx")
    keys = ["bin", "layer", "pair_idx"]
    return shards, want.join(have, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(have.join(want, keys, "left_anti").withColumn("problem", F.lit("unexpected")))
