"""Pair and pose files of datasets, how they are prepared, and what binds them to each other."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions import geometry as g

POSE = ("fx1", "fy1", "cx1", "cy1", "fx2", "fy2", "cx2", "cy2", "qw", "qx", "qy", "qz", "tx", "ty", "tz")
PAIR = ("image_1", "image_2", "image_1_height", "image_1_width", "image_2_height", "image_2_width")


class Mismatch(ValueError):
    pass


# ---------------------------------------------------------------- scans
def annotations(spark: SparkSession, path: str, schema: str, name: str = "filename") -> DataFrame:
    """JSON arrays of annotations with their ``filename``; a name that occurs twice is an error when it is read."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    counted = rows.join(rows.groupBy(name).agg(F.count("*").alias("_copies")), name)
    checked = F.when(F.col("_copies") > 1, F.raise_error(F.concat(F.lit("annotated twice: "), F.col(name))).cast("string")).otherwise(F.col(name))
    return counted.withColumn(name, checked).drop("_copies")


def pairs_with_poses(spark: SparkSession, path: str, invert: bool = False) -> DataFrame:
    """Text with 38 fields a line: two images, two unused, two 3 x 3 intrinsics, a 4 x 4 transform from camera 1 to 2 (``invert``: from 2 to 1).

    (line, image_1, image_2, k1, k2 (array<double> of 9), rotation (9), translation (3), problem); comments and empty lines are skipped.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    lines = lines.filter(~F.trim("value").rlike("^(#.*)?$")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    numbers = F.transform(F.slice("f", 5, 34), lambda x: x.try_cast("double"))
    problem = F.when(F.size("f") != 38, F.concat(F.lit("fields: "), F.size("f").cast("string"))).when(F.exists("n", lambda x: x.isNull()), "not a number")
    read = lines.withColumn("n", numbers).withColumn("problem", problem)
    m = lambda i, j: F.get("n", F.lit(18 + 4 * i + j))
    r, t = [[m(i, j) for j in range(3)] for i in range(3)], [m(i, 3) for i in range(3)]
    if invert:
        r = [[r[j][i] for j in range(3)] for i in range(3)]
        t = [-g.dot3(row, t) for row in r]
    flat = [x for row in r for x in row]
    return read.select("line", F.get("f", F.lit(0)).alias("image_1"), F.get("f", F.lit(1)).alias("image_2"), F.slice("n", 1, 9).alias("k1"), F.slice("n", 10, 9).alias("k2"), F.array(*flat).alias("rotation"), F.array(*t).alias("translation"), "problem")


SCENES = "scene string, at int, image_1 string, image_2 string, k1 array<double>, k2 array<double>, rotation array<double>, translation array<double>, distortion1 array<double>, distortion2 array<double>, problem string"


def scene_indexes(contents: DataFrame) -> DataFrame:
    """Scene index archives (path, content) as pairs (SCENES): images, intrinsics, distortion and the relative pose of each listed pair, by the scene's number and the pair's place.

    The archives hold their paths as text arrays; pickled objects are not read.
    """
    import io

    def run(batches):
        fields = [c.split(" ") for c in SCENES.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    with np.load(io.BytesIO(raw.as_py()), allow_pickle=False) as d:
                        names, k, dist, pose = d["image_paths"], *(np.asarray(d[n], np.float64) for n in ("intrinsics", "distortion_coefs", "poses"))
                        for at, (a, b) in enumerate(np.asarray(d["pair_infos"], np.int64).reshape(-1, 2).tolist()):
                            move = pose[b] @ np.linalg.inv(pose[a])
                            rows.append({"scene": name, "at": at, "image_1": str(names[a, 0]), "image_2": str(names[b, 1]), "k1": k[a, 0].ravel().tolist(), "k2": k[b, 1].ravel().tolist(), "rotation": move[:3, :3].ravel().tolist(), "translation": move[:3, 3].tolist(), "distortion1": dist[a, 0].ravel().tolist(), "distortion2": dist[b, 1].ravel().tolist()})
                except Exception as e:  # the archive's own problem, whatever it is
                    rows = [{"scene": name, "problem": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields], names=[n for n, _ in fields])

    return contents.select("path", "content").mapInArrow(run, SCENES)


# ---------------------------------------------------------------- preparation
def axis_scales(height: Column, width: Column, longest: int, only_down: bool = False) -> tuple[Column, Column]:
    """(x, y): what each axis is really scaled by, once the resized size was truncated to whole pixels."""
    h, w, _ = g.resize(height, width, longest, only_down)
    return w.cast("double") / width, h.cast("double") / height


def with_sizes(pairs: DataFrame, sizes: DataFrame, annotated: DataFrame | None = None) -> DataFrame:
    """Pairs with both images' sizes (image, height, width), and ``problem`` where an image has none or, where it is annotated, another one."""
    out = pairs
    for s in "12":
        out = out.join(sizes.select(F.col("image").alias(f"image_{s}"), F.col("height").alias(f"image_{s}_height"), F.col("width").alias(f"image_{s}_width")), f"image_{s}", "left")
        if annotated is not None:
            out = out.join(annotated.select(F.col("image").alias(f"image_{s}"), F.struct("height", "width").alias(f"_a{s}")), f"image_{s}", "left")
    wrong = lambda s: ~F.col(f"_a{s}").eqNullSafe(F.struct(F.col(f"image_{s}_height").alias("height"), F.col(f"image_{s}_width").alias("width")))
    problem = F.when(F.col("image_1_height").isNull() | F.col("image_2_height").isNull(), "no size")
    if annotated is not None:
        problem = problem.when(wrong("1") | wrong("2"), "size differs from the annotation")
    earlier = [F.col("problem")] if "problem" in pairs.columns else []
    return out.withColumn("problem", F.coalesce(*earlier, problem)).drop("_a1", "_a2")


def pose_rows(pairs: DataFrame, order: Sequence[str], longest: int, only_down: bool = False) -> DataFrame:
    """Pose and intrinsics rows from pairs with sizes, matrices and (where there are) distortions: intrinsics scaled with the image, the rotation as
    a quaternion, ids from 1 in the order of ``order``.  A pair list is some thousand rows, so it is ordered as a whole."""
    from pyspark.sql import Window

    k = lambda s, i: F.get(f"k{s}", F.lit(i))
    columns = {}
    for s in "12":
        sx, sy = axis_scales(F.col(f"image_{s}_height"), F.col(f"image_{s}_width"), longest, only_down)
        columns |= {f"fx{s}": k(s, 0) * sx, f"fy{s}": k(s, 4) * sy, f"cx{s}": k(s, 2) * sx, f"cy{s}": k(s, 5) * sy}
    r = [[F.get("rotation", F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    columns |= dict(zip(("qw", "qx", "qy", "qz"), g.canonical(g.quaternion(r)), strict=True)) | {c: F.get("translation", F.lit(i)) for i, c in enumerate(("tx", "ty", "tz"))}
    number = F.row_number().over(Window.orderBy(*order)).cast("long")
    extra = [c for c in ("distortion1", "distortion2") if c in pairs.columns]
    return pairs.select(number.alias("pair_idx"), *PAIR, *(c.alias(n) for n, c in columns.items()), *extra)


def prepare(spark: SparkSession, subsets: Mapping[str, Callable[[SparkSession], DataFrame]], hashes: DataFrame | None = None, expected: Mapping[str, str] | None = None) -> DataFrame:
    """The pose rows of all registered subsets with their ``subset``.  ``hashes`` (path, sha256) are held against the ``expected`` ones first."""
    if expected:
        have = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in hashes.filter(F.regexp_extract("path", r"([^/]+)$", 1).isin(*expected)).collect()}  # one row for each registered source
        wrong = [name for name, digest in expected.items() if have.get(name) != digest]
        if wrong:
            raise Mismatch(f"sources that are missing or have changed: {wrong}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (make(spark).withColumn("subset", F.lit(name)) for name, make in subsets.items()))


def number_text(x: Column) -> Column:
    """A double as text that reads back as the same double, zero without a sign."""
    return F.when(x == 0, "0").otherwise(F.regexp_replace(x.cast("string"), r"\.0$", ""))


def materialise(prepared: DataFrame, path: str, policy: str = "error") -> DataFrame:
    """Pairs, poses and manifest of each subset below ``path``; returns the manifest (subset, pairs, poses, pair_sha256).

    ``policy``: ``error`` if there is something already, ``overwrite``, or ``validate``: nothing is written, and a difference is an error.
    """
    spark = prepared.sparkSession
    tables = {"pairs": prepared.select("subset", "pair_idx", *PAIR), "poses": prepared.select("subset", "pair_idx", *POSE, *(c for c in ("distortion1", "distortion2") if c in prepared.columns))}
    line = F.concat_ws(":", F.col("pair_idx").cast("string"), "image_1", "image_2")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pair_idx", line.alias("line")))), lambda x: x["line"])  # a subset is some thousand pairs
    manifest = prepared.groupBy("subset").agg(F.count("*").alias("pairs"), F.count(F.when(g.finite(F.col("qw")), 1)).alias("poses"), F.sha2(F.array_join(lines, "\n"), 256).alias("pair_sha256"))
    if not manifest.filter("pairs != poses").isEmpty():
        raise Mismatch("a pair has no pose")
    tables["manifest"] = manifest
    if policy == "validate":
        for name, rows in tables.items():
            stored = spark.read.schema(rows.schema).parquet(f"{path}/{name}").select(*rows.columns)
            if not stored.exceptAll(rows).unionByName(rows.exceptAll(stored)).isEmpty():
                raise Mismatch(f"{name} differs from what is stored")
    else:
        for name, rows in tables.items():
            rows.write.mode("error" if policy == "error" else "overwrite").parquet(f"{path}/{name}")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


# ---------------------------------------------------------------- provenance
def bound(pose_manifest: DataFrame, match_manifest: DataFrame, poses: DataFrame, matches: DataFrame, keys: Sequence[str] = ("pair_file_sha256", "pair_identity_sha256")) -> DataFrame:
    """(problem, detail) of poses and association files that do not belong together: manifests are one row each with these keys and pair_count."""
    a, b = pose_manifest.first(), match_manifest.first()
    spark = poses.sparkSession
    if a is None or b is None:
        return spark.createDataFrame([("manifest missing", "pose" if a is None else "association")], "problem string, detail string")
    found = [(f"{k} differs", f"{a[k]} / {b[k]}") for k in keys if a[k] != b[k]]
    n, m = poses.count(), matches.select("pair_idx").distinct().count()
    found += [("pair_count differs", f"{a.pair_count} / {b.pair_count}")] * (a.pair_count != b.pair_count)
    found += [("pose rows", f"{a.pair_count} / {n}")] * (a.pair_count != n) + [("association files", f"{b.pair_count} / {m}")] * (b.pair_count != m)
    ids = lambda x, y, what: x.select("pair_idx").distinct().join(y.select("pair_idx").distinct(), "pair_idx", "left_anti").select(F.lit(what).alias("problem"), F.col("pair_idx").cast("string").alias("detail"))
    return spark.createDataFrame(found, "problem string, detail string").unionByName(ids(poses, matches, "pair without associations")).unionByName(ids(matches, poses, "pair without a pose"))


def camera_model(fx: Column, fy: Column, distortion: Column) -> Column:
    """The model that intrinsics ask for: one or two focal lengths, four or eight coefficients; null for any other number of them."""
    equal = F.abs(fx - fy) <= 1e-9 * F.greatest(F.abs(fx), F.abs(fy), F.lit(1.0))
    n = F.coalesce(F.size(distortion), F.lit(0))
    return F.when(n <= 0, F.when(equal, "SIMPLE_PINHOLE").otherwise("PINHOLE")).when(n == 4, "OPENCV").when(n == 8, "FULL_OPENCV")


def zero_based(rows: DataFrame, layers: int, column: str = "layer") -> DataFrame:
    """Layers that count from 1 as layers from 0; one outside ``1..layers`` is an error when it is read."""
    inside = F.col(column).between(1, layers)
    return rows.withColumn(column, F.when(inside, F.col(column) - 1).otherwise(F.raise_error(F.concat(F.lit("layer out of range: "), F.col(column).cast("string"))).cast("int")))


def same_schema(stored: DataFrame, new: DataFrame) -> None:
    """An append to a table of other columns or types is refused."""
    shape = lambda d: [(f.name, f.dataType.simpleString()) for f in d.schema.fields]
    if sorted(shape(stored)) != sorted(shape(new)):
        raise Mismatch(f"the table has {shape(stored)}, the rows have {shape(new)}")


def padded_sizes(images: DataFrame, longest: int, patch: int, only_down: bool = False) -> DataFrame:
    """The distinct padded sizes that a list of images (image, height, width) needs; an image with two sizes is an error when it is read."""
    one = images.groupBy("image").agg(F.min(F.struct("height", "width")).alias("size"), F.countDistinct("height", "width").alias("n"))
    height = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two sizes: "), "image")).cast("int")).otherwise(F.col("size.height"))
    sized = one.select(height.alias("h"), F.col("size.width").alias("w"))
    h, w, _ = g.resize(F.col("h"), F.col("w"), longest, only_down)
    return sized.select(g.pad(h, patch).alias("height"), g.pad(w, patch).alias("width")).distinct()


# ---------------------------------------------------------------- bases
BASIS = "layer int, height int, width int, comp int, u array<double>, strength double"


def fit_bases(vectors: DataFrame, rank: int, keys: Sequence[str] = ("layer", "height", "width")) -> DataFrame:
    """Per key the ``rank`` strongest directions of its unit vectors around their mean: (keys, comp from 0, u, strength), each u with a positive largest entry.

    vectors: keys, v.  Tasks add up each block's moments (a dim x dim matrix, whatever the number of vectors), one task for each key sums these and
    takes the eigenvectors, so no task holds a key's vectors.
    """
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in keys}
    moments = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n long, total binary, outer binary"

    def add(table: pa.Table) -> pa.Table:
        v = np.array(table.column("v").to_pylist(), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        head = {c: table.column(c).take([0]) for c in keys}
        return pa.table(head | {"n": pa.array([len(v)], pa.int64()), "total": pa.array([v.sum(0).tobytes()], pa.binary()), "outer": pa.array([(v.T @ v).tobytes()], pa.binary())})

    def solve(table: pa.Table) -> pa.Table:
        n = sum(table.column("n").to_pylist())
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("total"))
        outer = sum(np.frombuffer(x.as_buffer()) for x in table.column("outer")).reshape(len(total), -1)
        values, directions = np.linalg.eigh(outer - np.outer(total, total) / n)
        found = [directions[:, -1 - i] for i in range(min(rank, len(total)))]
        found = [u * np.sign(u[np.abs(u).argmax()]) for u in found]
        head = {c: pa.array(table.column(c).to_pylist()[:1] * len(found), table.schema.field(c).type) for c in keys}
        return pa.table(head | {"comp": pa.array(range(len(found)), pa.int32()), "u": pa.array([u.tolist() for u in found], pa.list_(pa.float64())), "strength": pa.array([float(np.sqrt(max(0.0, values[-1 - i]))) for i in range(len(found))], pa.float64())})

    block = F.pmod(F.xxhash64("v"), F.lit(256))
    summed = vectors.select(*keys, "v", block.alias("block")).groupBy(*keys, "block").applyInArrow(add, moments)
    return summed.groupBy(*keys).applyInArrow(solve, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", comp int, u array<double>, strength double")


def fit_missing(vectors: DataFrame, stored: DataFrame | None, rank: int, keys: Sequence[str] = ("layer", "height", "width")) -> DataFrame:
    """All keys' bases: those of ``stored`` that hold ``rank`` directions, and new ones for the rest."""
    if stored is None:
        return fit_bases(vectors, rank, keys)
    whole = stored.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= rank).select(*keys)
    kept = stored.join(whole, list(keys), "left_semi").filter(F.col("comp") < rank)
    return kept.unionByName(fit_bases(vectors.join(whole, list(keys), "left_anti"), rank, keys))


def task_order(tasks: DataFrame) -> DataFrame:
    """Tasks (k, dataset, subset, seed) in the order in which they are run: the largest K first."""
    return tasks.orderBy(F.desc("k"), "dataset", "subset", "seed")


def cost_order(pairs: DataFrame, heights: Sequence[str] = ("height_1", "height_2"), widths: Sequence[str] = ("width_1", "width_2")) -> DataFrame:
    """Pairs with their cost, the padded pixels of both images, the dearest first."""
    cost = reduce(lambda a, b: a + b, (F.col(h).cast("long") * F.col(w) for h, w in zip(heights, widths, strict=True)))
    return pairs.withColumn("cost", cost).orderBy(F.desc("cost"), "pair_idx")


def match_stage(spark: SparkSession, pairs: DataFrame, vectors: DataFrame, bases: DataFrame | None, k: int, most: int = 0) -> DataFrame:
    """From cached vectors to association graphs: bases removed (where there are), vectors normalised, mutual neighbours of each pair.

    pairs: pair_idx, image_1, image_2.  vectors: image, idx, v.  bases: comp, u, a few hundred rows that are constants of the plan.
    """
    from matchweave.functions.vector import let, normalize, project_out
    from matchweave.operators import knn

    columns = [r.u for r in bases.orderBy("comp").collect()] if bases is not None else []  # rank times dim numbers
    clean = (lambda v: project_out(v, columns)) if columns else (lambda v: let(v, normalize))
    ready = vectors.select("image", "idx", clean(F.transform("v", lambda x: x.cast("double"))).alias("v"))
    side = lambda s: pairs.select("pair_idx", F.col(f"image_{s}").alias("image")).join(ready, "image").select("pair_idx", "idx", "v")
    return knn.mutual_knn(side("1"), side("2"), k, most)
