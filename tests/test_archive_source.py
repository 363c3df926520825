"""The data source and sink of archives, the stage chain, and the repair of shards."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.sources import archives, chain, npz, shards


def save(path, **arrays):
    with open(path, "wb") as f:
        np.savez(f, **arrays)


@pytest.fixture(scope="module")
def source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(npz.FeatureArchives)
    yield lambda **options: spark.read.format(npz.NAME).options(**options)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("archives")
    (top / "d" / "deep").mkdir(parents=True)
    (top / "k").mkdir()
    rng = np.random.default_rng(1)
    for i, name in enumerate(("a", "b", "deep/c", "e")):
        save(top / "d" / f"{name}.npz", descriptor_map=rng.normal(size=(3, 4, 8)).astype(np.float32), schema_version=2, patch_size=8, proc_hw=[24, 32], orig_hw=[24, 32], model_name=f"m{i}")
        save(top / "k" / f"{name.rpartition('/')[2]}.npz", keypoints=rng.uniform(0, 32, (40, 2)).astype(np.float32), schema_version=1)
    (top / "d" / "torn.npz").write_bytes(b"nothing")
    save(top / "d" / "odd.npz", descriptor_map=np.zeros((3, 4)), schema_version=7, patch_size=0)
    return str(top)


def test_all_problems_of_an_archive_are_told(spark, folder):
    (row,) = archives.descriptors(spark, f"{folder}/d").filter("path LIKE '%odd.npz'").collect()
    assert all(x in row.problem for x in ("descriptor_map has the shape (3, 4)", "version 7", "patch_size is not positive"))
    assert npz.problems("keypoints", {"keypoints": np.zeros((3, 2)), "scores": np.zeros(2), "descriptors": np.zeros((3, 5)), "schema_version": 1}) == ["scores has the shape (2,), not ('points',)"]
    assert npz.problems("keypoints", {}) == ["keypoints is missing"]


def test_source_reads_what_the_reader_reads(spark, source, folder):
    for kind, read in (("descriptors", archives.descriptors), ("keypoints", archives.keypoints)):
        got = source(kind=kind).load(f"{folder}/{kind[0]}")
        name = F.regexp_extract("path", "([^/]*)$", 1)
        assert got.withColumn("path", name).withColumn("meta", F.to_json("meta")).exceptAll(read(spark, f"{folder}/{kind[0]}").withColumn("path", name).withColumn("meta", F.to_json("meta"))).isEmpty()
        assert got.count() == read(spark, f"{folder}/{kind[0]}").count()


def test_partitions_go_by_size_and_filters_leave_files_out(source, folder):
    whole = source(kind="descriptors", partitionBytes="1").load(f"{folder}/d")
    assert whole.rdd.getNumPartitions() == 6 and source(kind="descriptors").load(f"{folder}/d").rdd.getNumPartitions() == 1
    one = whole.filter(F.col("path") == f"{folder}/d/b.npz")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 12
    some = whole.filter(F.col("path").isin(f"{folder}/d/a.npz", f"{folder}/d/e.npz") & (F.col("gx") == 0))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 6
    assert whole.filter(F.col("path").startswith(f"{folder}/d/deep")).rdd.getNumPartitions() == 1


def test_columns_without_vectors_do_not_unpack_them(source, folder, tmp_path):
    got = source(kind="descriptors").schema("path string, patch_idx int, gx int").load(f"{folder}/d").filter("path LIKE '%/a.npz'")
    assert got.columns == ["path", "patch_idx", "gx"] and got.count() == 12
    # an archive whose vectors are damaged behind their header can still be listed
    save(tmp_path / "x.npz", descriptor_map=np.ones((3, 4, 2000), np.float32), patch_size=8)
    raw = bytearray((tmp_path / "x.npz").read_bytes())
    raw[50_000:50_100] = bytes(100)
    (tmp_path / "x.npz").write_bytes(bytes(raw))
    light = source(kind="descriptors").schema("path string, patch_idx int, problem string").load(str(tmp_path)).collect()
    heavy = source(kind="descriptors").load(str(tmp_path)).collect()
    assert len(light) == 12 and light[0].problem is None and len(heavy) == 1 and heavy[0].problem


def listed(path) -> set:
    return {f for _, _, names in os.walk(path) for f in names if f.endswith(".npz")}


def test_sink_publishes_all_or_none(spark, source, folder, tmp_path):
    out = str(tmp_path / "out")
    rows = archives.write_archives(archives.descriptors(spark, f"{folder}/d").filter("problem IS NULL").withColumn("name", chain.image_of(F.col("path"))), "name", {"descriptor_map": "v"}, "patch_idx")

    def boom(batches):
        from pyspark import TaskContext

        for b in batches:
            yield b
        if TaskContext.get().partitionId() == 2:
            raise RuntimeError("the task is lost")

    with pytest.raises(Exception, match="the task is lost"):
        rows.repartition(4, "name").mapInArrow(boom, "name string, content binary").write.format(npz.NAME).mode("append").save(out)
    assert listed(out) == set() and not [d for d in os.listdir(out) if os.path.isdir(d)] if os.path.exists(out) else True
    rows.write.format(npz.NAME).mode("append").save(out)
    assert listed(out) == {"a.npz", "b.npz", "c.npz", "e.npz"}
    read = source(kind="descriptors").load(out)
    assert read.filter("problem IS NOT NULL").count() == 4  # the flat vectors of this test are no grid, which each archive says of itself
    rows.filter("name = 'a'").write.format(npz.NAME).mode("overwrite").save(out)
    assert listed(out) == {"a.npz"}
    with pytest.raises(Exception, match="no name of a file"):
        rows.withColumn("name", F.lit("../a")).write.format(npz.NAME).mode("append").save(out)
    assert listed(out) == {"a.npz"}


def test_attempts_that_were_beaten_leave_nothing(tmp_path):
    import pyarrow as pa

    writer = npz.ArchiveWriter({"path": str(tmp_path)}, overwrite=False)
    rows = lambda *names: iter([pa.RecordBatch.from_pydict({"name": list(names), "content": [b"1"] * len(names)})])
    first, second, other = writer.write(rows("a", "b")), writer.write(rows("a", "b")), writer.write(rows("c"))
    assert first.files != second.files and listed(tmp_path) == set()
    writer.commit([second, other, None])
    assert listed(tmp_path) == {"a.npz", "b.npz", "c.npz"} and not [f for _, _, names in os.walk(tmp_path) for f in names if f not in listed(tmp_path) and f != "_manifest.json"]
    again = npz.ArchiveWriter({"path": str(tmp_path)}, overwrite=False)
    with pytest.raises(ValueError, match="two archives"):
        again.commit([again.write(rows("d")), again.write(rows("d"))])
    assert listed(tmp_path) == {"a.npz", "b.npz", "c.npz"} and len(os.listdir(tmp_path)) == 1


# ---------------------------------------------------------------- chain
def test_chain_from_archives_to_graphs(spark, folder, tmp_path):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "c", "e"), (3, "a", "nobody")], "pair_idx long, image_1 string, image_2 string")
    run = lambda **o: chain.match_archives(spark, f"{folder}/d", f"{folder}/k", pairs, str(tmp_path / "run"), patch_size=8, **o)
    edges, first = run(k=2, rank=2)
    assert first.made == ["descriptors", "maps", "points", "sampled", "bases", "cleaned", "edges"]
    got = {tuple(r) for r in edges.select("pair_idx", "left_idx", "right_idx", "k").collect()}
    assert {p for p, *_ in got} == {1, 2}
    # the same by arrays
    arrays = {n: np.load(f"{folder}/d/{'deep/' if n == 'c' else ''}{n}.npz")["descriptor_map"].astype(float) for n in "abce"}
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    every = unit(np.concatenate([a.reshape(-1, 8) for a in arrays.values()]))
    basis = np.linalg.eigh((every - every.mean(0)).T @ (every - every.mean(0)))[1][:, :-3:-1]
    feature = {}
    for n, a in arrays.items():
        xy = np.load(f"{folder}/k/{n}.npz")["keypoints"].astype(float)
        g = (xy + 0.5) / 8 - 0.5
        inside = ((g >= 0) & (g <= [3, 2])).all(1)
        at = np.floor(g).astype(int)
        d = g - at
        pick = lambda i, j, a=a, at=at: a[np.minimum(at[:, 1] + j, 2).clip(0), np.minimum(at[:, 0] + i, 3).clip(0)]
        v = sum((((d[:, 0] if i else 1 - d[:, 0]) * (d[:, 1] if j else 1 - d[:, 1]))[:, None] * pick(i, j)) for i in (0, 1) for j in (0, 1))
        v = unit(v)
        feature[n] = np.flatnonzero(inside), unit(v - v @ basis @ basis.T)[inside]
    want = set()
    for pair, a, b in ((1, "a", "b"), (2, "c", "e")):
        (ia, va), (ib, vb) = feature[a], feature[b]
        s = va @ vb.T
        lr, rl = np.argsort(np.argsort(-s, 1), 1) + 1, np.argsort(np.argsort(-s, 0), 0) + 1
        want |= {(pair, int(ia[i]), int(ib[j]), int(max(lr[i, j], rl[i, j]))) for i, j in zip(*np.nonzero((lr <= 2) & (rl <= 2)), strict=True)}
    assert got == want
    assert run(k=2, rank=2)[1].made == []
    assert run(k=1, rank=2)[1].made == ["edges"]
    assert run(k=2, rank=3)[1].made == ["bases", "cleaned", "edges"]
    os.remove(next(str(p) for p in (tmp_path / "run").glob("sampled-*/_SUCCESS")))  # a run that broke in this stage
    assert run(k=2, rank=2)[1].made == ["sampled"]


# ---------------------------------------------------------------- shards
SHARD = "pair_idx long, error double, bin string, layer int"


def some_shards(spark, value: float = 0.0):
    return spark.range(240).select(F.col("id").alias("pair_idx"), (F.col("id") * 0.5 + value).alias("error"), F.concat(F.lit("b"), F.col("id") % 3).alias("bin"), (F.col("id") % 4).cast("int").alias("layer"))


def stamps(path) -> dict:
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_broken_shards_are_written_again(spark, tmp_path):
    path = str(tmp_path / "shards")
    expected = some_shards(spark).select("bin", "layer").distinct()
    calls = []

    def make(cells):
        calls.append(sorted(map(tuple, cells.collect())))
        return some_shards(spark).join(cells, ["bin", "layer"], "left_semi")

    shards.write(some_shards(spark), path)
    assert shards.broken(spark, path, SHARD, expected).isEmpty() and shards.repair(spark, path, SHARD, expected, make) == [] and not calls
    cell = lambda b, n: f"{path}/cells/bin={b}/layer={n}"
    torn = next(f for f in stamps(cell("b1", 2)))
    os.truncate(torn, 40)  # one file is torn
    os.remove(os.path.join(os.path.dirname(torn), f".{os.path.basename(torn)}.crc"))
    for f in stamps(cell("b2", 0)):
        os.remove(f)  # one cell is gone
    some_shards(spark, 1.0).filter("bin = 'b0' AND layer = 3").select("pair_idx", "error").write.mode("overwrite").parquet(cell("b0", 3))  # one holds other numbers
    before = stamps(f"{path}/cells")
    assert shards.repair(spark, path, SHARD, expected, make) == [("b0", 3, "differs from the manifest"), ("b1", 2, shards_reason(spark, path, before)), ("b2", 0, "missing")]
    assert calls == [[("b0", 3), ("b1", 2), ("b2", 0)]]
    after = stamps(f"{path}/cells")
    kept = {f for f in before if not any(x in f for x in (cell("b0", 3), cell("b1", 2), cell("b2", 0)))}
    assert kept and all(after[f] == before[f] for f in kept)
    assert sorted(map(tuple, spark.read.schema(SHARD).parquet(f"{path}/cells").collect())) == sorted(map(tuple, some_shards(spark).collect()))


def shards_reason(spark, path, before) -> str:
    """A torn file leaves its cell empty if it was the only one."""
    return "missing" if sum("bin=b1/layer=2" in f for f in before) == 1 else "differs from the manifest"


def test_rules_find_cells_that_agree_with_their_manifest(spark, tmp_path):
    path = str(tmp_path / "shards")
    wrong = some_shards(spark).withColumn("error", F.when(F.col("pair_idx") == 7, -1.0).otherwise(F.col("error")))
    shards.write(wrong, path)
    expected = some_shards(spark).select("bin", "layer").distinct()
    make = lambda cells: some_shards(spark).join(cells, ["bin", "layer"], "left_semi")
    assert shards.repair(spark, path, SHARD, expected, make, rules=lambda s: s.filter("error < 0")) == [("b1", 3, "breaks a rule")]
    with pytest.raises(shards.Damaged, match="after the repair"):
        shards.repair(spark, path, SHARD, expected.unionByName(spark.createDataFrame([("b9", 1)], "bin string, layer int")), make)
