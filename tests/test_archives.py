"""Archives, preparation of datasets, provenance."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.sources import archives, datasets, readers


def save(path, **arrays):
    with open(path, "wb") as f:
        np.savez(f, **arrays)


def test_descriptor_archives(spark, tmp_path):
    v = np.arange(4 * 5 * 2, dtype=np.float32).reshape(4, 5, 2)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    save(tmp_path / "in" / "a.npz", descriptor_map=v, schema_version=2, patch_size=14, proc_hw=[42, 56], orig_hw=[100, 200], model_name="m")
    save(tmp_path / "in" / "deep" / "old.NPZ", descriptor_map=v)
    save(tmp_path / "in" / "small.npz", descriptor_map=v, schema_version=2, patch_size=14, proc_hw=[420, 56])
    save(tmp_path / "in" / "new.npz", descriptor_map=v, schema_version=9)
    (tmp_path / "in" / "torn.npz").write_bytes(b"no archive")
    (tmp_path / "in" / "note.txt").write_text("x")
    rows = archives.descriptors(spark, str(tmp_path / "in"), 16).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    a = sorted(by["a.npz"], key=lambda r: r.patch_idx)
    assert [(r.gy, r.gx) for r in a] == [(y, x) for y in range(3) for x in range(4)] and all(r.v == v[r.gy, r.gx].tolist() for r in a)
    assert (a[0].orig_h, a[0].orig_w, a[0].legacy, a[0].meta["model_name"]) == (100, 200, False, "m")
    assert len(by["old.NPZ"]) == 20 and by["old.NPZ"][0].legacy and by["old.NPZ"][0].proc_h == 64
    assert "needs a grid" in by["small.npz"][0].problem and "version 9" in by["new.npz"][0].problem and by["torn.npz"][0].problem and set(by) == {"a.npz", "old.NPZ", "small.npz", "new.npz", "torn.npz"}
    back = archives.write_archives(archives.descriptors(spark, str(tmp_path / "in")).filter("path LIKE '%a.npz'"), "path", {"descriptor_map": "v", "patch": "patch_idx"}, "patch_idx").first()
    again = np.load(io.BytesIO(back.content))
    assert (again["descriptor_map"].reshape(3, 4, 2) == v[:3, :4]).all() and again["patch"].tolist() == list(range(12))


def test_keypoint_archives(spark, tmp_path):
    xy = np.array([[1, 2], [3, 4.5]], np.float32)
    (tmp_path / "k").mkdir()
    save(tmp_path / "k" / "a.npz", keypoints=xy, scores=np.array([0.5, 1.0]), descriptors=np.ones((2, 3)), schema_version=1, long_edge=1024)
    save(tmp_path / "k" / "none.npz", keypoints=np.zeros((0, 2)))
    save(tmp_path / "k" / "bad.npz", keypoints=xy, scores=np.zeros(3))
    got = {}
    for r in archives.keypoints(spark, str(tmp_path / "k")).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert [(r.kp_idx, r.x, r.y, r.score, r.v) for r in got["a.npz"]] == [(0, 1.0, 2.0, 0.5, [1.0] * 3), (1, 3.0, 4.5, 1.0, [1.0] * 3)] and got["a.npz"][0].meta["long_edge"] == "1024"
    assert got["none.npz"][0].kp_idx is None and got["none.npz"][0].legacy and "scores" in got["bad.npz"][0].problem
    images = [(f"{n}.{s}", b"x" * (i + 1)) for i, (n, s) in enumerate([("a", "JPG"), ("b", "png"), ("c", "txt")])]
    for name, data in images:
        (tmp_path / "k" / name).write_bytes(data)
    assert {r.path.rsplit("/", 1)[1] for r in archives.images(spark, str(tmp_path / "k")).collect()} == {"a.JPG", "b.png"}
    import hashlib

    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in archives.content_ids(spark, str(tmp_path / "k"), [".txt"]).collect()} == {"c.txt": hashlib.sha256(b"xxx").hexdigest()}


def test_cache_policy(spark):
    cached = spark.createDataFrame([("fresh", False, {"m": "1", "n": "2"}), ("old", True, {}), ("stale", False, {"m": "0", "n": "2"}), ("short", False, {"m": "1"})], "image string, legacy boolean, meta map<string,string>")
    wanted = spark.createDataFrame([(x,) for x in ("fresh", "old", "stale", "short", "new")], "image string")
    act = lambda missing=False, **k: {r.image: r.action for r in archives.cache_policy(wanted, cached, "image", archives.stale(F.col("meta"), {"m": "1", "n": "2"}, missing), **k).collect()}
    assert act() == {"fresh": "hit", "old": "compute", "stale": "compute", "short": "compute", "new": "compute"}
    assert act(True, allow_legacy=True, compute=False) == {"fresh": "hit", "old": "legacy", "stale": "fail", "short": "hit", "new": "fail"}


SHARD = "pair_idx long, layer int, rank int, direction string, source long, target long, cosine double, cand_rank int, entry_k int, is_object boolean, has_depth boolean, error double"


def test_shard_problems(spark):
    inf = float("inf")
    sound = [(1, 1, 0, "a_to_b", 0, 0, 0.9, 1, 1, True, True, 0.5), (1, 1, 0, "a_to_b", 0, 1, 0.8, 2, 3, False, False, inf), (1, 1, 0, "b_to_a", 0, 0, 0.9, 1, 1, True, True, 0.4), (1, 1, 0, "b_to_a", 0, 1, 0.1, 2, 2, False, True, 0.7)]
    minimum = spark.createDataFrame([(1, "a_to_b", 0, 0.5), (1, "b_to_a", 0, 0.1)], "pair_idx long, direction string, source long, min_error double")
    counts = spark.createDataFrame([(1, 1, 0, 1, 1), (1, 1, 0, 2, 2)], "pair_idx long, layer int, rank int, k int, matches long")
    complete = spark.createDataFrame([(i, p) for i in "ab" for p in range(4)], "image string, patch_idx long")
    objects, ends = complete.filter("patch_idx = 0"), spark.createDataFrame([(1, "a_to_b", "a", "b"), (1, "b_to_a", "b", "a")], "pair_idx long, direction string, source_image string, target_image string")

    def check(rows, c=counts):
        return {r.check for r in archives.shard_problems(spark.createDataFrame(rows, SHARD), minimum, c, complete, objects, ends, 2).collect()}

    swap = lambda i, **new: [r if k != i else tuple(new.get(n.split()[0], x) for n, x in zip(SHARD.split(", "), r, strict=True)) for k, r in enumerate(sound)]
    assert check(sound) == set()
    assert check(swap(0, source=9, cand_rank=1)) >= {"source touches padding", "source outside the object"}
    assert check(swap(1, target=9)) == {"target touches padding"} and check(swap(1, is_object=True)) == {"object flag disagrees"}
    assert check(swap(1, cosine=0.95)) == {"cosine out of range or rising"} and check(swap(0, cosine=float("nan"))) >= {"cosine out of range or rising"}
    assert check(swap(0, error=-1.0)) >= {"error is not a distance"} and check(swap(1, has_depth=True)) == {"depth flag disagrees with the error"}
    assert check(swap(1, entry_k=4)) == {"entry out of range"} and check(swap(1, entry_k=1)) == {"entry before the rank"}
    assert check(swap(0, error=0.2)) == {"minimum above a candidate"} and check(swap(1, target=0)) >= {"target twice"} and check(sound[:3]) == {"ranks incomplete"}
    many = spark.createDataFrame([(1, 1, 0, 1, 9), (1, 1, 0, 2, 3)], counts.schema)
    assert check(sound, many) == {"matches not cumulative", "more matches than the graph can hold"}


def test_rank_shards_are_a_rectangle(spark, tmp_path):
    rows = spark.createDataFrame([(p, b, n, 0.5) for p in (1, 2) for b in ("x", "y") for n in (3, 4) if (p, b, n) != (2, "y", 4)] + [(9, "x", 3, 0.5)], "pair_idx long, bin string, layer int, error double")
    readers.write_rank_shards(rows, str(tmp_path / "s"))
    pairs = spark.createDataFrame([(1,), (2,)], "pair_idx long")
    shards, problems = archives.read_rank_shards(spark, str(tmp_path / "s"), "pair_idx long, error double, bin string, layer int", ["x", "y"], [3, 4], pairs)
    assert shards.count() == 8 and {tuple(r) for r in problems.collect()} == {("y", 4, 2, "missing"), ("x", 3, 9, "unexpected")}


def matrix_line(a, b, r, t):
    k = [500, 0, 320, 0, 510, 240, 0, 0, 1]
    m = [*r[0], t[0], *r[1], t[1], *r[2], t[2], 0, 0, 0, 1]
    return " ".join(map(str, [a, b, 0, 0, *k, *k, *m]))


def test_pairs_with_poses_and_their_preparation(spark, tmp_path):
    r, t = [[0, -1, 0], [1, 0, 0], [0, 0, 1]], [1, 2, 3]
    (tmp_path / "p.txt").write_text("# comment\n\n" + matrix_line("o/a", "o/b", r, t) + "\n" + matrix_line("o/c", "o/d", r, t) + "\nshort line\n" + matrix_line("x", "y", [["q", 0, 0], r[1], r[2]], t) + "\n")
    read = datasets.pairs_with_poses(spark, str(tmp_path / "p.txt"))
    assert sorted((x.image_1, x.problem) for x in read.collect() if x.problem) == [("short", "fields: 2"), ("x", "not a number")]
    turned = datasets.pairs_with_poses(spark, str(tmp_path / "p.txt"), invert=True).filter("image_1 = 'o/a'").first()
    assert turned.rotation == [0, 1, 0, -1, 0, 0, 0, 0, 1] and turned.translation == [-2, 1, -3]
    sizes = spark.createDataFrame([(f"o/{i}", 480, 640) for i in "abc"] + [("o/d", 960, 1280)], "image string, height int, width int")
    sized = datasets.with_sizes(read.filter("problem IS NULL"), sizes, sizes.withColumn("height", F.when(F.col("image") == "o/c", 1).otherwise(F.col("height"))))
    assert {x.image_1: x.problem for x in sized.collect()} == {"o/a": None, "o/c": "size differs from the annotation"}
    rows = datasets.pose_rows(datasets.with_sizes(read.filter("problem IS NULL"), sizes), ["line"], 320).orderBy("pair_idx").collect()
    assert [x.pair_idx for x in rows] == [1, 2] and (rows[0].fx1, rows[0].cy1, rows[1].fx2, rows[1].cy2) == (250.0, 120.0, 125.0, 60.0)
    assert np.allclose([rows[0].qw, rows[0].qx, rows[0].qy, rows[0].qz], [0.5**0.5, 0, 0, 0.5**0.5]) and [rows[0].tx, rows[0].ty, rows[0].tz] == t
    assert [x.t for x in spark.createDataFrame([(-0.0,), (2.0,), (0.1,)], "x double").select(datasets.number_text(F.col("x")).alias("t")).collect()] == ["0", "2", "0.1"]


def test_subsets_are_prepared_stored_and_validated(spark, tmp_path):
    row = lambda i, w=1.0: (i, f"a{i}", f"b{i}", 4, 5, 4, 5, *[1.0] * 8, w, *[0.0] * 3, *[1.0] * 3)
    schema = "pair_idx long, image_1 string, image_2 string, image_1_height int, image_1_width int, image_2_height int, image_2_width int, " + ", ".join(f"{c} double" for c in datasets.POSE)
    make = lambda *rows: lambda s: s.createDataFrame(list(rows), schema)
    prepared = datasets.prepare(spark, {"one": make(row(1), row(2)), "two": make(row(1))})
    manifest = datasets.materialise(prepared, str(tmp_path / "out"))
    assert {r.subset: (r.pairs, r.poses) for r in manifest.collect()} == {"one": (2, 2), "two": (1, 1)}
    datasets.materialise(prepared, str(tmp_path / "out"), "validate")
    with pytest.raises(Exception, match="exists"):
        datasets.materialise(prepared, str(tmp_path / "out"))
    with pytest.raises(datasets.Mismatch):
        datasets.materialise(datasets.prepare(spark, {"one": make(row(1), row(2, 0.5)), "two": make(row(1))}), str(tmp_path / "out"), "validate")
    with pytest.raises(datasets.Mismatch):
        datasets.materialise(datasets.prepare(spark, {"one": make(row(1, float("nan")))}), str(tmp_path / "other"))
    (tmp_path / "src.txt").write_text("x")
    ids = archives.content_ids(spark, str(tmp_path / "src.txt"))
    digest = ids.first().sha256
    assert datasets.prepare(spark, {"one": make(row(1))}, ids, {"src.txt": digest}).count() == 1
    with pytest.raises(datasets.Mismatch):
        datasets.prepare(spark, {"one": make(row(1))}, ids, {"src.txt": "0"})


def test_scene_indexes(spark):
    pose = np.stack([np.eye(4), np.eye(4)])
    pose[1, :3, 3] = [1, 2, 3]
    out = io.BytesIO()
    np.savez(out, image_paths=np.array([["a", "x"], ["y", "b"]]), intrinsics=np.ones((2, 2, 3, 3)), distortion_coefs=np.zeros((2, 2, 4)), poses=pose, pair_infos=[[0, 1]])
    contents = spark.createDataFrame([("s_1.npz", out.getvalue()), ("bad.npz", b"1")], "path string, content binary")
    got = {r.scene: r for r in datasets.scene_indexes(contents).collect()}
    assert (got["s_1.npz"].image_1, got["s_1.npz"].image_2, got["s_1.npz"].translation, got["s_1.npz"].distortion2) == ("a", "b", [1, 2, 3], [0.0] * 4) and got["bad.npz"].problem


def test_annotations_are_unique(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"filename": "x.jpg", "n": 1}, {"filename": "y.jpg", "n": 2}]))
    assert {r.filename: r.n for r in datasets.annotations(spark, str(tmp_path / "a.json"), "filename string, n int").collect()} == {"x.jpg": 1, "y.jpg": 2}
    (tmp_path / "b.json").write_text(json.dumps([{"filename": "x.jpg", "n": 1}, {"filename": "x.jpg", "n": 2}]))
    with pytest.raises(Exception, match="annotated twice"):
        datasets.annotations(spark, str(tmp_path / "b.json"), "filename string, n int").collect()


def test_manifests_bind_poses_and_associations(spark):
    schema = "pair_file_sha256 string, pair_identity_sha256 string, pair_count long"
    m = lambda *x: spark.createDataFrame([x], schema)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "pair_idx long")
    check = lambda *x: {(r.problem, r.detail) for r in datasets.bound(*x).collect()}
    assert check(m("a", "b", 2), m("a", "b", 2), ids(1, 2), ids(1, 2, 2)) == set()
    assert check(m("a", "b", 2), m("c", "b", 3), ids(1, 2), ids(1, 3)) == {("pair_file_sha256 differs", "a / c"), ("pair_count differs", "2 / 3"), ("association files", "3 / 2"), ("pair without associations", "2"), ("pair without a pose", "3")}
    assert check(m("a", "b", 2).limit(0), m("a", "b", 2), ids(1), ids(1)) == {("manifest missing", "pose")}


def test_schema_guard_layers_and_sizes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0)], "pair_idx long, x double")
    assert readers.append_new(rows, str(tmp_path / "t"), ["pair_idx"]) == 1 and readers.append_new(rows, str(tmp_path / "t"), ["pair_idx"]) == 0
    with pytest.raises(datasets.Mismatch):
        readers.append_new(spark.createDataFrame([(5, "a")], "pair_idx long, y string"), str(tmp_path / "t"), ["pair_idx"])
    with pytest.raises(Exception, match="layer out of range: 13"):
        datasets.zero_based(spark.createDataFrame([(1,), (13,)], "layer int"), 12).collect()
    with pytest.raises(Exception, match="two sizes"):
        datasets.padded_sizes(spark.createDataFrame([("a", 1, 2), ("a", 1, 3)], "image string, height int, width int"), 100, 14).collect()
    readers.write_long_table(rows, str(tmp_path / "z"))
    assert any(p.name.endswith(".csv.gz") for p in (tmp_path / "z").iterdir())
    order = [tuple(r) for r in datasets.task_order(spark.createDataFrame([(1, "a", "s", 0), (5, "b", "s", 1), (5, "b", "s", 0)], "k int, dataset string, subset string, seed int")).collect()]
    assert order == [(5, "b", "s", 0), (5, "b", "s", 1), (1, "a", "s", 0)]
    cost = datasets.cost_order(spark.createDataFrame([(1, 2, 3, 4, 5), (2, 9, 9, 9, 9)], "pair_idx long, height_1 int, width_1 int, height_2 int, width_2 int")).collect()
    assert [(r.pair_idx, r.cost) for r in cost] == [(2, 162), (1, 26)]


def test_bases_of_vectors(spark):
    """The fitted directions span what the singular vectors of all rows together span."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 6)) * [5, 3, 1, 1, 1, 1] + 1
    df = spark.createDataFrame([(1, 2, 3, x.tolist()) for x in v] + [(2, 2, 3, x.tolist()) for x in v[:50]], "layer int, height int, width int, v array<double>")
    got = datasets.fit_bases(df, 2)
    u = np.array([r.u for r in got.filter("layer = 1").orderBy("comp").collect()]).T
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s, w = np.linalg.svd(unit - unit.mean(0))[1:]
    assert np.allclose(u @ u.T, w[:2].T @ w[:2], atol=1e-9) and np.allclose([r.strength for r in got.filter("layer = 1").orderBy("comp").collect()], s[:2])
    again = datasets.fit_missing(df, got.filter("layer = 1").withColumn("strength", F.lit(-1.0)), 2)
    assert {(r.layer, r.comp): r.strength < 0 for r in again.collect()} == {(1, 0): True, (1, 1): True, (2, 0): False, (2, 1): False}


def test_match_stage(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((8, 4))
    vectors = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(v)] + [("b", i, (x + 0.01).tolist()) for i, x in enumerate(v[::-1])], "image string, idx long, v array<double>")
    pairs = spark.createDataFrame([(7, "a", "b")], "pair_idx long, image_1 string, image_2 string")
    bases = datasets.fit_bases(vectors.selectExpr("1 AS layer", "1 AS height", "1 AS width", "v"), 1)
    for b in (None, bases):
        edges = {(r.left_idx, r.right_idx) for r in datasets.match_stage(spark, pairs, vectors, b, 1).collect()}
        assert edges >= {(i, 7 - i) for i in range(8)} if b is None else len(edges & {(i, 7 - i) for i in range(8)}) >= 7


def test_association_files_are_audited_and_quarantined(spark, tmp_path):
    (tmp_path / "m").mkdir()
    head = "left_idx,right_idx,x1,y1,x2,y2,similarity,k\n"
    (tmp_path / "m" / "matching_001.csv").write_text(head + "0,1,1,1,1,1,0.5,1\n0,2,1,1,1,1,0.5,1\n")
    (tmp_path / "m" / "matching_002.csv").write_text(head + "0,1,1,1,1,1,0.5,1\n0,1,1,1,1,1,0.5,1\n-1,2,1,1,1,1,0.5,1\n")
    rows = readers.associations(spark, str(tmp_path / "m"))
    assert {r.pair_idx: (r.rows, r.edges, r.invalid, r.valid) for r in readers.association_audit(rows).collect()} == {1: (2, 2, 0, True), 2: (3, 1, 1, False)}
    fine, broken = readers.quarantine(rows)
    assert {r.pair_idx for r in fine.collect()} == {1} and [(r.pair_idx, r.reason, r.rows) for r in broken.collect()] == [(2, "negative id", 1)]


def test_pose_files_are_checked(spark, tmp_path):
    names = "pair_idx,f1,f2,cx1,cy1,cx2,cy2,qw,qx,qy,qz,tx,ty,tz,distortion1,distortion2"
    line = lambda i, d="", f="500": f'{i},{f},500,1,1,1,1,1,0,0,0,1,0,0,"{d}",""'
    (tmp_path / "p.csv").write_text("\n".join([names, line(1), line(2, "[1, 2, 3, 4]"), line(3, "[1, 2]"), line(4), line(4), line("x"), line(5, "", "")]) + "\n")
    got = {}
    for r in readers.poses(spark, str(tmp_path / "p.csv")).collect():
        got.setdefault(r.pair_idx, set()).add(r.problem)
    assert got == {1: {None}, 2: {None}, 3: {"distortion"}, 4: {"id twice"}, None: {"no id"}, 5: {"missing fx1, fy1"}}
