"""Scans, sinks, resuming and the registered queries' SQL."""

import json
import math

import pytest

import __spark_entry__
from matchweave import plans
from matchweave.sources import readers
from matchweave.streaming.resume import process_new


def write(path, text):
    path.write_text(text)
    return str(path)


def test_pair_list(spark, tmp_path):
    plain = write(tmp_path / "a.txt", "# comment\nimage_1 image_2\nx/1.jpg x/2.jpg\n\nx/3.jpg\tx/4.jpg\n")
    assert [tuple(r) for r in readers.pair_list(spark, plain).collect()] == [(0, "x/1.jpg", "x/2.jpg"), (1, "x/3.jpg", "x/4.jpg")]
    numbered = write(tmp_path / "b.csv", "pair_index,image_1,image_2\n7, a, b\n3,c,d\n")
    assert [tuple(r) for r in readers.pair_list(spark, numbered).collect()] == [(3, "c", "d"), (7, "a", "b")]
    assert [r.pair_idx for r in readers.pair_list(spark, numbered, most=1).collect()] == [7]


def test_associations_mark_only_bad_rows(spark, tmp_path):
    head = "left_idx,right_idx,x1,y1,x2,y2,similarity,k\n"
    write(tmp_path / "matching_001.csv", head + "0,1,1,2,3,4,0.5,1\n")
    write(tmp_path / "matching_002.csv", "idx1,idx2,x1,y1,x2,y2,score,k_first\n0,1,1,2,3,4,0.5,1\n0,x,1,2,3,4,0.5,1\n0,1,1,2,3,4,0.5\n-1,1,1,2,3,4,0.5,1\n0,1,1,2,nan,4,0.5,1\n0,1,1,2,3,4,0.5,0\n")
    write(tmp_path / "matching_003.csv", head)
    rows = readers.associations(spark, str(tmp_path)).collect()
    assert {r.pair_idx for r in rows} == {1, 2}
    assert [(r.left_idx, r.similarity, r.k, r.bad) for r in rows if r.pair_idx == 1] == [(0, 0.5, 1, None)]
    assert [r.bad for r in sorted((r for r in rows if r.pair_idx == 2), key=lambda r: r.line)] == [None, "invalid right_idx", "wrong number of fields", "negative id", "invalid x2", "k below 1"]


def test_poses(spark, tmp_path):
    full = write(tmp_path / "p.csv", 'pair_idx,qw,qx,qy,qz,tx,ty,tz,fx1,fy1,cx1,cy1,fx2,fy2,cx2,cy2,distortion1\n1,1,0,0,0,1,0,0,800,801,320,240,800,800,320,240,"[0.1, 0.2, 0, 0]"\n')
    r = readers.poses(spark, full).first()
    assert (r.pair_idx, r.fy1, r.distortion1, r.distortion2) == (1, 801.0, [0.1, 0.2, 0.0, 0.0], [])
    short = write(tmp_path / "q.csv", "pair_idx,qw,qx,qy,qz,tx,ty,tz,f1,cx1,cy1,f2,cx2,cy2\n1,1,0,0,0,1,0,0,800,320,240,700,320,240\n")
    r = readers.poses(spark, short).first()
    assert (r.fx1, r.fy1, r.fx2) == (800.0, 800.0, 700.0)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, math.nan), (2, math.inf), (3, 0.5)], "i int, v double")
    assert [json.loads(r.json) for r in readers.strict_json(rows).collect()] == [{"i": 1, "v": None}, {"i": 2, "v": None}, {"i": 3, "v": 0.5}]
    out = str(tmp_path / "out")
    assert readers.append_new(rows, out, ["i"]) == 3 and readers.append_new(rows.union(spark.createDataFrame([(4, 1.0)], rows.schema)), out, ["i"]) == 1
    assert sorted(r.i for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
    shards = spark.createDataFrame([("easy", 3, 1), ("hard", 3, 2)], "bin string, layer int, v int")
    readers.write_rank_shards(shards, str(tmp_path / "shards"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "shards")).filter("bin = 'hard'").collect()] == [2]
    edges = spark.createDataFrame([(1, 0, 0, 0.5, 1), (2, 1, 1, 0.5, 1)], "pair_idx int, left_idx int, right_idx int, similarity double, k int")
    readers.write_associations(edges, str(tmp_path / "edges"))
    assert spark.read.option("header", True).csv(str(tmp_path / "edges")).count() == 2


def test_resumed_stream(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "pair_idx long").write.mode("append").parquet(source)
    run = lambda: process_new(spark, source, "pair_idx long", lambda d: d.selectExpr("pair_idx", "pair_idx * 2 AS twice"), sink, mark, ["pair_idx"]).awaitTermination()
    batch(1, 2)
    run()
    batch(2, 3)
    run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(plans.SQL) >= 60 and set(plans.QUERIES) <= set(__spark_entry__.queries())


def values(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = plans.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = con.sql(plans.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert values(map(tuple, got.select(*columns).collect())) == values(tuple(r[i] for i in at) for r in want.fetchall())
