"""The pipeline stage by stage, and the registered queries' shape."""

import random

import pytest

import corpus_pipeline as c
from matchweave.llm import queries
from tests.llm.conftest import prose
from tests.llm.test_texts import toxic_texts
from tests.llm.test_tokens import colliding


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    sentence = lambda s, n: ". ".join(prose(s + k, 12) for k in range(n)) + "."
    clean = [(i, sentence(i * 50, rng.choice([3, 8])), "en") for i in range(60)]
    base = sentence(9000, 8)
    near = [(100 + i, base.replace(base.split()[5 * i], "edited", 1), "en") for i in range(6)]
    exact = [(200 + i, sentence(9100, 4), "en") for i in range(3)]
    passage = prose(77, 60)
    shared = [(300 + i, sentence(9500 + 20 * i, 4) + "\n" + passage + ".", "en") for i in range(3)]
    junk = [(400, "*** ### %%% a\n" * 30, "en"), (401, "Home | A | B | C\n" * 20, "en"), (402, "few words", "en"), (403, None, None)]
    toxic = [(500 + i, t + ".", "en") for i, t, y in toxic_texts(150, 3) if y]
    also = [(900 + i, t + ".", "en") for i, t, y in toxic_texts(150, 3) if not y]
    rows = clean + near + exact + shared + junk + toxic + also
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 1) for i, _, _ in toxic] + [(i, 1, 0) for i, _, _ in also + clean], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for number, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < len(c.STAGES) - 1:
            assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if number == 3:
            texts = {r.doc_id: r.text for r in docs.collect()}
    assert not kept[0] & {400, 401, 402, 403} and set(range(60)) <= kept[0]
    assert len([i for i in kept[0] - kept[1] if 500 <= i < 900]) >= 40 and len([i for i in kept[0] - kept[1] if i < 60]) <= 2
    assert kept[2] & set(range(100, 106)) == {100} and kept[2] & {200, 201, 202} == {200}
    assert kept[3] == kept[2] and all(" ".join(prose(77, 60).split()[:40]) not in (t or "") for t in texts.values())
    assert kept[4] == kept[3]


def test_run_equals_its_stages(spark, folder, tmp_path):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (_, stage) in enumerate(c.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    out = c.run(spark, folder)
    rows = lambda d: sorted(map(tuple, d.select(*columns).collect()))
    assert rows(out) == rows(docs) and out.count() > 50 and out.select("sequence_id").distinct().count() == out.count()


def test_the_pipeline_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()


ODD = "doc_id long, text string, lang string, source string, n_chars long, extra string, kept boolean, id long, row long"


def odd_rows():
    """Repeated and null ids, repeated rows, null and empty texts, a long text, a very long word, and columns whose names the stages use."""
    text = lambda s, n=6: ". ".join(prose(s + k, 14) for k in range(n)) + "."
    rows = [(1, text(100)), (1, text(200)), (2, text(300)), (2, text(300)), (None, text(400)), (None, text(500)), (3, None), (4, ""), (5, text(5000, 400)), (6, text(700) + " " + "x" * 30000 + " end.")]
    a, b = colliding(4096)
    rows += [(7, text(800) + f" {a} end."), (8, text(900) + f" {b} end.")]
    return [(i, t, "en", "s", len(t or ""), "e", False, 9, 9) for i, t in rows]


def test_stages_on_odd_rows(spark, folder):
    docs = spark.createDataFrame(odd_rows(), ODD)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    names = lambda d: sorted(-1 if r.doc_id is None else r.doc_id for r in d.select("doc_id").collect())
    quality, toxic, near, repeated, packed = (stage(spark, docs, folder) for _, stage in c.STAGES)
    assert all(d.columns == columns for d in (quality, toxic, near, repeated))
    assert names(quality) == [-1, -1, 1, 1, 2, 2, 5, 6, 7, 8]  # nulls and empty texts have no words
    assert names(near) == [-1, -1, 1, 1, 2, 3, 4, 5, 6, 7, 8]  # of the repeated row one stays, different texts with one id all do
    assert names(repeated) == names(docs) and {r.doc_id: r.text for r in repeated.collect()}[8] == docs.filter("doc_id = 8").first().text
    assert [r.text for r in repeated.filter("doc_id = 2").collect()] == ["", ""]  # they repeat each other
    assert set(names(toxic)) <= set(names(docs)) and sorted(set(names(packed))) == sorted(set(names(docs)))


def test_survivors_follow_from_their_own_group(spark, folder):
    """Rows with null and repeated ids change nothing about which document of another group stays."""
    texts = {name: " ".join(f"{name}{i}" for i in range(60)) for name in "abc"}
    rows = [(10, texts["a"]), (1, texts["a"]), (7, texts["b"]), (30, texts["b"]), (None, texts["b"]), (5, texts["c"])]
    survivors = lambda rows: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in c.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), folder).collect())
    plain = [r for r in rows if r[0] is not None]
    assert survivors(plain) == [(1, texts["a"]), (5, texts["c"]), (7, texts["b"])]
    for order in (1, -1):
        odd = [(None, "odd " * 9), (3, "x y z"), (3, "p q r"), (None, texts["c"]), *rows]
        assert survivors(odd[::order]) == [(-1, "odd " * 9), (1, texts["a"]), (3, "p q r"), (3, "x y z"), (5, texts["c"]), (7, texts["b"])]


def test_the_quality_verdict_is_computed_once(spark, folder):
    plan = c.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("alle rechte vorbehalten") == 1


def test_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for number, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert docs.count() == 0


def test_thirteen_queries_and_their_sql():
    names = [n for n in queries.queries()]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(queries.oracle_sql()) <= set(names)
