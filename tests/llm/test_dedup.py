"""Operators 3, 4 and 5 and the components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.llm import embed_dedup, minhash, substring
from matchweave.llm.components import connected
from tests.llm.conftest import prose
from tests.llm.test_tokens import colliding

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark, space):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, 5)]
    found = {r.id: r.component for r in connected(space, spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for e in links for x in e}, links)
    assert all(found.get(n, n) == c for n, c in want.items()) and set(found) <= set(want)
    assert connected(space, spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_shared_counts():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64)) for _ in range(n)] for n in (20, 30))
    minhash_columns, minhash.COLUMNS = minhash.COLUMNS, 64
    try:
        got = minhash._shared_counts(a, b)
    finally:
        minhash.COLUMNS = minhash_columns
    assert (got == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def near_texts():
    rng = random.Random(7)
    out = {}
    for base in range(30):
        words = prose(base, rng.choice([6, 30, 200])).split()
        for copy in range(rng.choice([1, 1, 2, 12])):
            w = words[:]
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 999)}"
            out[base * 100 + copy] = " ".join(w).upper() if copy % 3 == 1 else " ".join(w)
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_against_brute_force(spark, space, n):
    texts = near_texts() | {9001: None, 9002: "", 9003: "Solo", 9004: "solo", 9005: "a b"}
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(FOLD).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), space, n=n).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    assert len(links) > 30


def test_minhash_compares_components_in_blocks(spark, space, monkeypatch):
    """A chain of copies whose ends are far from each other, with blocks of three documents."""
    rng = random.Random(11)
    words = prose(5, 120).split()
    texts = []
    for i in range(40):
        for _ in range(3):
            words[rng.randrange(len(words))] = f"e{i}-{rng.random()}"
        texts.append((i, " ".join(words)))
    rng.shuffle(texts)
    texts = [(k, t) for k, (_, t) in enumerate(texts)]
    for size, few in ((3, 1), (3, 6), (256, 32)):
        monkeypatch.setattr(minhash, "BLOCK", size)
        monkeypatch.setattr(minhash, "FEW", few)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), space, n=2).collect()}
        sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in texts}
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        assert got == roots(sets, links)


def test_minhash_rows_of_a_hot_key(spark, space, monkeypatch):
    """A key whose members are alike but not near: pairs stay inside the tasks, rows grow with the members and the blocks."""
    rng = random.Random(5)
    common, n = prose(70, 200).split(), 60
    texts = []
    for i in range(n):
        w = common[:]
        for k in range(0, 200, 9):
            w[k] = f"own{i}x{rng.random()}"
        texts.append((i, " ".join(w)))
    texts += [(100, texts[0][1] + " end"), (101, texts[59][1].replace("own59", "else", 1))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(minhash, "FEW", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    written, table = {}, space.table
    monkeypatch.setattr(space, "table", lambda d, name: written.setdefault(name, table(d, name)))
    monkeypatch.setattr(space, "clear", lambda *keep: None)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, space, n=2).collect()}
    assert got == {i: i for i in range(n)} | {100: 0, 101: 59}
    members, blocks, keys = written["sized"].agg(F.sum("n")).first()[0], written["packed"].count(), written["sized"].select("key").distinct().count()
    assert members > 100 and written["candidates"].count() <= 2 * members * -(-blocks // keys) and written["inside-links"].count() <= 2


def brute_substring(texts, size):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for w in words:
        cover = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                cover[k : k + size] = [True] * size
        out.append((len(w), sum(cover), hashlib.sha256(b" ".join(x for x, c in zip(w, cover, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("size", [4, 7, 35])
def test_substring_against_brute_force(spark, space, size):
    rng = random.Random(size)
    passages = [prose(50 + i, rng.choice([3, 8, 20, 36, 60])).split() for i in range(12)]
    texts = [None, "", " \n", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"]
    for i in range(60):
        w = prose(i, rng.choice([2, 20, 100])).split()
        for p in rng.sample(passages, 2):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        texts.append("  ".join(w) if i % 5 == 0 else "\n".join(w))
    texts += texts[10:13]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, space, size=size).collect())
    assert got == sorted((i // 2, *x) for i, x in enumerate(brute_substring(texts, size)))


def test_dedup_on_odd_documents(spark, space, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(odd_docs, space, size=35).collect())
    assert got == sorted((-1 if r.doc_id is None else r.doc_id, *x) for r, x in zip(rows, brute_substring([r.text for r in rows], 35), strict=True))
    with_text = substring.remove_repeats(odd_docs, space, with_text=True, keep=("lang", "kept")).collect()
    assert all(r.lang == "en" and r.kept is True for r in with_text) and sorted(r.kept_text for r in with_text if not r.n_removed) == sorted(t for t in (r.text or "" for r in rows) if t != rows[5].text and t not in (rows[10].text,))
    near = minhash.near_duplicates(odd_docs, space).collect()
    assert len(near) == len(rows)
    by = {}
    for r in near:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[0] == [(0, 0, True)] and by[3] == [(1, 3, True)] * 2 and by[5][0][1] == 4 and all(c is None and k for _, c, k in by[None])
    assert {c for _, c, _ in by[9]} == {7}
    assert minhash.near_duplicates(no_docs, space).count() == 0 and substring.remove_repeats(no_docs, space).count() == 0


def test_embeddings_against_brute_force(spark, space):
    rng = np.random.default_rng(4)
    rows, centre = [], rng.standard_normal((40, 16))
    for i in range(900):
        c = centre[0] if i < 120 else centre[rng.integers(1, 40)]
        rows.append((i * 3, [float(np.float32(x)) for x in c + 0.03 * rng.standard_normal(16) * (i % 4)], int(i % 3) if i >= 120 else 0))
    rows += [(5001, None, 0), (5002, [0.0] * 16, 0), (5003, [float("nan")] * 16, 0), (5004, [1.0] + [None] * 15, 0), (5005, rows[0][1], None), (5006, [], 0), (5007, [float("inf")] * 16, 0), (None, rows[0][1], 0), (5008, [1.0, 2.0], 0), (5009, [2.0, 4.0], 0), (5010, [1e-30] * 16, 1), (5011, [1e-30] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "'x' AS v", "2 AS w")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, space).collect()}
    fine = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, (i, x, l) in enumerate(fine):
        for j, y, m in fine[a + 1 :]:
            if l == m and len(x) == len(y):
                p, q = x / abs(x).max(), y / abs(y).max()
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
                    links.append((i, j))
    ids = [i for i, _, _ in rows]
    want, count = roots([i for i in ids if i is not None], links), Counter(x for e in links for x in e)
    found = sum(v[0] for v in got.values())
    assert found >= 0.99 * 2 * len(links) and all(got[i][0] <= count[i] for i in want)
    assert {i: (count[i], want[i], want[i] == i) for i in want} == {i: got[i] for i in want}
    assert got[None] == (0, None, True)
    assert embed_dedup.near_duplicates(df.limit(0), space).count() == 0


def test_recall_of_the_graph_without_dense_counting(spark, space):
    """Random vectors with planted pairs only: what is found is found by the graph."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 24))
    rows = [(i, base[i].astype(np.float32).tolist(), 0) for i in range(1500)] + [(5000 + i, (base[i] + 0.05 * rng.standard_normal(24)).astype(np.float32).tolist(), 0) for i in range(300)]
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), space).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = {r[0]: int(n) - 1 for r, n in zip(rows, ((x @ x.T) >= 0.98).sum(1), strict=True)}
    assert sum(true.values()) > 400 and sum(got.values()) >= 0.98 * sum(true.values()) and all(got[i] <= true[i] for i in true)


def test_links_between_versions_whose_lists_are_full(spark, space):
    """Eight tight versions of one vector, each with more copies than the longest list: all pairs link, so there is one component."""
    rng = np.random.default_rng(21)
    base = rng.standard_normal(64)
    versions = [base + 0.05 * rng.standard_normal(64) for _ in range(8)]
    rows = [(i, (versions[i % 8] + 0.002 * rng.standard_normal(64)).astype(np.float32).tolist(), 0) for i in range(480)]
    rows += [(1000 + i, (rng.standard_normal(64)).astype(np.float32).tolist(), 0) for i in range(300)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), space).collect()}
    assert got == {i: (479, 0, i == 0) if i < 480 else (0, i, True) for i, _, _ in rows}


@pytest.mark.parametrize("groups", [2, 5])
def test_links_between_neighbouring_dense_groups(spark, space, groups):
    """Tight groups whose centres are neighbours (cosine 0.985), each larger than the longest list, beside random vectors."""
    rng = np.random.default_rng(groups)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    centres = [centre]
    for _ in range(groups - 1):
        side = rng.standard_normal(64)
        side -= side @ centre * centre
        centres.append(0.985 * centre + (1 - 0.985**2) ** 0.5 * side / np.linalg.norm(side))
    rows = [(200 * g + i, (c + 0.002 * rng.standard_normal(64)).astype(np.float32).tolist(), 0) for g, c in enumerate(centres) for i in range(200)]
    rows += [(5000 + i, rng.standard_normal(64).astype(np.float32).tolist(), 0) for i in range(200)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), space).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    ids = [i for i, _, _ in rows]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    want = roots(ids, links)
    assert got == {i: (int(n) - 1, want[i]) for i, n in zip(ids, near.sum(1), strict=True)} and len({want[i] for i in ids[: 200 * groups]}) == 1


def test_recall_in_a_large_label_beside_many_small_ones(spark, space):
    """Planted pairs in one label; the mean size of a label is small."""
    rng = np.random.default_rng(31)
    base = rng.standard_normal((8000, 64))
    x = np.concatenate((base, base[:2000] + 0.05 * rng.standard_normal((2000, 64)))).astype(np.float32)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())] + [(20000 + i, base[i].tolist(), 1 + i) for i in range(300)]
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), space).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {i: int(n) - 1 for i, n in enumerate((unit @ unit.T >= 0.98).sum(1))}
    found = sum(got[i] for i in true)
    assert sum(true.values()) >= 4000 and found >= 0.98 * sum(true.values()), (found, sum(true.values()))
    assert all(got[20000 + i] == 0 for i in range(300))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_collide_in_polynomial_hashes_are_different(spark, space, size):
    a, b = colliding(size)
    texts = [" ".join([x] * 3 + [f"{x}{i}" for i in range(40)]) for x in (a, b)] + [" ".join([a] * 2), " ".join([b] * 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, space, size=35).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_substring(texts, 35))] and not any(r[2] for r in got)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, space, n=2).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_each_block_sends_a_hash_once(monkeypatch):
    """However often a window occurs, a block sends one hash for it, and a bucket holds one for each block."""
    block = substring.Block(4)
    hot, rare = np.full(5000, 77, np.uint64), np.arange(10, dtype=np.uint64)
    block.add((1, 1), np.concatenate((hot, rare)), np.concatenate((hot, rare)))
    block.add((2, 2), rare + np.uint64(100), rare + np.uint64(100))
    rows = list(block.rows(9))
    sent = [substring._sent(memoryview(data)) for kind, _, _, data in rows if kind == 1]
    assert sum(len(h) for h, _ in sent) == 21 and sum(t.sum() for _, t in sent) == 1
    import pyarrow as pa

    table = lambda rows: pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "block": [r[1] for r in rows], "bucket": pa.array([r[2] for r in rows], pa.int32()), "data": pa.array([r[3] for r in rows], pa.binary())})
    said = [r for b in range(4) if (mine := [r for r in rows if r[0] == 1 and r[2] == b]) for r in map(tuple, (x.values() for x in substring._repeated(table(mine)).to_pylist()))]
    found = substring._answers(table([*said, rows[-1]])).to_pylist()
    assert [(r["k1"], int(substring._bits(r["bits"], 5010).sum())) for r in found] == [(1, 5000)]


def test_small_dense_groups_are_compared_with_themselves_alone(spark, space):
    """Blocks are linear in the groups: 300 groups of twelve give 300 pairs of a block with itself; all links are counted."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, 24))
    vectors = np.repeat(centres, 12, 0) + 0.002 * rng.normal(size=(3600, 24))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    sizes, plain = {}, space.table

    def spy(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    space.table = spy
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), space).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    want = near.sum(1) - 1
    assert sizes["packed"] == sizes["block-pairs"] == 300 and sizes["tiles"] == 0
    assert all(r.n_links == want[r.vec_id] for r in got) and len({r.component_id for r in got}) == 300


def test_rare_links_are_audited(spark, space):
    """Where a random sample holds almost no links, vectors near a link are asked too, so the audit counts every one of them."""
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(6000, 16))
    vectors[1:121:2] = vectors[0:120:2] + 0.01 * rng.normal(size=(60, 16))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    seen = {}
    plain = embed_dedup._truth
    embed_dedup._truth = lambda *a: seen.setdefault("truth", plain(*a))
    try:
        got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, space).collect()}
    finally:
        embed_dedup._truth = plain
    assert sum(n for n, _ in seen["truth"].values()) == 120 and sum(got.values()) == 120
