"""Operators 1, 2, 6 and 7."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchweave.llm import chat, quality, queries, toxicity, url_filter
from tests.llm.conftest import prose


def test_cascade_is_exact():
    rng = np.random.default_rng(1)
    for n, share in ((0, 0.5), (1, 1.0), (3000, 0.01), (3000, 0.5), (3000, 0.99), (500, 0.0)):
        h1, h2 = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        listed = rng.random(n) < share
        shards = 4
        shard = h1.view(np.int64) % shards
        rows = [{"shard": s, "levels": [{"k": k, "m": m, "bits": b} for k, m, b in url_filter.build_cascade(h1[shard == s], h2[shard == s], listed[shard == s])]} for s in range(shards)]
        assert (url_filter.Cascade(shards, rows).listed(h1, h2) == listed).all()
    with pytest.raises(ValueError):
        url_filter.build_cascade(np.zeros(2, np.uint64), np.zeros(2, np.uint64), np.array([True, False]))


def judge(url, tracking):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if host in tracking else "allow"


@pytest.mark.parametrize("broadcast", [url_filter.BROADCAST, 0])
def test_urls_against_brute_force(spark, space, broadcast):
    rng = random.Random(3)
    hosts = ["Example.ORG", "a.example.org", "xexample.org", "shop.com", "com", "news.net", "ad.net", "org", "a..com", "com.", ""]
    paths = ["", "/", "/en/1", "/en/12?x=1", "/es/", "/fr/9#t", "/de/", "/fr", "?utm_source=a", "/x?utm_source=y", "/de/#://"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "://", "a://b://c/fr/"]
    pages = spark.createDataFrame([(i // 2, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string").selectExpr("*", "1 AS host", "2 AS rule")
    tracking = {judge(u, ())[0] for u in urls if u and "utm_source=" in u} - {""}
    got = url_filter.judge(pages, queries.URL_RULES, url_filter.tracking_hosts(pages), space, broadcast=broadcast).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i // 2, h, p, r or "", v) for i, (h, p, r, v) in enumerate(judge(u, tracking) for u in urls))
    assert url_filter.judge(pages.limit(0), queries.URL_RULES, url_filter.tracking_hosts(pages.limit(0)), space).count() == 0


def test_quality_against_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab c d e".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["x\n\nx\nx \ny", "a" * 50, "a b c d e f g h i j", "ä# $5 <b>&|"]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = df.collect()
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got) and quality.judge(no_docs).count() == 0


def test_lines_that_fail(spark):
    good = "This is a long and ordinary sentence that ends with a full stop."
    bad = ["Home | About | Contact | News", "All rights reserved by someone.", "*** ### $$$ %%% word", "WORD!! OTHER!! THIRD!!", "Read more"]
    other = "Another line that is quite ordinary, if somewhat longer than the first."
    fine = [other, "Short one.", "A heading of four words here", "„Zitat.“", "Was it? Yes!"]
    df = spark.createDataFrame([(0, "\n".join([good, *bad])), (1, "\n".join(fine + ["", good])), (2, "\n".join([good[:20]] + bad * 4))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df, with_text=True).collect()}
    assert got[0].clean_text == good and got[0].n_lines_failed == len(bad)
    assert got[1].clean_text == "\n".join(fine + ["", good]) and got[1].kept and got[1].n_lines_failed == 0
    assert not got[2].kept


def conversation_rows(seed: int):
    rng = random.Random(seed)
    marks = ["</s>", "[INST]", "<|turn|>", "<|end|>\n", "&lt;", "&amp;", "&#91;", "\n", "日本", "<", "&", "plain words here", "&#10;"]
    rows = []
    for c in range(40):
        turns = rng.randint(1, 25)
        for t in range(turns):
            role = "system" if t == 0 and c % 3 == 0 else ("user" if t % 2 else "assistant")
            n = rng.choice([0, 1, 5, 40, 400])
            rows.append((c, t, role, " ".join(rng.choice(marks) for _ in range(n))))
    return rows + [(90, 0, "user", None), (90, 1, "assistant", ""), (91, 0, None, "x"), (92, 5, "ro\nle", "a"), (92, 5, "ro\nle", "a"), (93, 0, "system", "alone"), (None, 0, "user", "null id"), (94, None, "assistant", "no turn")]


@pytest.mark.parametrize("budget", [64, 512])
def test_chat_round_trip(spark, budget):
    rows = conversation_rows(1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "'q' AS window_id", "0 AS at")
    made = chat.windows(df, budget=budget, history_tokens=budget // 4)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)), c
    windows = made.collect()
    assert len(windows) > len(by) + 20
    for w in windows:
        parts = w.formatted.split(chat.OPEN)[1:]
        if w.n_tokens > budget:  # only a turn that does not fit by itself may do that
            assert sum(not p.startswith("system\n") for p in parts) <= 1
        for forbidden in ("</s>", "[INST]"):
            assert forbidden not in w.formatted
    for c in (0, 3, 6):  # a system turn is in every window
        assert all(w.formatted.startswith(chat.OPEN + "system\n") for w in windows if w.conv_id == c)
    # windows are full: the next window's first own turn would not have fitted
    sizes = {(r.conv_id, r.at): r.n for r in df.selectExpr("conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text").withColumns({"n": chat.bound_tokens(chat.escape(F.col("text"))), "at": F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))}).collect()}
    own = {}
    for w in sorted(windows, key=lambda w: (w.conv_id is not None, w.conv_id or 0, w.window_id)):
        first = own.get(w.conv_id, 0)
        if first:
            assert last_tokens + sizes[w.conv_id, first + 1] > budget
        own[w.conv_id] = first + w.formatted.count(chat.OPEN) - w.n_repeated
        last_tokens = w.n_tokens
    assert any(w.n_repeated > 1 for w in windows) and chat.read_back(chat.windows(df.limit(0))).count() == 0


def toxic_texts(n: int, seed: int):
    rng = random.Random(seed)
    insults = ["idiot", "scum", "moron", "worthless", "pathetic"]
    out = []
    for i in range(n):
        w = prose(seed * 1000 + i, rng.choice([30, 100, 300])).split()
        label = i % 3 == 0
        if label:
            for _ in range(max(2, len(w) // 25)):
                x = rng.choice(insults)
                if rng.random() < 0.3:  # a misspelling
                    k = rng.randrange(1, len(x) - 1)
                    x = x[:k] + x[k + 1] + x[k] + x[k + 2 :]
                w[rng.randrange(len(w))] = x
        out.append((i, " ".join(w), int(label)))
    return out


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    rows = toxic_texts(500, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = toxicity.learn(df.select("doc_id", "text"), labels, positive=200, negative=400)
    got = toxicity.score(df, model, keep=("toxic",)).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    # labels of held-out rows change nothing
    again = toxicity.learn(df.select("doc_id", "text"), labels.filter(~toxicity.held_out(labels.doc_id)), positive=200, negative=400)
    assert (again.weights == model.weights).all()
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd) and {r.held_out for r in odd if r.doc_id is None} == {False}
    assert toxicity.score(no_docs, model).count() == 0
    flat = toxicity.learn(no_docs, labels.limit(0))
    assert toxicity.score(odd_docs, flat).count() == odd_docs.count()


def test_mean_weights_are_those_of_single_texts():
    rng = np.random.default_rng(2)
    weights = rng.standard_normal(1 << toxicity.BITS)
    texts = ["", "a", "Hello  there\nWorld", "  ", "ß日本 x", prose(1, 40)]
    together = toxicity.mean_weights(texts, weights)
    assert np.allclose(together, [toxicity.mean_weights([t], weights)[0] for t in texts])


def test_the_token_bound_against_the_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["日本語のテキスト" * 80, "x" * 20000, "The quick brown fox. It isn't 2024-11-26!\n\n  Done", "Größe, naïve, señor", "русский текст", "a  b\t\tc   ", "😀😁", "", "{}[]<>&"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("i", "text", chat.bound_tokens(F.col("text")).alias("n")).collect():
        assert len(library.encode(r.text, add_special_tokens=False).ids) <= r.n - 4, r.text[:20]


def test_a_long_conversation_in_chunks(spark, monkeypatch):
    rows = [(1, i, "user" if i % 2 else "assistant", "word " * (i % 7)) for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    some = []
    for size in (3, 256, 1000):
        monkeypatch.setattr(chat, "CHUNK", size)
        some.append(sorted((r.window_id, r.formatted) for r in chat.windows(df, budget=100).collect()))
    assert some[0] == some[1] == some[2] and len(some[0]) > 50


def dense_fit(rows, labels, epochs, steps, batch, rate, start, seed):
    """``toxicity.fit`` with dense matrices: a bag matrix times all embeddings, and full gradients."""
    random, n = np.random.default_rng(seed), 1 << toxicity.BITS
    embedding = random.uniform(-1, 1, (n, toxicity.DIM)) / toxicity.DIM
    out = random.uniform(-1, 1, (toxicity.DIM, 2)) / toxicity.DIM
    bias = np.log(np.maximum(np.bincount(labels, minlength=2), 1) / len(labels)) * start
    seen_e, seen_o, seen_b = np.full(n, 1e-8), np.full(out.shape, 1e-8), np.full(2, 1e-8)
    bags = np.zeros((len(rows), n), np.float32)
    for i, (bucket, count) in enumerate(rows):
        bags[i, bucket] = toxicity.GAIN * count / (count.sum() + toxicity.PRIOR)
    for _ in range(max(epochs, -(-steps * batch // len(rows)))):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            bag = bags[part].astype(np.float64)
            average = bag @ embedding
            logits = average @ out + bias
            p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
            wrong = (p - np.eye(2)[labels[part]]) / len(part)
            g_e, g_o, g_b = bag.T @ (wrong @ out.T), average.T @ wrong, wrong.sum(0)
            used = bag.any(0)
            seen_e[used] += (g_e[used] ** 2).mean(1)
            embedding[used] -= rate * g_e[used] / np.sqrt(seen_e[used])[:, None]
            seen_o += g_o**2
            out -= 0.3 * rate * g_o / np.sqrt(seen_o)
            seen_b += g_b**2
            bias -= rate * g_b / np.sqrt(seen_b)
    return toxicity.GAIN * embedding @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]


def bags(texts):
    counted = (np.unique(np.concatenate([b for b, _ in toxicity.ngram_buckets([t])]), return_counts=True) for t in texts)
    return [(b, n.astype(np.float32)) for b, n in counted]


def test_fit_equals_a_dense_reference():
    rows = toxic_texts(40, 5)
    some, labels = bags([t for _, t, _ in rows]), np.array([y for _, _, y in rows])
    model = toxicity.fit(some, labels, epochs=2, steps=6, batch=16)
    weights, bias = dense_fit(some, labels, 2, 6, 16, 0.3, 2.0, 7)
    assert np.allclose(model.weights, weights, rtol=1e-3, atol=1e-3) and np.isclose(model.bias, bias, rtol=1e-4)


def test_an_unseen_misspelling_scores_near_its_word():
    rows = [(i, t, y) for i, t, y in toxic_texts(300, 6)]
    model = toxicity.fit(bags([t for _, t, _ in rows]), np.array([y for _, _, y in rows]))
    frame = prose(1, 20)
    score = lambda *words: model.score([f"{frame} {w} {w} {w}" for w in words])
    assert not any("wortthless" in t or "patthetic" in t for _, t, _ in rows)
    known, new, other = score("worthless", "pathetic"), score("wortthless", "patthetic"), score("windowsill", "parallels")
    assert (new > other).all() and (new - other > 0.5 * (known - other)).all()


def test_one_text_of_an_id_is_learned(spark):
    rows = toxic_texts(120, 8)
    df = spark.createDataFrame([(i % 40, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows[:40]], "doc_id long, toxic int")
    models = [toxicity.learn(d, labels) for d in (df, df.repartition(7).orderBy("text"))]
    assert (models[0].weights == models[1].weights).all()
