"""Operators 11, 12 and 13 against plain programs."""

import datetime
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from matchweave.llm import best_fit, prefix_trie, target_encoding
from matchweave.llm.oracles import oracle_sql

JSON = P.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- prefix trie
def plain_trie(rows) -> dict:
    """{(conv_id, depth): (parent, members, children, leaves, saved, digest)} of (conv_id, turn, role, text) rows."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = {}
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(node))))
        children = sum(len(m) == len(node) + 1 for m in below)
        out[min(convs), len(node)] = (min(members[node[:-1]]) if node else None, len(convs), children, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found_trie(spark, space, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS depth", "'x' AS chars")
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.trie(df, space).collect()}


def some_conversations(seed: int, n: int = 60):
    rng = random.Random(seed)
    rows = []
    for c in [rng.choice([i, 100 + i, 200 + i, 7000 + i]) for i in range(n)]:
        for turn in range(rng.randint(1, 8)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "user", "assistant", None]), rng.choice(["hi", "aé\U0001f600", "", None, "x" * 500])))
    return rows + [(None, 1, "user", "nobody's"), (500, 0, "user", "alone")] + rows[:3]


@pytest.mark.parametrize("seed", range(2))
def test_trie_is_that_of_a_plain_program(spark, space, seed):
    rows = some_conversations(seed)
    assert found_trie(spark, space, rows) == plain_trie(rows)


def test_deep_conversations_go_block_by_block(spark, space, monkeypatch):
    """Blocks of four places: sums and names are carried over several blocks; equal and shared long conversations meet."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    rng = random.Random(3)
    base = [("user", f"t{i % 5}") for i in range(60)]
    rows = [(c, i, *(base[i] if i < 37 or c % 2 else (base[i][0], rng.choice("ab")))) for c in (1, 2, 3, 4, 105, 106) for i in range(60 if c != 3 else 21)]
    assert found_trie(spark, space, rows) == plain_trie(rows)


def test_trie_of_nothing_and_of_very_long_texts(spark, space):
    assert found_trie(spark, space, []) == {}
    rows = [(c, t, "user", "y" * 300_000 + str(t)) for c in (100, 101, 102) for t in range(3)]
    assert found_trie(spark, space, rows) == plain_trie(rows)


# ---------------------------------------------------------------- target encoding
SALES, LINES = "sale_id long, client_id long, sold_at timestamp_ntz, total double", "sale_id long, line_no int, item_id long, vendor_id long, flag string, n long"
NAMES = ("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")


def shop(seed: int, n: int = 120):
    rng = random.Random(seed)
    some = lambda low, high, empty=0.1: None if rng.random() < empty else rng.randint(low, high)
    start = datetime.datetime(2024, 1, 1)
    sales = [(i, some(1, 9), None if rng.random() < 0.05 else start + datetime.timedelta(seconds=rng.randint(0, 90)), 1.0) for i in range(n)]
    lines = [(rng.choice([some(0, n + 5), 7]), j, some(1, 12), some(1, 6), rng.choice(["returned", "kept", None]), 3) for j in range(5 * n)]
    return {
        "sales": (sales, SALES),
        "sale_lines": (lines + lines[:40], LINES),
        "items": ([(i, some(0, 2)) for i in range(10)], "item_id long, kind string"),
        "vendors": ([(i, some(1, 2)) for i in range(5)] + [(None, 1)], "vendor_id long, nation_id int"),
        "clients": ([(i, rng.choice(["a", "b", None])) for i in range(8)], "client_id long, segment string"),
    }


def frames(spark, tables):
    made = {k: spark.createDataFrame([tuple(str(x) if t.endswith("kind string") and i and x is not None else x for i, x in enumerate(r)) for r in rows], t) for k, (rows, t) in tables.items()}
    return [made[k] for k in ("sale_lines", "sales", "items", "vendors", "clients")]


def plain_rates(tables, gap: int = 0) -> dict:
    sales = {s: (c, at) for s, c, at, _ in tables["sales"][0] if at is not None}
    group = {k: {i: g for i, g in tables[k][0] if i is not None} for k in ("items", "vendors", "clients")}
    rows = []
    for sale, _, item, vendor, flag, _ in tables["sale_lines"][0]:
        if sale in sales:
            client, at = sales[sale]
            item, client = -1 if item is None else item, -1 if client is None else client
            rows.append((sale, item, vendor, client, at, zlib.crc32(str(sale).encode()) % 5, group["items"].get(item), group["vendors"].get(vendor), group["clients"].get(client), flag == "returned"))
    out = {}
    for r in rows:
        past = [p for p in rows if p[5] != r[5] and (r[4] - p[4]).total_seconds() > gap]

        def rate(pick, prior, past=past):
            n, s = sum(map(pick, past)), sum(p[9] for p in past if pick(p))
            return n, prior if n < 1 else (1_000_000 * s + 50 * prior) // (n + 50)

        every = rate(lambda p: True, 500_000)[1]
        values = []
        for key, parent in ((1, 6), (2, 7), (3, 8)):
            prior = rate(lambda p, i=parent: p[i] == r[i], every)[1]  # noqa: B023
            values += rate(lambda p, i=key: p[i] == r[i], prior)  # noqa: B023
        n, s = out.get(r[:3], (0, 0))[:2]
        out[r[:3]] = (n + 1, s + r[9], *values)
    return out


@pytest.mark.parametrize(("seed", "gap", "shard"), [(1, 0, 400_000), (2, 0, 30), (3, 7, 30)])
def test_rates_are_those_of_a_plain_program(spark, space, monkeypatch, seed, gap, shard):
    """Small shards put one value into many of them, so that opening balances count; equal times, null ids and repeated lines occur."""
    monkeypatch.setattr(target_encoding, "SHARD", shard)
    tables = shop(seed)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in target_encoding.sale_rates(*frames(spark, tables), space, gap).select(*NAMES).collect()}
    assert got == plain_rates(tables, gap)


def test_rates_of_nothing(spark, space):
    tables = {k: ([], t) for k, (_, t) in shop(1).items()}
    assert target_encoding.sale_rates(*frames(spark, tables), space).collect() == []
    tables = shop(4, 20) | {"items": ([], "item_id long, kind string")}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in target_encoding.sale_rates(*frames(spark, tables), space).select(*NAMES).collect()}
    assert got == plain_rates(tables)


def test_checksums_of_the_sql():
    from matchweave.llm.oracles import CRC_MACRO

    for n in (0, 7, 1234567, 10**15):
        assert duckdb.sql(f"SELECT {CRC_MACRO.format(f'({n})::VARCHAR')}").fetchall()[0][0] == zlib.crc32(str(n).encode())
    assert {"op11_prefix_trie", "op12_target_encoding"} <= set(oracle_sql())


# ---------------------------------------------------------------- best-fit packing
def test_cuts_put_the_rest_first():
    assert best_fit.cut(1, 4) == [(0, 1)] and best_fit.cut(8, 4) == [(0, 4), (4, 4)] and best_fit.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]


def plain_place(lengths, capacity, rule):
    """The rule in words: longest first, into the open sequence that the rule prefers of those with room in every capacity."""
    demand = [sum(lengths) / capacity[0], len(lengths) / capacity[1], sum(n * n for n in lengths) / capacity[2]]
    weight = [d / max(demand) for d in demand]
    rooms, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = (lengths[i], 1, lengths[i] ** 2)
        fits = [k for k, room in enumerate(rooms) if all(a >= b for a, b in zip(room, size, strict=True))]
        if rule == "norm":
            best = min(fits, key=lambda k: round(sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(weight, rooms[k], size, capacity, strict=True)), 12), default=None)
        else:
            best = max(fits, key=lambda k: round(sum(w * a * b / c**2 for w, a, b, c in zip(weight, rooms[k], size, capacity, strict=True)), 12), default=None)
        if best is None:
            rooms.append(list(capacity))
            best = len(rooms) - 1
        where[i] = best, capacity[0] - rooms[best][0]
        rooms[best] = [a - b for a, b in zip(rooms[best], size, strict=True)]
    return [where[i] for i in range(len(lengths))], len(rooms)


@pytest.mark.parametrize("rule", best_fit.RULES)
@pytest.mark.parametrize("capacity", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 4_000), (100, 4, 5_000)])
def test_placing_is_that_of_a_plain_program(rule, capacity):
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.integers(1, 64, 300), int(capacity[2] ** 0.5))
    bins, offset = best_fit.place(lengths, capacity, rule)
    got = list(zip(bins.tolist(), offset.tolist(), strict=True))
    want, n = plain_place(lengths.tolist(), capacity, rule)
    if rule == "norm":
        assert got == want
    for b in range(bins.max() + 1):
        mine = np.flatnonzero(bins == b)
        mine = mine[np.argsort(offset[mine])]
        assert lengths[mine].sum() <= capacity[0] and len(mine) <= capacity[1] and (lengths[mine] ** 2).sum() <= capacity[2]
        assert offset[mine].tolist() == [0, *np.cumsum(lengths[mine])[:-1].tolist()]
    assert abs(bins.max() + 1 - n) <= (0 if rule == "norm" else 2)


def test_placing_wastes_little():
    rng = np.random.default_rng(2)
    lengths = np.minimum(1024, 1 + rng.exponential(250, 8000).astype(int))
    bins, _ = best_fit.place(lengths, (1024, 1024, 1024**2))
    assert bins.max() + 1 <= 1.005 * lengths.sum() / 1024 + 1


def test_packed_pieces_are_the_library_s_ids(spark, space, odd_docs, monkeypatch):
    monkeypatch.setattr(best_fit, "GROUP", 4)  # several groups
    tokenizer = Tokenizer.from_file(JSON)
    rows = best_fit.pack(odd_docs, JSON, space, tokens=64, end_id=2).collect()
    docs = {}
    for d in odd_docs.collect():
        docs.setdefault(d.doc_id, []).append([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2])
    want = sorted((i is None, i or 0, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for i, every in docs.items() for ids in every for k, (a, n) in enumerate(best_fit.cut(len(ids), 64)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_capacities_bound_every_sequence(spark, space, odd_docs, no_docs):
    held = {}
    for r in best_fit.pack(odd_docs, JSON, space, tokens=64, documents=2, cost=2500, rule="dot", end_id=2).collect():
        held.setdefault(r.sequence_id, []).append(r.length)
    assert all(len(x) <= 2 and sum(n * n for n in x) <= 2500 and sum(x) <= 64 for x in held.values()) and max(map(max, held.values())) == 50
    assert best_fit.pack(no_docs, JSON, space).collect() == []
    with pytest.raises(ValueError, match="rule"):
        best_fit.pack(no_docs, JSON, space, rule="first")
