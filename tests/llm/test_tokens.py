"""Operators 8, 9 and 10 against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from matchweave.llm import bpe_fst, packing, pretokens, token_count
from matchweave.llm.bpe import Vocabulary

JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def texts(n: int) -> list[str]:
    rng = random.Random(5)
    kinds = ["abcdefghij klmnop  \n'\t.,!?0123ééßñ'sllre", "日本語テキスト русский текст 😀😁 ab", " \n\t\u2028\u00a0\x1c\x85a1'", "a"]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["a" * 3000, "<|endoftext|>x<|endoftext|>", "don't  you'll\n've 'tis 's's"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_pieces_are_those_of_the_pattern():
    find = regex.compile(P.PATTERN)
    some = texts(1500)
    codes, ends = pretokens.block_codes(some)
    begin = [int(s) for s in pretokens.starts(codes) if codes[s] != pretokens.BETWEEN]
    assert begin == [m.start() + e + 1 for t, e in zip(some, ends, strict=False) for m in find.finditer(t)]


#: Code points that newer tables know as letters or digits and the tokenizers library takes as marks.
NEW_LETTERS = "\u0558b \U0003d000x 9\u0558 c\u088f\u088fd \U00011de0"


def test_pieces_hold_letters_that_the_library_does_not_know(library):
    counts, pieces = token_count._counter(JSON, P.PATTERN)
    assert "".join(pieces(NEW_LETTERS)) == NEW_LETTERS and pieces("a\u0558b") == ["a", "\u0558", "b"]
    assert [a for a, _ in library.pre_tokenizer.pre_tokenize_str("a\u0558b")][0] == "a"
    assert token_count.TextCounts(pieces(NEW_LETTERS), counts).n_tokens == len(library.encode(NEW_LETTERS, add_special_tokens=False).ids)
    assert packing.DocumentIds(JSON).of([NEW_LETTERS])[0].tolist() == library.encode(NEW_LETTERS, add_special_tokens=False).ids


def test_counts_at_every_prefix(library):
    counts, pieces = token_count._counter(JSON, P.PATTERN)
    for t in texts(300):
        found = token_count.TextCounts(pieces(t), counts)
        assert found.n_tokens == found.at(len(t.encode())) == len(library.encode(t, add_special_tokens=False).ids)
    for word in ("internationalisation", "aaaaaaaaab", "xyzzy1", "ab" * 300):
        for n, count in enumerate(counts[word]):
            piece = word[:n]
            if len(pieces(piece)) <= 1:
                assert count == len(library.encode(piece, add_special_tokens=False).ids)
    assert "ab" * 300 not in counts and "internationalisation" in counts


def test_longest_fit(library):
    counts, pieces = token_count._counter(JSON, P.PATTERN)
    text = "The quick brown fox, internationalisation é日本 and more"
    for budget in range(20):
        found = token_count.TextCounts(pieces(text), counts)
        size = found.longest_fit(budget)
        prefix = text.encode()[:size].decode()
        assert found.at(size) == token_count.TextCounts(pieces(prefix), counts).n_tokens <= budget or not prefix
        assert size == len(text.encode()) or found.at(size + len(text.encode()[size:].decode()[0].encode())) > budget


def test_truncation_makes_no_piece_again(library):
    counts, pieces = token_count._counter(JSON, P.PATTERN)
    found = token_count.TextCounts(pieces("one two three internationalisation " + "x" * 500), counts)
    make, counts.make = counts.make, None
    try:
        assert [found.longest_fit(b) for b in (0, 1, 2)] == [0, 3, 7]
    finally:
        counts.make = make


def test_transducer_equals_the_library_and_streams_back():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe_fst.Codec(Vocabulary.from_tiktoken(MULTI), P.PATTERN)
    for _ in range(2):  # the second time over known arcs
        for t in texts(600):
            ids = coder.encode(t)
            assert ids == encoding.encode_ordinary(t)
            assert coder.decode(ids) == t
    limit, bpe_fst.ARCS = bpe_fst.ARCS, 5
    try:
        small = bpe_fst.Codec(Vocabulary.from_tiktoken(MULTI), P.PATTERN)
        assert all(small.encode(t) == encoding.encode_ordinary(t) for t in texts(200))
        assert small.transducer.arcs <= 6
    finally:
        bpe_fst.ARCS = limit


def test_a_stream_of_ids_is_decoded_across_tokens():
    """Tokens that end inside a character, and streams that are not UTF-8."""
    coder = bpe_fst.Codec(Vocabulary.from_tiktoken(MULTI), P.PATTERN)
    rng = random.Random(6)
    single = [coder.transducer.vocabulary.ids[bytes((b,))] for b in (0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xF0, 0x90)]
    some = list(coder.tokens)
    for _ in range(800):
        ids = [rng.choice(single) if rng.random() < 0.7 else rng.choice(some) for _ in range(rng.randint(0, 12))]
        assert coder.decode(ids) == b"".join(coder.tokens[i] for i in ids).decode("utf-8", "replace")


def test_streaming_decoder_on_malformed_bytes():
    rng = random.Random(2)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(rng.randint(0, 8)))
        stream, out = bpe_fst.Utf8Stream(), ""
        while data:
            n = rng.randint(1, 3)
            out, data, head = out, data[n:], data[:n]
            out += stream.feed(head)
            fed = locals().get("fed", b"") + head
        assert out + stream.close() == (fed if "fed" in locals() else b"").decode("utf-8", "replace")
        fed = b""


def test_binary_pieces():
    for n in range(1, 300):
        parts = packing.binary_pieces(n, 64)
        assert [s for s, _ in parts] == list(np.cumsum([0] + [k for _, k in parts])[:-1]) and sum(k for _, k in parts) == n
        assert all(k & (k - 1) == 0 and k <= 64 for _, k in parts)
    with pytest.raises(ValueError):
        packing.pack(None, JSON, longest=100)


def test_operators_on_odd_documents(spark, odd_docs, no_docs, library):
    rows = odd_docs.select("doc_id", "text").collect()
    ids = [library.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    counted = token_count.count_tokens(odd_docs, JSON, P.PATTERN, limit=100).collect()
    key = lambda x: [(-1 if v is None else v) for v in x]
    assert sorted(map(key, ((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counted))) == sorted(map(key, ((r.doc_id, len((r.text or "").encode()), len(i), len(i) > 100) for r, i in zip(rows, ids, strict=True))))
    coded = bpe_fst.encode_documents(odd_docs, MULTI, P.PATTERN, with_ids=True).collect()
    assert sorted(r.decoded for r in coded) == sorted(r.text or "" for r in rows)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted(r.ids for r in coded) == sorted(encoding.encode_ordinary(r.text or "") for r in rows)
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in coded)
    pieces = packing.pack(odd_docs, JSON, longest=64, with_ids=True).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
    assert sum(p.length for p in pieces) == sum(len(i) + 1 for i in ids)
    once = {r.doc_id for r in rows if sum(x.doc_id == r.doc_id for x in rows) == 1}
    assert len(once) > 5
    for r, i in zip(rows, ids, strict=True):
        if r.doc_id in once:
            mine = sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.start)
            assert [x for p in mine for x in p.ids] == [*i, 1]
    for empty in (token_count.count_tokens(no_docs, JSON, P.PATTERN), bpe_fst.encode_documents(no_docs, MULTI, P.PATTERN), packing.pack(no_docs, JSON)):
        assert empty.count() == 0


def colliding(size: int) -> tuple[str, str]:
    """Two words that every polynomial hash modulo a power of two takes for equal: a word of two letters and the same with these exchanged."""
    a, b = "a", "b"
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_collide_in_polynomial_hashes_have_their_own_ids(library, size):
    a, b = colliding(size)
    coder = packing.DocumentIds(JSON)
    for group in ([a, b], [b, a], [f"{a} {b}", f"{b} {a}"]):
        assert [x.tolist() for x in coder.of(group)] == [library.encode(t, add_special_tokens=False).ids for t in group]


def test_packed_pieces_by_bucket(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(200)], "doc_id long, text string")
    packing.write_buckets(packing.pack(docs, JSON, longest=32, with_ids=True), f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert {(r.bucket, r.length) for r in back.collect()} == {(1 << k, 1 << k) for k in range(6)}
    assert back.count() == packing.pack(docs, JSON, longest=32).count()


def test_long_texts_are_split_at_pieces(library, monkeypatch):
    monkeypatch.setattr(packing, "PART", 40)
    coder = packing.DocumentIds(JSON)
    rng = random.Random(12)
    long = [" ".join(t for t in rng.sample(texts(300), 60)) for _ in range(12)] + ["x" * 500, " " * 500, "a \u00a0b \x1c c  d " * 60, "don't 's " * 40]
    assert max(len(list(packing.parts(t))) for t in long) > 5 and all("".join(packing.parts(t)) == t for t in long)
    assert [x.tolist() for x in coder.of(long)] == [library.encode(t, add_special_tokens=False).ids for t in long]
