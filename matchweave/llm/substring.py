"""Substring dedup by level-wise doubling.

A window of ``size`` words is looked for at a quarter of its length first:
windows that are repeated at one length alone are extended to twice that
length, until the full one; the survivors there are the repeated windows.

*Level 1.*  Each full window is stood for by its anchor, the quarter window with
the smallest hash in it (the leftmost of equal ones).  Equal full windows have equal anchors at equal
places, so a full window whose anchor is not repeated is not repeated; and as
neighbouring windows mostly share their anchor, about one position in fourteen is an anchor.
*Level 2.*  Anchors that are repeated are extended to both sides, to twice their length.
*Level 3.*  Full windows that hold their anchor's surviving extensions are compared.

**How windows are compared.**  Tasks do not send rows for windows but, for each
block of documents, one packed array of its distinct hashes for each of many buckets, with a
mark on those that the block itself holds twice.  One task per bucket finds the hashes that occur
twice and answers each block with one bit for each of its hashes.
A window in any number of documents is sent once by each block, and memory is one bucket's hashes.
Levels 1 and 2 only choose candidates; the last level compares two 64-bit hashes that go back to two independent
hashes of the words (``shared.span_hashes``), so two different candidates are taken for equal
with a probability of about 2**-128 for each pair of them.

Documents are found again by a 128-bit hash of their text, so repeated rows, equal ids and null ids are
fine: each row is a document, and copies repeat each other's windows.  Null and empty texts have no words, an empty table
gives an empty result, and columns that are not named are not read, whatever their names.  A text of any length is
taken whole, in memory that grows with the text; a word of any length is one word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchweave.llm.shared import Workspace, block_words, blocks, broadcast_if_small, lean, mix, pair, span_hashes

#: Buckets at least; bytes of text for each further one (a bucket then holds at most about 8 million hashes); hashes of a block at least and at most, two a bucket between.
LEAST_BUCKETS, BYTES_PER_BUCKET, BLOCK, MOST_BLOCK = 256, 64 << 20, 300_000, 4_000_000

# Rows between the levels.  kind 0: a document; 1: a block's hashes of one bucket; 2: a block's documents.
ROWS = "kind int, block long, bucket int, data binary, {id}, k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, text string, bits1 binary, extra string"


# ---------------------------------------------------------------- windows
def window_hash(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """The hash of each window of so many words, by doubling: windows of 2, 4, 8, ... words, then two of them that overlap."""
    n, now = 1, h
    while 2 * n <= length and len(now):
        now = pair(now[:-n], now[n:], n)
        n *= 2
    if len(h) < length:
        return h[:0]
    rest = length - n
    return pair(now[: len(now) - rest], now[rest:], length + seed)


class Windows:
    """The windows of some texts; all positions count the words of all of them."""

    def __init__(self, raws: list[bytes], size: int):
        self.size, self.short = size, -(-size // 4)
        self.h, self.starts, self.ends, self.data, self.first = block_words(raws)
        n = len(self.h)
        self.at = self.anchor = self.anchors = np.zeros(0, np.int64)
        if n >= size:
            quarter = window_hash(self.h, self.short)
            at = np.arange(n - size + 1)
            text = np.searchsorted(self.first, at, "right") - 1
            whole = at + size <= self.first[text + 1]
            least = np.lib.stride_tricks.sliding_window_view(quarter, size - self.short + 1).argmin(1)
            self.at = at[whole]
            self.anchor = (at + least)[whole]
            self.anchors = np.unique(self.anchor)
            self.quarter = quarter[self.anchors]
        self.text_of = lambda p: np.searchsorted(self.first, p, "right") - 1

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each full window, from two independent hashes of the words."""
        words = span_hashes(self.data, self.starts, self.ends, second=True)
        return window_hash(self.h, self.size), window_hash(words, self.size, 1 << 20)

    def extensions(self, alive: np.ndarray) -> np.ndarray:
        """Starts of the doubled windows to both sides of the anchors that are alive."""
        text = self.text_of(alive)
        right = alive[alive + 2 * self.short <= self.first[text + 1]]
        left = (alive - self.short)[alive - self.short >= self.first[text]]
        return np.unique(np.concatenate((right, left)))

    def candidates(self, alive: np.ndarray, extended: np.ndarray) -> np.ndarray:
        """Starts of the full windows that hold an anchor that is alive and its surviving extensions."""
        mark = np.zeros(len(self.h) + 1, bool)
        mark[alive] = True
        wide = np.zeros(len(self.h) + 1, bool)
        wide[extended] = True
        ahead = self.anchor - self.at
        right = (ahead > self.size - 2 * self.short) | wide[self.anchor]
        left = (ahead < self.short) | wide[self.anchor - self.short]
        return self.at[mark[self.anchor] & right & left]


# ---------------------------------------------------------------- comparing hashes
class Block:
    """The hashes of some documents, in order; the second one of each decides its bucket, and is compared too if ``wide``."""

    def __init__(self, n_buckets: int, wide: bool = False):
        self.n_buckets, self.wide, self.size, self.keys, self.counts, self.hashes, self.second = n_buckets, wide, 0, [], [], [], []
        self.full = min(max(BLOCK, 2 * n_buckets), MOST_BLOCK)

    def add(self, key: tuple[int, int], hashes: np.ndarray, second: np.ndarray) -> None:
        if len(hashes):
            self.size += len(hashes)
            self.keys.append(key)
            self.counts.append(len(hashes))
            self.hashes.append(hashes)
            self.second.append(second)

    def rows(self, block: int):
        """(kind, block, bucket, data) of the block's rows: for each bucket the distinct hashes and which of them occur here twice,
        and for the block its documents with the places of their hashes among these."""
        if not self.keys:
            return
        hashes, second = np.concatenate(self.hashes), np.concatenate(self.second)
        bucket = (second % np.uint64(self.n_buckets)).astype(np.uint32)
        order = np.lexsort((second, hashes, bucket) if self.wide else (hashes, bucket))
        h, s, b = hashes[order], second[order], bucket[order]
        new = np.concatenate(([True], (b[1:] != b[:-1]) | (h[1:] != h[:-1]) | (self.wide & (s[1:] != s[:-1]))))
        place = np.zeros(len(order), np.uint32)
        place[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        twice = np.diff(np.append(first, len(order))) > 1
        distinct = np.stack((h, s) if self.wide else (h,), 1)[first]
        present, cuts = np.unique(b[first], return_index=True)
        for number, part, marks in zip(present.tolist(), np.split(distinct, cuts[1:]), np.split(twice, cuts[1:]), strict=True):
            yield 1, block, number, np.int64(len(part)).tobytes() + part.tobytes() + np.packbits(marks).tobytes()
        sizes = np.array([len(self.keys), len(present), len(first)], np.int64)
        parts = (sizes, np.array(self.keys, np.int64), np.array(self.counts, np.int64), present.astype(np.int64), cuts.astype(np.int64), place)
        yield 2, block, -1, b"".join(x.tobytes() for x in parts)


def _sent(data: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's row the hashes (one or two columns) and whether each occurs twice in its block."""
    n = int(np.frombuffer(data[:8], np.int64)[0])
    tail = -(-n // 8)
    hashes = np.frombuffer(data[8 : len(data) - tail], np.uint64).reshape(n, -1)
    return hashes, np.unpackbits(np.frombuffer(data[len(data) - tail :], np.uint8), count=n).astype(bool)


def _repeated(group: pa.Table) -> pa.Table:
    """One bucket: which hashes of each block occur twice or more in it."""
    parts, marks = zip(*(_sent(memoryview(x.as_buffer())) for x in group.column("data")), strict=True)
    every, again = np.concatenate(parts), np.concatenate(marks)
    order = np.lexsort(every.T)
    ordered = every[order]
    new = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(1))))
    sizes = np.diff(np.append(new, len(order)))
    flags = np.zeros(len(order), bool)
    flags[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(again[order], new), sizes)
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(f).tobytes() if f.any() else None for f in np.split(flags, ends[:-1])]
    found = [i for i, x in enumerate(bits) if x is not None]
    return pa.table({"kind": pa.array([1] * len(found), pa.int32()), "block": group.column("block").take(pa.array(found, pa.int64())), "bucket": group.column("bucket").take(pa.array(found, pa.int64())), "data": pa.array([bits[i] for i in found], pa.binary())})


def _answers(group: pa.Table) -> pa.Table:
    """One block: for each of its documents with a repeated hash the bits of its hashes, in order."""
    index, answers = None, {}
    for kind, bucket, data in zip(group.column("kind").to_pylist(), group.column("bucket").to_pylist(), group.column("data"), strict=True):
        if kind == 2:
            index = data.as_py()
        else:
            answers[bucket] = data.as_py()
    keys, out = [], []
    if index is not None and answers:
        n, n_present, n_distinct = np.frombuffer(index[:24], np.int64).tolist()
        heads = np.frombuffer(index[24 : 24 + 8 * (3 * n + 2 * n_present)], np.int64)
        names, counts, present, cuts = heads[: 2 * n].reshape(n, 2), heads[2 * n : 3 * n], heads[3 * n : 3 * n + n_present], heads[3 * n + n_present :]
        place = np.frombuffer(index[24 + 8 * (3 * n + 2 * n_present) :], np.uint32)
        flags, ends = np.zeros(n_distinct, bool), np.append(cuts[1:], n_distinct)
        for bucket, bits in answers.items():
            at = int(np.searchsorted(present, bucket))
            flags[cuts[at] : ends[at]] = _bits(bits, ends[at] - cuts[at])
        for name, part in zip(names, np.split(flags[place], np.cumsum(counts)[:-1]), strict=True):
            if part.any():
                keys.append(name)
                out.append(np.packbits(part).tobytes())
    k = np.array(keys, np.int64).reshape(-1, 2)
    return pa.table({"k1": pa.array(k[:, 0]), "k2": pa.array(k[:, 1]), "bits": pa.array(out, pa.binary())})


def _compare(space: Workspace, rows: DataFrame, name: str) -> DataFrame:
    """(k1, k2, bits) of the documents with a hash that is repeated anywhere, as a table with one row for each text."""
    sent = rows.filter("kind = 1").select("kind", "block", "bucket", "data")
    said = sent.groupBy("bucket").applyInArrow(_repeated, "kind int, block long, bucket int, data binary")
    index = rows.filter("kind = 2").select("kind", "block", "bucket", "data")
    answers = said.unionByName(index).groupBy("block").applyInArrow(_answers, "k1 long, k2 long, bits binary")
    return space.table(answers.groupBy("k1", "k2").agg(F.first("bits").alias("bits")), name)


def _bits(data, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


# ---------------------------------------------------------------- passes over the texts
def _batch(rows: list[tuple], made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Document rows and hash rows as one batch of ROWS."""
    every = rows + made
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*every, strict=True), schema, strict=True)] if every else [pa.array([], f.type) for f in schema], schema=schema)


def _hash_rows(block: Block, number: int, width: int) -> list[tuple]:
    return [(*row, *[None] * (width - 4)) for row in block.rows(number)]


def _schema(id_type: pa.DataType) -> pa.Schema:
    kinds = [("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary()), ("id", id_type), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("bits1", pa.binary()), ("extra", pa.string())]
    return pa.schema(kinds)


def _number(count: int) -> int:
    return (TaskContext.get().partitionId() << 24) + count


def _anchors(size: int, buckets: int):
    """Level 1: the anchors of all texts (k1, k2, text)."""

    def send(block: Block, number: int) -> pa.RecordBatch:
        kind, numbers, bucket, data = zip(*made, strict=True) if (made := list(block.rows(number))) else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(numbers, pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["kind", "block", "bucket", "data"])

    def run(batches):
        block, count = Block(buckets), 0
        for batch in batches:
            k1, k2 = (batch.column(i).to_pylist() for i in (0, 1))
            with np.errstate(over="ignore"):
                for first, raws in blocks(batch.column(2).to_pylist()):
                    w = Windows(raws, size)
                    if len(w.anchors):
                        parts = np.searchsorted(w.anchors, w.first)
                        second = mix(w.quarter ^ np.uint64(0x2545F4914F6CDD1D))
                        for i in range(len(raws)):
                            a, b = parts[i], parts[i + 1]
                            block.add((k1[first + i], k2[first + i]), w.quarter[a:b], second[a:b])
            if block.size >= block.full:
                yield send(block, _number(count))
                block, count = Block(buckets), count + 1
        yield send(block, _number(count))

    return run


def _extend(size: int, buckets: int, id_type: pa.DataType):
    """Level 2: the repeated anchors of each text that has one are extended."""
    schema = _schema(id_type)

    def run(batches):
        block, count = Block(buckets), 0
        for batch in batches:
            ids, k1, k2, texts, bits, extra = (batch.column(i).to_pylist() for i in range(6))
            rows = []
            with np.errstate(over="ignore"):
                for first, raws in blocks(texts):
                    w = Windows(raws, size)
                    wide = window_hash(w.h, 2 * w.short)
                    parts = np.searchsorted(w.anchors, w.first)
                    for j, i in enumerate(range(first, first + len(raws))):
                        mine = w.anchors[parts[j] : parts[j + 1]]
                        starts = w.extensions(mine[_bits(bits[i], len(mine))])
                        hashes = wide[starts]
                        block.add((k1[i], k2[i]), hashes, mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)))
                        rows.append((0, None, None, None, ids[i], k1[i], k2[i], int(w.first[j + 1] - w.first[j]), None, None, texts[i], bits[i], extra[i]))
            yield _batch(rows, [], schema)
            if block.size >= block.full:
                yield _batch([], _hash_rows(block, _number(count), len(schema)), schema)
                block, count = Block(buckets), count + 1
        yield _batch([], _hash_rows(block, _number(count), len(schema)), schema)

    return run


def _alive(w: Windows, j: int, parts: np.ndarray, bits1, bits2) -> tuple[np.ndarray, np.ndarray]:
    """Of text j: the anchors and the extensions that are alive."""
    mine = w.anchors[parts[j] : parts[j + 1]]
    alive = mine[_bits(bits1, len(mine))]
    starts = w.extensions(alive)
    return alive, starts[_bits(bits2, len(starts))] if bits2 is not None else starts[:0]


def _full_windows(size: int, buckets: int, id_type: pa.DataType):
    """Level 3: the full windows that are still candidates; their places go where level 1's bits were."""
    schema = _schema(id_type)

    def run(batches):
        block, count = Block(buckets, wide=True), 0
        for batch in batches:
            ids, k1, k2, words, texts, bits1, bits2, extra = (batch.column(i).to_pylist() for i in range(8))
            rows = []
            with np.errstate(over="ignore"):
                for first, raws in blocks(texts):
                    w = Windows(raws, size)
                    full, second = w.full()
                    parts = np.searchsorted(w.anchors, w.first)
                    living = [_alive(w, j, parts, bits1[first + j], bits2[first + j]) for j in range(len(raws))]
                    found = w.candidates(np.concatenate([a for a, _ in living]), np.concatenate([e for _, e in living]))
                    cuts = np.searchsorted(found, w.first)
                    for j in range(len(raws)):
                        i, mine = first + j, found[cuts[j] : cuts[j + 1]]
                        block.add((k1[i], k2[i]), full[mine], second[mine])
                        runs = (mine - w.first[j]).astype(np.int32)
                        rows.append((0, None, None, None, ids[i], k1[i], k2[i], words[i], None, None, texts[i], _runs(runs).tobytes(), extra[i]))
            yield _batch(rows, [], schema)
            if block.size >= block.full:
                yield _batch([], _hash_rows(block, _number(count), len(schema)), schema)
                block, count = Block(buckets, wide=True), count + 1
        yield _batch([], _hash_rows(block, _number(count), len(schema)), schema)

    return run


def _runs(numbers: np.ndarray) -> np.ndarray:
    """Ascending numbers as (first, count) of their runs."""
    if not len(numbers):
        return np.zeros((0, 2), np.int32)
    cut = np.flatnonzero(np.diff(numbers) != 1) + 1
    first = np.concatenate(([0], cut))
    return np.stack((numbers[first], np.diff(np.concatenate((first, [len(numbers)])))), 1).astype(np.int32)


def _listed(runs: bytes) -> np.ndarray:
    pairs = np.frombuffer(runs, np.int32).reshape(-1, 2)
    return np.concatenate([np.arange(a, a + n) for a, n in pairs]) if len(pairs) else np.zeros(0, np.int64)


def _cut(size: int, with_text: bool):
    """The words that no repeated window covers."""

    def run(batches):
        for batch in batches:
            ids, words, texts, runs, bits = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4))
            removed, digests, kept_texts = [], [], []
            for text, r, b in zip(texts, runs, bits, strict=True):
                split = text.encode("utf-8", "surrogatepass").split()
                if b is not None:
                    at = _listed(r)
                    at = at[_bits(b, len(at))]
                    depth = np.zeros(len(split) + 1, np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + size, -1)
                    covered = np.cumsum(depth[:-1]) > 0
                    split = [x for x, c in zip(split, covered.tolist(), strict=True) if not c]
                joined = b" ".join(split)
                removed.append(len(split))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append((joined.decode("utf-8", "surrogatepass") if b is not None else text) if with_text else None)
            n_removed = [n - k for n, k in zip(words, removed, strict=True)]
            arrays = [batch.column(0), batch.column(5), pa.array(words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "extra", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _whole(with_text: bool):
    """Texts without a repeated anchor keep all their words."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            n = pa.array([len(x) for x in split], pa.int64())
            arrays = [batch.column(0), batch.column(1), n, pa.array([0] * len(split), pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in split], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(2)] * with_text, names=["id", "extra", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def remove_repeats(docs: DataFrame, space: Workspace, size: int = 35, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word is removed if a window of ``size`` words that covers it has the same words as a window
    that starts anywhere else.  ``with_text`` adds ``kept_text``: the kept words joined by one space, or the
    text as it was (empty for null) if all are kept.  ``keep`` names columns to hand on.
    """
    if size < 4:
        raise ValueError("size must be 4 or more")
    id_type = to_arrow_type(docs.schema[doc_id].dataType)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows_schema = ROWS.format(id=f"id {kind}")
    extra = F.to_json(F.struct(*keep)) if keep else F.lit(None).cast("string")
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), extra.alias("extra"))
    source = source.select("id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), "text", "extra")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = LEAST_BUCKETS + int(total // BYTES_PER_BUCKET)

    first = space.table(source.select("k1", "k2", "text").mapInArrow(lean(_anchors(size, buckets)), "kind int, block long, bucket int, data binary"), "anchors")
    alive = _compare(space, first, "anchors-alive")
    space.drop("anchors")
    some = broadcast_if_small(alive, binary="bits")
    opened = source.join(some, ["k1", "k2"]).select("id", "k1", "k2", "text", "bits", "extra")
    second = space.table(opened.mapInArrow(lean(_extend(size, buckets, id_type)), rows_schema), "extended")
    wider = _compare(space, second, "extended-alive")
    open_ = second.filter("kind = 0").select("id", "k1", "k2", "n_words", "text", "bits1", "extra").join(broadcast_if_small(wider, binary="bits"), ["k1", "k2"], "left")
    third = space.table(open_.select("id", "k1", "k2", "n_words", "text", "bits1", F.col("bits").alias("bits2"), "extra").mapInArrow(lean(_full_windows(size, buckets, id_type)), rows_schema), "full")
    repeated = _compare(space, third, "full-alive")
    space.drop("extended", "extended-alive")
    last = third.filter("kind = 0").select("id", "k1", "k2", "n_words", "text", "bits1", "extra").join(broadcast_if_small(repeated, binary="bits"), ["k1", "k2"], "left").select("id", "n_words", "text", "bits1", "bits", "extra")
    columns = ["id", "extra", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    made = f"id {kind}, extra string, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    whole = source.join(some, ["k1", "k2"], "left_anti").select("id", "extra", "text").mapInArrow(lean(_whole(with_text)), made)
    out = whole.unionByName(last.mapInArrow(lean(_cut(size, with_text)), made))
    if keep:
        handed = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        out = out.select(*columns, F.from_json("extra", handed).alias("handed")).select(*columns, *(F.col(f"handed.`{c}`") for c in keep))
    return out.drop("extra").withColumnRenamed("id", doc_id)
