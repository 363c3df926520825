"""Best-fit packing under several capacities at once.

A document is its ids and an end id.  Only a document that is longer than a sequence is cut, into whole sequences behind a first piece that may
be shorter.  A piece weighs on three capacities of a sequence: tokens, documents (one each) and attention cost (the square of its
length, as documents do not see each other).  Pieces are placed longest first; among the open sequences that have room in
every capacity, ``rule`` takes one: ``norm`` that with the smallest weighted norm of what would be left, ``dot`` that
whose room has the largest weighted dot product with the piece.  A capacity's weight is its demand: the sum of the pieces over the capacity.

Documents are cut where they lie.  The pieces, without their texts, are dealt by row number into groups of about ``GROUP``, each packed by itself: a group leaves
a sequence or two partly filled, so the number of sequences stays within about a thousandth of one packing of everything, and no task grows with the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.packing import _ids as document_ids
from matchweave.llm.shared import Workspace, lean, no_cycles, text_groups

#: Pieces of a group, about.
GROUP = 8192
RULES = ("norm", "dot")


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: what is left over first, then whole sequences."""
    first = n % longest
    return [(0, first)] * (first > 0) + [(at, longest) for at in range(first, n, longest)]


def place(lengths: np.ndarray, capacity: tuple[int, int, int], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ``capacity`` is (tokens, documents, attention cost).

    Pieces of one length are placed in their given order; of sequences that are equally good the one opened first is taken.
    """
    lengths = lengths.astype(np.int64)
    full = np.array(capacity, np.int64)
    sizes = np.stack((lengths, np.ones_like(lengths), lengths**2))
    bins, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if not len(lengths):
        return bins, offset
    if (sizes.max(1) > full).any():
        raise ValueError("a piece exceeds a capacity")
    scale = sizes.sum(1) / full
    scale = scale / scale.max() / full.astype(float) ** 2  # weight over the square of the capacity
    room = np.empty((3, 64), np.int64)  # of open sequences
    name = np.empty(64, np.int64)
    n_open = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[:, i]
        left = room[:, :n_open] - size[:, None]
        fits = np.flatnonzero((left >= 0).all(0))
        if len(fits):
            if rule == "norm":
                k = fits[np.argmin(scale @ (left[:, fits].astype(float) ** 2))]
            else:
                k = fits[np.argmax((scale * size) @ room[:, fits])]
        else:
            if n_open == len(name):
                # sequences that nothing can enter any more are left out, else there is more space
                shut = (room[:, :n_open] < sizes.min(1)[:, None]).any(0)
                keep = np.flatnonzero(~shut)
                n_open = len(keep)
                space = max(64, 2 * n_open)
                room, old = np.empty((3, space), np.int64), room
                name, names = np.empty(space, np.int64), name
                room[:, :n_open], name[:n_open] = old[:, keep], names[keep]
            k = n_open
            room[:, k], name[k] = full, made
            n_open += 1
            made += 1
        bins[i], offset[i] = name[k], full[0] - room[0, k]
        room[:, k] -= size
    return bins, offset


def pack(
    docs: DataFrame, vocabulary: str, space: Workspace, tokens: int = 1024, documents: int | None = None, cost: int | None = None, rule: str = "norm", end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence holds at most ``tokens`` tokens, ``documents`` documents and an attention cost of ``cost``; without the last two
    they are as large as any sequence of so many tokens can need, so they are met but never decide.  A piece is at most as long as all
    three allow.  Null and empty texts are one piece, the end id.  Repeated rows and null ids are packed each by itself; pieces of equal length are
    placed by id, piece and checksum, so a task that runs again gives the same.  Texts of any length are taken whole, other columns are not read, an empty table
    gives an empty result.  ``sequence_id`` is unique, its numbers have gaps.
    """
    capacity = (tokens, tokens if documents is None else documents, tokens**2 if cost is None else cost)
    if min(capacity) < 1 or rule not in RULES:
        raise ValueError("capacities must be positive and the rule one of " + ", ".join(RULES))
    longest = min(tokens, int(np.sqrt(capacity[2] + 0.5)))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        with no_cycles():
            coder = document_ids(vocabulary)
            for batch in batches:
                first = 0
                for group in text_groups(batch.column(1).to_pylist()):
                    rows = []
                    for i, own in enumerate(coder.of(group), first):
                        raw = own.astype("<u4").tobytes() + tail
                        rows += [(i, k, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(raw) // 4, longest))]
                    at, piece, start, length, crc = zip(*rows, strict=True)
                    first += len(group)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["id", "piece", "start", "length", "ids_crc32"]
                    )

    def packed(group: pa.Table) -> pa.Table:
        number = group.column("part")[0].as_py() if len(group) else 0
        rows = group.drop_columns(["part"]).sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offset = place(rows.column("length").to_numpy(), capacity, rule)
        return rows.append_column("sequence_id", pa.array((number << 32) + bins)).append_column("offset", pa.array(offset))

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = space.table(docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).mapInArrow(lean(run), schema), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))  # of a written table: the same in each run
    return dealt.groupBy("part").applyInArrow(packed, schema + ", sequence_id long, offset long").withColumnRenamed("id", doc_id)
