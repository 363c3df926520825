"""Packing by power-of-two decomposition.

A document's tokens (its ids, then the end id) are cut into pieces of the
largest length 2**k first, down the binary digits of its token count; what
exceeds the longest sequence is cut into whole sequences of that length.  Every
piece is a sequence by itself, in the bucket of its length, so no sequence
crosses documents and none has padding.  Pieces never move between rows: no
shuffle, and memory of one document at a time.  ``write_buckets`` puts equal
lengths together at rest, so that a batch of sequences needs no padding.

A null text counts as empty: one piece, the end id.  Repeated rows and null ids are packed each by itself, an empty table gives
an empty result, a text of any length is taken whole, and columns that are not named are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.pretokens import PieceTable, classes
from matchweave.llm.shared import give_back, lean, no_cycles, text_groups


class DocumentIds:
    """Ids of whole texts by the tokenizers library.  Texts are split into the pattern's pieces by vector operations;
    pieces that a table of a fixed size does not hold are encoded by the library, and so are whole texts with an added token's string."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = PieceTable(self._make)
        classes()
        give_back()  # what was needed to read the vocabulary and the character classes

    def _make(self, pieces: list[str]) -> list[np.ndarray]:
        # a few pieces at a time: what the library returns for each is a hundred times its ids
        some = (pieces[at : at + 1024] for at in range(0, len(pieces), 1024))
        return [np.array(e.ids, np.uint32) for x in some for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text.  Long texts go through the table part by part, so that its vectors stay small."""
        out = []
        for x in texts:
            if len(x) > PART and not any(s in x for s in self.specials):
                out.append(np.concatenate([self._ids([part])[0] for part in parts(x)]))
            else:
                out.append(None)
        short = [x for x, done in zip(texts, out, strict=True) if done is None]
        rest = iter(self._ids(short) if short else [])
        return [next(rest) if done is None else done for done in out]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        ids, at, _, _ = self.table.lookup(texts)
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i, x in enumerate(texts):
            if any(s in x for s in self.specials):
                out[i] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32)
        return out


#: Characters of a part, about, and where a text can be cut: a single space between other characters always begins a piece.
PART, _CUT = 1 << 16, re.compile(r"(?<=[^\s]) (?=[^\s])")


def parts(text: str):
    """The text in parts of about ``PART`` characters whose pieces are those of the whole text; longer where it has no single space."""
    at = 0
    while len(text) - at > 2 * PART and (cut := _CUT.search(text, at + PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=2)
def _ids(path: str) -> DocumentIds:
    return DocumentIds(path)


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole sequences, then the binary digits of the rest, largest first."""
    pieces = [(at, longest) for at in range(0, n - longest + 1, longest)]
    start, rest = n - n % longest, n % longest
    for k in range(longest.bit_length() - 1, -1, -1):
        if rest >> k & 1:
            pieces.append((start, 1 << k))
            start += 1 << k
    return pieces


def pack(docs: DataFrame, vocabulary: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0), bucket (= length); ``with_ids`` adds the ids.

    ``vocabulary`` is a tokenizers .json with the byte-level pattern; ``longest`` is a power of two.  A null or empty text is one piece of the end id alone.
    ``sequence_id`` is unique over all rows, repeated or null ids included: it numbers
    the rows of each input split, so it is the same when a lost task runs again.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        with no_cycles():
            yield from packed(batches)

    def packed(batches):
        coder = _ids(vocabulary)
        for batch in batches:
            first = 0
            for group in text_groups(batch.column(1).to_pylist()):
                ids, rows, blobs = [], [], []
                for i, own in enumerate(coder.of(group), first):
                    raw = own.astype("<u4").tobytes() + tail
                    n = len(raw) // 4
                    for start, length in binary_pieces(n, longest):
                        blob = raw[4 * start : 4 * (start + length)]
                        ids.append(i)
                        rows.append((start, length, zlib.crc32(blob), n))
                        if with_ids:
                            blobs.append(blob)
                start, length, crc, total = zip(*rows, strict=True) if rows else ((),) * 4
                arrays = [batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    flat = pa.array(memoryview(b"".join(blobs)).cast("I").tolist(), pa.int64())
                    ends = [0]
                    for x in length:
                        ends.append(ends[-1] + x)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                    names.append("ids")
                first += len(group)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    pieces = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).mapInArrow(lean(run), schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")}).withColumnRenamed("id", doc_id)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Packed pieces as Parquet in one folder for each length (at most 2 + log2 of the longest of them)."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
