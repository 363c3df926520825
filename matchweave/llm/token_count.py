"""Token counts: prefix dynamic programming over byte-level BPE.

For every prefix of a piece the last token of its encoding is unique: it is the
token that ends there and is stable after the last token of what precedes it.
One pass from left to right therefore gives the exact count at *every* prefix,
and questions about truncation or budgets are look-ups in these counts.

Pieces (matches of the vocabulary's pattern) repeat, so the arrays of their prefix counts are
kept in a bounded memory in each worker, and a text's counts are these arrays in a row:
``TextCounts`` answers how many tokens a prefix takes and which prefix fits a budget from them, without encoding anything again.

A null text counts as empty: no bytes, no tokens.  Strings of added tokens (``specials``) inside a text are one token each, as
the library does by default.  Other columns are not read, whatever their names; an empty table gives an empty result.  A
text or a piece of any length is counted whole, in memory that grows with it; pieces too long to repeat are not remembered.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from functools import cached_property, lru_cache
from itertools import accumulate, chain
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from matchweave.llm.bpe import Remembered, Vocabulary
from matchweave.llm.pretokens import pieces as class_pieces
from matchweave.llm.shared import no_cycles, utf8

#: Bound of each of the two generations of pieces that a worker remembers.
PIECES = 700_000
#: Fixed value: the pattern of byte-level vocabularies, whose character classes ``pretokens`` knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixCounts(Remembered):
    """piece -> its exact token counts at every byte, ``counts[piece][n]`` of the first n bytes, as bytes where they fit."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(PIECES)
        self.vocabulary = vocabulary

    def make(self, piece: str) -> bytes | array:
        raw = utf8(piece)
        if piece in self.vocabulary.specials:
            return bytes(len(raw)) + b"\1"
        counts, last = [0], [b""]
        self.vocabulary.fill(raw, last)
        for end in range(1, len(raw) + 1):
            counts.append(counts[end - len(last[end])] + 1)
        return bytes(counts) if counts[-1] < 256 else array("I", counts)


_LAST = itemgetter(-1)


class TextCounts:
    """The token counts of a text at every prefix: those of its pieces in a row."""

    def __init__(self, parts: list[str], counts: PrefixCounts):
        self.parts, self.each = parts, list(map(counts.__getitem__, parts))
        self.n_tokens = sum(map(_LAST, self.each))

    @cached_property
    def tokens(self) -> list[int]:
        """Tokens before each piece, and of all."""
        return [0, *accumulate(map(_LAST, self.each))]

    @cached_property
    def ends(self) -> list[int]:
        """Bytes before each piece, and of all."""
        return [0, *accumulate([len(c) - 1 for c in self.each])]

    def at(self, size: int) -> int:
        """Tokens of the first ``size`` bytes."""
        piece = bisect_right(self.ends, size) - 1
        return self.tokens[piece] + (self.each[piece][size - self.ends[piece]] if piece < len(self.each) else 0)

    def longest_fit(self, budget: int) -> int:
        """Bytes of the longest prefix of at most ``budget`` tokens: whole pieces, then the longest prefix of the next
        that the budget allows and that ends between characters."""
        piece = bisect_right(self.tokens, budget) - 1
        size = sum(map(len, self.each[:piece])) - piece
        if piece == len(self.each):
            return size
        raw, rest = utf8(self.parts[piece]), budget - self.tokens[piece]
        return size + max((i for i, c in enumerate(self.each[piece]) if c <= rest and (i == len(raw) or raw[i] & 0xC0 != 0x80)), default=0)


def splitter(pattern: str, specials) -> callable:
    """text -> its pieces; strings of added tokens are pieces of their own, the text between them is split by itself."""
    find = class_pieces if pattern == PATTERN else regex.compile(pattern).findall
    if not specials:
        return find
    apart = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")").split

    def pieces(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return find(text)
        return list(chain.from_iterable([x] if x in specials else find(x) for x in apart(text)))

    return pieces


@lru_cache(maxsize=2)
def _counter(path: str, pattern: str):
    vocabulary = Vocabulary.from_json(path) if path.endswith(".json") else Vocabulary.from_tiktoken(path)
    return PrefixCounts(vocabulary), splitter(pattern, vocabulary.specials)


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit) and fit_bytes, the bytes of its longest prefix within the limit.

    ``vocabulary`` is the path of a tokenizers .json or a tiktoken file, the same on all
    executors.  Repeated rows and null ids are counted each by itself.
    """

    def run(batches):
        with no_cycles():
            yield from counted(batches)

    def counted(batches):
        counts, pieces = _counter(vocabulary, pattern)
        for batch in batches:
            n_bytes, n_tokens, fit = [], [], []
            for x in batch.column(1).to_pylist():
                x = x or ""
                found = TextCounts(pieces(x), counts)
                n_bytes.append(len(utf8(x)))
                n_tokens.append(found.n_tokens)
                fit.append(n_bytes[-1] if found.n_tokens <= limit else found.longest_fit(limit))
            n_tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), n_tokens, pc.greater(n_tokens, limit), pa.array(fit, pa.int64())], names=["id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")
    return out.withColumnRenamed("id", doc_id)
