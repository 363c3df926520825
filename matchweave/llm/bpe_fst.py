"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

**Encoder.**  While the bytes of a piece are read, several tokenisations are
still possible; they differ only behind their last common token.  A state is
that common token, the anchor, together with the bytes read since (these two
determine the last token of each prefix).  On a byte the machine finds
the last token of the longer prefix, keeps the tokenisations that a later token
can still start from, and emits the tokens that all of them share.  A token is
thus emitted after a bounded lookahead: less than the longest token's bytes.
States and arcs are made when a piece first needs them, one for each piece, so
that frequent beginnings are found first; when the bounded table is full, or
behind a piece's new arc, the same step is simulated without keeping states, and
the ids of whole short pieces are remembered in a bounded memory.

**Decoder.**  ``Utf8Stream`` is the incremental UTF-8 machine: token bytes go
in one token at a time, whole characters come out as soon as they are complete,
and malformed bytes become U+FFFD by the maximal-subpart rule.  Each document's ids are
decoded as one stream (``Codec.decode``).

A null text counts as empty: no ids, both digests of no bytes.  An empty table gives an empty result; a text or
a word of any length is taken whole, in memory that grows with it; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matchweave.llm.bpe import Remembered, Vocabulary
from matchweave.llm.shared import no_cycles, utf8

#: Bounds of a worker's tables of arcs, and of each of two generations of whole pieces.
ARCS, PIECES = 120_000, 500_000


class State:
    """pending: the bytes since the anchor; last: the anchor, then the last token of each prefix of them."""

    __slots__ = ("pending", "last", "arcs", "final")

    def __init__(self, pending: bytes, last: tuple[bytes, ...]):
        self.pending, self.last = pending, last
        self.arcs: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.final: tuple[int, ...] | None = None


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.start = State(b"", (b"",))
        self.states: dict[tuple[bytes, bytes], State] = {(b"", b""): self.start}
        self.arcs = 0

    def _ids(self, last, cut: int) -> tuple[int, ...]:
        """The ids of the first ``cut`` pending bytes."""
        out = []
        while cut:
            token = last[cut]
            out.append(self.vocabulary.ids[token])
            cut -= len(token)
        return tuple(out[::-1])

    def _arc(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The arc of a state for a byte: the determinisation step."""
        v = self.vocabulary
        text = state.pending + bytes((byte,))
        n = cut = len(text)
        last = (*state.last, v.last_token(text, n, state.last))
        if text in v.open:
            cut = 0
        else:  # a later token starts at the end, or where all bytes to the end are the beginning of some token: find the last cut that all these share
            for end in range(n - 1, 0, -1):
                if text[end:] in v.open:
                    while end != cut:
                        if end > cut:
                            end -= len(last[end])
                        else:
                            cut -= len(last[cut])
                    if not cut:
                        break
        anchor, pending = (last[cut], text[cut:]) if cut else (last[0], text)
        to = self.states.get((anchor, pending))
        if to is None:
            to = self.states[anchor, pending] = State(pending, last[cut:])
        self.arcs += 1
        state.arcs[byte] = arc = (to, self._ids(last, cut))
        return arc

    def _simulate(self, state: State, rest: bytes) -> tuple[int, ...]:
        """All ids still to come for the ``rest`` of a piece, without making states."""
        text, last = state.pending + rest, list(state.last)
        self.vocabulary.fill(text, last)
        return self._ids(last, len(text))

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece.  It may make one arc, while the table has room; behind that the piece is simulated."""
        state, out, grows = self.start, [], self.arcs < ARCS
        for at, byte in enumerate(piece):
            arc = state.arcs.get(byte)
            if arc is None:
                if not grows:
                    out += self._simulate(state, piece[at:])
                    return out
                grows = False
                arc = self._arc(state, byte)
            state, ids = arc
            if ids:
                out += ids
        if state.final is None:
            state.final = self._ids(state.last, len(state.pending))
        out += state.final
        return out


def _utf8_table() -> dict[tuple[int, int], int]:
    """Arcs of the UTF-8 machine.  State 0 is between characters; 1, 2, 3 wait for so many plain continuation bytes; 4-7 restrict the
    next byte after E0 (A0-BF), ED (80-9F), F0 (90-BF) and F4 (80-8F)."""
    arcs = {(0, b): 0 for b in range(0x80)}
    leads = [(range(0xC2, 0xE0), 1), ([0xE0], 4), (range(0xE1, 0xED), 2), ([0xED], 5), (range(0xEE, 0xF0), 2), ([0xF0], 6), (range(0xF1, 0xF4), 3), ([0xF4], 7)]
    arcs |= {(0, b): to for span, to in leads for b in span}
    follow = {1: (0x80, 0xC0, 0), 2: (0x80, 0xC0, 1), 3: (0x80, 0xC0, 2), 4: (0xA0, 0xC0, 1), 5: (0x80, 0xA0, 1), 6: (0x90, 0xC0, 2), 7: (0x80, 0x90, 2)}
    return arcs | {(s, b): to for s, (low, high, to) in follow.items() for b in range(low, high)}


UTF8_ARCS = _utf8_table()


class Utf8Stream:
    """Incremental UTF-8: ``feed`` bytes, get the characters that are complete; ``close`` flushes what is open."""

    def __init__(self):
        self.state, self.held = 0, bytearray()

    def feed(self, data: bytes) -> str:
        if not self.state and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            to = UTF8_ARCS.get((self.state, b))
            if to is None and self.state:  # the open character is broken; the byte starts anew
                out.append("�")
                self.held.clear()
                to = UTF8_ARCS.get((0, b))
            if to is None:
                out.append("�")
                self.state = 0
                continue
            self.held.append(b)
            self.state = to
            if not to:
                out.append(self.held.decode("utf-8"))
                self.held.clear()
        return "".join(out)

    def close(self) -> str:
        out = "�" if self.state else ""
        self.state = 0
        self.held.clear()
        return out


def _whole(token: bytes) -> str | None:
    """What a token is between characters, if it ends between characters too."""
    stream = Utf8Stream()
    text = stream.feed(token)
    return text if not stream.state else None


class Codec(Remembered):
    """piece -> its ids, by the transducer; ``decode`` takes a stream of ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__(PIECES)
        self.transducer = Transducer(vocabulary)
        self.tokens = {i: t for t, i in vocabulary.ids.items()}
        self.digits = {i: b"%d" % i for i in self.tokens}
        #: The arcs from state 0 back to it for whole tokens; None where a token leaves a character open.
        self.whole = {i: _whole(t) for i, t in self.tokens.items()}
        self.pieces = regex.compile(pattern).findall

    def make(self, piece: str) -> tuple[int, ...]:
        return tuple(self.transducer.encode(utf8(piece)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> str:
        """The text of a stream of ids, token by token: by arcs for whole tokens while no character is open, byte by byte from
        a token that leaves one open until it is closed."""
        parts = list(map(self.whole.__getitem__, ids))
        stream, at = Utf8Stream(), -1
        while True:
            try:
                at = parts.index(None, at + 1)
            except ValueError:
                break
            parts[at] = stream.feed(self.tokens[ids[at]])
            while stream.state and at + 1 < len(parts):
                at += 1
                parts[at] = stream.feed(self.tokens[ids[at]])
        parts.append(stream.close())
        return "".join(parts)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(Vocabulary.from_json(path) if path.endswith(".json") else Vocabulary.from_tiktoken(path), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to).

    ``with_ids`` adds the ids themselves (array<int>) and the decoded text.  Each
    match of ``pattern`` is encoded by itself.  Repeated rows and null ids are handled row by row.
    """

    def run(batches):
        with no_cycles():
            yield from encoded(batches)

    def encoded(batches):
        coder = codec(vocabulary, pattern)
        digits = coder.digits.__getitem__
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                ids = coder.encode(x or "")
                decoded = coder.decode(ids)
                rows.append((len(ids), hashlib.sha256(b",".join(map(digits, ids))).hexdigest(), hashlib.sha256(utf8(decoded)).hexdigest()))
                if with_ids:
                    rows[-1] += (ids, decoded)
            n, a, b, *more = zip(*rows, strict=True) if rows else ((), (), ()) + ((), ()) * with_ids
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(more[0], pa.list_(pa.int32())), pa.array(more[1], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", doc_id)
