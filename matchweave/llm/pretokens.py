"""The pieces of the byte-level pattern for many texts at once, and a table of what pieces are worth.

``public_tokenizers.PATTERN`` splits a text into contractions, runs of letters,
of digits and of other marks, each with one space before it if there is one, and
white space.  Where the pieces begin depends only on the classes of neighbouring
characters, so a block of texts is split by a few vector operations instead of
a regular expression; ``starts`` gives the same pieces as the pattern does.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex

from matchweave.llm.shared import span_hashes, utf8

LETTER, DIGIT, OTHER, SPACE, BORDER = range(5)
#: Stands between texts of a block; no text can hold it, as it is no character.
BETWEEN = 0x110000
#: What the pattern takes together with an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, by the pattern's own character classes.  Code points that are not assigned in
    ``unicodedata`` are marks, as the tokenizers library takes them, though newer tables know letters and digits among them."""
    out = np.full(BETWEEN + 1, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, BETWEEN)))
    for kind, name in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
            out[a:b] = kind
    out[[c for c in np.flatnonzero(out != OTHER).tolist() if unicodedata.category(chr(c)) == "Cn"]] = OTHER
    out[BETWEEN] = BORDER
    return out


def block_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts with a border before each and at the end, and the places of the borders."""
    encoded = [x.encode("utf-32-le", "surrogatepass") for x in texts]
    ends = np.cumsum([0] + [len(x) // 4 + 1 for x in encoded])
    border = BETWEEN.to_bytes(4, "little")
    return np.frombuffer(border + b"".join([x + border for x in encoded]), np.uint32), ends


def starts(codes: np.ndarray) -> np.ndarray:
    """Where the pieces of a block of texts begin; each border is a piece of its own."""
    kind = classes()[codes]
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    plain = codes == 32
    space = kind == SPACE
    solid = ~space & (kind != BORDER)
    # the last white space before a solid character stands alone, and if it is a space the character joins it
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & solid[1:]
    start |= last
    joins = np.zeros(n, bool)
    joins[1:] = last[:-1] & plain[:-1]
    start &= ~joins
    start[kind == BORDER] = True
    # an apostrophe that begins a piece takes a contraction's letters
    quote = np.flatnonzero((codes == 39) & start & ~joins)
    if len(quote):
        taken = np.zeros(n, np.int64)
        free = quote[(kind[quote - 1] != OTHER)]
        padded = np.concatenate((codes, np.full(3, BETWEEN, np.uint32)))
        for c in sorted(CONTRACTIONS, key=len):
            fits = np.ones(len(free), bool)
            for i, letter in enumerate(c, 1):
                fits &= padded[free + i] == ord(letter)
            taken[free[fits]] = len(c)
        for at, size in zip(*(x.tolist() for x in (np.flatnonzero(taken), taken[taken > 0])), strict=True):
            start[at + 1 : at + 1 + size] = False
            if kind[at + 1 + size] != BORDER and not space[at + 1 + size]:
                start[at + 1 + size] = True
    return np.flatnonzero(start)


def pieces(text: str) -> list[str]:
    """The pieces of one text."""
    codes, _ = block_codes([text])
    at = starts(codes).tolist()  # the first and the last are the borders
    return [text[a - 1 : b - 1] for a, b in zip(at[1:-1], at[2:], strict=True)]


class PieceTable:
    """What ``make`` gives for pieces, ids as unsigned 32-bit numbers, in a table of a fixed size with one place for each hash.

    A piece is known again by its place and two independent hashes of its bytes (``shared.span_hashes``), 85 bits in all, and in a
    block of texts by two hashes of 64 bits; two different pieces are taken for equal with a probability of 2**-85 for a pair of them.
    A piece with more than ``WIDTH`` ids, or with one beyond 16 bits, is made anew each time; a place that another piece needs is overwritten.
    """

    BITS, WIDTH = 21, 6

    def __init__(self, make):
        self.make = make  # list of pieces -> list of arrays of ids
        self.rows = np.zeros((1 << self.BITS, 5 + self.WIDTH), np.uint16)  # 32 bits of both hashes, the number of ids (0: free), the ids

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids before each text and in all, ids of each piece, first piece of each text and the end)."""
        codes, ends = block_codes(texts)
        begin = starts(codes)
        end = np.append(begin[1:], len(codes))
        solid = codes[begin] != BETWEEN
        begin, end = begin[solid], end[solid]
        # the same places in UTF-8, where a border is one byte
        data = np.frombuffer(b"\n" + b"".join([utf8(x) + b"\n" for x in texts]), np.uint8)
        width = 1 + (codes >= 0x80).view(np.int8) + (codes >= 0x800).view(np.int8) + ((codes >= 0x10000) & (codes != BETWEEN)).view(np.int8)
        width[codes == BETWEEN] = 1
        place = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        low, high = place[begin], place[end]
        h, second = span_hashes(data, low, high), span_hashes(data, low, high, second=True)
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        row = self.rows[slot]
        name = np.stack((h.astype(np.uint32), second.astype(np.uint32)), 1).view(np.uint16)
        known = (row[:, :4] == name).all(1) & (row[:, 4] > 0)
        size = row[:, 4].astype(np.int64)
        row = row[:, 5:]
        missing = np.flatnonzero(~known)
        apart: dict[int, np.ndarray] = {}
        if len(missing):
            _, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            other = np.flatnonzero(second[missing] != second[missing[first]][back])  # pieces that share the first hash alone
            at = missing[np.concatenate((first, other))]
            made = self.make([data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(low[at].tolist(), high[at].tolist(), strict=True)])
            back[other] = len(first) + np.arange(len(other))
            n = np.array([len(x) for x in made], np.int64)
            short = (n <= self.WIDTH) & np.array([not len(x) or x.max() < 1 << 16 for x in made])
            packed = np.zeros((len(made), self.WIDTH), np.uint16)
            flat = np.concatenate([x for x, s in zip(made, short.tolist(), strict=True) if s] or [np.zeros(0, np.uint32)])
            packed[short] = _spread(flat, n[short], self.WIDTH)
            size[missing], row[missing] = n[back], packed[back]
            self.rows[slot[at[short]]] = np.concatenate((name[at[short]], n[short, None].astype(np.uint16), packed[short]), 1)
            for i in np.flatnonzero(~short[back]).tolist():
                apart[int(missing[i])] = made[back[i]]
        first_piece = np.searchsorted(begin, ends)
        total = np.concatenate(([0], np.cumsum(size)))
        ids = np.zeros(total[-1], np.uint32)
        narrow = size <= self.WIDTH
        narrow[list(apart)] = False
        for k in range(self.WIDTH):
            has = np.flatnonzero(narrow & (size > k))
            ids[total[has] + k] = row[has, k]
        for i, x in apart.items():
            ids[total[i] : total[i + 1]] = x
        return ids, total[first_piece], size, first_piece


def _spread(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of up to ``width`` numbers, padded with zeros, from all their numbers in a row."""
    out = np.zeros((len(sizes), width), np.uint16)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
