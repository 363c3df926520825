"""Byte-level BPE vocabularies, and which pairs of tokens can stand side by side.

BPE of a piece is the only sequence of tokens that spells it and in which every
two neighbours are *stable*: merging the bytes of the two alone gives the two
back.  Token counting (``token_count``) and the transducer (``bpe_fst``) both
build on this, so neither runs merges over a text.
"""

from __future__ import annotations

import base64
import json

import ahocorasick

#: No rank; bound of a worker's memory of pairs, which starts anew when full.
NEVER, PAIRS = 1 << 40, 150_000


class Remembered(dict):
    """What ``make`` gives for a key, remembered in two generations of a bounded size: when the new one is full, the old one goes.
    Keys longer than ``LONGEST`` are made anew each time, so the memory is bounded in bytes too."""

    LONGEST = 64

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for the 256 bytes: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes with their merge ranks and ids."""

    def __init__(self, ranks: dict[bytes, int], ids: dict[bytes, int], specials: dict[str, int]):
        self.ranks, self.ids, self.specials = ranks, ids, specials
        self.longest = max(map(len, ids))
        #: Proper prefixes of tokens: where a token that is still open can stand.
        self.open = {t[:n] for t in ids for n in range(1, len(t))}
        self._edges: dict[bytes, tuple[list, list]] = {}
        self._stable: dict[tuple[bytes, bytes], bool] = {}
        #: Finds all tokens that end at each byte of a text (in Latin-1), the longest first.
        self.matches = ahocorasick.Automaton()
        for token in ids:
            if token:
                self.matches.add_word(token.decode("latin-1"), token)
        self.matches.make_automaton()

    @classmethod
    def from_tiktoken(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        return cls(ranks, ranks, {})

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        read = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = {read(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        return cls({read(a) + read(b): i for i, (a, b) in enumerate(merges)}, ids, {t["content"]: t["id"] for t in spec["added_tokens"]})

    def edges(self, token: bytes) -> tuple[list, list]:
        """What stands at the left edge and at the right edge of a token while BPE builds it: for each edge, from
        a byte to the whole, (part, rank of the merge that replaces this part); empty if BPE never makes the token."""
        known = self._edges.get(token)
        if known is None:
            parts = [token[i : i + 1] for i in range(len(token))]
            left, right = [[parts[0], NEVER]], [[parts[-1], NEVER]]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                for edge, part in ((left, parts[0]), (right, parts[-1])):
                    if len(part) != len(edge[-1][0]):
                        edge[-1][1] = rank
                        edge.append([part, NEVER])
            known = self._edges[token] = (left, right) if len(parts) == 1 else ([], [])
        return known

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether BPE of ``left + right`` is just these two tokens.

        While both are built side by side, a merge over the border comes about if its rank is below that of the
        next merge at the left one's right edge, and not above that at the right one's left edge (of equal ranks the leftmost merges first).
        """
        key = (left, right)
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > PAIRS:
                self._stable.clear()
            known = self._stable[key] = self._meet(self.edges(left)[1], self.edges(right)[0])
        return known

    def _meet(self, left: list, right: list) -> bool:
        if not left or not right:
            return False
        rank, i, j = self.ranks.get, 0, 0
        while True:
            (a, next_a), (b, next_b) = left[i], right[j]
            over = rank(a + b, NEVER)
            if over < next_a and over <= next_b and over != NEVER:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def fill(self, text: bytes, last: list[bytes]) -> None:
        """Appends to ``last``, which has the last tokens of BPE of the shorter prefixes of ``text``, those of all others."""
        known, end = self._stable.get, len(last)
        for at, token in self.matches.iter(text.decode("latin-1")):
            if at + 1 == end:
                before = last[end - len(token)]
                fits = known((before, token)) if before else bool(self.edges(token)[0])
                if fits or (fits is None and self.stable(before, token)):
                    last.append(token)
                    end += 1
        if end <= len(text):
            raise ValueError(f"no token of the vocabulary ends {text[:end]!r}")

    def last_token(self, text: bytes, end: int, last: list[bytes]) -> bytes:
        """The last token of BPE of ``text[:end]``, given those of all shorter prefixes."""
        ids, known = self.ids, self._stable.get
        for start in range(end - self.longest if end > self.longest else 0, end):
            token = text[start:end]
            if token in ids:
                before = last[start]
                if not before:
                    if self.edges(token)[0]:
                        return token
                    continue
                fits = known((before, token))
                if fits or (fits is None and self.stable(before, token)):
                    return token
        raise ValueError(f"no token of the vocabulary ends {text[:end]!r}")
