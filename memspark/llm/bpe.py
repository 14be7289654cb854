"""Byte-pair merges of many words at once, on numpy arrays.

All pieces of a slice are one flat array of symbols. A round finds the pair with the best rank of every piece, merges it
where it stands first, and looks up the ranks of the two pairs beside it; pieces without a known pair leave the array.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from memspark.llm.textbatch import constants

_NONE = np.int32(2**31 - 1)
#: Code points of plain words: letters, digits and signs whose lower case is one character, and which nothing composes with.
_PLAIN_RANGES = ((0x21, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC))
_TOP = 0x2C80
_LETTER, _NUMBER, _OTHER = 1, 2, 3


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable bytes stand for themselves, the others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class (0: not plain) and lower case of every code point below _TOP."""
    kind, lower = np.zeros(_TOP, np.int8), np.arange(_TOP, dtype=np.int64)
    for lo, hi in _PLAIN_RANGES:
        for c in range(lo, hi + 1):
            low = chr(c).lower()
            if len(low) == 1 and ord(low) < _TOP:
                lower[c] = ord(low)
                major = unicodedata.category(low)[0]
                kind[c] = _LETTER if major == "L" else _NUMBER if major == "N" else _OTHER
    return kind, lower


_KIND, _LOWER = _tables()


class WordMerges:
    """Ids of plain words by a vocabulary of lower-case pieces whose last byte bears an end-of-word sign."""

    def __init__(self, path: str, end: str = "</w>"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, b in letters.items():
            self.inner[b], self.last[b] = vocab[c], vocab[c + end]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        # a table with as many rows as keys share a slot
        self.factor, self.shift = constants(1, 71)[0], np.uint64(64 - 18)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        nth = np.arange(len(keys)) - np.searchsorted(slot[order], slot[order])
        self.keys = np.full((nth.max() + 1, 1 << 18), -1, np.int64)
        self.ranks = np.full(self.keys.shape, _NONE, np.int32)
        self.keys[nth, slot[order]], self.ranks[nth, slot[order]] = keys[order], order

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.factor) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        out = np.full(len(key), _NONE, np.int32)
        for keys, ranks in zip(self.keys, self.ranks, strict=True):
            hit = np.flatnonzero(keys[slot] == key)
            out[hit] = ranks[slot[hit]]
        return out

    def merged(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of pieces of ``symbols`` that start at ``first`` (none is empty)."""
        n = len(first)
        piece = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.append(first, len(symbols))))
        rank = np.full(len(symbols), _NONE, np.int32)
        if len(symbols) > 1:
            inside = np.flatnonzero(piece[1:] == piece[:-1])
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        done_ids, done_pieces = [], []
        while len(symbols):
            size = np.diff(np.append(first, len(symbols)))
            best = np.minimum.reduceat(rank, first)
            ready = best == _NONE
            if ready.any():
                of = np.repeat(ready, size)
                done_ids.append(symbols[of])
                done_pieces.append(piece[of])
                symbols, piece, rank, best, size = symbols[~of], piece[~of], rank[~of], best[~ready], size[~ready]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.append(True, piece[at][1:] != piece[at][:-1])]
            symbols[at] = self.made[best]
            rank[at] = rank[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, piece, rank = symbols[keep], piece[keep], rank[keep]
            at -= np.arange(len(at))
            size -= 1
            first = np.cumsum(size) - size
            right = at[at + 1 < first + size]
            rank[right] = self.rank(symbols[right], symbols[right + 1])
            left = at[at > first] - 1
            rank[left] = self.rank(symbols[left], symbols[left + 1])
        ids, of = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (done_ids, done_pieces))
        count = np.bincount(of, minlength=n)
        begin = np.cumsum(count) - count
        new = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])  # a piece's ids stand together
        out = np.empty_like(ids)
        out[np.arange(len(ids)) + np.repeat(begin[of[new]] - new, count[of[new]])] = ids
        return out, count

    def words(self, data: bytes, most: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each word, words left out) of words that a space ends each.

        A word is left out, with no ids, if it isn't plain or has a piece of more than ``most`` bytes.
        """
        point = np.frombuffer(data.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        kind = _KIND[np.minimum(point, _TOP - 1)]
        space = point == 0x20
        ends = np.flatnonzero(space)
        word = np.cumsum(space) - space
        left_out = np.zeros(len(ends), bool)
        left_out[word[(kind == 0) & ~space]] = True
        point = _LOWER[np.minimum(point, _TOP - 1)]
        kind[space] = 0
        start = np.ones(len(point), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        # an apostrophe alone takes the letters of a short form with it
        quotes = np.flatnonzero((point == 0x27) & start)
        after = lambda k: point[np.minimum(quotes + k, len(point) - 1)]
        one = np.isin(after(1), [*b"stmd"])
        pair = after(1) * 256 + after(2)
        two = ~one & np.isin(pair, [a * 256 + b for a, b in (b"re", b"ve", b"ll")])
        for q, n in ((quotes[one], 1), (quotes[two], 2)):
            start[q + 1] = False
            start[np.minimum(q + 1 + n, len(point) - 1)] = True
        n_bytes = 1 + (point >= 0x80) + (point >= 0x800)
        # bytes of what stays
        stays = ~space & ~left_out[word]
        lengths = np.add.reduceat(np.where(stays, n_bytes, 0), np.flatnonzero(start)) if len(point) else np.zeros(0, np.int64)
        long = np.flatnonzero(start)[lengths > most]
        if len(long):
            left_out[word[long]] = True
            stays &= ~left_out[word]
        symbols = np.frombuffer(point[stays].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        at = np.cumsum(n_bytes[stays]) - n_bytes[stays]
        first = at[start[stays]]
        ids = self.inner[symbols]
        last = np.append(first[1:], len(symbols)) - 1
        if len(first):
            ids[last] = self.last[symbols[last]]
        found, n = self.merged(ids, first)
        counts = np.bincount(word[stays][start[stays]], weights=n, minlength=len(ends)).astype(np.int64) if len(first) else np.zeros(len(ends), np.int64)
        return found, counts, np.flatnonzero(left_out)
