"""Token counts by a byte-level BPE vocabulary compiled into a counting transducer.

Two facts make the count a finite-state computation. First, the last token of a text's encoding is the one vocabulary
entry that ends there and may stand beside the last token of what is before it; so a state needs the longest suffix
that still may begin an entry, with the last token and the relative count at each place in it. States and transitions
are built when first met, and each transition carries the change of the token count. A chunk maps entry states to exit
states and counts, and maps of adjacent chunks compose. Second, a space after a character that is no white space always
begins a new pre-token, whatever came before: there every state leads to the start state. Chunks between such places
(units) are mostly words; their maps are constant, so the prefix scan over all units of a slice of texts is one
cumulative sum, and equal units are worked out once. A pre-token of any length is cut into chunks of CHUNK bytes. Each chunk's map is made
without its predecessor's, for the states that the bytes before it lead to, and the maps are composed by the tree of a parallel prefix scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from memspark.llm.bpe import byte_letters
from memspark.llm.textbatch import byte_table, distinct, slices, tidy

#: Bytes of a chunk of a pre-token, and of texts that are worked on together.
CHUNK, SLICE = 1 << 12, 1 << 21
#: Most states and most remembered units of a worker (beyond them the tables start anew; results don't change), and the longest unit, in bytes.
MOST_STATES, MOST_UNITS, REMEMBERED = 250_000, 500_000, 64
# Fixed value: the published pre-token pattern of this kind of vocabulary.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Bytes before a chunk from which its entry states are guessed.
LOOK_BACK = (24, 48, 96)
_NOWHERE = (b"", 0)
_MARKS = frozenset(",.;:!?")
_SPACE = byte_table(bytes([0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]))
# White space of two and three bytes, as UTF-8.
_SPACES = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class Transducer:
    """Counts the tokens of pre-tokens, byte by byte."""

    def __init__(self, vocabulary: list[bytes], merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        self.tokens = set(vocabulary)
        self.prefixes = {t[:k] for t in vocabulary for k in range(1, len(t))}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int, int]]] = {}
        self.alone: dict[bytes, bool] = {}
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.start()

    @classmethod
    def of_file(cls, path: str) -> Transducer:
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        return cls([raw(t) for t in model["vocab"]], [(raw(a), raw(b)) for a, b in pairs])

    def start(self) -> None:
        # a state: (suffix, last token at each place in it, count at each place relative to its end)
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.state((b"", (None,), (0,)))

    def state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        return found

    def merged(self, text: bytes) -> list[bytes]:
        """The encoding of a short text by the merges themselves."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """What stands at the left (0) or right (1) edge of ``token`` while it is built: (part, rank of the merge that makes it, rank of the merge that ends it)."""
        found = self.edges.get((token, side))
        if found is None:
            chain = [token]
            while chain[-1] in self.parts:
                chain.append(self.parts[chain[-1]][side])
            made = [self.rank[self.parts[t]] if t in self.parts else -1 for t in chain]
            found = self.edges[token, side] = list(zip(chain, made, [1 << 40, *made], strict=False))
        return found

    def may_follow(self, left: bytes | None, token: bytes) -> bool:
        """Whether an encoding may hold ``token`` right after ``left`` (None: at the start): no merge crosses the place between them."""
        fits = self.alone.get(token)
        if fits is None:
            fits = self.alone[token] = self.merged(token) == [token]
        if not fits or left is None:
            return fits
        found = self.beside.get((left, token))
        if found is None:
            found = self.beside[left, token] = not any(
                max(made_x, made_y) < min(end_x, end_y) and (r := self.rank.get((x, y))) is not None and r < end_x and r <= end_y
                for x, made_x, end_x in self.edge(left, 1)
                for y, made_y, end_y in self.edge(token, 0)
            )
        return found

    def ending(self, state: int, byte: int) -> tuple[bytes, int]:
        """(last token, change of the count) after ``byte``."""
        suffix, last, count = self.keys[state]
        longer = suffix + bytes((byte,))
        for k in range(len(longer)):
            token = longer[k:]
            if token in self.tokens and self.may_follow(last[k], token):
                return token, count[k] + 1
        raise ValueError("the vocabulary lacks a byte")

    def step(self, state: int, byte: int) -> tuple[int, int]:
        token, change = self.ending(state, byte)
        suffix, last, count = self.keys[state]
        longer = suffix + bytes((byte,))
        # a place counts on only where an entry may begin that goes on beyond the end
        places = [*((last[k], count[k] - change) if longer[k:] in self.prefixes else _NOWHERE for k in range(len(longer))), (token, 0)]
        drop = 0
        while places[drop] is _NOWHERE:
            drop += 1
        lasts, counts = zip(*places[drop:], strict=True)
        found = self.steps[state][byte] = (self.state((longer[drop:], lasts, counts)), change)
        return found

    def run(self, state: int, chunk: bytes) -> tuple[int, int]:
        """(exit state, tokens) of ``chunk`` entered in ``state``."""
        total, steps = 0, self.steps
        for b in chunk:
            state, change = steps[state].get(b) or self.step(state, b)
            total += change
        return state, total

    def count(self, piece: bytes) -> int:
        """The tokens of a piece; the state after its last byte isn't needed, and isn't built."""
        state, n = self.run(0, piece[:-1])
        known = self.steps[state].get(piece[-1])
        n += known[1] if known else self.ending(state, piece[-1])[1]
        self.tidy()
        return n

    def tidy(self) -> None:
        if len(self.keys) > MOST_STATES:
            self.start()
            self.beside.clear()


class ChunkMap:
    """What a chunk does to states of the transducer: entry state to (exit state, tokens).

    A map is made of the chunk alone and the LOOK_BACK bytes before it: its entries are the states that these bytes lead to from the start
    state, begun at several places, as the state soon forgets what came earlier. An entry that isn't among them is worked out when a
    composition asks for it, so the result doesn't depend on the guess.
    """

    def __init__(self, transducer: Transducer, chunk: bytes, before: bytes = b""):
        self.transducer, self.chunk, self.known = transducer, chunk, {}
        for state in {transducer.run(0, before[-n:])[0] for n in LOOK_BACK} if before else (0,):
            self(state)

    def __call__(self, state: int) -> tuple[int, int]:
        found = self.known.get(state)
        if found is None:
            found = self.known[state] = self.transducer.run(state, self.chunk)
        return found


class Composed:
    """The map of adjacent chunks: the entries of the left one, led on by the right one."""

    def __init__(self, left: ChunkMap | Composed, right: ChunkMap | Composed):
        self.left, self.right, self.known = left, right, {}
        for state in left.known:
            self(state)

    def __call__(self, state: int) -> tuple[int, int]:
        found = self.known.get(state)
        if found is None:
            middle, n = self.left(state)
            end, more = self.right(middle)
            found = self.known[state] = end, n + more
        return found


def prefix_scan(maps: list[ChunkMap | Composed]) -> list[ChunkMap | Composed]:
    """The map of every prefix of ``maps``, by the tree of a parallel scan: neighbours are composed in pairs, the scan of the pairs fills every second
    prefix, and one more composition each the others."""
    if len(maps) < 2:
        return list(maps)
    pairs = prefix_scan([Composed(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
    return [maps[0], *(pairs[i // 2] if i % 2 else Composed(pairs[i // 2 - 1], m) for i, m in enumerate(maps[1:], 1))]


class Units(dict):
    """Token counts of units: texts that begin and end where pre-tokens surely do.

    A unit leads every state to the start state, so its map is its count, and maps of units compose by adding.
    """

    def __init__(self, transducer: Transducer, special: list[str], chunk: int = CHUNK):
        super().__init__()
        self.transducer, self.chunk = transducer, chunk
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.firsts = sorted({t.encode()[0] for t in special})

    @classmethod
    def of_file(cls, path: str) -> Units:
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens", [])
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that take white space or whole words only aren't known here")
        return cls(Transducer.of_file(path), [t["content"] for t in added])

    def pre_token(self, piece: bytes) -> int:
        if len(piece) <= self.chunk:
            return self.transducer.count(piece)
        places = range(0, len(piece), self.chunk)
        maps = [ChunkMap(self.transducer, piece[i : i + self.chunk], piece[max(0, i - LOOK_BACK[-1]) : i]) for i in places]
        _, n = prefix_scan(maps)[-1](0)
        self.transducer.tidy()
        return n

    def __missing__(self, unit: bytes) -> int:
        text = unit.decode()
        body = text[1:] if text[0] == " " else text
        if body.isalpha():
            n = self.pre_token(unit)
        elif body[-1:] in _MARKS and body[:-1].isalpha():
            n = self[unit[:-1]] + 1
        else:
            n = sum(self.pre_token(m[0].encode()) for m in PRE_TOKENS.finditer(text))
        if len(unit) <= REMEMBERED:
            if len(self) > MOST_UNITS:
                self.clear()
            self[unit] = n
        return n

    def of_slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The count of every text of a slice, special strings as one token each."""
        found = {}
        if self.special is not None:
            spots = np.flatnonzero(np.isin(data, self.firsts))
            for i in np.unique(np.searchsorted(offsets, spots, "right") - 1).tolist():
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                n = len(self.special.findall(text))
                if n:
                    parts = [p.encode() for p in self.special.split(text)]
                    at = np.cumsum([0, *map(len, parts)])
                    found[i] = n + int(self.of_texts(np.frombuffer(b"".join(parts), np.uint8), at).sum())
        out = self.of_texts(data, offsets)
        out[list(found)] = list(found.values())
        return out

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        units = Pieces(data, np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], sure_places(data)))
        first, index = distinct(units)
        raw = data.tobytes()
        counts = np.array([self[raw[a:b]] for a, b in zip(units.start[first].tolist(), units.end[first].tolist(), strict=True)], np.int64)
        # the scan over all units of the slice; a text's count is what its last prefix has above its first
        total = np.concatenate([[0], np.cumsum(counts[index])])
        return np.diff(total[np.searchsorted(units.start, offsets)])


class Pieces:
    """Bounds of consecutive pieces of ``data`` that begin at ``start``."""

    def __init__(self, data: np.ndarray, start: np.ndarray):
        self.data, self.start, self.end = data, start, np.append(start[1:], len(data)) if len(start) else start


def sure_places(data: np.ndarray) -> np.ndarray:
    """Places of spaces after a character that is no white space: a pre-token begins there, whatever came before."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    last = data[at - 1]
    sure = ~_SPACE[last]
    high = np.flatnonzero(last >= 0x80)
    if len(high):
        place = at[high]
        two, three = data[place - 2].astype(np.int64) << 8 | last[high], data[np.maximum(place - 3, 0)].astype(np.int64) << 16
        sure[high] = ~(np.isin(two, _SPACES) | np.isin(three | two, _SPACES))
    return at[sure]


_counters: dict[str, Units] = {}


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (n_tokens above ``limit``) of every row of ``docs``.

    ``path`` is a byte-level BPE file that every executor has. A null text counts as empty (0 tokens); rows are counted
    one by one, so repeated rows repeat; an empty table gives none. There is no shuffle. A task's memory follows a slice
    of SLICE bytes, or one text if that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _counters.get(path) or _counters.setdefault(path, Units.of_file(path))
        for batch in batches:
            for part, data, offsets in slices(batch, "_text", SLICE):
                n = units.of_slice(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias(key), docs[text].alias("_text"))
    return rows.mapInArrow(tidy(run), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
