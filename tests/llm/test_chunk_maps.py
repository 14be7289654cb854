"""op6: maps of chunks, made without their predecessors and composed by a scan tree, against the library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memspark.llm.token_counts import LOOK_BACK, PRE_TOKENS, ChunkMap, Composed, Units, prefix_scan

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("chunk", [1, 3, 7, 64, 4096])
def test_long_pre_tokens(library, chunk):
    rnd = random.Random(chunk)
    units = Units.of_file(PATH)
    units.chunk = chunk
    for _ in range(40):
        text = "".join(rnd.choice(["the", "ing", "a", "é", "ß", "x", "Z", "qu", "漢", "ab"]) for _ in range(rnd.randint(1, 200 if chunk < 64 else 4000)))
        text = rnd.choice([text, text.replace("é", "1"), "-=" * len(text), "aaaa" * len(text)])[:20_000]
        assert sum(units.pre_token(m[0].encode()) for m in PRE_TOKENS.finditer(text)) == len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_and_every_entry():
    rnd = random.Random(9)
    transducer = Units.of_file(PATH).transducer
    piece = "".join(rnd.choice(["tion", "the", "er", "x", "qu", "zz"]) for _ in range(300)).encode()
    maps = [ChunkMap(transducer, piece[i : i + 50], piece[max(0, i - LOOK_BACK[-1]) : i]) for i in range(0, len(piece), 50)]
    # a map is made of its chunk and the bytes before it; what it guesses is what the chunk before it gives
    for a, b in zip(maps, maps[1:], strict=False):
        assert {x for x, _ in a.known.values()} & set(b.known)
    entries = [0, *(transducer.run(0, w)[0] for w in (b"th", b"q", b"ti"))]
    for n, m in enumerate(prefix_scan(maps), 1):
        for state in entries:
            assert m(state) == transducer.run(state, piece[: 50 * n])
    # composing is associative
    for state in entries:
        assert Composed(Composed(maps[0], maps[1]), maps[2])(state) == Composed(maps[0], Composed(maps[1], maps[2]))(state)


def test_a_wrong_guess_changes_nothing():
    transducer = Units.of_file(PATH).transducer
    wrong = [ChunkMap(transducer, b"hello", b"zzz"), ChunkMap(transducer, b"world", b"qqqq")]
    assert prefix_scan(wrong)[-1](0) == transducer.run(0, b"helloworld")
