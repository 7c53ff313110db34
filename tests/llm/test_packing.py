import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliospark.llm import packing
from foliospark.llm.packing import VOCABULARY, Ids, pack, piece_bounds, plan

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(found):
    return np.frombuffer(found, "<u4").tolist()


def test_ids_equal_the_tokenizers_library(tokenizer, monkeypatch):
    rng = random.Random(1)
    parts = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x1F600, 0x4E2D, 0xFEFF, 0x10FFFF]] + ["<|endoftext|>", "<|endof", "'s", "'LL", "\r\n", "  ", " the"]
    plain = [p for p in parts if not packing.OTHER_SPACE.search(p)] + [" ", "\n", "\t"] * 40
    texts = ["".join(rng.choice(parts if k % 2 else plain) for _ in range(rng.randint(0, 50))) for k in range(3000)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids(f) for f in Ids(PATH).of_texts(texts)] == want
    for name, value in (("CHARS_AT_ONCE", 20), ("REMEMBERED", 5)):
        monkeypatch.setattr(packing, name, value)
        assert [ids(f) for f in Ids(PATH).of_texts(texts)] == want


@pytest.mark.parametrize("unit", [" ", "\n", " \t", "a", "é", "\u00a0", " the", "word  \n\n and"])
def test_ids_of_very_long_texts(tokenizer, unit):
    texts = [unit * ((10_000_000 if unit == " " else 1_000_000) // len(unit)), "x" + unit * (2_200_000 // len(unit)) + "y"]
    for text, found in zip(texts, Ids(PATH).of_texts(texts), strict=True):
        assert np.array_equal(np.frombuffer(found, "<u4"), np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))


def check_plan(counts, capacity):
    patterns = plan(counts, capacity)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= capacity and times > 0
        for n in pattern:
            used[n] += times
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(times for _, times in patterns)


def test_plan_uses_exact_complements():
    assert check_plan({600: 5, 424: 5}, 1024) == 5  # singles
    assert check_plan({600: 4, 300: 4, 124: 4}, 1024) == 4  # pairs
    assert check_plan({400: 3, 300: 3, 200: 3, 124: 3}, 1024) == 3  # triples
    assert check_plan({512: 7}, 1024) == 4
    assert check_plan({}, 1024) == 0
    assert check_plan({513: 3, 511: 2, 256: 1, 255: 1}, 1024) == 3  # counts run out in the middle
    assert check_plan({341: 6, 342: 3}, 1024) == 3  # a pair of equal lengths
    rng = random.Random(2)
    for capacity in (7, 32, 100):
        for _ in range(30):
            counts = {n: rng.randint(0, 5) for n in range(1, capacity + 1)}
            bound = -(-sum(n * c for n, c in counts.items()) // capacity)
            assert bound <= check_plan(counts, capacity) <= 1.2 * bound + 2


def test_piece_bounds():
    assert piece_bounds(3, 4) == [(0, 3)] and piece_bounds(4, 4) == [(0, 4)]
    assert piece_bounds(9, 4) == [(0, 1), (1, 4), (5, 4)] and piece_bounds(8, 4) == [(0, 4), (4, 4)]


def test_pack_round_trip(docs_of, tokenizer):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "of", "x1", "é", "foo"]) for _ in range(rng.choice([0, 3, 50, 400, 3000])))) for k in range(60)]
    rows += [(100, None), (101, ""), (100, None), (None, "null id"), (102, "<|endoftext|>")]
    got = pack(docs_of(rows)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        copies = sum(r[0] == doc_id for r in rows)
        want = [(k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(piece_bounds(len(ids), 1024))] * copies
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc_id]) == sorted(want)
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 1024) + 3


def test_empty_table(docs_of):
    assert pack(docs_of([])).count() == 0
