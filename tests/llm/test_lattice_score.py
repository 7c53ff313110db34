"""Scores against every segmentation written out and a plain word model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliospark.llm import lattice_score as L

PATH = public_tokenizers.path(L.VOCABULARY)


@pytest.fixture(scope="module")
def pieces():
    return L.pieces_of(PATH)


def segmentations(string, index):
    """Every way to write a string as pieces, as lists of their numbers."""
    if not string:
        yield []
    for n in range(1, len(string) + 1):
        if string[:n] in index:
            for rest in segmentations(string[n:], index):
                yield [index[string[:n]], *rest]


def by_hand(word, index, p):
    return sum(math.prod(p[k] for k in found) for found in segmentations(" " + word.decode("latin-1"), index))


WORDS = [b"a", b"the", b"there", "é".encode(), "日本".encode(), b"xq#9", "▁t".encode(), b"\xff\x00"]


def test_lattice_is_the_sum_over_all_segmentations(pieces, monkeypatch):
    index = {s: k for k, s in enumerate(pieces.strings)}
    logs = np.log(pieces.prior)
    assert abs(pieces.prior.sum() - 1) < 1e-12
    want = [math.log(by_hand(w, index, pieces.prior)) if w else logs[-1] for w in [*WORDS, b""]]
    for bytes_ in (1, 12, 1 << 16):  # however many words are worked on at once
        monkeypatch.setattr(L, "BYTES_AT_ONCE", bytes_)
        assert np.allclose(L.word_logs([*WORDS, b""], pieces, logs), want, rtol=1e-12)
    # a literal mark of a word's beginning isn't a blank
    marked, plain = L.word_logs(["▁t".encode(), b"t"], pieces, logs)
    assert marked < plain


def test_expected_counts(pieces):
    index = {s: k for k, s in enumerate(pieces.strings)}
    want = Counter()
    for word in WORDS:
        for found in segmentations(" " + word.decode("latin-1"), index):
            for k in found:
                want[k] += math.prod(pieces.prior[j] for j in found) / by_hand(word, index, pieces.prior)
    lattices = L.Lattices(WORDS, pieces, np.log(pieces.prior))
    got = np.bincount(lattices.piece, lattices.expected(), len(pieces.prior))
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-15) for k in range(len(got)))


def model_by_hand(rows, rounds):
    """doc rows (id, text) to (held, n_tokens, n_known, N, base, score), all by plain loops."""
    pieces = L.pieces_of(PATH)
    index = {s: k for k, s in enumerate(pieces.strings)}
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    p = pieces.prior
    for _ in range(rounds):
        counts = len(p) * pieces.prior
        for w in c:
            if not w:
                counts[-1] += 1
                continue
            total = by_hand(w, index, p)
            for found in segmentations(" " + w.decode("latin-1"), index):
                for k in found:
                    counts[k] += math.prod(p[j] for j in found) / total
        p = counts / counts.sum()

    def word(w):
        sub = by_hand(w, index, p) if w else p[-1]
        return math.log10((max(c[w] - d, 0) + d * v * sub) / n if n else sub)

    known = {}
    out = []
    for i, t in rows:
        ws = tokens(t)
        for w in ws:
            if w not in known:
                known[w] = word(w)
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), sum(known[w] for w in ws)))
    return out


def close(got, want):
    order = lambda r: (r[0] is None, *(x or 0 for x in r))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-5), (g, w)


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def sample(n):
    rng = random.Random(3)
    vocabulary = ["the", "The", "a", "cat", "né", "x#1", "日", "ab\x85c"] + [f"w{k}" for k in range(60)]
    return [(k, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randint(0, 30)))) for k in range(n)]


@pytest.mark.parametrize("frequent", [0, 5, 1 << 16])
def test_scores_by_hand_for_any_number_of_frequent_words(docs_of, frequent):
    rows = [*sample(40), (100, None), (101, ""), (102, "  \n"), (103, "same"), (103, "same"), (103, "other"), (None, "no id"), (None, "no id either")]
    close(L.score_texts(docs_of(rows), held_out(), rounds=1, frequent=frequent).collect(), model_by_hand(rows, 1))


def test_two_rounds(docs_of):
    rows = sample(25)
    close(L.score_texts(docs_of(rows), held_out(), rounds=2).collect(), model_by_hand(rows, 2))


def test_without_training_rows_and_empty_table(docs_of):
    rows = [(k, "a cat") for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    got = L.score_texts(docs_of(rows), held_out())
    close(got.collect(), model_by_hand(rows, 0))
    assert L.score_texts(docs_of([]), held_out()).count() == 0


def test_very_long_texts_and_words(docs_of, monkeypatch):
    monkeypatch.setattr(L, "WORDS_AT_ONCE", 100)
    rows = [(1, "ab" * 200_000), (2, "ab" * 200_000), (3, "the " * 200_000), (4, " ".join(map(str, range(3000))))]
    got = {r["doc_id"]: r for r in L.score_texts(docs_of(rows), held_out(), rounds=1).collect()}
    assert got[1]["n_tokens"] == 2 and got[3]["n_tokens"] == 200_001 and got[4]["n_tokens"] == 3001
    assert got[1]["score"] == got[2]["score"] and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values())


def test_known_text_is_likelier_than_its_scramble(docs_of):
    rows = sample(60)
    rows += [(1000, "the cat a cat"), (1001, "eht tac a tca")]
    got = {r["doc_id"]: r["score"] for r in L.score_texts(docs_of(rows), F.col("doc_id") >= 1000).collect()}
    assert got[1000] > got[1001]
