import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from foliospark.llm.suffix_dedup import LENGTH, Prefixes, common_extension, found_twice, remove_repeats, runs_of, suffix_sort


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + LENGTH] for d in data for k in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - LENGTH + 1):
            if seen[d[k : k + LENGTH]] > 1:
                cover[k : k + LENGTH] = True
        cover = cover[:-1]
        kept = bytes(b for b, c in zip(d, cover, strict=True) if not c)
        out.append((len(d), int(cover.sum()), int((cover & ~np.r_[False, cover[:-1]]).sum()) if len(d) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(25)
    found = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "d" * 5000, "ab" * 400, prose(2000)]
    for _ in range(25):  # the passage in other texts, with an edit in some
        p = passage.split()
        if rng.random() < 0.5:
            p[rng.randrange(len(p))] = word()
        found.append(prose(rng.randint(0, 60)) + " " + " ".join(p) + " " + prose(rng.randint(0, 60)))
    found += [prose(20) + " " + line + " " + prose(20) for _ in range(12)]  # under the length: stays
    near = prose(300).split()
    for _ in range(12):
        copy = list(near)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        found.append(" ".join(copy))
    twice = prose(80)
    return [*found, found[9], found[9], twice + "|" + twice]


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_brute_force_on_all_paths(docs_of):
    rows = list(enumerate(texts()))
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows]), strict=True)), key=str)
    assert any(w[2] for w in want)
    assert result(remove_repeats(docs_of(rows))) == want  # sorted suffix by suffix
    assert result(remove_repeats(docs_of(rows), most_runs=1, block=300)) == want  # dealt by the strings' digests; texts in many blocks
    again = [*rows, rows[8], (None, "z" * 300)]  # repeated and null ids: rows are numbered
    want = sorted(((i, *b) for (i, _), b in zip(again, brute([t for _, t in again]), strict=True)), key=str)
    assert result(remove_repeats(docs_of(again))) == want


def test_suffix_sort_orders_strings():
    rng = random.Random(8)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode() + b"a" * 600, np.uint8)
    prefixes = Prefixes(data, len(data) + 1)
    starts = np.array(sorted(rng.sample(range(len(data) - LENGTH), 800)))
    group = np.repeat(np.arange(8), 100)
    order = suffix_sort(data, prefixes, starts, group)
    for g in range(8):
        cut = [data[s : s + LENGTH].tobytes() for s in starts[order[g * 100 : g * 100 + 100]]]
        assert cut == sorted(data[s : s + LENGTH].tobytes() for s in starts[g * 100 : g * 100 + 100])
    a, b = starts[:-1], starts[1:]
    slow = [next((k for k in range(LENGTH) if data[x + k] != data[y + k]), LENGTH) for x, y in zip(a, b, strict=True)]
    assert common_extension(prefixes, a, b).tolist() == slow


def test_blocks_give_the_same_strings():
    data = np.frombuffer(texts()[8].encode() + b"z" * 900, np.uint8)
    for size in (1 << 19, 1000, 7):
        found = list(runs_of(data, size))
        start, count, distance = (np.concatenate([f[k] for f in found]) for k in (3, 4, 5))
        assert np.array_equal(np.repeat(start, count) + np.concatenate([np.arange(c) for c in count]), np.arange(len(data) - LENGTH + 1))
        assert ((distance - count + 1 >= 0) & (distance <= LENGTH - 50)).all()


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_colliding_hashes_remove_nothing_wrong(monkeypatch, bits):
    """With hashes of few bits the sort goes astray, but whatever it finds twice is there twice."""
    whole = Prefixes.hashes
    monkeypatch.setattr(Prefixes, "hashes", lambda self, a, n: whole(self, a, n) & np.uint64((1 << bits) - 1))
    rng = random.Random(3)
    run = "".join(rng.choice("abc") for _ in range(260))
    runs = [run, "x" + run[1:], run[:-1] + "y", "".join(rng.choice("abc") for _ in range(260)), run]
    data, n = np.frombuffer("".join(runs).encode(), np.uint8), 260 - LENGTH + 1
    found = found_twice(data, np.arange(5) * 260, np.full(5, n), np.full(5, n), np.zeros(5, np.int64))
    strings = [r[k : k + LENGTH] for r in runs for k in range(n)]
    times = Counter(strings)
    assert all(times[s] > 1 for s, f in zip(strings, found, strict=True) if f)
    if bits == 64:
        assert all(f == (times[s] > 1) for s, f in zip(strings, found, strict=True))


def test_empty_table(docs_of):
    assert remove_repeats(docs_of([])).count() == 0
