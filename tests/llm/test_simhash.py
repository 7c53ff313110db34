import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from foliospark.llm.simhash import LARGE_BUCKET, chain_passed, fingerprint, links_in_buckets, near_dedup, near_links, without_near_copies
from foliospark.operators.graph import components


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def lowest(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                root[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        low[find(k)] = min(low.get(find(k), i), i)
    return [low[find(k)] for k in range(len(ids))]


def test_fingerprint_by_brute_force():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "a b", "É A b\x0bc d e"] + [" ".join(rng.choice("abcDEé") for _ in range(rng.randint(1, 60))) for _ in range(30)]:
        assert fingerprint(text) == slow_fingerprint(text)


def test_links_lose_nothing(spark):
    """Fingerprints around a few centres, some buckets beyond the small size: same components as all pairs."""
    rng = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([3, 20, 150])):
            f = centre
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = lowest(signed, fps)
    for largest in (LARGE_BUCKET, 40, 3):  # keys of one length, of all, and pairs of blocks
        roots = {r["node"]: r["root"] for r in components(near_links(classes, largest)).collect()}
        assert [roots.get(f, f) for f in signed] == want


def test_near_dedup_by_brute_force(docs_of):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(300)) for _ in range(6)]
    rows = [(k, rng.choice(base)) for k in range(20)]
    for k in range(20, 50):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    rows += [(60, None), (61, ""), (62, "\n"), (63, rows[3][1].upper()), (3, rows[3][1])]
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted((i, f, c) for (i, _), f, c in zip(rows, fps, lowest([i for i, _ in rows], fps), strict=True))
    docs = docs_of(rows)
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in near_dedup(docs).collect()) == want
    left = without_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, _, c in want})


def test_empty_table(docs_of):
    assert near_dedup(docs_of([])).count() == 0
    assert len(links_in_buckets(np.zeros(1, np.int64), np.zeros(1, np.uint64))[0]) == 0


def test_chains_pass_all_pairs_within_the_budget(spark):
    rng = random.Random(3)
    pairs = []
    for k in range(400):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), k % 28):
            b ^= 1 << bit
        pairs.append((*np.array([a, b], np.uint64).view(np.int64).tolist(), k % 28))
    got = spark.createDataFrame(pairs, "a long, b long, d int").select("d", chain_passed(F.col("a"), F.col("b"), 20, 8).alias("near"), chain_passed(F.col("a"), F.col("b"), 3, 4).alias("nearer"))
    for r in got.collect():
        assert r["near"] == (r["d"] <= 20) and r["nearer"] == (r["d"] <= 3)


def test_a_very_long_text_and_an_empty_table(docs_of):
    text = "one two three four five " * 200_000
    assert {r["component_id"] for r in near_dedup(docs_of([(5, text), (2, text + "six"), (9, "other words in here")])).collect()} == {2, 9}
    assert without_near_copies(docs_of([])).count() == 0
