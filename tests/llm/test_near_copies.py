import random

import numpy as np
import pytest

import corpus_pipeline
from foliospark.llm import near_copies
from foliospark.llm.simhash import fingerprint


def shingle_set(text):
    words = (text or "").lower().translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def lowest_of_groups(rows):
    """The ids that stay, from all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted(low.values())


def edited(rng, words, places):
    out = list(words)
    for at in rng.sample(range(len(out)), places):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("small", [near_copies.SMALL_BUCKET, 2])
def test_stage_by_brute_force(spark, docs_of, monkeypatch, small):
    """Copies on both sides of a similarity of 0.8, in groups and chains, with a line that all share; also by rounds of pivots."""
    monkeypatch.setattr(near_copies, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_copies, "MORE_PIVOTS", 4)
    rng = random.Random(5)
    line = "this very common line stands in nearly every document of the table".split()
    rows = []
    for _ in range(14):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 260))] + line
        rows.append(base)
        for _ in range(rng.randint(0, 9)):
            rows.append(edited(rng, rng.choice(rows[-3:]), rng.randint(1, 1 + len(base) // 25)))
    rng.shuffle(rows)
    rows = [(k, " ".join(r)) for k, r in enumerate(rows)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one  TWO"), (305, rows[3][1].upper()), (306, "É a b c d e"), (307, "é A b c d e")]
    docs = docs_of(rows)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == lowest_of_groups(rows)


def test_stage_finds_pairs_beyond_three_bits(spark, docs_of):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**5)}" for _ in range(200)]
    near = next(t for _ in range(200) if bin(fingerprint(" ".join(t := edited(rng, base, 4))) ^ fingerprint(" ".join(base))).count("1") > 3)
    kept = corpus_pipeline.near_dedup(spark, docs_of([(1, " ".join(base)), (2, " ".join(near))]), "")
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_prefix_is_the_first_in_one_order():
    common, rank = np.array([2, 5]), np.array([1, 0])
    assert near_copies.prefix(np.array([1, 2, 3, 5, 9]), common, rank).tolist() == [1, 3]
    assert near_copies.prefix(np.array([2, 5]), common, rank).tolist() == [5]
    assert near_copies.prefix(np.array([2, 5]), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == [2]


def test_repeated_ids_and_empty_table(spark, docs_of):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A b c"), (3, "x y z")]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()) == [1, 3]
    assert corpus_pipeline.near_dedup(spark, docs_of([]), "").count() == 0


def test_very_long_texts_and_an_id_named_n(docs_of):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(base)), (2, " ".join(edited(rng, base, 3000))), (3, " ".join(edited(rng, base, 30_000))), (4, "word " * 400_000), (5, "word " * 300_000)]
    docs = docs_of(rows).drop("_id").withColumnRenamed("doc_id", "n")
    kept = near_copies.without_similar(docs, "n")
    assert kept.columns == docs.columns and sorted(r["n"] for r in kept.collect()) == [1, 3, 4]


def test_a_line_that_all_texts_share(docs_of):
    """Three hundred texts begin with one line; every group of near copies among them is found."""
    rng = random.Random(8)
    line = "one line at the head of each text".split()
    rows = []
    for _ in range(100):
        base = [f"w{rng.randrange(10**5)}" for _ in range(rng.randint(20, 90))]
        rows += [line + base, line + edited(rng, base, 1), line + edited(rng, base, len(base) // 2)]
    rows = [(k, " ".join(r)) for k, r in enumerate(rows)]
    kept = near_copies.without_similar(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == lowest_of_groups(rows)
