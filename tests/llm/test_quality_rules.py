import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from foliospark.llm.quality_rules import QUANTILES, RATIOS, labelled_sample, learn_rules, score_quality, without_rejects

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    marked = {j for k, w in enumerate(windows) if counts[w] > 1 for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeated = len(words), len(marked)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(1, 5)))
    found = [None, "", " \n\t ", "one", "a b", "a b a b a b", "x y z\nx y z\n\nx y z", "a\x0bb\x0cc\rd", "#*$ <b> & | %"]
    for _ in range(40):
        words = [word() for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.5:
            words += words[: rng.randint(0, len(words))]
        found.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    return found + [found[-1], " ".join(f"w{k}" for k in range(30_000))]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_statistics_by_brute_force(spark, docs_of):
    rows = list(enumerate(texts()))
    got = score_quality(docs_of(rows), labels(spark, [])).collect()
    told = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got}
    assert told == {i: brute(t) for i, t in rows}
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # without labels there are no rules


@pytest.fixture(scope="module")
def junk():
    rng = random.Random(5)
    rows, told = [], []
    for k in range(400):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200))]
        bad = k % 4 == 0
        rows.append((k, " ".join(w + rng.choice("#$%") if bad and rng.random() < 0.7 else w for w in words)))
        told.append((k, int(not bad), 0))
    return rows, told


def test_rules_are_learned_and_take_effect(spark, docs_of, junk):
    rows, told = junk
    docs = docs_of([*rows, (1000, None), (1001, "")])
    got = {r["doc_id"]: r["kept"] for r in score_quality(docs, labels(spark, told)).collect()}
    assert not got[1000] and not got[1001]
    assert all(got[k] == bool(quality) for k, quality, _ in told)
    left = without_rejects(docs, labels(spark, told))
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, kept in got.items() if kept)


def test_empty_table(spark, docs_of):
    assert score_quality(docs_of([]), labels(spark, [(1, 0, 0), (1, 1, None), (None, 0, 0)])).count() == 0
    assert without_rejects(docs_of([]), labels(spark, [])).count() == 0


def test_as_many_rules_as_there_are_kinds_of_junk(spark, docs_of):
    """Kinds of junk that no single condition tells from good texts; ids with several texts and labels count once."""
    rng = random.Random(8)
    marks = ["#", "!", "7", "Q"]
    rows, told = [], []
    for k in range(1500):
        kind = k % 5
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        rows.append((k, " ".join(marks[kind] * 2 + w[2:] if kind < 4 and rng.random() < 0.6 else w for w in words)))
        told.append((k, int(kind == 4), 0))
    docs, known = docs_of([*rows, (4, rows[4][1] + " more")]), labels(spark, [*told, told[4]])
    sample = labelled_sample(docs, known, "doc_id", "text", "quality", 10_000)
    assert sample.count() == 1500
    rules = learn_rules(sample)
    assert len(rules) >= 4 and all(r.conditions for r in rules)
    got = {r["doc_id"]: (r["kept"], r["rule"]) for r in score_quality(docs, known).collect()}
    assert sum(got[k][0] != bool(quality) for k, quality, _ in told) <= 15
    assert {r for _, r in got.values()} == set(range(len(rules) + 1))


def plain_covering(rows, names, points):
    """Sequential covering by loops over rows: (bad, held, statistics by name) to rules as lists of (statistic, threshold, above)."""
    cuts = {n: [(a + b) / 2 for a, b in zip(sorted(set(points[n])), sorted(set(points[n]))[1:])] for n in names}  # noqa: B905
    meets = lambda r, c: r[2][c[0]] > c[1] if c[2] else r[2][c[0]] <= c[1]

    def gain(before, after):
        p0, n0, p, n = (sum(r[0] == bad for r in some) for some in (before, after) for bad in (1, 0))
        return p * (math.log2((p + 1) / (p + n + 1)) - math.log2((p0 + 1) / (p0 + n0 + 1))) if p and p0 else 0.0

    rules = []
    while True:
        covered, chosen = [r for r in rows if not r[1]], []
        while any(r[0] for r in covered) and not all(r[0] for r in covered):
            best, found = 1e-9, None
            for name in names:
                for t in cuts[name]:
                    for above in (False, True):
                        g = gain(covered, [r for r in covered if meets(r, (name, t, above))])
                        if g > best:
                            best, found = g, (name, t, above)
            if not found:
                break
            chosen.append(found)
            covered = [r for r in covered if meets(r, found)]
        if not chosen:
            return rules
        worth = []
        for k in range(1, len(chosen) + 1):
            held = [r for r in rows if r[1] and all(meets(r, c) for c in chosen[:k])]
            p = sum(r[0] for r in held)
            worth.append(((2 * p - len(held)) / max(1, len(held)), -k, p, len(held)))
        _, k, p, n = max(worth)
        if n < 4 or p < 0.97 * n:
            return rules
        rules.append(chosen[:-k])
        rows = [r for r in rows if not all(meets(r, c) for c in rules[-1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_by_a_plain_covering(spark, seed):
    """On random statistics, where some kinds are bad, some labels are wrong and many conditions gain alike."""
    rng = random.Random(seed)
    rows = []
    for _ in range(700):
        stats = {n: float(rng.randint(0, 12)) for n in RATIOS}
        a, b, c = (stats[n] for n in list(RATIOS)[:3])
        bad = (a > 8 and b <= 5) or c > 10
        rows.append((int(bad if rng.random() < 0.998 else not bad), int(rng.random() < 0.34), stats))
    sample = spark.createDataFrame([(*[r[2][n] for n in RATIOS], r[0], bool(r[1])) for r in rows], ", ".join([*(f"_{n} double" for n in RATIOS), "bad int", "held boolean"]))
    points = sample.agg(*[F.percentile_approx(f"_{n}", [i / QUANTILES for i in range(1, QUANTILES)], 1000).alias(n) for n in RATIOS]).first()
    got = [[(c.stat[1:], c.threshold, c.above) for c in r.conditions] for r in learn_rules(sample)]
    assert got == plain_covering(rows, list(RATIOS), points)
    assert got
