import math
import random
import time
import zlib

from pyspark.sql import functions as F

from foliospark.llm.toxicity import FOLDING, Lexicon, folded, held_out, learn_lexicon, score_toxicity, total_weight, training_rows


def test_folding():
    assert folded("L0ser, ŁÖSÉR") == folded("loser  loser")
    assert folded("іdіоt") == folded("1D10T") == folded("idiot")
    assert folded("\U0001d408\U0001d403\U0001d408\U0001d40e\U0001d413") == folded("IDIOT") and folded("ⒾⒹⒾⓄⓉ") == folded("idiot")  # capitals after decomposition
    assert all(folded(chr(k)) == v for k, v in FOLDING.items() if v)
    assert folded("st​upid") == folded("stupid") == folded("ｓｔｕｐｉｄ")


def test_weights_and_exceptions():
    lexicon = Lexicon({f" {folded('clown')} ": 2.0, f" {folded('stup')}": 1.0}, (f" {folded('clown')} fish ",))
    weigh = lambda t: total_weight(folded(t), lexicon.automaton())
    assert weigh("a CL0WN and stupidity") == (3.0, 4)
    assert weigh("a clown fish") == (0.0, 3) and weigh("a clown fish, clown!")[0] == 2.0
    assert weigh("") == (0.0, 0) and weigh("unstupid clowns") == (0.0, 2)
    assert total_weight("x", Lexicon().automaton()) == (0.0, 1)


def test_learned_words_are_found_in_held_out_texts(spark, docs_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkm") for _ in range(rng.randint(3, 8)))
    bad = ["zounder", "quibbler", "wretchy"]
    rows, told = [], []
    for k in range(600):
        words = [word() for _ in range(rng.randint(20, 200))]
        if k % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad).upper().replace("E", "3" if rng.random() < 0.5 else "E")
        rows.append((k, " ".join(words)))
        told.append((k, 1, int(k % 5 == 0)))
    docs = docs_of([*rows, (1000, None), (1001, "")])
    labels = spark.createDataFrame([*told, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = learn_lexicon(training_rows(docs, labels, "doc_id", "text", "toxic", 10_000))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in score_toxicity(docs, lexicon).collect()}
    assert len(got) == 602 and got[1000] == got[1001] and got[1000][1] == 0
    wrong = [k for k, _, toxic in told if got[k][1] != toxic]
    assert len(wrong) <= 6


def test_no_labels_and_empty_table(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = learn_lexicon(training_rows(docs_of([(1, "a")]), none, "doc_id", "text", "toxic", 10))
    assert [r["predicted"] for r in score_toxicity(docs_of([(1, "a")]), lexicon).collect()] == [0]
    assert score_toxicity(docs_of([]), lexicon).count() == 0


def slow_score(text, lexicon):
    """By the definition: every place of every entry, held against every place of every phrase."""
    words = folded(text or "").split()
    text = f" {' '.join(words)} "
    places = lambda e: [(k, k + len(e)) for k in range(len(text)) if text.startswith(e, k)]
    excused = [p for e in lexicon.exceptions for p in places(e)]
    weight = sum(w for e, w in lexicon.weights.items() for a, b in places(e) if not any(x <= a and b <= y + 1 for x, y in excused))
    c = lexicon.curve
    return 1 / (1 + math.exp(-max(-30, min(30, c[0] + c[1] * math.log1p(max(weight, 0)) + c[2] * math.log1p(max(weight, 0) * 100 / max(len(words), 1))))))


def test_scores_by_brute_force(docs_of):
    rng = random.Random(7)
    lexicon = Lexicon({" ab": 1.5, " abc ": 0.5, " bad ": 2.0, " x ": 0.25}, (" bad ab ", " a bad ", " c x c "), (-1.0, 0.7, 0.2))
    texts = [" ".join(rng.choice(["ab", "abc", "bad", "BAD", "x", "c", "a", "Аb", "4b", "zebra"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = [*enumerate(texts), (500, None), (501, ""), (500, None), (None, texts[3])]
    got = score_toxicity(docs_of(rows), lexicon).collect()
    assert len(got) == len(rows)
    want = {r[0]: slow_score(r[1], lexicon) for r in rows}
    assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_a_very_long_text_takes_linear_time():
    lexicon = Lexicon({" bad ": 2.0}, (" bad ab ",))
    began = time.perf_counter()
    assert total_weight(folded("bad ab bad x " * 250_000), lexicon.automaton()) == (500_000.0, 1_000_000)
    assert time.perf_counter() - began < 20


def test_held_out_rows_teach_nothing(spark, docs_of):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    docs = docs_of([(k, f"verywicked word{k}" if k % 2 else f"fine word{k}") for k in ids])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in ids], "doc_id long, quality int, toxic int")
    assert training_rows(docs, labels, "doc_id", "text", "toxic", 10_000).count() == 0
    assert [r[0] for r in spark.createDataFrame([(k,) for k in range(400)], "i long").filter(held_out(F.col("i"))).orderBy("i").collect()] == ids
