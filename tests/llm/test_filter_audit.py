"""The transducer and its hash table against plain Python, the audit against every order applied by hand, and the query against DuckDB."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np

from foliospark.llm import filter_audit
from foliospark.llm.filter_audit import Transducer, audit_filters, counts_of, first_of_kind

WORD = r"[^\x20\x09-\x0D]+"


def by_hand(rows, labels):
    """rows (id, text, part): every order applied to every row."""
    found, kinds = {}, []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(WORD, text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        mine = [x for x in labels if i is not None and x[0] == i]
        kinds.append((part or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    for part in {k[0] for k in kinds}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [k for k in kinds if k[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [k for k in left if f in k[1]]
                redundant = sum(f in k[1] for k in gone)
                left = [k for k in left if f not in k[1]]
                gone += here
                shapley[f] += len(here)
                unique = sum(k[0] == part and k[1] == {f} for k in kinds)
                found[part, "".join(order), step] = [len(left), len(here), redundant, unique, sum(k[2] for k in here), sum(k[3] for k in here), f]
        for key, v in found.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return sorted((*k, *v) for k, v in found.items())


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, 0, "x", "x", "x", "x") for i, t, p in rows], "doc_id long, text string, source string, words long, bits string, part string, digest string, _id string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def words_like(k, n, distinct):
    return " ".join(f"w{(k * 7 + j) % distinct}" for j in range(n))


ROWS = [
    (1, None, None), (2, "", "a"), (3, "", "a"), (4, words_like(1, 300, 200), "a"), (5, words_like(1, 300, 200), "b"), (5, words_like(1, 300, 200), "b"), (6, words_like(2, 300, 100), "b"),
    (7, "AB " * 250, "b"), (8, "# " + words_like(3, 220, 220), "c"), (9, words_like(4, 100, 60) + " é\U0001f600 | X", None), (None, words_like(1, 300, 200), "a"), (None, words_like(1, 300, 200), "a"),
    (10, words_like(1, 200, 100), "a"), (11, words_like(1, 199, 199), "a"), (12, "A" * 2 + "b" * 98, "c"), (13, "A" * 3 + "b" * 97, "c"), (13, "other text", "c"),
]
LABELS = [(1, 1, 0), (3, 1, 1), (4, 0, 1), (5, 1, 0), (5, None, 1), (6, 1, 1), (7, None, None), (None, 1, 1), (13, 1, 0), (99, 1, 1)]


def test_audit_by_hand_with_nulls_ties_and_repeats(spark):
    docs, labels = tables(spark, ROWS, LABELS)
    assert sorted(map(tuple, audit_filters(docs, labels).collect())) == by_hand(ROWS, LABELS)


def test_one_text_and_one_source_hold_most_rows(spark):
    rows = [(k, "THE SAME # TEXT", "hot") for k in range(400)] + [(1000 + k, words_like(k, 210, 150), "cold") for k in range(5)]
    docs, labels = tables(spark, rows, [(k, k % 2, int(k % 9 == 0)) for k in range(0, 400, 3)])
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit_filters(docs, labels).collect()}
    assert len(got) == 2 * 120 * 5
    assert got["hot", "EABCD", 1]["removed"] == 399 and got["hot", "EABCD", 2]["removed"] == 1 and got["hot", "EABCD", 2]["redundant"] == 399
    assert got["cold", "ABCDE", 5]["kept"] == 5 and got["cold", "ABCDE", 5]["shapley"] == 0


def test_empty_tables(spark):
    docs, labels = tables(spark, [], [])
    assert audit_filters(docs, labels).count() == 0
    docs, _ = tables(spark, ROWS[:3], [])
    assert {r["good_lost"] for r in audit_filters(docs, labels).collect()} == {0}


def test_query_matches_sql(spark, tmp_path):
    # DuckDB's labels join knows no null ids
    docs, labels = tables(spark, [r for r in ROWS if r[0] is not None], [x for x in LABELS if x[0] is not None])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    told = con.sql(filter_audit.ORACLE_SQL["op11_filter_audit"])
    got = filter_audit.op11_filter_audit(spark, str(tmp_path))
    assert got.columns == told.columns
    assert sorted(map(tuple, got.collect())) == sorted(told.fetchall())


def counted(texts):
    enc = [t.encode() for t in texts]
    return [tuple(map(int, x)) for x in zip(*counts_of(Transducer(), np.frombuffer(b"".join(enc), np.uint8), np.cumsum([0, *map(len, enc)])), strict=True)]


def told(text):
    words = re.findall(WORD, text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def test_transducer_on_random_texts():
    alphabet = ["a", "B", "é", "\U0001f600", " ", "\n", "#", "|", "word", "x" * 64, "x" * 65, "y" * 200, "\x85", " ", "\x0b", "\x00"]
    rng = random.Random(5)
    for _ in range(200):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 0, 1, 3, 20, 300]))) for _ in range(rng.randint(1, 9))]
        assert counted(texts) == [told(t) for t in texts]


def test_transducer_on_very_long_texts():
    texts = ["word " * 500_000 + "X" * 1_000_000, "", "z" * 2_000_000, " ".join(map(str, range(300_000)))]
    assert counted(texts) == [told(t) for t in texts]


def test_colliding_spans_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "span_hashes", lambda windows, data, owner, start, length: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"ab cd ab ab cd abc ab", np.uint8)
    start, length = np.array([0, 3, 6, 9, 12, 15, 19]), np.array([2, 2, 2, 2, 2, 3, 2])
    new = first_of_kind(data, np.array([0, 0, 0, 0, 0, 0, 1]), start, length)
    assert new.sum() == 4  # ab, cd, abc, and ab of another text
