import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing
from foliospark.llm.mixing import mix_sources, target_rates


def copies(doc_id, rate, seed="mix-1"):
    draws = max(math.ceil(rate / 32), 1)
    total = 0
    for i in range(draws):
        u = int(hashlib.md5(f"{seed}|{'null' if doc_id is None else doc_id}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / draws)
        k = 0
        while c <= u and k < mixing.TERMS:
            k += 1
            p *= rate / draws / k
            c += p
        total += k
    return total


def rows_of():
    rows = [(k, f"t{k}", "hot") for k in range(300)] + [(1000 + k, f"u{k}", "small") for k in range(10)] + [(2000, None, None), (None, "n", "small"), (5, "t5", "hot")]
    return rows


def test_counts_by_brute_force(docs_of):
    rows = rows_of()
    sizes = Counter(r[2] for r in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    want = Counter()
    for doc_id, _, source in rows:
        want[(doc_id, source)] += copies(doc_id, math.sqrt(sizes[source]) / total * len(rows) / sizes[source])
    docs = docs_of(rows)
    got = mix_sources(docs)
    assert got.columns == [*docs.columns, "copy", "n_copies", "mix_key"]
    assert Counter((r["doc_id"], r["source"]) for r in got.collect()) == +want


@pytest.mark.parametrize("broadcast", [True, False])
def test_target_weights(docs_of, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    docs = docs_of(rows_of())
    rates = {r["source"]: r["rate"] for r in target_rates(docs, weights={"small": 3, "hot": 1}, epochs=4).collect()}
    assert rates["small"] * 11 == pytest.approx(3 * rates["hot"] * 301) and rates[None] == 0
    got = Counter(r["source"] for r in mix_sources(docs, weights={"small": 3, "hot": 1}, epochs=4).collect())
    assert set(got) == {"small", "hot"}
    assert got["small"] == pytest.approx(3 / 4 * 4 * 313, rel=0.3) and got["hot"] == pytest.approx(313, rel=0.3)  # a rate of 85 takes several draws


def test_order_is_a_shuffle_and_repeatable(docs_of):
    docs = docs_of([(k, "t", f"s{k % 3}") for k in range(400)])
    ids = [r["doc_id"] for r in mix_sources(docs, epochs=2.0).collect()]
    assert ids == [r["doc_id"] for r in mix_sources(docs, epochs=2.0).collect()]
    rising = sum(a < b for a, b in zip(ids, ids[1:], strict=False))
    assert 0.4 < rising / len(ids) < 0.6


def test_empty_table(docs_of):
    assert mix_sources(docs_of([])).count() == 0


def test_rows_without_ids_are_dealt_out(docs_of):
    docs = docs_of([(None, f"text {k}", "s") for k in range(200)])
    mixed = mix_sources(docs, weights={"s": 1}, epochs=3)
    parts = mixed.groupBy(F.spark_partition_id().alias("p")).count().collect()
    counts = {r["n_copies"] for r in mixed.collect()}
    assert len(counts) <= 1 and (not counts or len(parts) > 1)


def test_very_long_texts_and_ties(docs_of):
    rows = [(k, "long text " * 200_000, "s") for k in range(4)] + [(1, "long text " * 200_000, "s"), (9, None, "s")]
    got = Counter(r["doc_id"] for r in mix_sources(docs_of(rows), weights={"s": 1}, epochs=2).select("doc_id").collect())
    rate = 2.0
    want = Counter()
    for k, _, _ in rows:
        want[k] += copies(k, rate)
    assert got == +want


def test_copies_of_a_rare_source_are_dealt_in_blocks(docs_of, monkeypatch):
    """One row with nine tenths of the weight: the same rows whether its copies are made at once or in blocks."""
    docs = docs_of(rows_of() + [(3000, "rare", "rare")])
    weights = {"rare": 9, "hot": 1}
    rate = next(r["rate"] for r in target_rates(docs, weights=weights, epochs=12).collect() if r["source"] == "rare")
    columns = ["doc_id", "text", "source", "copy", "n_copies", "mix_key"]
    blocks = sorted(map(str, mix_sources(docs, weights=weights, epochs=12).select(columns).collect()))
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 1 << 30)
    assert blocks == sorted(map(str, mix_sources(docs, weights=weights, epochs=12).select(columns).collect()))
    assert rate > 2 * 1024 and sum("'rare'" in r for r in blocks) == copies(3000, rate)


def test_one_copy_more_than_a_block(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 7)
    got = mix_sources(docs_of([(1, "a", "s"), (None, None, None)]), weights={"s": 1}, epochs=20).collect()
    assert sorted(r["copy"] for r in got) == list(range(got[0]["n_copies"])) and {r["doc_id"] for r in got} == {1}
