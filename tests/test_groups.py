"""Running totals, groups under a bound and hashes against plain loops."""

import random
import struct

from pyspark.sql import functions as F

from foliospark.operators.groups import memory_groups, output_hashes, running_totals
from foliospark.plans import registry

SF = "/root/testdata/sf0.001"


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 50), "x") for k in range(500)] + [(1000, None, None)]
    rng.shuffle(rows)
    got = {r["k"]: (r["before_a"], r["before_n"]) for r in running_totals(spark.createDataFrame(rows, "k int, w int, _part string"), ["k"], a=F.col("w"), n=F.lit(1)).collect()}
    total = 0
    for n, (k, w, _) in enumerate(sorted(rows, key=lambda r: r[0])):
        assert got[k] == (total, n)
        total += w or 0
    assert running_totals(spark.createDataFrame([], "k int, w int"), ["k"], a=F.col("w")).count() == 0


def test_groups_keep_the_bound_and_the_order(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 1, 5, 30, 49, 50, 51, 90, 150, None])) for k in range(400)]
    got = sorted((r["k"], r["w"] or 0, r["group"]) for r in memory_groups(spark.createDataFrame(rows, "k int, w int"), ["k"], F.col("w"), 100).collect())
    assert [x[0] for x in got] == list(range(400))
    sums, members = {}, {}
    for _, w, g in got:
        sums[g], members[g] = sums.get(g, 0) + w, members.get(g, 0) + 1
    assert all(n <= 100 or members[g] == 1 for g, n in sums.items())
    assert all(members[g] == 1 for _, w, g in got if w > 50) and all(g >= 0 for _, w, g in got if w <= 50)
    light = [g for _, w, g in got if w <= 50]
    assert light == sorted(light) and len(set(light)) <= sum(w for _, w, _ in got if w <= 50) * 2 / 100 + 1


def test_output_hashes(spark):
    rows = [(1, [1.0, -2.5, 0.1]), (2, [0.1, -2.5, 1.0]), (3, []), (4, None), (5, [float("nan"), float("inf"), -0.0])]
    got = {r["k"]: r["output_hash"] for r in output_hashes(spark.createDataFrame(rows, "k int, v array<float>"), "v").collect()}
    for k, v in rows:
        h = 0xCBF29CE484222325
        for byte in b"".join(struct.pack("<f", x) for x in v or []):
            h = (h ^ byte) * 0x100000001B3 % 2**64
        assert got[k] == (None if v is None else f"{h:016x}")
    assert got[1] != got[2]


def test_page_flow_query_keeps_every_page(spark):
    rows = registry.queries()["page_flow"](spark, SF).collect()
    assert {r["image"] for r in rows} == set(range(500))
    for r in rows:
        assert (r["error"] is not None) == (r["image"] % 50 == 0) and (r["region"] is None or r["text"] is not None)
    assert sum(r["region"] is not None for r in rows) > 1000
