"""Borders against flood fills, scores against every pixel, grown outlines against distances, and the older flow's known cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators.borders import border_rows, trace, traced
from foliospark.operators.contours import contour_regions, grown_ring, grown_rings, mean_inside, polygon_area, ring_area, turns_around, without_repeats


def flood(mask, corners):
    """Numbers of the connected parts of a mask."""
    found, n = np.zeros(mask.shape, int), 0
    for at in zip(*np.nonzero(mask), strict=True):
        if found[at]:
            continue
        n += 1
        found[at], open_ = n, [at]
        while open_:
            y, x = open_.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    to = y + dy, x + dx
                    if (corners or not dy or not dx) and 0 <= to[0] < mask.shape[0] and 0 <= to[1] < mask.shape[1] and mask[to] and not found[to]:
                        found[to] = n
                        open_.append(to)
    return found


def borders_by_floods(hot):
    """(component, background) to the pixels of the component beside it, and the background around each component."""
    framed = np.pad(hot, 1)
    parts, ground = flood(framed, True), flood(~framed, False)
    beside, around = {}, {}
    for y, x in zip(*np.nonzero(framed), strict=True):
        around.setdefault(parts[y, x], ground[y, x - 1])  # left of the first pixel
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            if not framed[y + dy, x + dx]:
                beside.setdefault((parts[y, x], ground[y + dy, x + dx]), set()).add((int(x) - 1, int(y) - 1))
    return beside, around


def test_borders_of_random_maps_with_their_parents():
    rng = np.random.default_rng(1)
    for _ in range(250):
        hot = rng.random(rng.integers(1, 14, 2)) < rng.choice([0.3, 0.5, 0.7, 0.85])
        beside, around = borders_by_floods(hot)
        found = trace(hot)
        keys = {(frozenset(points), bool(around[c] != b), c): b for (c, b), points in beside.items()}
        assert len(found) == len(beside)
        key_of = []
        for b in found:
            assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 1 for p, q in zip(b.points, b.points[1:] + b.points[:1], strict=True))
            key_of.append(next((c, ground) for (points, hole, c), ground in keys.items() if points == frozenset(b.points) and hole == b.hole))
        firsts = [(b.points[0][1], b.points[0][0]) for b in found]
        assert firsts == sorted(firsts)
        inside = {b: c for (c, b) in beside if around[c] != b}  # the component around a hole
        for b, (c, ground) in zip(found, key_of, strict=True):
            if b.hole:
                assert not found[b.parent].hole and key_of[b.parent][0] == c
            elif ground in inside:
                assert found[b.parent].hole and key_of[b.parent] == (inside[ground], ground)
            else:
                assert b.parent == -1


def test_traced_pages_keep_errors(spark):
    ring = np.ones((5, 5))
    ring[2, 2] = 0.0
    rows = [(1, 5, 5, ring.ravel().tolist()), (2, 5, 5, [0.0] * 25), (3, 5, 5, [1.0] * 24), (4, 0, 0, []), (5, 5, 5, None), (6, 1, 1, [float("nan")]), (7, None, 5, [1.0])]
    pages = traced(spark.createDataFrame(rows, "image int, height int, width int, values array<double>"), 0.5)
    got = {r["image"]: r for r in pages.collect()}
    assert [(b["hole"], b["parent"], len(b["points"]), len(b["hull"])) for b in got[1]["borders"]] == [(False, -1, 16, 4), (True, 0, 4, 4)]
    assert got[2]["borders"] == [] and got[6]["borders"] == []
    assert {k: got[k]["border_error"] for k in got} == {1: None, 2: None, 3: "size", 4: "empty_map", 5: "size", 6: None, 7: "empty_map"}
    assert border_rows(pages, "image").filter("NOT hole").count() == 1
    assert traced(spark.createDataFrame([], pages.schema).select("image", "height", "width", "values"), 0.5).count() == 0


def inside_ring(x, y, points):
    crossings = sorted(ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True) if ay <= y < by or by <= y < ay)
    return any(a <= x <= b for a, b in zip(crossings[::2], crossings[1::2], strict=True))


def test_scores_against_every_pixel():
    rng = np.random.default_rng(2)
    for _ in range(300):
        h, w = rng.integers(1, 12, 2)
        p, points = rng.normal(0.5, 0.5, (h, w)), np.stack([rng.integers(-2, w + 2, n := rng.integers(1, 9)), rng.integers(-2, h + 2, n)], 1)
        held = [(int(min(max(x, 0), w - 1)), int(min(max(y, 0), h - 1))) for x, y in points]
        pixels = set(held) | {(x, y) for y in range(h) for x in range(w) if inside_ring(x, y, held)}
        assert mean_inside(p, points) == pytest.approx(np.mean([min(max(p[y, x], 0), 1) for x, y in pixels]))
    assert mean_inside(np.ones((2, 2)), np.zeros((0, 2), int)) == 0.0


def distances(places, ring):
    a, b = ring, np.roll(ring, -1, 0)
    d = b - a
    t = np.clip(((places[:, None] - a) * d).sum(2) / (d**2).sum(1), 0, 1)
    return np.sqrt(((places[:, None] - a - t[..., None] * d) ** 2).sum(2)).min(1)


def test_grown_outlines_against_distances():
    rng = np.random.default_rng(3)
    checked = 0
    for trial in range(120):
        n = rng.integers(3, 14)
        angle, r = np.sort(rng.random(n)) * 2 * np.pi, rng.uniform(2, 12, n)
        ring = np.stack([r * np.cos(angle), r * np.sin(angle)], 1)
        ring = np.rint(ring) if trial % 2 else ring
        ring = without_repeats(ring[::-1] if trial % 3 == 0 else ring)
        turn = np.diff(np.append(angle, angle[0] + 2 * np.pi)).max()
        by, places = rng.uniform(0.2, 4), rng.uniform(-18, 18, (1500, 2))
        around = turns_around(places, ring) if len(ring) > 2 else np.array([-1])
        if turn > np.pi or around.min() < 0 or around.max() > 1:
            continue  # such rings may cross themselves
        checked += 1
        away = np.where(around > 0, 0, distances(places, ring))
        inside = sum(turns_around(places, outer) + sum(turns_around(places, h) for h in holes) for outer, holes in grown_ring(ring, by))
        assert (inside[away < by * np.cos(0.05) - 1e-6] == 1).all() and (inside[away > by + 1e-6] == 0).all()
    assert checked > 60


def test_growth_closes_and_keeps_holes():
    c = np.array([(0, 0), (20, 0), (20, 20), (0, 20), (0, 11), (2, 11), (2, 18), (18, 18), (18, 2), (2, 2), (2, 9), (0, 9)], float)  # a ring with a gap of 2
    (outer, holes), = grown_ring(c, 1.5)
    assert len(holes) == 1 and ring_area(holes[0]) == pytest.approx(-(13 * 13), abs=0.5) and ring_area(outer) > 400
    assert len(grown_ring(c, 0.5)[0][1]) == 0
    assert len(grown_ring(c, 9.0)[0][1]) == 0
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert [ring_area(grown_ring(square, 2.0, join)[0][0]) for join in ("bevel", "miter")] == [pytest.approx(56), pytest.approx(64)]
    line = np.array([(0, 0), (5, 0), (9, 0), (5, 0)], float)  # a border that goes back on itself
    assert ring_area(grown_ring(line, 1.0)[0][0]) == pytest.approx(18 + np.pi, abs=0.02)
    assert grown_ring(square, 0.0)[0][0].tolist() == square.tolist() and grown_ring(square[:2], 1.0)[0][0].tolist() == square[:2].tolist()


def test_growth_is_larger_in_frames(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (2, None)], "k int, ring array<struct<x:double,y:double>>")
    got = {r["k"]: r["a"] for r in grown_rings(rows, "ring", F.lit(2.0)).select("k", polygon_area(F.get("grown", F.lit(0))).alias("a")).collect()}
    assert got[1] > 16 and got[2] is None
    with pytest.raises(ValueError):
        grown_rings(rows, "ring", F.lit(2.0), join="other")


def flow(spark, *maps, **settings):
    rows = [(k, *m.shape, m.ravel().tolist()) for k, m in enumerate(maps)]
    return contour_regions(spark.createDataFrame(rows, "image int, height int, width int, values array<double>"), **settings)


def test_older_flow_known_cases(spark):
    small = np.zeros((4, 4))
    small[1:3, 1:3] = 1.0
    blobs, sizes, dot, donut = np.zeros((12, 12)), np.zeros((12, 12)), np.zeros((4, 4)), np.ones((9, 9))
    blobs[2:6, 2:6], blobs[7:11, 7:11] = 0.9, 0.4
    sizes[1:3, 1:3] = sizes[5:11, 5:11] = 1.0
    dot[1, 1], donut[3:6, 3:6] = 1.0, 0.0
    assert flow(spark, small, threshold=0.5, min_area=1.0, min_result_area=0.0).filter("region IS NOT NULL").count() == 1
    (row,) = flow(spark, blobs, min_area=1.0, max_candidates=0, min_result_area=0.0).collect()
    assert row["score"] == pytest.approx(0.9) and all(p["x"] < 7.5 and p["y"] < 7.5 for p in row["polygon"]["ring"])
    (row,) = flow(spark, sizes, threshold=0.5, min_area=0.0, box_threshold=0.0, max_candidates=1, min_result_area=0.0).collect()
    assert all(p["x"] >= 1.0 for p in row["polygon"]["ring"]) and row["area"] == 25.0
    (row,) = flow(spark, dot, threshold=0.5, min_area=5.0).collect()
    assert row["region"] is None and row["error"] is None
    rows = flow(spark, donut, threshold=0.5, min_area=0.0, box_threshold=0.0, unclip_ratio=0.0, min_result_area=0.0).collect()
    assert [r["area"] for r in rows] == [64.0]  # the hole's border gives no region
    (row,) = flow(spark, np.zeros((0, 0))).collect()
    assert row["error"] == "empty_map"


def test_pixels_beside_holes_count_islands_as_the_sql_does(spark, tmp_path):
    import duckdb

    from foliospark.plans.contours import ORACLE_SQL, border_counts

    drawn = {
        1: "........ .#####.. .#...#.. .#.#.#.. .#...#.. .#####.. ........ .......#",  # a point in a hole
        2: "######## #......# #.####.# #.#..#.# #.#..#.# #.####.# #......# ########",  # a ring in a hole, with a hole of its own
        3: "####.... #..#.... ####.... ........ ....#### ....#.## ....#### ........",
    }
    rng = np.random.default_rng(4)
    rows = [(k, [1.0 if c == "#" else -1.0 for c in m.replace(" ", "")]) for k, m in drawn.items()] + [(k, [float(x) for x in rng.normal(size=64)]) for k in range(4, 40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = sorted(tuple(r) for r in border_counts(spark, str(tmp_path)).collect())
    assert found == sorted(duck.sql(ORACLE_SQL["border_counts"]).fetchall())
    assert found[0] == (1, 3, 1, 13) and found[1] == (2, 2, 2, 20 + 20 - 8 + 12)


def test_rings_of_all_sizes_grow_together_as_alone(spark):
    rng = np.random.default_rng(7)
    rings = []
    for k in range(60):  # round ones, stars, repeats, either way round, fewer than three points
        n = int(rng.integers(3, 12))
        angle, reach = np.arange(n) * 2 * np.pi / n, rng.uniform(3, 9, n) if k % 2 else np.full(n, 6.0)
        ring = np.stack([np.cos(angle) * reach, np.sin(angle) * reach], 1)
        ring = np.repeat(ring, 2, 0) if k % 5 == 0 else ring
        rings.append((ring[::-1] if k % 3 == 0 else ring)[: 2 if k % 20 == 19 else None])
    rings[7] = rings[7][:0]
    points = "array<struct<x:double,y:double>>"
    rows = [(k, None if k == 11 else [tuple(p) for p in r.tolist()], None if k == 12 else 0.0 if k == 13 else 0.5 + k % 4) for k, r in enumerate(rings)]
    for join in ("round", "bevel", "miter"):
        df = spark.createDataFrame(rows, f"k int, ring {points}, by double").coalesce(1)
        found = {r["k"]: r["grown"] for r in grown_rings(df, "ring", F.col("by"), join).collect()}
        assert len(found) == 60 and found[11] is None and found[12] is None
        for k, ring, by in rows:
            if k not in (11, 12):
                alone = grown_ring(np.array(ring).reshape(-1, 2), by, join)
                assert len(found[k]) == len(alone)
                for p, (outer, holes) in zip(found[k], alone, strict=True):
                    assert np.array_equal(np.array(p["ring"]).reshape(-1, 2), outer) and len(p["holes"]) == len(holes)
                    assert all(np.array_equal(np.array(a), b) for a, b in zip(p["holes"], holes, strict=True))


def test_a_rings_derivation_is_bound_once(spark):
    from foliospark.functions import geometry as g

    x = F.col("id") + 1.0
    ring = g.ring((x, x), (x + 3, x), (x + 3, x + 2), (x, x + 2))
    df = spark.range(3).select(ring.alias("q")).filter((g.unclip_distance(F.col("q"), 1.5) > 0.5) & (g.short_side(F.col("q")) >= 2))
    assert df.count() == 3
    plan = lambda d: str(d._jdf.queryExecution().optimizedPlan())
    assert plan(df).count("array(struct(") == 3  # once where it is made and in each condition, not for each corner of each edge


def test_the_unclip_query_works_its_distance_out_once(spark, tmp_path):
    from foliospark.plans.regions import unclip_rect

    row = (1, 2, 3, 1, 20.0, 9000.0, 0.1, 0.1, "A", "B", None)
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame([row], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = unclip_rect(spark, str(tmp_path))
    assert [(r["d"], r["gw"], r["gh"]) for r in df.collect()] == [(3.5526, 16.1053, 17.1053)]
    assert str(df._jdf.queryExecution().optimizedPlan()).upper().count("SQRT") == 4
