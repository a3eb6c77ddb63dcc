"""Operators that SQL does not express, against brute force, and the edge cases of those that it does."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import routing as R
from tessera.operators import sequence as Q
from tessera.operators import spatial as P
from tessera.operators import state as T
from tessera.operators.graph import connected_components
from tessera.plans.filters import buildings_in


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a == b:
            continue
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_a_path_a_star_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(200, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    df = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert dict(got(df, "node", "component")) == components(nodes, edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_crossings_against_all_pairs(spark):
    rng = random.Random(77)
    segs = [(i, j, *(rng.randint(-150, 170) for _ in range(4))) for i in range(25) for j in range(4)]
    df = spark.createDataFrame(segs, "street long, seg int, x1 long, y1 long, x2 long, y2 long")

    def side(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    want = []
    for s in segs:
        for t in segs:
            if s[0] < t[0]:
                a, b, c, d = s[2:4], s[4:6], t[2:4], t[4:6]
                if side(*a, *b, *c) * side(*a, *b, *d) < 0 and side(*c, *d, *a) * side(*c, *d, *b) < 0:
                    want.append((s[0], s[1], t[0], t[1]))
    assert want and got(P.segment_crossings(df), "street_a", "seg_a", "street_b", "seg_b") == sorted(want)


def test_nearest_segments_against_all_pairs(spark):
    rng = random.Random(5)
    segs = [(i, 0, *(rng.randint(-300, 300) for _ in range(2))) for i in range(80)]
    segs = [(i, j, x, y, x + rng.randint(-40, 40), y + rng.randint(-40, 40)) for i, j, x, y in segs]
    pts = [(i, rng.randint(-300, 300), rng.randint(-300, 300)) for i in range(40)]

    def d2(px, py, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = 0 if n == 0 else min(max(((px - x1) * dx + (py - y1) * dy) / n, 0), 1)
        return round((x1 + t * dx - px) ** 2 + (y1 + t * dy - py) ** 2, 6)

    want = []
    for i, x, y in pts:
        near = sorted((d2(x, y, *s[2:]), s[0], s[1]) for s in segs)
        want += [(i, s, r + 1) for r, (d, s, _) in enumerate([n for n in near if n[0] <= 96 * 96][:3])]
    df = P.nearest_segments(spark.createDataFrame(pts, "id long, x long, y long"), spark.createDataFrame(segs, "street long, seg int, x1 long, y1 long, x2 long, y2 long"), 96, 3)
    assert want and got(df, "id", "street", "rank") == sorted(want)


def test_half_open_boxes(spark):
    df = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 10, 0, 5, 5), (3, -5, 0, 5, 5), (4, 4, 4, 1, 1)], "id int, x int, y int, w int, h int")
    assert got(buildings_in(df, 0, 0, 10, 10), "id") == [(1,), (4,)]
    d = spark.range(1).select(P.rect_distance2(F.lit(12), F.lit(5), F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("d"), P.rect_distance2(F.lit(10), F.lit(10), F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("e")).first()
    assert (d["d"], d["e"]) == (4, 0)


def test_rounding(spark):
    r = spark.range(1).select(S.half_units(F.lit(-0.25)).alias("a"), S.half_units(F.lit(0.25)).alias("b"), S.round3(F.lit(-0.0001)).alias("c"), F.bround(F.lit(2.5)).alias("d"), S.quarter_units(F.lit(0.125)).alias("e")).first()
    assert (r["a"], r["b"], r["d"], r["e"]) == (0, 1, 2.0, 0.25) and math.copysign(1, r["c"]) == 1


def test_coordinates(spark):
    texts = ["12, 34", "-3.5;7", "12", "a 1 2", "1 2 3", "9999999999 1", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [(r["i"], tuple(r["p"])) for r in df.select("i", S.parse_coords(F.col("t")).alias("p")).orderBy("i").collect() if r["p"]] == [(0, (12, 34)), (1, (-4, 7))]


def test_dominant_class_needs_a_share_and_no_equal(spark):
    rows = [("a", "x")] * 4 + [("a", "y")] + [("b", "x")] * 2 + [("b", "y")] * 2 + [("c", "z")]
    out = A.dominant_class(spark.createDataFrame(rows, "k string, c string"), ["k"], "c", 0.8)
    assert got(out, "k", "cls") == [("a", "x"), ("b", "unknown"), ("c", "z")]
    half = A.dominant_class(spark.createDataFrame(rows, "k string, c string"), ["k"], "c", 0.5)
    assert ("b", "unknown") in got(half, "k", "cls")


def test_intervals(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 8), ("k", 10, 12), ("k", 3, 3)], "k string, s int, e int")
    assert got(Q.merge_intervals(df, ["k"], "s", "e"), "s", "e") == [(0, 8), (10, 12)]
    cover = spark.createDataFrame([("k", 2, 3), ("k", 11, 20), ("j", 0, 100)], "k string, s int, e int")
    assert got(Q.subtract_intervals(df, cover, ["k"], "s", "e"), "s", "e") == [(0, 2), (3, 8), (10, 11)]


def test_rectangles_merge_until_stable(spark):
    df = spark.createDataFrame([("k", x, y, 1, 1) for x in range(4) for y in range(4)] + [("k", 9, 9, 1, 1)], "k string, x long, y long, w long, h long")
    assert got(Q.coalesce_rects(df, ["k"]), "x", "y", "w", "h") == [(0, 0, 4, 4), (9, 9, 1, 1)]


def test_fills(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([None, 1.0, None, None, 2.0, None])], "k string, i int, v double")
    assert [r[0] for r in got(Q.carry_forward(df, ["k"], "i", F.col("v"), 1, "c").withColumn("c", F.coalesce("c", F.lit(-1.0))).withColumn("z", F.struct("i", "c")), "z")] == [(0, -1.0), (1, 1.0), (2, 1.0), (3, -1.0), (4, 2.0), (5, 2.0)]
    assert [x[1] for x in got(Q.fill_nearest(df, ["k"], "i", "i", F.col("v"), "f"), "i", "f")] == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0]


def test_ordered_folds_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, float((i * 7 + k) % 13)) for k in range(9) for i in range(25)]
        df = spark.createDataFrame(rows, "k long, i int, s double")
        want = []
        for k in range(9):
            part, held = 0, 0.0
            for _, i, s in [r for r in rows if r[0] == k]:
                if i and held + s > 20:
                    part, held = part + 1, 0.0
                held += s
                want.append((k, i, part))
        assert got(Q.size_capped_batches(df, ["k"], ["i"], "s", 20), "k", "i", "part") == sorted(want)
        line = spark.createDataFrame([(k, i, float(i), float((i % 2) * (5 if i == 11 else 0.1))) for k in range(5) for i in range(20)], "k long, i int, x double, y double")
        assert got(Q.simplify_lines(line, ["k"], "i", 1.0), "k", "i") == [(k, i) for k in range(5) for i in (0, 10, 11, 12, 19)]
        upd = spark.createDataFrame([("a", i, e) for i, e in enumerate([0, 0, 1, 5, 2])], "k string, i int, e int")
        assert [r[1] for r in got(T.optimistic_updates(upd, ["k"], "i", "e"), "i", "accepted")] == [True, False, True, False, True]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_debounce_and_reversals(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate("aaabaaabbbb")], "k string, i int, v string")
    assert got(Q.debounced_changes(df, ["k"], "i", "v"), "i", "v") == [(0, "a"), (7, "b")]
    back = spark.createDataFrame([("k", i, float(x), 0.0) for i, x in enumerate([0, 10, 8, 20])], "k string, i int, x double, y double")
    assert [r[0] for r in got(Q.drop_reversals(back, ["k"], "i"), "i")] != [0, 1, 2, 3]


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate([3, 4, 9, 1])], "k string, i int, c int")
    assert got(Q.budget_prefix(df, ["k"], ["i"], "c", 10), "i", "running") == [(0, 3), (1, 7)]


def test_greedy_labels(spark):
    df = spark.createDataFrame([(1, 0, 0, 4, 4, 0), (2, 2, 2, 4, 4, 0), (3, 4, 0, 4, 4, 0)], "id int, x int, y int, w int, h int, c int")
    assert got(Q.greedy_labels(df, ["c"], ["id"]), "id") == [(1,), (3,)]


def grid(n, rng):
    return [(f, g, rng.randint(1, 9)) for x in range(n) for y in range(n) for f, g in ((x * n + y, x * n + y + 1), (x * n + y, x * n + n + y)) if (g < n * n and (g != f + 1 or y < n - 1)) and rng.random() < 0.85]


def test_routes_and_distances_against_dijkstra(spark):
    rng = random.Random(11)
    one = grid(9, rng)
    near = {}
    for a, b, c in one:
        near.setdefault(a, []).append((b, c))
        near.setdefault(b, []).append((a, c))

    def dijkstra(s):
        dist, heap = {s: 0}, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for v, c in near.get(u, ()):
                if d + c < dist.get(v, 1e18):
                    dist[v] = d + c
                    heapq.heappush(heap, (d + c, v))
        return dist

    edges = spark.createDataFrame([(a, b, float(c)) for a, b, c in one] + [(b, a, float(c)) for a, b, c in one], "a long, b long, cost double")
    asked = [(i, rng.choice(list(near)), rng.choice(list(near))) for i in range(30)]
    want = [(i, float(dijkstra(s)[t])) for i, s, t in asked if t in dijkstra(s)]
    assert got(R.routes(spark.createDataFrame(asked, "query long, start long, end long"), edges), "query", "cost") == sorted(want)
    s = asked[0][1]
    assert got(R.distances(edges, spark.createDataFrame([(7, s)], "source long, node long"), 20.0), "node", "dist") == sorted((n, float(d)) for n, d in dijkstra(s).items() if d <= 20)


def test_avoided_edges_are_taken_only_if_there_is_no_way_round(spark):
    one = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.0)]
    edges = spark.createDataFrame(one + [(b, a, c) for a, b, c in one], "a long, b long, cost double")
    asked = spark.createDataFrame([(1, 0, 2), (2, 2, 3)], "query long, start long, end long")
    avoid = spark.createDataFrame([(1, 0), (2, 3)], "a long, b long")
    assert got(R.routes(asked, edges, avoid, 1000.0), "query", "cost") == [(1, 5.0), (2, 1001.0)]


def test_chains_keep_costs(spark):
    path = [(0, 1), (1, 2), (2, 3), (3, 4), (3, 5), (5, 6), (6, 7), (7, 5)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in path] + [(b, a, 1.0) for a, b in path], "a long, b long, cost double")
    assert got(R.contract_chains(edges), "a", "b", "cost", "n") == [(0, 3, 3.0, 3), (3, 4, 1.0, 1), (3, 5, 1.0, 1), (5, 5, 3.0, 3)]


def test_patch_and_all_or_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    good = J.all_or_nothing(df, spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], ["v"])
    assert got(good, "k", "v", "applied") == [(1, "x", True), (2, "b", True), (2, "b", True)]
    bad = J.all_or_nothing(df, spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), ["k"], ["v"])
    assert got(bad, "k", "v", "applied") == [(1, "a", False), (2, "b", False), (2, "b", False)]


def test_evict_and_replay(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(6)], "k string, seq int, t int")
    assert got(T.evict(df, ["k"], F.col("t"), 2), "seq") == [(4,), (5,)]
    snap = spark.createDataFrame([("a",), ("b",)], "k string")
    ch = spark.createDataFrame([("a", 1, True), ("c", 1, True), ("c", 2, False)], "k string, o long, gone boolean")
    assert got(T.apply_changes(snap, ch, ["k"], "o", "gone"), "k") == [("b",), ("c",)]


@pytest.mark.parametrize("n,truncated", [(5, False), (11, True)])
def test_retention(spark, n, truncated):
    df = spark.createDataFrame([(i, i // 2) for i in range(n)], "seq int, t int")
    out = T.retained(df, F.col("t"), "seq", 10, 8).collect()
    assert len(out) == (8 if truncated else n) and all(r["truncated"] == truncated for r in out)
