"""Operators on dense tables: many rows of one key, many equal boxes, many places close together."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.scalars import half_up, slug
from tessera.operators import joins as J
from tessera.operators import matching as M
from tessera.operators import routing as R
from tessera.operators import sequence as Q
from tessera.operators import spatial as P


def test_fill_nearest_costs_each_row_once(spark):
    d = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") % 3).alias("kind"), F.when(F.col("id") % 20_000 == 7, F.col("id")).alias("v"))
    for got in (Q.fill_nearest(d, ["k"], "seq", "seq", F.col("v"), "near"), Q.fill_nearest_alike(d, ["k"], "seq", "seq", F.col("v"), "kind", "near")):
        assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert got.filter(F.col("near") != F.when(F.col("seq") <= 10_007, 7).otherwise(20_007)).isEmpty() and got.filter("near IS NULL").isEmpty()


def _counted(monkeypatch, module):
    """Counts the rows of both sides of every box join."""
    seen, real = [], module.box_join
    monkeypatch.setattr(module, "box_join", lambda left, right, *a, **k: seen.append((left.count(), right.count())) or real(left, right, *a, **k))
    return seen


def test_polygons_and_points_at_one_place_are_looked_at_once(spark, monkeypatch):
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    polys = spark.createDataFrame([(i, ring(100.0 * (i % 2), 0.0, 10.0)) for i in range(40)] + [(90, ring(500.0, 0.0, 10.0))], "poly long, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(i, 5, 4) for i in range(30)] + [(50, 130, 5), (51, 103, 5), (52, 470, 0), (53, 900, 900)], "id long, x long, y long")
    seen = _counted(monkeypatch, P)
    got = {r["id"]: (r["poly"], r["inside"], r["away"]) for r in P.nearest_polygons(pts, polys, 40.0).collect()}
    assert got == {i: (0, True, -4.0) for i in range(30)} | {50: (1, False, 20.0), 51: (1, True, -3.0), 52: (90, False, 30.0)}
    assert seen == [(5, 3), (3, 3)]  # places and rings; those with nothing near look further


def test_equal_boxes_are_joined_once(spark, monkeypatch):
    kinds = [(0, 0, 4, 4), (3, 3, 9, 9), (9, 9, 9, 9), (40, 40, 50, 50)]
    rows = [(i, *kinds[i % 4]) for i in range(80)] + [(200, 40, 0, 41, 1), (None, 0, 0, 4, 4)]
    boxes = spark.createDataFrame(rows, "id long, x1 long, y1 long, x2 long, y2 long")
    seen = _counted(monkeypatch, P)
    got = sorted(map(tuple, P.meeting_boxes(boxes).collect()))
    meet = lambda a, b: a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    known = [r for r in rows if r[0] is not None]
    assert got == sorted((a[0], b[0]) for a in known for b in known if a[0] < b[0] and meet(a, b))
    assert seen == [(5, 5)]


def test_components_of_copies_come_from_their_classes(spark, tmp_path, monkeypatch):
    from tessera.plans import relations

    key = F.col("id") % 30 + 1024 * 16 * F.floor(F.col("id") / 30)  # 30 boxes, 100 times
    parts = spark.range(3000).select(key.alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit(3).alias("p_size"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    given = []
    monkeypatch.setattr(relations, "connected_components", lambda e, a, b: given.append(e.count()) or e)
    relations.components(spark, str(tmp_path))
    pairs = relations.rect_overlap_pairs(spark, str(tmp_path)).count()
    assert given[0] <= 4 * 3000 and pairs > 10 * given[0]


def test_equal_labels_are_joined_once(spark, monkeypatch):
    rows = [(i, 10 * (i % 3), 0, 15, 5) for i in range(90)] + [(i, 500, 0, 0, 5) for i in (100, 101)]
    seen = _counted(monkeypatch, P)
    got = Q.greedy_labels(spark.createDataFrame(rows, "id long, x long, y long, w long, h long"), [], ["id"])
    taken = []
    for i, x, y, w, h in rows:
        if not any(x < c + e and c < x + w and y < d + f and d < y + h for _, c, d, e, f in taken):
            taken.append((i, x, y, w, h))
    assert sorted(map(tuple, got.collect())) == sorted(taken)
    assert seen == [(5, 5)]  # three boxes and two empty ones, which bar nothing


def test_landmark_distances_in_tasks_equal_rounds_of_joins(spark, monkeypatch):
    from tessera.operators import routing as R

    place = lambda x, y: (x << 32) + y
    lines = [(place(i + 100 * c, j), place(i + 100 * c + di, j + dj), 1.0 + (i * 7 + j * 3 + c) % 5) for c in range(3) for i in range(6) for j in range(6) for di, dj in ((1, 0), (0, 1)) if i + di < 6 and j + dj < 6]
    edges = spark.createDataFrame(lines + [(b, a, c) for a, b, c in lines], "a long, b long, cost double")
    marks = R.extreme_nodes(edges)
    table = lambda **k: sorted(map(tuple, R.landmark_bounds(edges, marks, 20.0, **k).collect()))
    rounds = table(edges_in_task=1)
    assert len(rounds) > 3 * 36 * 3
    monkeypatch.setattr(R, "distances", None)  # small components take no rounds
    assert table() == rounds


def test_short_routes_are_asked_without_landmarks(spark, sf, monkeypatch):
    from tessera.plans import networks

    asked = {}
    monkeypatch.setattr(networks.N, "planar_pieces", lambda s: s)
    monkeypatch.setattr(networks.N, "planar_edges", lambda s: s)
    monkeypatch.setattr(networks, "stored", lambda s: s)
    monkeypatch.setattr(networks.R, "request_routes", lambda q, e, **k: asked.update(k) or (q.withColumn("cost", F.lit(0.0)), e))
    networks.requested_routes(spark, sf)
    assert asked == {"landmarks": False, "max_cost": 1500.0}


def test_feet_of_ends_are_reckoned_once(spark):
    from tessera.operators import network as N

    kind = "street long, seg int, x1 double, y1 double, x2 double, y2 double, width double, surface string, bridge boolean, mask int, pin1 boolean, pin2 boolean"
    segs = spark.createDataFrame([(1, 1, 0.0, 0.0, 40.0, 0.0, 4.0, "paved", False, None, False, False), (2, 1, 20.0, 3.0, 20.0, 60.0, 4.0, "paved", False, None, False, False)], kind)
    found = N.attachments(N.near_pairs(N.with_ends(segs)))
    assert [(r["kind"], r["street"], r["qx"], r["d2"]) for r in found.collect()] == [("tee", 1, 20.0, 9.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    near = next(line for line in plan.splitlines() if "Filter" in line and "d2#" in line)
    assert " / " not in near  # the filter reads the distance, and does not reckon the foot anew at each place that needs it


def test_points_at_one_place_look_for_segments_once(spark, monkeypatch):
    segs = spark.createDataFrame([(1, 1, 0, 0, 10, 0), (2, 1, 0, 30, 10, 30), (3, 1, 900, 0, 910, 0)], "street long, seg int, x1 long, y1 long, x2 long, y2 long")
    pts = spark.createDataFrame([(i, 5 + 900 * (i % 2), 1) for i in range(40)] + [(50, None, 1)], "id long, x long, y long")
    asked, real = [], P.nearest_in_tree
    monkeypatch.setattr(P, "nearest_in_tree", lambda p, s, k: asked.append(p.count()) or real(p, s, k))
    got = sorted((r["id"], r["rank"], r["street"], r["d2"]) for r in P.nearest_in_rings(pts, segs, 1).collect())
    assert got == [(i, 1, 1 + 2 * (i % 2), 1.0) for i in range(40)] and asked == [2]


def _random_segments(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, far = rng.randint(-300, 300), rng.randint(-300, 300), 900 if i % 17 == 0 else 40
        out.append((i // 3, i % 3, x, y, x + rng.randint(-far, far), y + rng.randint(-far, far)))
    return [s for s in out if s[2:4] != s[4:]]


def _after_arrow(df):
    """The plan's nodes above its last pass over Arrow batches."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan[: plan.index("MapInArrow")]


def test_cuts_are_made_without_a_shuffle_of_crossings(spark):
    rows = _random_segments(300, 5)
    segs = spark.createDataFrame([*rows, (999, 1, None, 0, 1, 1)], "street long, seg int, x1 long, y1 long, x2 long, y2 long")
    got = M.cut_at_crossings(segs)
    assert "Join" not in _after_arrow(got) and "Aggregate" not in _after_arrow(got)
    side = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    want = {(999, 1): 1}
    for a in rows:
        places = set()
        for b in rows:
            p, q = (a, b) if a[0] < b[0] else (b, a)
            ca, cb, ac, ad = side(*q[2:], *p[2:4]), side(*q[2:], *p[4:]), side(*p[2:], *q[2:4]), side(*p[2:], *q[4:])
            if a[0] != b[0] and ca * cb < 0 and ac * ad < 0:
                t = ca / (ca - cb)
                places.add((round(p[2] + t * (p[4] - p[2]), 4), round(p[3] + t * (p[5] - p[3]), 4)))
        want[a[:2]] = len(places) + 1
    assert sum(want.values()) > 600
    pieces = {}
    for r in got.collect():
        pieces.setdefault((r["street"], r["seg"]), {})[r["piece"]] = tuple(r)[3:]
    assert {k: len(v) for k, v in pieces.items()} == want
    for s in rows:
        p = [pieces[s[:2]][i] for i in range(want[s[:2]])]
        assert p[0][:2] == s[2:4] and p[-1][2:] == s[4:] and all(a[2:] == b[:2] for a, b in zip(p[:-1], p[1:], strict=True))


def test_halves_are_rounded_as_spark_does(spark):
    values = [0.00005, -0.00005, 1.00015, 2.03125, 16383.96875, 0.1 + 0.2, 12.34565, -12.34565, 7.0, 8191.99995] + [i / 32 for i in range(64)] + [i / 96 for i in range(200)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    want = [r["w"] for r in df.select("i", F.round("v", 4).alias("w")).orderBy("i").collect()]
    assert half_up(np.array(values), 4).tolist() == want


def test_lines_along_others_without_a_shuffle_of_pairs(spark):
    rows = _random_segments(200, 6)
    rng = random.Random(7)
    pts = [(e, p, rng.randint(-200, 200) + 0.5, rng.randint(-200, 200) + 0.25) for e in range(40) for p in range(3)]
    pts += [(100 + i, p, x + 1.0, y + 2.0) for i, s in enumerate(rows[:30]) for p, (x, y) in enumerate((s[2:4], s[4:]))]
    got = M.overlapping_lines(spark.createDataFrame(pts, "ext int, pos int, x double, y double"), spark.createDataFrame(rows, "street long, seg int, x1 long, y1 long, x2 long, y2 long"))
    assert "Join" not in _after_arrow(got)

    def d2(px, py, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = min(max(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
        return (x1 + t * dx - px) ** 2 + (y1 + t * dy - py) ** 2

    want = {}
    for e in {p[0] for p in pts}:
        mine, found = [p for p in pts if p[0] == e], []
        for s in {r[0] for r in rows}:
            near = [d for d in (min(d2(x, y, *r[2:]) for r in rows if r[0] == s) for _, _, x, y in mine) if d <= 36]
            if near and len(near) * 2 >= len(mine):
                found.append((-round(len(near) / len(mine), 6), round(sum(d**0.5 for d in near) / len(near), 6), s))
        if found:
            r, m, s = min(found)
            want[e] = (s, -r, m)
    assert len(want) >= 30
    assert {r["ext"]: (r["street"], r["ratio"], r["mean"]) for r in got.collect()} == want


def test_short_lines_are_split_together(spark, monkeypatch):
    rng = random.Random(11)
    lines = [(k, i, rng.randint(0, 60), rng.randint(0, 60)) for k in range(3000) for i in range(rng.randint(1, 9))]
    x, y = (np.array([r[c] for r in lines], float) for c in (2, 3))
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff([r[0] for r in lines]) != 0]), len(lines)]
    calls, real = [], np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda v: calls.append(len(v)) or real(v))
    got = Q._split_lines(x, y, cuts, 12.0)
    assert len(calls) < 9 and sum(calls) < 9 * len(lines)  # a call for each level, not for each part
    monkeypatch.undo()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        alone = Q._split_lines(x[a:b], y[a:b], np.array([0, b - a]), 12.0)
        assert got[a:b].tolist() == alone.tolist() and got[a] == got[b - 1] == np.inf
    kept = {(r["k"], r["i"]) for r in Q.simplify_lines(spark.createDataFrame(lines, "k int, i int, x int, y int"), ["k"], "i", 12.0).collect()}
    assert kept == {lines[i][:2] for i in np.flatnonzero(got > 0)}


def test_pairs_of_either_key_need_no_distinct_of_all(spark):
    left = spark.createDataFrame([(1, "a", 7), (1, "b", 7), (2, "a", 2), (3, None, 9), (1, "a", 7)], "s int, g string, k int")
    right = spark.createDataFrame([(7, "a", 7), (7, "b", 7), (2, "a", 2), (9, "x", 9), (5, None, 5)], "c int, h string, m int")
    got = J.either_key(left, right, [("g", "h"), ("k", "m")], ["s", "c"])
    want = sorted({(a["s"], b["c"]) for a in left.collect() for b in right.collect() if (a["g"] is not None and a["g"] == b["h"]) or a["k"] == b["m"]})
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "__again" not in plan.splitlines()[0]  # not an Aggregate over all pairs


def test_starts_are_searched_only_as_far_as_their_queries_can_gain(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(50)] + [(i + 1, i, 1.0) for i in range(50)], "a long, b long, cost double")
    schema = "query long, node long, extra double"
    starts, ends = spark.createDataFrame([(1, 0, 5.0), (1, 9, 1.0), (2, 3, 0.0)], schema), spark.createDataFrame([(1, 9, 3.0), (1, 8, 1.0), (2, 6, 1.0)], schema)
    found, real = [], R.distances
    monkeypatch.setattr(R, "distances", lambda *a: found.append(real(*a)) or found[-1])
    got = {r["query"]: tuple(r)[1:] for r in R.routes_between(starts, ends, edges, 10.0).collect()}
    assert got == {1: (9, 8, 3.0), 2: (3, 6, 4.0)}
    assert found[0].filter("source = 0").count() == 1 and found[0].filter("source = 9").count() <= 5


def test_slugs_of_odd_texts(spark):
    rows = [(0, None), (1, ""), (2, "Grüße, ﬁne Straße!"), (3, "ＡＢＣ ½ 한글 é")] + [(i, f"Word {i}") for i in range(4, 1300)]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", slug("t").alias("s")).collect()}
    assert [got[i] for i in range(4)] == ["", "", "grue-fine-strae", "abc-12-e"] and got[1299] == "word-1299" and len(got) == 1300
