"""Greedy labels, rate limits, routes and polyline joins against brute force; readers that must refuse bad files."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import matching as M
from tessera.operators import routing as R
from tessera.operators import sequence as Q
from tessera.operators import spatial as P
from tessera.operators import state as T
from tessera.operators.graph import connected_components
from tessera.sources import files
from tessera.streaming import replication as L
from tests.test_sources import events, run


def test_greedy_labels_across_cells(spark):
    rng = random.Random(9)
    boxes = [(i, rng.randint(-300, 300), rng.randint(-300, 300), rng.randint(0, 90), rng.randint(1, 90), rng.choice("ab")) for i in range(250)]
    taken = []
    for b in boxes:
        if not any(b[5] == t[5] and b[1] < t[1] + t[3] and t[1] < b[1] + b[3] and b[2] < t[2] + t[4] and t[2] < b[2] + b[4] for t in taken):
            taken.append(b)
    df = spark.createDataFrame(boxes, "id int, x int, y int, w int, h int, c string").repartition(5)
    assert sorted(r["id"] for r in Q.greedy_labels(df, ["c"], ["id"]).collect()) == [t[0] for t in taken]
    assert Q.greedy_labels(df.limit(0), ["c"], ["id"]).count() == 0


def test_rate_limit_moves_on_accepted_rows_only(spark):
    rng = random.Random(2)
    rows = [(k, i, round(rng.uniform(0, 60), 2)) for k in "abc" for i in range(200)] + [("d", i, i * 0.9) for i in range(50)]
    want = []
    for k in "abcd":
        last = None
        for t, i in sorted((t, i) for q, i, t in rows if q == k):
            if last is None or t - last >= 1.0:
                want.append((k, i))
                last = t
    df = spark.createDataFrame(rows, "k string, seq int, t double")
    assert sorted((r["k"], r["seq"]) for r in T.rate_limited(df, ["k"], F.col("t")).collect()) == sorted(want)
    assert len([w for w in want if w[0] == "d"]) == 25  # a steady stream below the limit is thinned, not silenced


def test_streams_do_not_depend_on_how_batches_are_cut(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    times = [0, 0.6, 1.2, 1.8, 2.4, 3.0, 3.6]
    rows = [("a", i, t0 + timedelta(seconds=t)) for i, t in enumerate(times)]
    s = events(spark, tmp_path, [rows[:3], rows[3:5], rows[5:]])
    slow = spark.read.parquet(run(L.rate_limit(s, "k", "ts"), tmp_path / "r")).collect()
    assert sorted(r["rev"] for r in slow) == [0, 2, 4, 6]
    new = spark.read.parquet(run(L.accept_newer(s, "k", "rev"), tmp_path / "n")).collect()
    assert sorted(r["rev"] for r in new) == list(range(7))


def test_small_and_large_components_agree(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)], "src long, dst long")
    one, many = (sorted(map(tuple, connected_components(edges, small_edges=n).collect())) for n in (10_000, 0))
    assert one == many


def grid_edges(spark, rng, n=7):
    cost = {}
    for x in range(n):
        for y in range(n):
            for q in ((x + 1, y), (x, y + 1)):
                if max(q) < n:
                    cost[x * n + y, q[0] * n + q[1]] = cost[q[0] * n + q[1], x * n + y] = float(rng.randint(1, 9))
    return cost, spark.createDataFrame([(a, b, c) for (a, b), c in cost.items()], "a long, b long, cost double")


def all_pairs(cost, n):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), c in cost.items():
        d[a, b] = c
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


def test_routes_of_a_component_too_large_for_a_task(spark):
    rng = random.Random(1)
    cost, edges = grid_edges(spark, rng)
    d = all_pairs(cost, 49)
    asked = [(i, rng.randrange(49), rng.randrange(49)) for i in range(12)]
    asked = [(i, s, t) for i, s, t in asked if s != t]
    q = spark.createDataFrame(asked, "query long, start long, end long")
    for limit in (1_000_000, 10):
        got = {r["query"]: r for r in R.routes(q, edges, edges_in_task=limit).collect()}
        for i, s, t in asked:
            path = got[i]["path"]
            assert got[i]["cost"] == d[s, t] == sum(cost[p] for p in zip(path[:-1], path[1:], strict=True)) and (path[0], path[-1], len(path) - 1) == (s, t, got[i]["hops"])


def test_routes_between_candidates(spark):
    rng = random.Random(3)
    cost, edges = grid_edges(spark, rng, 5)
    d = all_pairs(cost, 25)
    s = [(q, rng.randrange(25), float(rng.randint(0, 5))) for q in range(6) for _ in range(3)]
    t = [(q, rng.randrange(25), float(rng.randint(0, 5))) for q in range(6) for _ in range(2)]
    want = {q: min((a[2] + d[a[1], b[1]] + b[2], a[1], b[1]) for a in s for b in t if a[0] == b[0] == q) for q in range(6)}
    schema = "query long, node long, extra double"
    got = R.routes_between(spark.createDataFrame(s, schema), spark.createDataFrame(t, schema), edges, 1000.0).collect()
    assert {r["query"]: (r["cost"], r["start"], r["end"]) for r in got} == want


def test_nearest_segment_however_far(spark):
    pts = spark.createDataFrame([(1, 0, 0), (2, 9000, 9000)], "id long, x long, y long")
    segs = spark.createDataFrame([(1, 1, 10, 0, 20, 0), (2, 1, 0, 300, 5, 300), (2, 2, 0, -300, 5, -300)], "street long, seg int, x1 long, y1 long, x2 long, y2 long")
    got = sorted((r["id"], r["rank"], r["street"], r["seg"], r["ring"]) for r in P.nearest_in_rings(pts, segs, 2).collect())
    assert got == [(1, 1, 1, 1, 640), (1, 2, 2, 1, 640), (2, 1, 2, 1, 40960), (2, 2, 1, 1, 40960)] or got[0] == (1, 1, 1, 1, 640) and got[2][2:4] == (2, 1)


def test_runs_forward_and_reversed(spark):
    lines = spark.createDataFrame([(1, i, float(10 * i), 0.0, False) for i in range(6)] + [(2, i, float(10 * (5 - i)), 0.4, True) for i in range(6)], "line int, pos int, x double, y double, named boolean")
    runs = spark.createDataFrame([(7, k, 3, 20.0 + 10 * k, 0.1) for k in range(3)] + [(8, k, 2, 10.0 + 20 * k, 0.0) for k in range(2)], "run int, k int, m int, x double, y double")
    assert [tuple(r) for r in M.match_runs(runs, lines).collect()] == [(7, 2, 3, True)]


def test_crossing_streets_are_cut_at_one_place(spark):
    segs = spark.createDataFrame([(1, 1, 0, 0, 100, 100), (2, 1, 0, 100, 100, 0), (3, 1, 20, 0, 20, 90), (4, 1, 500, 0, 510, 0)], "street long, seg int, x1 long, y1 long, x2 long, y2 long")
    got = M.cut_at_crossings(segs)
    assert sorted((r["street"], r["piece"]) for r in got.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2), (4, 0)]
    assert R.build_edges(got).groupBy("a").count().filter("count = 4").count() == 3


def test_ambiguous_lookups_give_null(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    names = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert sorted(((r["k"] or 0, r["v"]) for r in J.lookup_unless_ambiguous(left, names, ["k"], "v").collect()), key=str) == [(0, None), (1, "a"), (2, None), (3, None)]


def test_bad_registries_and_runs_are_refused(spark, tmp_path):
    def reads(name, text, read):
        (tmp_path / name).write_text(text)
        return read(str(tmp_path / name)).collect()

    registry = lambda p: files.read_registry(spark, p, "name string, online boolean", "online")
    assert len(reads("a", '{"count":1,"online":0}\n{"name":"x","online":false}\n', registry)) == 1
    for bad in ('{"count":2,"online":0}\n{"name":"x","online":false}\n', '{"count":1,"online":1}\n{"name":"x","online":false}\n', '{"count":1,"online":0}\n{"name":"x","onl\n'):
        with pytest.raises((PySparkException, Py4JJavaError)):
            reads("b", bad, registry)
    runs = lambda p: files.read_reset_runs(spark, p)
    assert len(reads("c", "MMRESETS\nRUN r2 20 2\nC 1,2;3,4\nRUN r1 10 1\nC 5,6\nEND 2\n", runs)) == 3
    for bad in ("RUN r1 10 1\nC 5,6\nRUN r2 20 1\nC 1,2\n", "RUN r1 10 2\nC 5,6\n"):
        with pytest.raises(PySparkException):
            reads("d", bad, runs)
