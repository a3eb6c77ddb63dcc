"""Steps whose share of a task must not grow with the table."""

import random
import re

import numpy as np
import pytest

from tessera import catalog
from tessera.operators import routing as R
from tessera.operators import sequence as Q
from tessera.operators.graph import connected_components


@pytest.mark.parametrize("name", ["coalesce_intervals", "sequence_contiguity"])
def test_tasks_follow_the_rows_of_a_table(spark, sf, monkeypatch, name):
    query = catalog.queries()[name]
    want = sorted(map(tuple, query(spark, sf).collect()))
    monkeypatch.setattr(Q, "ROWS_IN_TASK", 100)  # lineitem has 6,000 rows
    df = query(spark, sf)
    assert sorted(map(tuple, df.collect())) == want
    sizes = [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]
    assert sizes and min(sizes) == spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100


def test_components_by_ranges_of_nodes(spark):
    rng = random.Random(4)
    rows = [(i, i + rng.choice((1, 1, 2, 3))) for i in range(400) if rng.random() < 0.6] + [(5, 390), (7, 7), (None, 3)]
    edges = spark.createDataFrame(rows, "a long, b long")
    want = sorted(map(tuple, connected_components(edges, "a", "b").collect()))
    for small in (30, 0):
        assert sorted(map(tuple, connected_components(edges, "a", "b", small_edges=small, near=True).collect())) == want


def test_searches_of_a_task_go_on_together(spark, monkeypatch):
    rng = random.Random(8)
    at = [(rng.randrange(40), rng.randrange(40)) for _ in range(120)]
    key = [x * (1 << 33) + y * 2 for x, y in at]  # places as build_edges names them
    ways = {(i, j): round(float(np.hypot(at[i][0] - at[j][0], at[i][1] - at[j][1])), 6) for i, j in (rng.sample(range(120), 2) for _ in range(260)) if key[i] != key[j]}
    edges = spark.createDataFrame([(key[p], key[q], c) for (i, j), c in ways.items() for p, q in ((i, j), (j, i))], "a long, b long, cost double").groupBy("a", "b").min("cost").toDF("a", "b", "cost").cache()
    cost = {(r["a"], r["b"]): r["cost"] for r in edges.collect()}
    nodes = sorted({a for a, _ in cost})
    far = {(s, t): 0.0 if s == t else cost.get((s, t), np.inf) for s in nodes for t in nodes}
    for k in nodes:
        for s in nodes:
            for t in nodes:
                far[s, t] = min(far[s, t], far[s, k] + far[k, t])
    asked = [(n, rng.choice(nodes), rng.choice(nodes)) for n in range(300)]
    q = spark.createDataFrame(asked, "query long, start long, end long")
    calls, real = [], R._ways
    for labels in (4_000_000, 500):
        monkeypatch.setattr(R, "LABELS_AT_ONCE", labels)
        es, qs = edges.withColumn("component", R.F.lit(0).cast("long")), q.withColumn("component", R.F.lit(0).cast("long"))
        monkeypatch.setattr(R, "_ways", lambda *a: calls.append(len(a[0])) or real(*a))
        got = {r["query"]: r for r in R._ways_in_task(qs.toArrow(), es.toArrow()).to_pylist()}
        for n, s, t in asked:
            assert (n in got) == np.isfinite(far[s, t])
            if n in got:
                path = got[n]["path"]
                assert abs(got[n]["cost"] - far[s, t]) < 1e-6 and abs(sum(cost[p] for p in zip(path[:-1], path[1:], strict=True)) - far[s, t]) < 1e-6
                assert (path[0], path[-1], len(path) - 1) == (s, t, got[n]["hops"])
    assert calls[0] == 300 and len(calls) > 2 and max(calls[1:]) <= 6


def test_planar_build_shuffles_segments_only(spark, sf, monkeypatch):
    """Pieces, edges and chains of cells are those of joins, whatever the margin, and no pair, cut or piece is shuffled."""
    from tessera.operators import network as N
    from tessera.operators import planar as L
    from tessera.operators.routing import contract_labelled
    from tessera.sources.tables import roads

    rows = lambda df: sorted(map(repr, df.collect()))
    segs = roads(spark, sf).filter("street < 700").cache()
    parts = N._pieces_by_joins(segs)
    edges = N.planar_edges(parts.cache()).cache()
    label = N.F.struct("surface", "mask")
    rounded = lambda df: rows(df.select("a", "b", N.F.round("cost", 6).alias("cost"), "n", "surface", "mask"))
    chains = rounded(contract_labelled(edges.select("a", "b", N.F.col("length").alias("cost"), label.alias("label"))).select("a", "b", "cost", "n", "label.*"))
    for size in (4096, 512, 96):  # in small cells most runs are open, and some nodes need more than the first margin
        got = N.planar_pieces(segs, size)
        assert [len(x[3]) for x in got._cells.levels][-1] == 0
        assert rows(got) == rows(parts) and rows(N.planar_edges(got)) == rows(edges)
        assert rounded(N.planar_chains(got)) == chains
        for df in (got, N.planar_edges(got)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert len(got._cells.levels) > 1
    monkeypatch.setattr(L, "LEVELS", 1)
    assert N.Cells(segs, 96, (4.5, 1.0, 1.0, 0.25, 1.0)).levels is None  # then joins build all


def test_cell_with_a_chain_of_moves_from_afar_is_not_whole(spark):
    """Each road ends near the next one's beginning, so that ends move along a chain past the margin of a small cell."""
    from tessera.operators import network as N

    kind = "street long, seg int, x1 double, y1 double, x2 double, y2 double, width double, surface string, bridge boolean, mask int, pin1 boolean, pin2 boolean"
    rows = [(i, 1, 6.0 * i, 0.0, 6.0 * i, 40.0 + i % 3, 4.0, "paved", False, None, False, False) for i in range(60)]
    rows += [(100, 1, 900.0, 0.0, 900.0, 9.0, None, None, None, 3, None, None), (101, 1, 899.0, 4.0, 930.0, 4.0, 4.0, None, None, None, None, None), (102, 1, None, 0.0, 1.0, 2.0, 4.0, "dirt", False, None, False, False), (103, 1, 5.0, 5.0, 5.0, 5.0, 4.0, "dirt", False, None, False, False)]
    segs = spark.createDataFrame(rows, kind).cache()
    good = segs.filter("street NOT IN (102, 103)")
    want = N._pieces_by_joins(good)
    got = N.planar_pieces(segs, 64)
    table = lambda df: sorted(map(repr, df.collect()))
    assert len(got._cells.levels) > 1 and table(got) == table(want)
    assert table(N.planar_edges(got)) == table(N.planar_edges(want))


def test_polylines_of_a_dense_cell_are_compared_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from tessera.operators import matching as M

    rng = random.Random(5)
    at = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(80)]
    points = spark.createDataFrame([(e, i, x + 4.0 * i, y + rng.uniform(-3, 3)) for e, (x, y) in enumerate(at) for i in range(3)], "ext long, pos int, x double, y double")
    segs = spark.createDataFrame([(i, x - 5, y, x + 20, y + rng.uniform(-2, 2)) for i, (x, y) in enumerate(at)], "street long, x1 double, y1 double, x2 double, y2 double")
    want = sorted(map(tuple, M.overlapping_lines(points, segs).collect()))
    sizes, real = [], M.near_blocks
    monkeypatch.setattr(M, "near_blocks", lambda left, right, **k: sizes.append(len(left)) or real(left, right, **k))
    monkeypatch.setattr(M, "fold_cells", lambda left, right, fold, schema: spark.createDataFrame(pa.Table.from_batches(list(fold(left.toArrow(), right.toArrow()))).to_pandas(), schema))
    monkeypatch.setattr(M, "PAIRS_AT_ONCE", 100)
    assert len(want) > 60 and sorted(map(tuple, M.overlapping_lines(points, segs).collect())) == want
    assert sum(sizes) == 240 and max(sizes[2:]) < 60


def test_short_searches_take_few_rounds(spark, monkeypatch):
    from tessera.operators import search as S

    place = lambda i: (6 * i) << 32
    edges = spark.createDataFrame([(place(i), place(i + 1), 3.0, "paved", False, None) for i in range(300)], "a long, b long, length double, surface string, bridge boolean, mask int")
    ask = spark.createDataFrame([(1, 0.0, 1.0, 900.0, 2.0, None, 1)], "query long, sx double, sy double, tx double, ty double, avoid array<struct<x:double,y:double,r:double>>, bit int")
    plans, real = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df: (plans.append(1) if df.columns == ["query", "limit", "ub"] else None) or real(df))
    found, _ = S.request_routes(ask, edges, landmarks=False, max_cost=1500.0)
    assert [tuple(r) for r in found.select("query", "cost").collect()] == [(1, 909.0)]
    assert len(plans) <= 2
