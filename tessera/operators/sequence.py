"""Ordered-sequence operators: pairs, islands, fills, change points, budgets, batches and greedy choices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: So many rows of ordered sequences are dealt to a task.
ROWS_IN_TASK = 500_000


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table dealt by its keys to a task for each ROWS_IN_TASK rows, for windows over them; it is counted first, so it should be a plain read.

    Without a number Spark puts what is few bytes into few tasks, and each sorts more rows the larger the table is.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_IN_TASK)), *keys)


def consecutive_pairs(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Each row with the next row's values as next_*; the last row of a key is left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumns({f"next_{v}": F.lead(v).over(w) for v in values} | {"__more": F.lead(F.lit(True)).over(w)})
    return out.filter("__more").drop("__more")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, touching: bool = True) -> DataFrame:
    """Union of overlapping intervals (those that touch, too, if ``touching``): keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | ((F.col(start) > reach) if touching else (F.col(start) >= reach))
    marked = df.withColumn("__new", new.cast("int")).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__island")


def subtract_intervals(df: DataFrame, covered: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """What remains of the half-open intervals of ``df`` outside those of ``covered``, as disjoint pieces, by boundary events."""
    def events(d: DataFrame, a: int, b: int) -> DataFrame:
        return d.select(*keys, F.col(start).alias("at"), F.lit(a).alias("da"), F.lit(b).alias("db")).union(d.select(*keys, F.col(end), F.lit(-a), F.lit(-b)))

    d = events(df.filter(F.col(start) < F.col(end)), 1, 0).union(events(covered.filter(F.col(start) < F.col(end)), 0, 1))
    d = d.groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(*keys, F.col("at").alias(start), F.lead("at").over(w).alias(end), F.sum("da").over(run).alias("a"), F.sum("db").over(run).alias("b")).filter("a > 0 AND b = 0")
    return merge_intervals(d, keys, start, end).drop("n")


def coalesce_adjacent(df: DataFrame, keys: list[str], fixed: list[str], start: str, length: str) -> DataFrame:
    """Join rows that agree in ``fixed`` and whose spans adjoin exactly; one pass in one direction."""
    w = Window.partitionBy(*keys, *fixed).orderBy(start)
    new = (F.lag(F.col(start) + F.col(length)).over(w) != F.col(start)).cast("int")
    marked = df.withColumn("__island", F.sum(F.coalesce(new, F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, *fixed, "__island").agg(F.min(start).alias(start), F.sum(length).alias(length)).drop("__island")


def coalesce_rects(df: DataFrame, keys: list[str], max_passes: int = 20) -> DataFrame:
    """Merge exactly adjoining rectangles (x, y, w, h) along rows and then columns until nothing changes."""
    from tessera.operators.graph import _ensure_checkpoint_dir

    _ensure_checkpoint_dir(df)
    cur = df.select(*keys, "x", "y", "w", "h").distinct().checkpoint()
    n = cur.count()
    for _ in range(max_passes):
        cur = coalesce_adjacent(coalesce_adjacent(cur, keys, ["y", "h"], "x", "w"), keys, ["x", "w"], "y", "h").select(*keys, "x", "y", "w", "h").checkpoint()
        if (m := cur.count()) == n:
            return cur
        n = m
    raise RuntimeError(f"rectangles still merge after {max_passes} passes")


def carry_forward(df: DataFrame, keys: list[str], order: str, value: Column, rows: int, name: str) -> DataFrame:
    """The last non-null value among this row and the ``rows`` before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def _back_and_ahead(keys: list[str], order: str) -> tuple:
    """Windows of all rows up to this one and, in reverse, of all rows from it on; both grow by a row each, so a key of n rows costs n steps.

    A window that ends at the last row is summed anew for every row, which costs the square of a key's rows.
    """
    w = Window.partitionBy(*keys)
    return tuple(w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(order), F.desc(order)))


def fill_nearest(df: DataFrame, keys: list[str], order: str, at: str, value: Column, name: str) -> DataFrame:
    """The non-null value nearest by ``at``; of two equally near ones the earlier."""
    back, ahead = _back_and_ahead(keys, order)
    seen = F.when(value.isNotNull(), F.struct(F.col(at).alias("at"), value.alias("v")))
    d = df.withColumns({"__b": F.last(seen, ignorenulls=True).over(back), "__a": F.last(seen, ignorenulls=True).over(ahead)})
    near = F.when(F.col("__b").isNull(), F.col("__a.v")).when(F.col("__a").isNull(), F.col("__b.v")).when(F.col(at) - F.col("__b.at") <= F.col("__a.at") - F.col(at), F.col("__b.v")).otherwise(F.col("__a.v"))
    return d.withColumn(name, near).drop("__a", "__b")


def fill_nearest_alike(df: DataFrame, keys: list[str], order: str, at: str, value: Column, kind: str, name: str) -> DataFrame:
    """As fill_nearest, but of two equally near ones the later if it alone is of the row's own kind."""
    back, ahead = _back_and_ahead(keys, order)
    seen = F.when(value.isNotNull(), F.struct(F.col(at).alias("at"), value.alias("v"), F.col(kind).alias("kind")))
    d = df.withColumns({"__b": F.last(seen, ignorenulls=True).over(back), "__a": F.last(seen, ignorenulls=True).over(ahead)})
    da, db = F.col(at) - F.col("__b.at"), F.col("__a.at") - F.col(at)
    later = (db < da) | ((db == da) & (F.col("__a.kind") == F.col(kind)) & (F.col("__b.kind") != F.col(kind)))
    near = F.when(F.col("__b").isNull(), F.col("__a.v")).when(F.col("__a").isNull(), F.col("__b.v")).when(later, F.col("__a.v")).otherwise(F.col("__b.v"))
    return d.withColumn(name, near).drop("__a", "__b")


def priority_fill(df: DataFrame, bucket: str, order: list[str], cap: int, keys: list[str] | None = None) -> DataFrame:
    """Rows by bucket and then by arrival up to ``cap`` for each key; without keys Spark keeps a top-k."""
    if not keys:
        return df.orderBy(bucket, *order).limit(cap)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(bucket, *order))).filter(F.col("__r") <= cap).drop("__r")


def budget_prefix(df: DataFrame, keys: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """Rows in order before the first that takes the running cost over ``cap``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("__total", total)
    over = F.max((F.col("__total") > cap).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__over", over).filter("__over = 0").withColumnRenamed("__total", "running").drop("__over")


def reorder_known(df: DataFrame, key: str, slot: str, rank: str) -> DataFrame:
    """Rows with a rank are put in rank order into the slots that rows with a rank hold; others keep their slots."""
    w = Window.partitionBy(key)
    known = df.filter(F.col(rank).isNotNull())
    places = known.select(F.col(key), F.col(slot).alias("new_slot"), F.row_number().over(w.orderBy(slot)).alias("__i"))
    moved = known.withColumn("__i", F.row_number().over(w.orderBy(rank, slot))).join(places, [key, "__i"]).drop("__i")
    return moved.unionByName(df.filter(F.col(rank).isNull()).withColumn("new_slot", F.col(slot)))


def in_batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Each row with the number of its batch of ``size`` and its place in it, in order."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__r", r).withColumns({"part": F.floor(F.col("__r") / size).cast("int"), "place": (F.col("__r") % size).cast("int")}).drop("__r")


Fold = Callable[..., tuple[np.ndarray, dict[str, np.ndarray]]]


def fold_sequences(df: DataFrame, keys: list[str], order: list[str], fold: Fold, adds: str = "", many: bool = False) -> DataFrame:
    """An ordered fold of each key's rows: ``fold`` gets their columns as arrays and returns places to keep and new columns.

    With ``many`` it gets the rows of many keys at once and, as a second argument, where each begins and the last ends.

    Rows are dealt by key and sorted by Spark, and a task walks through its keys one after another, so it holds one
    sequence and a batch at a time and a key costs no call of its own between Spark and Python.
    """
    schema = T.StructType([*df.schema.fields, *(T._parse_datatype_string(adds).fields if adds else [])])
    n_keys, names = len(keys), df.columns
    key_at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            change = np.zeros(t.num_rows - 1, bool)
            for i in key_at:
                v = t.column(i).to_pandas().to_numpy()
                change |= v[1:] != v[:-1]
            cuts = np.flatnonzero(change) + 1
            if len(cuts):
                yield from folded(t.slice(0, cuts[-1]), np.concatenate([[0], cuts]))
                t = t.slice(cuts[-1])
            held = t
        if held is not None:
            yield from folded(held, np.array([0, held.num_rows]))

    def folded(t: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        cols = {n: t.column(i).to_pandas().to_numpy() for i, n in enumerate(names)}
        places, more = [], []
        if many:
            kept, extra = fold(cols, cuts)
            places.append(np.asarray(kept, np.int64))
            more.append(extra)
        for a, b in () if many else zip(cuts[:-1], cuts[1:], strict=True):
            kept, extra = fold({n: v[a:b] for n, v in cols.items()})
            places.append(np.asarray(kept, np.int64) + a)
            more.append(extra)
        out = t.take(pa.array(np.concatenate(places)))
        for f in schema.fields[len(names) :]:
            out = out.append_column(f.name, pa.array(np.concatenate([m[f.name] for m in more])))
        yield from out.combine_chunks().to_batches()

    assert n_keys
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def debounced_changes(df: DataFrame, keys: list[str], order: str, value: str, hold: int = 3) -> DataFrame:
    """Rows at which the value differs from the last accepted one and holds for ``hold`` rows: an ordered fold for each key."""

    def fold(c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
        v, out, cur = c[value].tolist(), [], None
        for i in range(len(v) - hold + 1):
            if v[i] != cur and all(v[i + j] == v[i] for j in range(hold)):
                out.append(i)
                cur = v[i]
        return np.array(out, np.int64), {}

    return fold_sequences(df.select(*keys, order, value), keys, [order], fold)


def size_capped_batches(df: DataFrame, keys: list[str], order: list[str], size: str, cap: float) -> DataFrame:
    """Greedy parts: a part ends before the row that would take it over ``cap``; an oversized row is a part of its own."""

    def fold(c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
        part, held, out = 0, 0.0, []
        for i, s in enumerate(c[size].tolist()):
            if i and held + s > cap:
                part, held = part + 1, 0.0
            held += s
            out.append(part)
        return np.arange(len(out)), {"part": np.array(out, np.int32)}

    return fold_sequences(df, keys, order, fold, "part int")


def drop_reversals(df: DataFrame, keys: list[str], order: str, cos_limit: float = -0.866, max_leg: float = 4.0) -> DataFrame:
    """Vertices without short legs that turn back by 150 degrees or more: an ordered fold for each polyline."""

    def fold(c: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
        kept: list[int] = []
        xy = list(zip(c["x"].tolist(), c["y"].tolist(), strict=True))
        for i, (x, y) in enumerate(xy):
            while len(kept) >= 2:
                (ax, ay), (bx, by) = xy[kept[-2]], xy[kept[-1]]
                ux, uy, vx, vy = bx - ax, by - ay, x - bx, y - by
                lu, lv = (ux * ux + uy * uy) ** 0.5, (vx * vx + vy * vy) ** 0.5
                if lu and lv and (ux * vx + uy * vy) / (lu * lv) <= cos_limit and min(lu, lv) <= max_leg:
                    kept.pop()
                else:
                    break
            kept.append(i)
        return np.array(kept, np.int64), {}

    return fold_sequences(df.select(*keys, order, "x", "y"), keys, [order], fold)


def _split_lines(x: np.ndarray, y: np.ndarray, cuts: np.ndarray, least: float, from_start: bool = False) -> np.ndarray:
    """Importance of the vertices of many polylines, line i from cuts[i] to cuts[i + 1]: see ``line_importance``.

    All parts of all lines are split at once, level by level of their trees; a level costs the vertices of its parts. With
    ``from_start`` distances are reckoned from a part's start, which differs in the last bit.
    """
    out = np.zeros(len(x))
    a, b = cuts[:-1], cuts[1:] - 1
    out[a] = out[b] = most = np.full(len(a), np.inf)
    while True:
        open_ = b - a >= 2
        a, b, most = a[open_], b[open_], most[open_]
        if not len(a):
            return out
        n = b - a - 1
        first = np.cumsum(n) - n
        part = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(part)) - first[part] + a[part] + 1
        dx, dy = x[b] - x[a], y[b] - y[a]
        d2 = dx * dx + dy * dy
        px, py, dx, dy = x[at] - x[a][part], y[at] - y[a][part], dx[part], dy[part]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(d2[part] > 0, np.clip((px * dx + py * dy) / d2[part], 0.0, 1.0), 0.0)
        if from_start:
            far = np.hypot(px - t * dx, py - t * dy)
        else:
            ex, ey = x[a][part] + t * dx - x[at], y[a][part] + t * dy - y[at]
            far = np.sqrt(ex * ex + ey * ey)
        top = np.maximum.reduceat(far, first)
        split = top > least
        is_top = np.flatnonzero((far == top[part]) & split[part])
        k = at[is_top[np.unique(part[is_top], return_index=True)[1]]]  # the first of equally far ones
        a, b, most = a[split], b[split], np.minimum(top, most)[split]
        out[k] = most
        a, b, most = np.concatenate([a, k]), np.concatenate([k, b]), np.concatenate([most, most])


def simplify_lines(df: DataFrame, keys: list[str], order: str, epsilon: float) -> DataFrame:
    """Douglas-Peucker on each polyline: what has an importance, and so is farther than ``epsilon`` from its part's line, stays."""

    def fold(c: dict[str, np.ndarray], cuts: np.ndarray) -> tuple[np.ndarray, dict]:
        return np.flatnonzero(_split_lines(c["x"].astype(float), c["y"].astype(float), cuts, epsilon, from_start=True) > 0), {}

    return fold_sequences(df.select(*keys, order, "x", "y"), keys, [order], fold, many=True)


def line_importance(df: DataFrame, keys: list[str], order: str, least: float = 0.0) -> DataFrame:
    """Each vertex (x, y) of each polyline with importance: the largest tolerance at which the line still keeps it.

    One pass over the tree of splits: a vertex has its distance from the line between the ends of its part, at most the
    importance of the vertex that made the part, so a line simplified by any tolerance keeps exactly what is above it. Ends
    have infinity, vertices within ``least`` of their part 0. Of equally far vertices the first one splits.
    """

    def fold(c: dict[str, np.ndarray], cuts: np.ndarray) -> tuple[np.ndarray, dict]:
        return np.arange(len(c["x"])), {"importance": _split_lines(c["x"].astype(float), c["y"].astype(float), cuts, least)}

    return fold_sequences(df.select(*keys, order, "x", "y"), keys, [order], fold, "importance double", many=True)


def simplify_to_budget(df: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """Vertices of each polyline with importance and kept: those above the least tolerance that keeps at most ``budget``.

    Equally important vertices stay or go together, so fewer may be kept; ends always stay.
    """
    from pyspark.sql import Window

    ranked = line_importance(df, keys, order).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("importance"), order)))
    over = F.coalesce(F.max(F.when(F.col("__r") > budget, F.col("importance"))).over(Window.partitionBy(*keys)), F.lit(-1.0))
    return ranked.withColumn("kept", (F.col("importance") > over) | (F.col("importance") == float("inf"))).drop("__r")


def greedy_labels(df: DataFrame, keys: list[str], order: list[str], size: int = 16) -> DataFrame:
    """Boxes (x, y, w, h) taken in order unless they overlap one taken before; only boxes of equal keys can meet.

    Of equal boxes only the first can be taken: it bars the others, or what bars it bars them, too. Overlaps of the rest come
    from one grid join. In each round the boxes without an earlier neighbour left are taken and their later
    neighbours drop out, which frees further ones, so the rounds follow the longest chain of overlaps, not the number of
    boxes. Each round settles one box at least, so they end.
    """
    from tessera.operators.graph import stored, unstore
    from tessera.operators.spatial import box_join

    boxes = df.withColumn("__id", F.monotonically_increasing_id())
    same = Window.partitionBy(*keys, "x", "y", "w", "h")
    again = (F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.struct(*order, "__id") > F.min(F.struct(*order, "__id")).over(same))
    boxes = stored(boxes.withColumn("__again", F.coalesce(again, F.lit(False))))
    place = boxes.filter("NOT __again").select("__id", F.struct(*order, "__id").alias("o"), F.struct(F.lit(0), *keys).alias("k"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    over = (F.col("l_x1") < F.col("r_x2")) & (F.col("r_x1") < F.col("l_x2")) & (F.col("l_y1") < F.col("r_y2")) & (F.col("r_y1") < F.col("l_y2"))
    pairs = box_join(place, place, size).filter(over & F.col("l_k").eqNullSafe(F.col("r_k")) & (F.col("l_o") < F.col("r_o"))).select(F.col("l___id").alias("a"), F.col("r___id").alias("b")).transform(stored)
    lost = boxes.filter("__again").select(F.col("__id").alias("b"))
    while True:
        if pairs.isEmpty():
            return boxes.join(lost.select(F.col("b").alias("__id")), "__id", "left_anti").select(*df.columns)
        taken = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")), "a", "left_anti")
        out = pairs.join(taken, "a", "left_semi").select("b").distinct().transform(stored)
        before, pairs = pairs, pairs.join(out, "b", "left_anti").join(out.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b").transform(stored)
        lost = stored(lost.union(out))
        unstore(before)
