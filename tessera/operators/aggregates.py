"""Aggregates: summaries, class shares, moments, profiles, best rows with ties, digests and conservative merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, p95 (linear between ranks) and max, to six decimals."""
    r = lambda c: F.round(c, 6)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), r(F.avg(value)).alias("mean"), r(F.median(value)).alias("median"), r(F.percentile(value, 0.95)).alias("p95"), r(F.max(value)).alias("max"))


def amortised(df: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Per key: frames over all, mean over all frames of the table, median and rate of the frames where it is not zero."""
    frames = df.agg(F.count_distinct(frame).alias("frames"))
    per = df.groupBy(*keys, frame).agg(F.sum(value).alias("v"))
    out = per.groupBy(*keys).agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("total"), F.median(F.when(F.col("v") > 0, F.col("v"))).alias("median_nonzero"), F.count_if(F.col("v") > 0).alias("hits"))
    # one row beside each
    return out.crossJoin(F.broadcast(frames)).select(*keys, "hits", F.round(F.col("total") / F.col("frames"), 6).alias("amortised"), F.round("median_nonzero", 6).alias("median_nonzero"), F.round(F.col("hits") / F.col("frames"), 6).alias("rate"))


def dominant_class(df: DataFrame, keys: list[str], cls: str, share: float = 0.8) -> DataFrame:
    """The class with at least ``share`` of a key's rows and more than any other, else unknown."""
    n = df.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy(*keys).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by(cls, "n").alias("best"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))  # one number for each class
    tied = (F.size("ns") > 1) & (F.get("ns", F.lit(1)) == F.col("most"))
    return out.select(*keys, "total", "most", F.when((F.col("most") >= share * F.col("total")) & ~tied, F.col("best")).otherwise("unknown").alias("cls"))


def class_mode(df: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """The most frequent class of each key; of equals the first by name."""
    n = df.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min_by(F.col(cls), F.struct(-F.col("n"), F.col(cls))).alias("mode"), F.max("n").alias("n"))


def principal_axis(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Centre, the eigenvalues of the 2 x 2 covariance and the direction of the larger one."""
    m = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("a"), F.var_pop(y).alias("c"), F.covar_pop(x, y).alias("b"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    angle = F.lit(0.5) * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))
    return m.select(*keys, "n", *(F.round(v, 4).alias(k) for k, v in {"mx": F.col("mx"), "my": F.col("my"), "l1": half + root, "l2": half - root, "angle": angle}.items()))


def axis_profile(df: DataFrame, keys: list[str], along: Column, across: Column, bin_size: float = 4) -> DataFrame:
    """Widths by bins along an axis: n, bins, median and p95 of max - min across."""
    bins = df.groupBy(*keys, F.floor(along / bin_size).alias("bin")).agg((F.max(across) - F.min(across)).alias("width"))
    return bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("bins"), F.round(F.median("width"), 6).alias("median_width"), F.round(F.percentile("width", 0.95), 6).alias("p95_width"))


def best_row(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Columns of the first row of each key in the order given."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def merge_edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """Parallel edges as one, never better than any: surfaces that differ are unknown, least width, all masks, bridge if all."""
    ends = df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
    return ends.groupBy("lo", "hi").agg(
        F.when(F.min("surface") == F.max("surface"), F.min("surface")).otherwise("unknown").alias("surface"),
        F.min("width").alias("width"), F.bit_or("mask").alias("mask"), F.bool_and("bridge").alias("bridge"), F.count(F.lit(1)).alias("n"),
    )


def group_by_shared(df: DataFrame, item: str, shared: list[str]) -> DataFrame:
    """Items that share any key, directly or through others: (item, component), the component its smallest item.

    Each key links its items to its smallest one, so a key held by many items adds as many links, not their square.
    """
    keyed = df.select(item, F.xxhash64(*shared).alias("__key")).distinct()
    links = keyed.join(keyed.groupBy("__key").agg(F.min(item).alias("__first")), "__key")
    comps = connected_components(links.select(F.col(item).alias("src"), F.col("__first").alias("dst")))
    return df.select(item).distinct().join(comps, F.col(item) == F.col("node"), "left").select(item, F.coalesce("component", item).alias("component"))


def best_category(rooms: DataFrame, categories: DataFrame, accessory: float = 0.1, house_area: int = 800) -> DataFrame:
    """The first category, by priority, that passes its gates for each building.

    ``rooms`` has building, room, area; ``categories`` room, cat, priority and accessory (bool). An accessory room counts
    with at least a tenth of the building's area; a house passes up to ``house_area`` and with a tenth of bedrooms.
    """
    total = rooms.groupBy("building").agg(F.sum("area").alias("total"))
    part = rooms.join(F.broadcast(categories), "room").groupBy("building", "cat", "priority", "accessory").agg(F.sum("area").alias("part"))  # categories: a table of the caller's, some hundred rows
    ok = part.join(total, "building").filter(F.when(F.col("cat") == "house", (F.col("total") <= house_area) & (F.col("part") >= accessory * F.col("total"))).otherwise(~F.col("accessory") | (F.col("part") >= accessory * F.col("total"))))
    return ok.groupBy("building").agg(F.min_by("cat", F.struct("priority", "cat")).alias("cat"), F.max("total").alias("area"))
