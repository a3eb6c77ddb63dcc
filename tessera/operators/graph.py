"""Graph operators: connected components by alternating star contractions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many edges (two numbers each) components are found in one task instead of in rounds; the result is the same.
SMALL_EDGES = 300_000


def _ensure_checkpoint_dir(df: DataFrame) -> None:
    """Checks that checkpoints have a folder; a session of one machine that names none gets a local one."""
    sc = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("/tmp/tessera-checkpoints")


def stored(df: DataFrame) -> DataFrame:
    """The table written below the checkpoint folder and read back: for rounds of joins.

    A checkpoint keeps the optimiser's estimates, and those of a join are the product of its sides', so over many rounds of
    checkpointed joins they grow beyond all bounds; a written table has the size of its files. See ``unstore``.
    """
    _ensure_checkpoint_dir(df)
    spark = df.sparkSession
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = spark.conf.get("spark.checkpoint.dir", None) or held.get()
    path = f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def unstore(*tables: DataFrame | None) -> None:
    """Delete stored tables once all that was made of them is stored, too."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def shared(df: DataFrame) -> DataFrame:
    """The table after its shuffles have run, for several jobs that read them: they are shuffled once and nothing is written besides."""
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def _least_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v): labels fall to the least of both ends and are then followed to their ends."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    nodes, at = np.unique(np.concatenate([table.column(0).to_numpy(), table.column(1).to_numpy()]), return_inverse=True)
    u, v = at[: table.num_rows], at[table.num_rows :]
    label = np.arange(len(nodes))
    while (label[u] != label[v]).any():
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (after := label[label])).any():
            label = after
    yield pa.RecordBatch.from_arrays([pa.array(nodes, table.schema.field(0).type), pa.array(nodes[label], table.schema.field(0).type)], names=["node", "component"])


def _by_neighbourhoods(e: DataFrame, parts: int, max_rounds: int, small_edges: int) -> DataFrame:
    """As ``connected_components`` for edges (u, v): ranges of nodes find their own components first, in a task each.

    A node is then in as many of these as ranges have edges of it; what joins them is a graph of its own, and a small one
    where most edges are between near numbers.
    """
    kind = e.schema["u"].dataType.simpleString()
    local = e.repartitionByRange(parts, "v", "u").mapInArrow(_least_of_all, f"node {kind}, component {kind}").checkpoint()
    of = local.groupBy("node").agg(F.min("component").alias("m"), F.max("component").alias("most")).checkpoint()
    links = local.join(of.filter("m < most").select("node", "m"), "node").filter("component <> m").select("component", "m")
    joined = connected_components(links, "component", "m", max_rounds, small_edges).toDF("m", "c")
    return of.join(joined, "m", "left").select("node", F.coalesce("c", "m").alias("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50, small_edges: int = SMALL_EDGES, near: bool = False) -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    Each round links every node's larger neighbours, and then its smaller ones, to the least node in reach, which halves
    paths; edges are checkpointed each round. Sums are combined before shuffling, so a node with very many edges is no
    hot spot in the grouping, and AQE splits its side of the join. Once at most ``small_edges`` edges are left, at the
    start or after a round, one task finishes them. With ``near``, for edges that are mostly between near numbers, as those of
    places are, ranges of nodes are contracted in tasks before the first round, so fewer edges go through rounds. Loops and null ends are ignored. Raises RuntimeError if the edges
    still change after ``max_rounds``.
    """
    _ensure_checkpoint_dir(edges)
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
    if near and (n := edges.count()) > small_edges:  # repeats do no harm to ranges
        return _by_neighbourhoods(e, -(-n // max(1, small_edges)), max_rounds, small_edges)
    e = e.distinct().checkpoint()
    kind = e.schema["u"].dataType.simpleString()
    n, seen = e.count(), None
    for _ in range(max_rounds):
        if n <= small_edges:
            return e.coalesce(1).mapInArrow(_least_of_all, f"node {kind}, component {kind}")
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().checkpoint()
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen, n = state, state[0]
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
