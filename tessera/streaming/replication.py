"""Structured Streaming forms of the state recipes: latest revisions, rate limits, session timeouts, idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.state import accepted_at, latest_revision


def accept_newer(stream: DataFrame, key: str, revision: str) -> DataFrame:
    """Of each key only rows whose revision is above all accepted before, with that state kept across batches.

    A micro-batch's rows of a key are taken in order of their revision, so what is accepted does not depend on how Arrow
    cuts it; of rows with equal revisions the first that came.
    """
    kind = stream.schema[revision].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(revision, kind="stable")  # a key's rows in one micro-batch
        new = pdf[~pdf[revision].duplicated()]
        if state.exists:
            new = new[new[revision] > state.get[0]]
        if len(new):
            state.update((int(new[revision].iloc[-1]),))
        yield new

    return stream.groupBy(key).applyInPandasWithState(step, stream.schema, f"seen {kind}", "append", GroupStateTimeout.NoTimeout)


def rate_limit(stream: DataFrame, key: str, ts: str, limit_s: float = 1.0) -> DataFrame:
    """Rows at least ``limit_s`` after the row of their key accepted before, in order of time within a batch."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(ts, kind="stable")  # a key's rows in one micro-batch
        micros = pdf[ts].astype("datetime64[us]").astype("int64").to_numpy()
        kept = accepted_at(micros, limit_s * 1e6, state.get[0] if state.exists else None)
        if len(kept):
            state.update((int(micros[kept[-1]]),))
        yield pdf.iloc[kept]

    return stream.groupBy(key).applyInPandasWithState(step, stream.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def session_counts(stream: DataFrame, key: str, ts: str, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key by event time with a gap; rows later than the watermark are dropped by Spark."""
    t = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    return t.groupBy(key, F.session_window("__t", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def windowed_counts(stream: DataFrame, key: str, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    t = stream.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    return t.groupBy(F.window("__t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def upsert_to(path: str, key: list[str], revision: str):
    """A foreachBatch function that merges a batch into versions of a table: version i holds all rows up to batch i.

    A batch that is replayed writes its version again from the version before it, so the merge is idempotent.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = batch if batch_id == 0 else spark.read.parquet(f"{path}/v{batch_id - 1}").unionByName(batch)
        latest_revision(merged, key, [revision]).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return merge
