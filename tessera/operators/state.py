"""Replicated state as batch recipes: latest revisions, watermarks, rate limits, sessions, snapshots, reconciliation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import fold_sequences


def latest_revision(df: DataFrame, key: list[str], revision: list[str]) -> DataFrame:
    """The row of the highest revision of each key; of equal ones the last by the further columns of ``revision``.

    Rows are combined before the shuffle, so a key with very many revisions is no hot spot.
    """
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*revision)).alias("__row"))
    return best.select(*[F.col(c) if c in key else F.col(f"__row.{c}") for c in df.columns])


def accepted_at(t: np.ndarray, limit: float, last: float | None = None) -> np.ndarray:
    """Places of the sorted times that are at least ``limit`` after the one accepted before; refused ones move nothing."""
    out, i = [], 0
    while i < len(t):
        if last is not None:
            i = max(i, int(np.searchsorted(t, last + limit - 1e-6)))
            while i < len(t) and t[i] - last < limit:
                i += 1
        if i < len(t):
            out.append(i)
            last = t[i]
            i += 1
    return np.array(out, np.int64)


def rate_limited(df: DataFrame, key: list[str], ts: Column, limit_s: float = 1.0, order: str = "seq") -> DataFrame:
    """First rows of each key, and rows at least ``limit_s`` after the row accepted before them: an ordered fold.

    A row after a pause of ``limit_s`` is accepted whatever came before, so the fold starts anew there and a key with very
    many rows is dealt over as many tasks as it has pauses.
    """
    w = Window.partitionBy(*key).orderBy("__t", order)
    d = df.withColumn("__t", ts).withColumn("__new", F.coalesce(F.col("__t") - F.lag("__t").over(w) >= limit_s, F.lit(True)).cast("long"))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    kept = fold_sequences(d, [*key, "__run"], ["__t", order], lambda c: (accepted_at(c["__t"], limit_s), {}))
    return kept.drop("__t", "__run")


def sessions(df: DataFrame, key: list[str], ts: Column, gap_s: float = 300, order: str = "seq") -> DataFrame:
    """Each row with its session's number: a new one begins after a gap of more than ``gap_s``."""
    w = Window.partitionBy(*key).orderBy("__t", order)
    d = df.withColumn("__t", ts)
    new = F.col("__t") - F.lag("__t").over(w) > gap_s
    return d.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__t", "__new")


def monotone_sequence(df: DataFrame, key: list[str], now: str, order: str) -> DataFrame:
    """seq_i = max(now_i, seq_(i-1) + 1): the running maximum of now - position, plus position."""
    w = Window.partitionBy(*key).orderBy(order)
    d = df.withColumn("__i", F.row_number().over(w))
    return d.withColumn("sequence", F.max(F.col(now) - F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__i")).drop("__i")


def after_watermark(df: DataFrame, mark: DataFrame, key: list[str], value: str, name: str = "watermark") -> DataFrame:
    """Rows newer than their key's watermark; keys without one pass."""
    return df.join(mark, key, "left").filter(F.col(name).isNull() | (F.col(value) > F.col(name))).drop(name)


def reuploads(df: DataFrame, key: list[str], kind: Column, order: str) -> DataFrame:
    """The items a key has after its last reset: earlier ones were not sent again and are gone."""
    w = Window.partitionBy(*key)
    d = df.withColumn("__reset", F.max(F.when(kind, F.col(order))).over(w))
    return d.filter(F.col("__reset").isNull() | (F.col(order) > F.col("__reset"))).drop("__reset")


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: list[str], order: str, deleted: str) -> DataFrame:
    """A snapshot with a change log applied: the last change of a key wins, tombstones remove it. Snapshot order is -1."""
    both = snapshot.withColumns({order: F.lit(-1).cast("long"), deleted: F.lit(False)}).unionByName(changes)
    return latest_revision(both, key, [order]).filter(~F.col(deleted)).drop(deleted)


def reconcile(ours: DataFrame, theirs: DataFrame, key: list[str], digest: Column) -> DataFrame:
    """Keys whose (count, digest sum) differ between two stores; a full exchange is needed for these only."""
    side = lambda d, p: d.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{p}_n"), F.pmod(F.sum(digest), F.lit(2147483647)).alias(f"{p}_digest"))
    j = side(ours, "ours").join(side(theirs, "theirs"), key, "full_outer")
    return j.filter(~(F.col("ours_n").eqNullSafe(F.col("theirs_n")) & F.col("ours_digest").eqNullSafe(F.col("theirs_digest"))))


def evict(df: DataFrame, key: list[str], seen: Column, keep: int, idle_before: Column | None = None, tie: str = "seq") -> DataFrame:
    """At most ``keep`` rows of each key, the last seen; with ``idle_before``, also none seen before it."""
    d = df if idle_before is None else df.filter(seen >= idle_before)
    w = Window.partitionBy(*key).orderBy(seen.desc(), F.desc(tie))
    return d.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= keep).drop("__r")


def retained(df: DataFrame, seen: Column, tie: str, most: int, keep: int) -> DataFrame:
    """All rows if there are at most ``most``, else the ``keep`` last seen; truncated tells which. Spark keeps a top-k."""
    n = df.agg((F.count(F.lit(1)) > most).alias("truncated"))
    top = df.orderBy(seen.desc(), tie).limit(most + 1)
    ranked = top.withColumn("__r", F.row_number().over(Window.orderBy(seen.desc(), tie)))  # most + 1 rows
    return ranked.crossJoin(F.broadcast(n)).filter(~F.col("truncated") | (F.col("__r") <= keep)).drop("__r")


def optimistic_updates(df: DataFrame, key: list[str], order: str, expected: str) -> DataFrame:
    """Updates in order, each accepted if it expects the revision that the accepted ones before it made: rows with accepted.

    Revision i is expected by the update that is accepted as number i, so the accepted ones are the first row expecting 0,
    the first later one expecting 1, and so on: an ordered fold for each key.
    """

    def fold(c):
        rev, out = 0, []
        for e in c[expected].tolist():
            ok = e == rev
            rev += ok
            out.append(ok)
        return np.arange(len(out)), {"accepted": np.array(out, bool)}

    return fold_sequences(df, key, [order], fold, "accepted boolean")


def snapshot_parts(df: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """Each row with its part, from 1, and the number of parts of its key's snapshot."""
    w = Window.partitionBy(*key)
    n = F.count(F.lit(1)).over(w)
    r = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumns({"part": (F.floor(r / size) + 1).cast("int"), "parts": F.floor((n + size - 1) / size).cast("int")})


def whole_snapshots(df: DataFrame, key: list[str], seq: str, part: str, parts: str) -> DataFrame:
    """The rows of each key's newest snapshot of which every part has come; older and partial ones are left out."""
    whole = df.groupBy(*key, seq).agg(F.count_distinct(part).alias("__n"), F.max(parts).alias("__all")).filter("__n = __all")
    newest = whole.groupBy(*key).agg(F.max(seq).alias(seq))
    return df.join(newest, [*key, seq], "left_semi")


def running_states(df: DataFrame, key: list[str], order: str, done: Column, percent: int) -> DataFrame:
    """Each row's state by what has come so far: cleared at ``percent`` done, refreshed once it falls below, else visited."""
    run = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__ok", F.sum(F.when(done, 1).otherwise(0)).over(run) * 100 >= percent * F.count(F.lit(1)).over(run))
    was = F.max("__ok").over(run)
    return d.withColumn("state", F.when(F.col("__ok"), "cleared").when(was, "refreshed").otherwise("visited")).drop("__ok")


def keep_active(df: DataFrame, key: list[str], at: str, dirty: Column, idle: int) -> DataFrame:
    """(key, n, last_seq) of the keys that stay: seen within ``idle`` of the newest row, or with something unsaved."""
    now = df.agg(F.max(at).alias("__now"))
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"), F.max(at).alias("__last"), F.count_if(dirty).alias("__dirty"))
    return per.crossJoin(F.broadcast(now)).filter(~((F.col("__now") - F.col("__last") > idle) & (F.col("__dirty") == 0))).select(*key, "n", "last_seq")  # one row beside each
