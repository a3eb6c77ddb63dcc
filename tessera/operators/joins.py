"""Equi, anti, semi and precedence joins with the checks that make them safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unambiguous(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value) of the keys with one distinct value; keys with several have no row."""
    return df.groupBy(*key).agg(F.min(value).alias(value), F.max(value).alias("__most")).filter(F.col(value) == F.col("__most")).drop("__most")


def lookup_unless_ambiguous(df: DataFrame, lookup: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each row with the lookup's value of its key; null where the lookup has none, or several different ones."""
    return df.join(unambiguous(lookup, key, value), key, "left")


def with_lookup(df: DataFrame, lookup: DataFrame, key: list[str], value: str, default: Column) -> DataFrame:
    """Left join with a default for what the lookup lacks."""
    return df.join(lookup, key, "left").withColumn(value, F.coalesce(F.col(value), default))


def live_wins(live: DataFrame, registry: DataFrame, key: list[str], flag: str = "online") -> DataFrame:
    """All live rows and the registry rows without a live one; ``flag`` tells them apart."""
    return live.withColumn(flag, F.lit(True)).unionByName(registry.join(live.select(*key), key, "left_anti").withColumn(flag, F.lit(False)), allowMissingColumns=True)


def all_or_nothing(df: DataFrame, patch: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows with the patch's columns put in, if every patch row meets exactly one row; else rows as they are, applied false."""
    p = patch.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    met = p.join(df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")), key, "left")
    good = met.agg(F.coalesce(F.bool_and(F.coalesce("__n", F.lit(0)) == 1), F.lit(True)).alias("applied"))
    out = df.join(p.withColumn("__hit", F.lit(True)), key, "left").crossJoin(F.broadcast(good))  # one row beside each
    return out.select(*[F.when(F.col("applied") & F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns], "applied")


def either_key(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], columns: list[str]) -> DataFrame:
    """Pairs that agree in any of several keys, once: one equi-join for each key instead of a join with OR.

    A pair is kept at the first key in which it agrees, so pairs need not be told apart afterwards. Only rows whose
    ``columns`` another row of their side has, too, with other keys, can bring a pair again; theirs alone are made distinct.
    """
    def marked(side: DataFrame, keys: list[str], flag: str) -> DataFrame:
        own = [c for c in side.columns if c in columns]
        rows = side.select(*{*own, *keys}).distinct()
        return rows.withColumn(flag, F.count(F.lit(1)).over(Window.partitionBy(*own or [F.lit(0)])) > 1)

    lefts, rights = marked(left, [a for a, _ in pairs], "__l"), marked(right, [b for _, b in pairs], "__r")
    out, before = None, F.lit(False)
    for a, b in pairs:
        got = lefts.join(rights, (lefts[a] == rights[b]) & ~before).select(*columns, (F.col("__l") | F.col("__r")).alias("__again"))
        before = before | F.coalesce(lefts[a] == rights[b], F.lit(False))
        out = got if out is None else out.union(got)
    return out.filter("NOT __again").drop("__again").union(out.filter("__again").drop("__again").distinct())


def by_precedence(df: DataFrame, key: list[str], rank: Column, columns: list[str]) -> DataFrame:
    """One row for each key: the one of least rank, ties by the columns in order."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(rank, *columns)).alias("__row")).select(*key, "__row.*")


def without_pairs(pairs: DataFrame, excluded: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that are not excluded in either order."""
    both = excluded.select(a, b).union(excluded.select(F.col(b), F.col(a)))
    return pairs.join(both, [a, b], "left_anti")


def highest_owner(df: DataFrame, cell: list[str], rank: str) -> DataFrame:
    """Rows of the best-ranked source of their cell, others gone."""
    best = df.groupBy(*cell).agg(F.min(rank).alias("__best"))
    return df.join(best, cell).filter(F.col(rank) <= F.col("__best")).drop("__best")


def translated(df: DataFrame, names: DataFrame, key: list[str], text: str, active: Column, original: Column) -> DataFrame:
    """Rows with ``text``: the one translation that active sources have of their key, else the original."""
    return lookup_unless_ambiguous(df, names.filter(active).select(*key, text), key, text).withColumn(text, F.coalesce(text, original))


def converted(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that can be converted, and one row that counts all and the skipped; a null check is a failed one."""
    good = F.coalesce(ok, F.lit(False))
    return df.filter(good), df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~good).alias("skipped"))


def passing_gates(df: DataFrame, gates: dict[str, str]) -> DataFrame:
    """Rows that no gate closes: each gate is a SQL predicate by name, one false closes, and null or an error passes.

    An error closes nothing only if the predicate yields null for it, so predicates are written with ``try_`` functions
    (``try_cast``, ``try_divide``, ``try_to_timestamp``, ``try_element_at``), which Spark evaluates without leaving the plan.
    Column ``closed_by`` of ``gate_findings`` has the names of gates that are false.
    """
    return gate_findings(df, gates).filter(F.size("closed_by") == 0).drop("closed_by")


def gate_findings(df: DataFrame, gates: dict[str, str]) -> DataFrame:
    """Every row with ``closed_by``, the names of the gates that are false for it, in the order of registration."""
    closed = [F.when(~F.coalesce(F.expr(predicate), F.lit(True)), F.lit(name)) for name, predicate in gates.items()]
    return df.withColumn("closed_by", F.array_compact(F.array(*closed)) if closed else F.array().cast("array<string>"))
