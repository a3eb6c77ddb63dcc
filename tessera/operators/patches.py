"""Patches of street networks: operations in one transaction each, applied whole or refused with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("remove", "width", "surface", "add", "bridge")
# What a width may be, and the surfaces there are.
WIDTHS, SURFACES = (1.0, 64.0), ("paved", "gravel", "dirt", "unknown")


def patch_findings(segs: DataFrame, ops: DataFrame, headers: DataFrame) -> DataFrame:
    """(patch, refused) of every header: the first thing that is wrong with a patch, or null.

    ``ops`` is (patch, kind, street, seg, id, value, surface, x1, y1, x2, y2), ``headers`` (patch, kind, n): how many operations of
    each kind a patch says that it has; ``segs`` has patch, the one that may change a segment. Operations are checked in the
    order of KINDS after their counts. Those of segments must name one that the patch may change, at most once for each
    kind; widths and surfaces must be valid; a new segment needs an id of its own and a length.
    """
    counted = headers.join(ops.groupBy("patch", "kind").agg(F.count(F.lit(1)).alias("has")), ["patch", "kind"], "left")
    counts = counted.filter(F.col("n") != F.coalesce("has", F.lit(0))).select("patch", F.lit(0).alias("at"), F.lit("count mismatch").alias("why"))
    known = segs.select("patch", "street", "seg", F.lit(True).alias("known"))
    named = ops.filter(F.col("kind").isin("remove", "width", "surface")).join(known, ["patch", "street", "seg"], "left")
    named = named.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("patch", "kind", "street", "seg")))
    fine_width = F.coalesce(F.col("value").between(*WIDTHS), F.lit(False))
    fine_surface = F.coalesce(F.col("surface").isin(*SURFACES), F.lit(False))
    bad = F.col("known").isNull() | (F.col("times") > 1) | ((F.col("kind") == "width") & ~fine_width) | ((F.col("kind") == "surface") & ~fine_surface)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("at")
    conflicts = named.filter(bad).select("patch", place, F.concat("kind", F.lit(" conflict")).alias("why"))
    new = ops.filter(F.col("kind").isin("add", "bridge")).withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("patch", "id")))
    moved = F.coalesce((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")), F.lit(False))
    invalid = new.filter(F.col("id").isNull() | (F.col("times") > 1) | ~fine_width | ~fine_surface | ~moved).select("patch", place, F.concat(F.lit("invalid "), "kind").alias("why"))
    first = counts.union(conflicts).union(invalid).groupBy("patch").agg(F.min(F.struct("at", "why")).alias("m"))
    return headers.select("patch").distinct().join(first, "patch", "left").select("patch", F.col("m.why").alias("refused"))


def apply_patches(segs: DataFrame, ops: DataFrame, headers: DataFrame) -> DataFrame:
    """Segments after all patches that hold: (patch, street, seg, id, x1, y1, x2, y2, width, surface, bridge).

    Of a refused patch no operation is applied. Removed segments go, widths and surfaces are set, and added segments and
    bridges follow with an id instead of a street. One join by segment for all changes, as a patch names each once.
    """
    held = patch_findings(segs, ops, headers).filter("refused IS NULL").select("patch")
    good = ops.join(held, "patch", "left_semi")
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    changes = good.filter(F.col("kind").isin("remove", "width", "surface")).groupBy("patch", "street", "seg").agg(of("remove", F.lit(True)).alias("gone"), of("width", F.col("value")).alias("w"), of("surface", F.col("surface")).alias("s"))
    kept = segs.join(changes, ["patch", "street", "seg"], "left").filter("gone IS NULL")
    shape = ["x1", "y1", "x2", "y2"]
    kept = kept.select("patch", "street", "seg", F.lit(None).cast("string").alias("id"), *shape, F.coalesce("w", "width").alias("width"), F.coalesce("s", "surface").alias("surface"), "bridge")
    new = good.filter(F.col("kind").isin("add", "bridge")).select("patch", F.lit(None).cast("long").alias("street"), F.lit(None).cast(segs.schema["seg"].dataType).alias("seg"), "id", *shape, F.col("value").alias("width"), "surface", (F.col("kind") == "bridge").alias("bridge"))
    return kept.union(new)
