"""Sharding by global byte-size prefix sums: contiguous shards of nearly equal size, in DataFrame operations only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SHARDS = 16
ROWS_PER_RANGE = 200_000
LEAST_RANGES = 128
CUTS = 1024


def range_bucket(df: DataFrame, key: str, rows_per_range: int = ROWS_PER_RANGE, tie: str | None = None) -> tuple[Column, int]:
    """An expression that numbers each row's range of an integer ``key`` in order, and how many numbers there are.

    Up to CUTS approximate quantiles cut the keys into parts of nearly equal numbers of rows; for more ranges than that,
    each part is divided evenly by key. So a range has about ``rows_per_range`` rows, or fewer, while keys are spread
    evenly within a part. Null keys come first. A key that is several of the quantiles, and null keys, are divided by
    ``tie``, a column of even numbers from 0 to 2**32 - 1, if it is given: rows are then ranged by key and tie.
    """
    rows, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    wanted = max(LEAST_RANGES, -(-rows // rows_per_range))
    n, within = min(CUTS, wanted), -(-wanted // CUTS)
    split = lambda r: max(1, -(-r // max(1, min(rows_per_range, rows // n)))) if tie else 1
    by_tie = lambda first, parts: F.lit(first) if parts == 1 else F.lit(first) + F.floor(F.col(tie).cast("long") * parts / (1 << 32)).cast("int")
    points = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(key, points, 20 * CUTS).alias("q"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    of_nulls = split(nulls)
    if row["low"] is None:
        return by_tie(0, of_nulls), of_nulls
    seen = Counter(int(x) for x in row["q"])
    hot = {k: split(-(-rows * c // n)) for k, c in seen.items() if c > 1}
    edges = sorted({int(row["low"]) - 1, *seen, *(k - 1 for k in hot), int(row["high"])})  # part i: above edge i, to edge i + 1
    edges = [e for e in edges if int(row["low"]) - 1 <= e <= int(row["high"])]
    parts = [hot.get(e, 1) if e - d == 1 else within for d, e in zip(edges[:-1], edges[1:], strict=True)]
    firsts = [of_nulls * (nulls > 0) + sum(parts[:i]) for i in range(len(parts))]

    def tree(lo: int, hi: int) -> Column:
        # a row meets about log2(CUTS) comparisons
        if lo == hi:
            if parts[lo] == 1:
                return F.lit(firsts[lo])
            wide = edges[lo + 1] - edges[lo]
            if wide == 1:
                return by_tie(firsts[lo], parts[lo])
            return F.lit(firsts[lo]) + F.floor((F.col(key) - F.lit(edges[lo] + 1)) * F.lit(parts[lo]) / F.lit(wide)).cast("int")
        mid = (lo + hi) // 2
        return F.when(F.col(key) <= F.lit(edges[mid + 1]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    ranges = tree(0, len(parts) - 1)
    return (F.when(F.col(key).isNull(), by_tie(0, of_nulls)).otherwise(ranges) if nulls else ranges), firsts[-1] + parts[-1]


def shard_by_bytes(df: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Every input row with size, text_crc32, law, shard, slot and grown_shard.

    Rows are ordered by (id, CRC of the text, size); nulls come first. Totals of ranges of ids give each range its global
    byte and row offsets, and a running sum within the range gives each row's. A row goes to the shard in which its first
    byte falls when the total is cut into equal parts, so shards are contiguous and differ by less than one row's size.
    Size is the UTF-8 length of the text plus 1; a null text counts as empty. Rows that agree in all three keys have the
    same content and take neighbouring slots in either order. Columns of the input that bear a result's name are replaced.
    An empty table gives no rows. The text itself is never used as a key; callers that select only keys shuffle no text.
    """
    own = [c for c in df.columns if c not in {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}]
    base = df.select(*own)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary"))})
    bucket, _ = range_bucket(base.select(id_col, "text_crc32"), id_col, rows_per_range, "text_crc32")
    base = base.withColumn("__range", bucket)

    totals = base.groupBy("__range").agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    # one row for each range: a global running sum over these is small
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__range",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    inside = Window.partitionBy("__range").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")
    placed = (
        base.withColumns({"__row": F.row_number().over(inside) - 1, "__end": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
        .join(F.broadcast(offsets), "__range")  # rows / rows_per_range rows of four longs: 5 MB for 30 thousand million rows
        .withColumn("__start", F.col("__bytes_before") + F.col("__end") - F.col("size"))
        .withColumn("__at", F.col("__rows_before") + F.col("__row"))
        .withColumn("shard", F.least(F.floor(F.col("__start").cast("decimal(38,0)") * n_shards / F.col("__total")), F.lit(n_shards - 1)).cast("int"))
    )
    firsts = placed.groupBy("shard").agg(F.min("__at").alias("__first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # n_shards rows
        *own, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__at") - F.col("__first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: The query's rows in DuckDB, with CRC-32 by its table of 256 remainders.
SHARDS_SQL = """WITH crcs AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n) a) b),
bytes AS (SELECT doc_id, [4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
d AS (SELECT doc_id, CAST(len(b) AS BIGINT) AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM bytes, crcs),
p AS (SELECT *, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, row_number() OVER w AS place, sum(size) OVER () AS total FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, crc, size)),
s AS (SELECT *, CAST(least(start * 16 // total, 15) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
