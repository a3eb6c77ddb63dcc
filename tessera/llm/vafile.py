"""Vector codes by a product quantiser whose nearest entries are found as in a VA-file.

The coordinates of a codebook's entries are quantised to a few bits. For each vector part, tables by cell give the least
and the greatest squared distance in that coordinate; their sums bound the distance to every entry, and only entries whose
bounds overlap the best one are compared exactly. All numbers are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textops import written

PARTS, ENTRIES, ROUNDS, BITS = 16, 64, 2, 4
SCALE = 256
#: Components are held within this, so that squared distances of a vector stay below 2**63.
LARGEST = 1 << 18
BLOCK_ROWS = 2_048
BROADCAST_LABELS = 100_000


class CellFile:
    """The entries of one codebook (entries x dims of whole numbers), each coordinate in one of at most ``2**bits`` cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries.astype(np.int64)
        n, dims = self.entries.shape
        cells = min(1 << bits, n)
        self.cell = np.zeros((n, dims), np.int64)
        self.low, self.high = np.zeros((dims, cells), np.int64), np.zeros((dims, cells), np.int64)
        for d in range(dims):
            x = self.entries[:, d]
            edges = np.sort(x)[np.arange(1, cells) * n // cells]
            used, own = np.unique(np.searchsorted(edges, x, side="right"), return_inverse=True)
            self.cell[:, d] = own
            for c in range(len(used)):
                self.low[d, c], self.high[d, c] = x[own == c].min(), x[own == c].max()

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each query (the least of equally near ones), its squared distance, and how many were refined."""
        q = queries.astype(np.int64)
        least, most = np.zeros((len(q), len(self.entries)), np.int64), np.zeros((len(q), len(self.entries)), np.int64)
        for d in range(q.shape[1]):
            below, above = self.low[d] - q[:, d : d + 1], q[:, d : d + 1] - self.high[d]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)  # to the farther end; both are at least as far as any entry of the cell
            far = np.maximum(np.maximum(far, below), above)
            least += (near * near)[:, self.cell[:, d]]
            most += (far * far)[:, self.cell[:, d]]
        row, entry = np.nonzero(least <= most.min(axis=1, keepdims=True))
        gap = q[row] - self.entries[entry]
        exact = (gap * gap).sum(axis=1)
        order = np.lexsort((entry, exact, row))
        first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
        return entry[first], exact[first], len(row)


def whole_vectors(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``dims`` components, all finite, and those as whole numbers ``floor(256 * x)``."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    fit = np.flatnonzero(sizes == dims)
    flat = vectors.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fit), dims)  # nulls become NaN
    finite = np.isfinite(flat).all(axis=1)
    return fit[finite], np.clip(np.floor(flat[finite] * SCALE), -LARGEST * SCALE, LARGEST * SCALE).astype(np.int64)


def _assigned(books: list[CellFile], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row in each part."""
    width = x.shape[1] // len(books)
    entry, error = np.zeros((len(x), len(books)), np.int64), np.zeros((len(x), len(books)), np.int64)
    for p, book in enumerate(books):
        entry[:, p], error[:, p], _ = book.nearest(x[:, p * width : (p + 1) * width])
    return entry, error


def first_entries(df: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> np.ndarray:
    """The ``entries`` vectors of least id as whole numbers, in order; equal ids by their components, null ids last.

    Of these, rows of another length than the first one's with a multiple of ``parts`` components are passed over.
    """
    v = F.col(vector_col)
    good = df.select(F.col(id_col).alias("i"), v.cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0))
    good = good.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    first = good.orderBy(F.asc_nulls_last("i"), "v").limit(1).collect()
    if not first:
        return np.zeros((0, parts), np.int64)
    rows = good.filter(F.size("v") == len(first[0]["v"])).orderBy(F.asc_nulls_last("i"), "v").limit(entries).collect()  # as many rows as a codebook has entries
    return np.clip(np.floor(np.array([r["v"] for r in rows]) * SCALE), -LARGEST * SCALE, LARGEST * SCALE).astype(np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BLOCK_ROWS):
        yield batch.slice(at, BLOCK_ROWS)


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS) -> list[np.ndarray]:
    """A codebook for each part (entries x dims), after ``rounds`` of assigning all vectors and averaging, rounding down.

    Each task adds up its own vectors; what is shuffled and sent to the driver is one sum for each part and entry.
    """
    start = first_entries(df, id_col, vector_col, parts, entries)
    if not len(start):
        return []
    dims, width = start.shape[1], start.shape[1] // parts
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        files = [CellFile(b, bits) for b in books]

        def sums(batches: Iterator[pa.RecordBatch], files: list[CellFile] = files) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts, len(start), width), np.int64), np.zeros((parts, len(start)), np.int64)
            for batch in batches:
                for block in _blocks(batch):
                    _, x = whole_vectors(block.column(0), dims)
                    entry, _ = _assigned(files, x)
                    for p in range(parts):
                        count[p] += np.bincount(entry[:, p], minlength=len(start))
                        np.add.at(total[p], entry[:, p], x[:, p * width : (p + 1) * width])
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

        found = df.select(vector_col).mapInArrow(sums, "part int, entry int, n long, total array<long>")
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.element_at("total", i + 1)).alias(f"t{i}") for i in range(width)]).collect():  # parts x entries rows
            books[r["part"]] = books[r["part"]].copy()
            books[r["part"]][r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(df: DataFrame, books: list[np.ndarray], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", bits: int = BITS) -> DataFrame:
    """(id, code, error, label) of every vector of the codebooks' length whose components are all finite; others are dropped."""
    files, dims = [CellFile(b, bits) for b in books], sum(b.shape[1] for b in books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                kept, x = whole_vectors(block.column(1), dims)
                entry, error = _assigned(files, x)
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([block.column(0).take(at), pa.array([bytes(r).hex() for r in entry.astype(np.uint8)], pa.string()), pa.array(error.sum(axis=1)), block.column(2).take(at)], names=["vec_id", "code", "error", "label"])

    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kind = df.schema[label_col].dataType.simpleString() if label_col else "int"
    return df.select(F.col(id_col).cast("long"), vector_col, label).mapInArrow(code, f"vec_id long, code string, error long, label {kind}")


def code_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept.

    Vectors that are null, hold null or non-finite components, or are not of the length of the first kept one are dropped;
    components beyond 2**18 count as that. Fewer vectors than ``entries`` (256 at most, as a code has two hex digits a part) give
    shorter codebooks, none give no rows. Repeated rows are coded each. ``label_error`` sums the errors of equal labels, nulls
    together; sums by label are broadcast while there are at most ``broadcast_labels``, and joined on the label beyond that.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    books = train(df, id_col, vector_col, parts, entries, rounds, bits)
    if not books:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(encode(df, books, id_col, vector_col, label_col, bits))
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if labels.count() <= broadcast_labels:
        labels = F.broadcast(labels)
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """The query's rows in DuckDB: each round joins all parts with all entries of their codebook."""
    books = [f"""b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, row) - 1 AS e, v AS c FROM x WHERE row IN (SELECT row FROM k ORDER BY vec_id, row LIMIT {ENTRIES}))"""]
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT row, x.p, min({{'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS m FROM x JOIN b{r} ON x.p = b{r}.p GROUP BY 1, 2)"""
    move = lambda r: f"""b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.e, coalesce(t, c) AS c FROM b{r} LEFT JOIN (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS t FROM (SELECT x.p, m.e AS e, j, CAST(sum(v[j]) AS DOUBLE) AS s, count(*) AS n FROM x JOIN a{r} ON x.row = a{r}.row AND x.p = a{r}.p, (SELECT unnest(range(1, width + 1)) AS j, width FROM w) g GROUP BY 1, 2, 3) q GROUP BY 1, 2) u ON u.p = b{r}.p AND u.e = b{r}.e)"""
    for r in range(ROUNDS):
        books += [near(r), move(r)]
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, label) AS row, vec_id, label, list_transform(embedding, lambda z: CAST(floor({SCALE} * CAST(z AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda z: isfinite(z)))),
w AS (SELECT max(len(v)) // {PARTS} AS width FROM k),
x AS MATERIALIZED (SELECT row, vec_id, p, v[p * width + 1 : (p + 1) * width] AS v FROM k, w, (SELECT unnest(range({PARTS})) AS p) q),
{", ".join(books)}, {near(ROUNDS)},
c AS (SELECT row, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c ON k.row = c.row, h"""


CODES_SQL = _rounds_sql()


def op13_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
