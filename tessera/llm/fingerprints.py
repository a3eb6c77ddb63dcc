"""Document fingerprints from prefix polynomial hashes.

Prefix arrays of polynomials modulo the prime 2**31 - 1, for two bases, give the hash of any span in constant time, so
spans compare without reading them and longest common extensions are found by binary search. A fingerprint is the hash of
the whole text and the least hashes, by class, of all its spans of a fixed width.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.sharding import range_bucket
from tessera.llm.textops import _split_schema, mix, text_slices, written

PRIME = np.uint64((1 << 31) - 1)
BASES = (911_382_323, 972_663_749)
SPAN = 16
SLOTS = 64
MOST_BROADCAST = 500_000
EMPTY = "----"
_SHIFT = np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62, without division."""
    x = (x & PRIME) + (x >> _SHIFT)
    x = (x & PRIME) + (x >> _SHIFT)
    return np.where(x >= PRIME, x - PRIME, x)


_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases, for exponents below n at least."""
    if not _tables or len(_tables[0]) < n:
        size = max(1 << 14, 1 << int(n - 1).bit_length())
        _tables.clear()
        for base in BASES:
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), int(PRIME))))])
            _tables.append(out)
    return _tables


class PrefixHash:
    """Prefix arrays of one text; a span is (start, end) in code points, ends exclusive."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(self.codes)
        self.sums = []
        for p in _powers(self.n + 1):
            s = np.zeros(self.n + 1, np.uint64)
            # terms are below 2**31, so 2**31 of them can be added before the sum is reduced
            np.cumsum(_mod(self.codes * p[: self.n]), out=s[1:])
            self.sums.append(_mod(s))

    def span(self, start: int, end: int, shift: int = 0) -> tuple[int, int]:
        """The span's hash times base**(shift - start); spans compare at one shift, no less than either start."""
        out = []
        for s, p in zip(self.sums, _powers(shift + 1), strict=True):
            out.append((int(s[end]) + int(PRIME) - int(s[start])) * int(p[shift - start]) % int(PRIME))
        return out[0], out[1]

    def equal(self, start: int, other: PrefixHash, at: int, n: int) -> bool:
        shift = max(start, at)
        return self.span(start, start + n, shift) == other.span(at, at + n, shift)

    def common_extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Code points that agree from ``start`` here and ``at`` there on, by binary search over span equality."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, at, mid) else (low, mid - 1)
        return low

    def windows(self, width: int = SPAN) -> np.ndarray:
        """Hashes of all spans of ``width``; of the whole text if it is shorter."""
        width = min(width, self.n)
        if not width:
            return np.zeros(0, np.uint64)
        both = []
        for s, p in zip(self.sums, _powers(self.n + 1), strict=True):
            m = self.n - width + 1
            # times base**(last - start): every span is moved to the same place
            both.append(_mod((s[width:] + PRIME - s[:m]) % PRIME * p[m - 1 :: -1][:m]))
        # the common place depends on the text's length; taking it out makes spans of different texts comparable
        back = [np.uint64(pow(b, -(self.n - width), int(PRIME))) for b in BASES]
        a, b = (_mod(x * y) for x, y in zip(both, back, strict=True))
        return mix((a << np.uint64(32)) | b)

    def fingerprint(self) -> str:
        """Length-prefixed hash of the whole text, then the least window hash of each of SLOTS classes."""
        a, b = self.span(0, self.n)
        whole = f"{int(mix(np.array([(a << 32) | b], np.uint64) ^ np.uint64(self.n))[0]):016x}"
        return whole + slots(self.windows())


def slots(windows: np.ndarray) -> str:
    held = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(held, (windows >> np.uint64(58)).astype(np.intp), windows << np.uint64(6))
    return "".join(EMPTY if v == np.iinfo(np.uint64).max else f"{(int(v) * 0x9E3779B97F4A7C15 >> 40) & 0xFFFF:04x}" for v in held)


def likeness(one: str, two: str) -> float:
    """Dice share of common spans estimated from two fingerprints; 1 for equal ones, 0 for none in common.

    Both empty: 1. One empty: 0.
    """
    if one == two:
        return 1.0
    pairs = [(one[i : i + 4], two[i : i + 4]) for i in range(16, 16 + 4 * SLOTS, 4)]
    used = [(a, b) for a, b in pairs if a != EMPTY or b != EMPTY]
    j = sum(a == b for a, b in used) / len(used) if used else 0.0
    return min(2 * j / (1 + j), 0.999)


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(df: DataFrame, id_col: str, text_col: str, fn, schema: str, rows_per_range: int = 10_000) -> DataFrame:
    """Apply ``fn(text, next text)`` to every row, where the next is the row below in descending order of the id.

    Rows are dealt to ranges of ids and sorted within; each range also gets the highest row of the range below (the lowest
    range gets the highest row of all), so the last row of a range finds its next one. The text is shuffled once.
    Equal ids follow each other in the order of their texts' CRCs and then of their texts; a null id counts as the lowest.
    """
    names = [x.split()[0] for x in _split_schema(schema)]
    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    bucket, _ = range_bucket(base.select("doc_id", "crc"), "doc_id", rows_per_range, "crc")
    dealt = base.withColumn("range", bucket)
    # the highest row of each range by id and CRC, as three numbers; the last ranges' top goes to the first
    place = F.struct("doc_id", "crc")
    tops = dealt.groupBy("range").agg(F.max(place).alias("top")).select(F.col("range").alias("of"), "top.*")
    ordered = Window.orderBy("of")  # one row for each range
    tops = tops.withColumn("above", F.coalesce(F.lead("of").over(ordered), F.min("of").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    tops = written(tops)
    n = tops.count()
    # rows / rows_per_range rows; only rows of a range's highest id and CRC meet them, most often one
    heads = F.broadcast(tops) if n <= MOST_BROADCAST else tops
    first = dealt.join(heads.withColumnsRenamed({"doc_id": "top_id", "crc": "top_crc"}), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("crc") == F.col("top_crc"))).groupBy("of", "above").agg(F.min("text").alias("text"))
    guests = first.select(F.lit(None).cast(kind).alias("doc_id"), "text", F.lit(0).cast("long").alias("crc"), F.col("above").alias("range"), F.lit(True).alias("guest"))
    both = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    placed = both.repartitionByRange("range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), F.col("crc").desc(), "text")

    def run(batches):
        held: tuple | None = None
        for batch in batches:
            for part in text_slices(batch, 1):
                ids, out = [], []
                for i, text, guest in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if held is not None:
                        ids.append(held[0])
                        out.append(fn(held[1], text))
                    held = None if guest else (i, text)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field(0).type), *(pa.array(x) for x in zip(*out, strict=True))], names=["doc_id", *names])

    return placed.mapInArrow(run, f"doc_id {kind}, {schema}")


class _Last:
    """The last text's prefix arrays: each text is met as the next one, and then by itself."""

    text: str | None = None
    made: tuple[PrefixHash, str] | None = None

    def of(self, text: str) -> tuple[PrefixHash, str]:
        if self.text != text:
            p = PrefixHash(text)
            self.text, self.made = text, (p, p.fingerprint())
        return self.made


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: the fingerprints of its text and its edited text, their likeness and common prefix.

    A null text counts as empty; an empty text has a fingerprint without spans and equals its edited text. A table of one
    row has itself as next. Equal texts have equal fingerprints. Repeated rows follow each other. Other columns are not
    read, so their names cannot clash. An empty table gives no rows. Texts shorter than a span count as one span.
    """

    def compare(text: str, following: str) -> tuple:
        one = memo.of(text)
        edited = edited_text(text, following)
        own = PrefixHash(edited)
        mark = own.fingerprint()
        shared = one[0].common_extension(0, own, 0)
        after = memo.of(following)[1]
        return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), one[1], mark, likeness(one[1], mark), likeness(one[1], after), shared

    memo = _Last()
    return with_next(df, id_col, text_col, compare, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
