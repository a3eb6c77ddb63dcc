"""Small helpers that the corpus operators share: slicing Arrow batches, hashing words, writing intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def text_slices(batch: pa.RecordBatch, column: int, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``max_bytes`` of text; one longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held + n > max_bytes and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def map_text(df: DataFrame, text_at: int, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Apply ``fn`` to text-bounded slices of each partition; ``fn`` returns the columns of ``schema`` in order, or None."""
    names = [x.split()[0] for x in _split_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_at):
                if (out := fn(part)) is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=names)

    return df.mapInArrow(run, schema)


def _split_schema(schema: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that the session names; a session of one machine that names none gets one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        held = sc._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir("/tmp/tessera-checkpoints")
            held = sc._jsc.sc().getCheckpointDir()
        root = held.get()
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables once all that was made of them is written, too."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def without_ids(df: DataFrame, ids: DataFrame, id_col: str, broadcast_ids: int = 2_000_000) -> DataFrame:
    """Rows of ``df`` whose id is not among ``ids`` (one column); null ids stay.

    The ids are broadcast while there are at most ``broadcast_ids``; beyond that Spark shuffles both sides.
    """
    ids = ids.toDF("__id").filter("__id is not null").distinct()
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    return df.join(ids, df[id_col] == ids["__id"], "left_anti")


_STEP = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``step**i`` and its inverse modulo 2**64, for i below n at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            both = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, dtype=np.uint64)])) for base in (_STEP, pow(_STEP, -1, 1 << 64))]
        _powers[:] = both
    return _powers[0], _powers[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z lowered, and the index of each word's text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
    space = _SPACE[data]
    if space.all():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    firsts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
    return hashes, np.searchsorted(firsts, starts, side="right") - 1


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as (text index, hash), sorted by both.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    words, at = word_hashes(texts)
    if not len(words):
        return at, words
    n = np.bincount(at, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    with np.errstate(over="ignore"):
        steps = np.cumprod(np.full(k, np.uint64(_STEP)))
        whole = np.ones(max(0, len(words) - k + 1), dtype=bool)
        sums = np.zeros(len(whole), np.uint64)
        for j in range(k):
            sums += words[j : j + len(whole)] * steps[j]
            whole &= at[j : j + len(whole)] == at[: len(whole)]
        short = np.flatnonzero((n > 0) & (n < k))
        extra = [np.sum(words[first[i] : first[i] + n[i]] * steps[: n[i]], dtype=np.uint64) + np.uint64(n[i]) for i in short]
        hashes = mix(np.concatenate([sums[whole] + np.uint64(k), np.array(extra, np.uint64)]))
    owner = np.concatenate([at[: len(whole)][whole], short])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    keep = np.ones(len(owner), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[keep], hashes[keep]
