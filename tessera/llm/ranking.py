"""Ranked lexical search: max trees over document ranges, searched best first with bounds.

Documents are tokenised once into postings of the queries' terms. A segment of consecutive documents gets, for each term,
a tree of the largest score that any document of a range takes from it: leaves of LEAF documents, FAN leaves to a node.
A query opens ranges in the order of their summed maxima and ends when no range left can reach its tenth score.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.textops import SLICE_BYTES, discard, map_text, mix, powers, written

TOP = 10
LEAF, FAN = 64, 16
SEGMENT_DOCS = LEAF * FAN * FAN
SEGMENT_POSTINGS = 2_000_000
BLOCK_TERMS, BLOCK_ITEMS = 20_000, 4_096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE_VALUES = np.random.default_rng(20260301).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lowered bytes, and where the terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` start and end in them."""
    data = np.frombuffer(raw + b" ", dtype=np.uint8)
    edge = np.diff(np.concatenate([[False], _TERM[data]]).astype(np.int8))
    return _LOWER[data], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    data, starts, ends = spans((text or "").encode("utf-8", "surrogatepass"))
    held = data.tobytes()
    return [held[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class Vocabulary:
    """Terms as numbers 0, 1, ... in byte order, found by 64-bit hash and then compared byte by byte."""

    def __init__(self, terms: set[bytes]):
        self.terms = sorted(terms)
        joined = b"".join(t + b" " for t in self.terms)
        self.bytes, self.starts, self.ends = spans(joined)
        hashes = span_hashes(self.bytes, self.starts, self.ends) if self.terms else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms have the same hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms, and the number of each such span's term."""
        if not len(starts) or not self.terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        which = np.flatnonzero(self.hashes[at] == hashes)
        ids, sizes = self.order[at[which]], (ends - starts)[which]
        same = sizes == (self.ends - self.starts)[ids]
        for j in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(same & (sizes > j))
            same[live] = data[starts[which[live]] + j] == self.bytes[self.starts[ids[live]] + j]
        return which[same], ids[same]


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces of about SLICE_BYTES, cut where no term is."""
    start = 0
    while len(raw) - start > SLICE_BYTES:
        end = start + SLICE_BYTES
        while end < len(raw) and _TERM[raw[end]]:
            end += 1
        yield raw[start:end]
        start = end
    yield raw[start:]


def postings(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term at all: n of any terms, those of the vocabulary and how often."""

    def count(batch: pa.RecordBatch) -> dict:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        n, keys = np.zeros(len(raw), np.int64), []
        size = max(1, len(vocabulary.terms))
        for joined, owners in [(b" ".join(raw), None)] if len(raw) > 1 else [(p, 0) for p in _pieces(raw[0])]:
            data, starts, ends = spans(joined)
            firsts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
            owner = np.searchsorted(firsts, starts, side="right") - 1 if owners is None else np.zeros(len(starts), np.int64)
            n += np.bincount(owner, minlength=len(raw))
            which, ids = vocabulary.find(data, starts, ends)
            keys.append(owner[which] * size + ids)
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        has = np.flatnonzero(n)
        offsets = np.concatenate([[0], np.searchsorted(key, (has + 1) * size)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (key % size, tf)]
        return {"doc_id": batch.column(0).take(pa.array(has)), "n": n[has], "terms": lists[0], "tfs": lists[1]}

    return map_text(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), 1, count, "doc_id long, n long, terms array<int>, tfs array<int>")


class Segment:
    """Consecutive documents with their max tree: ``levels[0]`` has a column for each leaf, the last level one for all."""

    def __init__(self, ids: pa.Array, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, docs: int, tokens: int):
        order = np.asarray(pc.sort_indices(ids, null_placement="at_end"))
        self.ids = ids.take(pa.array(order))
        firsts = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(firsts[order] - np.concatenate([[0], np.cumsum(counts[order])[:-1]]), counts[order]) + np.arange(len(terms))
        self.doc = np.repeat(np.arange(len(order)), counts[order])
        m = 10 + 90 * n[order] * docs // tokens
        tf = tfs[at].astype(np.int64)
        self.gain = weights[terms[at]] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc]))
        self.terms, self.term = np.unique(terms[at], return_inverse=True)
        self.bounds = np.searchsorted(self.doc, np.arange(0, len(order) + LEAF, LEAF))
        level = np.zeros((len(self.terms), -(-len(order) // LEAF)), np.int64)
        np.maximum.at(level, (self.term, self.doc // LEAF), self.gain)
        self.levels = [level]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    def local(self, terms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return at[self.terms[at] == terms] if len(self.terms) else at[:0]

    def search(self, terms: np.ndarray, least: int, k: int, leaves: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (-score, document), and how many leaves were opened; only scores of ``least`` and more are looked for.

        Ranges are opened by their summed maxima, highest first, as long as a range's sum reaches the k-th score so far or
        equals it, as a document with an equal score and a smaller id may be inside. ``leaves`` ends the search early.
        """
        own = self.local(terms)
        best, least, opened = [], max(1, least), 0
        if not len(own):
            return best, opened
        wanted = np.zeros(len(self.terms), bool)
        wanted[own] = True
        top = len(self.levels) - 1
        heap = [(-int(self.levels[top][own, 0].sum()), top, 0)]
        while heap and -heap[0][0] >= least and (leaves is None or opened < leaves):
            _, depth, node = heapq.heappop(heap)
            if depth:
                first = node * FAN
                sums = self.levels[depth - 1][own, first : first + FAN].sum(axis=0)
                for i in np.flatnonzero(sums >= least).tolist():
                    heapq.heappush(heap, (-int(sums[i]), depth - 1, first + i))
                continue
            opened += 1
            a, b = self.bounds[node], self.bounds[node + 1]
            hit = a + np.flatnonzero(wanted[self.term[a:b]])
            scores = np.zeros(LEAF, np.int64)
            np.add.at(scores, self.doc[hit] - node * LEAF, self.gain[hit])
            good = np.flatnonzero(scores >= least)
            if len(good):
                best = sorted([*best, *((-int(scores[i]), node * LEAF + i) for i in good.tolist())])[:k]
                if len(best) == k:
                    least = max(least, -best[-1][0])
        return best, opened


def _segments(batches: Iterator[pa.RecordBatch], weights: np.ndarray, docs: int, tokens: int) -> Iterator[Segment]:
    held: list[pa.RecordBatch] = []
    rows = entries = 0

    def build() -> Segment:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = [t.column(c).combine_chunks() for c in ("terms", "tfs")]
        counts = np.diff(lists[0].offsets.to_numpy())
        flat = [x.flatten().to_numpy() for x in lists]
        return Segment(t.column("doc_id").combine_chunks(), t.column("n").to_numpy(), counts, *flat, weights, docs, tokens)

    for batch in batches:
        at = batch.schema.get_field_index("terms")
        ends = batch.column(at).offsets.to_numpy().astype(np.int64)
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(ends, ends[start] + SEGMENT_POSTINGS - entries, side="right")) - 1
            stop = min(batch.num_rows, start + SEGMENT_DOCS - rows, max(fits, start + (not held)))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                rows += stop - start
                entries += int(ends[stop] - ends[start])
            if stop < batch.num_rows:
                yield build()
                held, rows, entries = [], 0, 0
            start = stop
    if held:
        yield build()


def _of_block(docs: DataFrame, queries: list[tuple[int | None, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    """The k best documents of each query of a block, in any order: item_id, doc_id, score."""
    vocabulary = Vocabulary({t for _, terms in queries for t in terms})
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    wanted = [np.unique(np.array([number[t] for t in terms], np.int64)) for _, terms in queries]
    items = [i for i, _ in queries]
    held = written(postings(docs, vocabulary, id_col, text_col))
    n_docs, n_tokens = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary.terms), np.int64)
    for term, n in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():  # a row for each term of the block
        df[term] = n
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)

    def first_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, best = [0] * len(items), [[] for _ in items]
        for s in _segments(batches, weights, n_docs, n_tokens):
            for q, terms in enumerate(wanted):
                found, _ = s.search(terms, least[q], k, leaves=1)
                best[q] = sorted([*best[q], *(x for x, _ in found)])[:k]
                least[q] = -best[q][-1] if len(best[q]) == k else 0
        full = [q for q in range(len(items)) if least[q]]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([least[q] for q in full], pa.int64())], names=["q", "least"])

    # a task's k-th score is one that k documents reach; the highest of all tasks holds for all documents
    known = dict(held.mapInArrow(first_leaves, "q int, least long").groupBy("q").agg(F.max("least")).collect())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, best = [known.get(q, 0) for q in range(len(items))], [[] for _ in items]
        for s in _segments(batches, weights, n_docs, n_tokens):
            for q, terms in enumerate(wanted):
                found, _ = s.search(terms, least[q], k)
                if found:
                    new = [(x, (i is None, i or 0)) for x, i in zip([x for x, _ in found], s.ids.take(pa.array([d for _, d in found])).to_pylist(), strict=True)]
                    best[q] = sorted([*best[q], *new])[:k]
                    if len(best[q]) == k:
                        least[q] = max(least[q], -best[q][-1][0])
        out = [(items[q], None if i[0] else i[1], -x) for q in range(len(items)) for x, i in best[q]]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["item_id", "doc_id", "score"])

    found = written(held.mapInArrow(search, "item_id long, doc_id long, score long"))
    discard(held)
    return found


def _blocks(items: DataFrame, id_col: str, text_col: str, terms: int, most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block: list[tuple[int | None, list[bytes]]] = []
    held: set[bytes] = set()
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).orderBy(F.col(id_col)).toLocalIterator():
        own = set(terms_of(row[1]))
        if block and block[-1][0] == row[0]:
            own |= set(block.pop()[1])
        elif block and (len(held | own) > terms or len(block) >= most):
            yield block
            block, held = [], set()
        if own:
            block.append((row[0], sorted(own)))
            held |= own
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The ``k`` documents of highest score for each item: item_id, rank, doc_id, score; equal scores by id, null ids last.

    Items are taken in blocks of at most ``block_terms`` distinct terms (or one item) and ``block_items`` items, each block
    against all documents. Rows of items with the same id are one item with the terms of all; items without terms and
    documents that score nothing have no row. Repeated documents are ranked each. Of a block, tasks get the terms, their
    weights and a threshold for each item, and send at most k documents for each item. Empty tables give no rows; other
    columns play no part.
    """
    spark = docs.sparkSession
    found = [_of_block(docs, block, k, id_col, text_col) for block in _blocks(items, item_col, item_text, block_terms, block_items)]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).cast("int")
    return functools.reduce(DataFrame.unionByName, found).withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = "list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda t: t <> '')"
#: The query's rows in DuckDB.
RANKS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_TERMS} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS tokens FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
f AS (SELECT row, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, t, unnest(t) AS term FROM d) x WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3, 4),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
g AS (SELECT row, doc_id, f.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // tokens))) AS gain FROM f JOIN w ON f.term = w.term, c),
s AS (SELECT item_id, row, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM i JOIN g ON i.term = g.term GROUP BY 1, 2, 3),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}"""


def op12_max_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rank_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
