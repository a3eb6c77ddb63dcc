"""Token counts by a separator scan of flat token files.

A flat file is nothing but token ids, one document after another, each closed by an end-of-document id; no index says where
documents begin. Blocks of a file are searched for that id by vector comparison, and a prefix scan over the blocks of each
file carries what is open at a block's end into the next, so files are read in blocks of any size, in any order.
"""

from __future__ import annotations

import base64
import importlib.util
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.textops import text_slices, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50256  # fixed value: the vocabulary's free id, used as end of document
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 27

_encoders: dict[tuple[str, str], object] = {}


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The public byte-level BPE of that file, made once in a process; special tokens' strings are ordinary text."""
    if (folder, vocabulary) not in _encoders:
        import tiktoken

        spec = importlib.util.spec_from_file_location("public_tokenizers", str(Path(folder) / "__init__.py"))
        notes = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(notes)
        with open(Path(folder) / vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[folder, vocabulary] = tiktoken.Encoding("public", pat_str=notes.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[folder, vocabulary]


def flat_token_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, end: int = END, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Documents as flat files of 16-bit ids, cut to blocks without regard to documents: (file, block, data, ids, row).

    Rows with data are the files; rows with ids are the list of documents of each file in order, from ``row`` on. A task
    writes files of about ``file_tokens``. A null text has no tokens, only its end.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(folder, vocabulary).encode_ordinary
        part, number, block, held, n_held, n_file, row = TaskContext.get().partitionId(), 0, 0, [], 0, 0, 0
        name = lambda: (part << 24) | number

        def whole_blocks(held, n, rest):
            stream = np.concatenate(held)
            return [stream[i : i + block_tokens].tobytes() for i in range(0, n if rest else n - n % block_tokens, block_tokens)]

        def rows(blocks, ids, first, id_type):
            n = len(blocks) + (1 if ids else 0)
            files = [name()] * n
            return pa.RecordBatch.from_arrays(
                [pa.array(files, pa.int64()), pa.array([*range(block, block + len(blocks)), *([None] if ids else [])], pa.int64()), pa.array([*blocks, *([None] if ids else [])], pa.binary()), pa.array([*[None] * len(blocks), *([ids] if ids else [])], pa.list_(id_type)), pa.array([*[None] * len(blocks), *([first] if ids else [])], pa.int64())],
                names=["file", "block", "data", "ids", "row"],
            )

        id_type = None
        for batch in batches:
            for cut in text_slices(batch, 1):
                id_type, ids, first = cut.schema.field(0).type, [], row
                for i, t in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True):
                    got = np.array([*encode(t or ""), end], np.uint16)
                    held.append(got)
                    ids.append(i)
                    n_held, n_file, row = n_held + len(got), n_file + len(got), row + 1
                    if n_file >= file_tokens:
                        yield rows(whole_blocks(held, n_held, True), ids, first, id_type)
                        number, block, held, n_held, n_file, row, ids, first = number + 1, 0, [], 0, 0, 0, [], 0
                if ids:
                    blocks = whole_blocks(held, n_held, False)
                    yield rows(blocks, ids, first, id_type)
                    block += len(blocks)
                    if blocks:
                        held = [np.concatenate(held)[len(blocks) * block_tokens :]]
                        n_held = len(held[0])
        if n_held:
            yield rows([np.concatenate(held).tobytes()], [], 0, id_type)

    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string")).mapInArrow(run, f"file long, block long, data binary, ids array<{kind}>, row long")


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """(file, block, data) of flat files on any storage that Spark reads; a file may have up to 2 GB."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", F.length("content").alias("n"))
    step = block_tokens * width
    cut = raw.select("file", "content", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - 1) / step), F.lit(0)).cast("int"))).alias("block"))
    return cut.select("file", F.col("block").cast("long").alias("block"), F.substring("content", F.col("block") * step + 1, F.lit(step)).alias("data"))


def scan_separators(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(file, row, start, n_tokens, closed) of every document in flat token blocks (file, block, data).

    ``row`` counts a file's documents from 0, ``start`` is the place of its first token in the file, n_tokens leaves the
    separator out. A document that the file's end cuts off has closed false. Separators next to each other make empty
    documents. Empty and null blocks are passed over. A block with bytes that are no whole token raises. Work and memory
    follow the number of tokens, however short the documents.
    """
    kind = np.uint16 if width == 2 else np.uint32
    name = blocks.schema["file"].dataType.simpleString()

    def searched(batch):
        for i in range(batch.num_rows):  # a block is some 100 kB; documents in it are found all at once
            ids = np.frombuffer(batch.column(2)[i].as_py() or b"", kind)
            if len(ids):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(ids), np.flatnonzero(ids == end)

    def measure(batches):
        for batch in batches:
            found = [(f, b, n, len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None) for f, b, n, at in searched(batch)]
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["file", "block", "n", "seps", "first", "last"])

    def places(batches):
        for batch in batches:
            for f, b, _, at in searched(batch):  # a block at a time: one of nothing but separators has as many documents as tokens
                for i in range(0, len(at), 1 << 15):
                    m = len(at[i : i + (1 << 15)])
                    yield pa.RecordBatch.from_arrays([pa.array([f] * m, batch.schema.field(0).type), pa.array([b] * m, pa.int64()), pa.array(np.arange(i, i + m)), pa.array(np.where(np.arange(i, i + m) > 0, at[np.maximum(np.arange(i, i + m) - 1, 0)], -1)), pa.array(at[i : i + m])], names=["file", "block", "i", "before", "sep"])

    blocks = blocks.select("file", "block", "data")
    found = blocks.mapInArrow(measure, f"file {name}, block long, n long, seps long, first long, last long")
    # the prefix scan: a row of numbers for each block; a file of 2 GB has some thousand of them
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = found.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("rows", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    s = s.withColumn("open", F.coalesce(F.max(F.col("at") + F.col("last") + 1).over(before), F.lit(0)))  # where the open document began
    s = written(s.withColumn("final", F.lead("block").over(order).isNull()))
    # each separator closes the document that began after the one before it
    inside = blocks.mapInArrow(places, f"file {name}, block long, i long, before long, sep long").join(s.select("file", "block", "at", "rows", "open"), ["file", "block"])
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("at") + F.col("before") + 1)
    closed = inside.select("file", (F.col("rows") + F.col("i")).alias("row"), start.alias("start"), (F.col("at") + F.col("sep") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    opened = F.when(F.col("seps") > 0, F.col("at") + F.col("last") + 1).otherwise(F.col("open"))
    tail = s.filter("final").select("file", (F.col("rows") + F.col("seps")).alias("row"), opened.alias("start"), (F.col("at") + F.col("n") - opened).alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return closed.unionByName(tail)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each input row: doc_id, n_tokens, file, row, start. Flat files are written to the shared folder and scanned.

    A null or empty text has no tokens; ids may repeat or be null; other columns are not read, so names cannot clash. A
    text of any length may span blocks. An empty table gives no rows.
    """
    flat = written(flat_token_blocks(df, id_col, text_col, folder, block_tokens=block_tokens))
    found = scan_separators(flat.filter("data IS NOT NULL"))
    names = flat.filter("ids IS NOT NULL").select("file", F.col("row").alias("first"), F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("row"), "doc_id")
    return names.join(found, ["file", "row"]).select("doc_id", "n_tokens", "file", "row", "start")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
