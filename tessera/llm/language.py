"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed character n-grams tells the languages with a 1
from those with a 0. Decoding takes the codeword of least loss, each bit weighted by how well its classifier does on the
language in question, and flags texts whose two nearest codewords lie close together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textops import map_text, mix, text_slices

BUCKETS = 1 << 14
ORDERS = (2, 3)
CALIBRATION_ROWS = 20_000
MAX_LANGUAGES = 1_000
AMBIGUOUS_BELOW = 0.1
UNKNOWN = "und"


def codewords(k: int) -> np.ndarray:
    """A k x bits matrix of +1 and -1: all splits for up to 6 languages, else spread-out random words of 10 log2(k) bits."""
    if k < 2:
        return np.zeros((k, 0), np.int8)
    if k <= 6:
        words = np.array([[(m >> i) & 1 for m in range(1, 1 << (k - 1))] for i in range(k)], np.int8)
        return 2 * words - 1
    rng, best, far = np.random.default_rng(7), None, -1
    bits = math.ceil(10 * math.log2(k))
    for _ in range(100):
        words = rng.integers(0, 2, (k, bits), dtype=np.int8) * 2 - 1
        if (abs(words.sum(0)) == k).any():
            continue
        apart = (bits - words.astype(np.int32) @ words.T.astype(np.int32)) // 2 + bits * np.eye(k, dtype=np.int32)
        if apart.min() > far:
            best, far = words, apart.min()
    return best


_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        # planes 0 to 3; beyond them Unicode has no letters
        _letters.append(np.array([chr(c).isalpha() for c in range(0x40000)] + [False], dtype=bool))
    return _letters[0][np.minimum(codes, 0x40000)]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts (bucket, text index) and the number of letters of each text.

    Letters are lowered and all else counts as one kind of blank; an n-gram begins or ends with a letter.
    """
    lowered = [(t or "").lower() for t in texts]
    lengths = np.array([len(t) + 3 for t in lowered])
    codes = np.frombuffer(("".join(" " + t + "  " for t in lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(codes)
    codes = np.where(letter, codes, 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    n_letters = np.bincount(owner, weights=letter, minlength=len(texts)).astype(np.int64)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n))
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + codes[j : j + m]
            use = letter[:m] | letter[n - 1 : n - 1 + m]
            use &= owner[:m] == owner[n - 1 : n - 1 + m]
            buckets.append((mix(h[use]) & np.uint64(BUCKETS - 1)).astype(np.int32))
            owners.append(owner[:m][use])
    return np.concatenate(buckets), np.concatenate(owners), n_letters


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of the bit
    gain: np.ndarray  # by bit
    trust: np.ndarray  # languages x bits: how often the classifier of the bit is right on the language, summing to 1

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log odds of each bit for each text, and the texts' letters."""
        bucket, owner, letters = grams(texts)
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        out = np.stack([np.bincount(owner, weights=w[bucket], minlength=len(texts)) / n for w in self.weights.T], 1) if self.weights.shape[1] else np.zeros((len(texts), 0))
        return out, letters

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, a score between 0 and 1, and the relative gap of loss to the second nearest."""
        if len(self.languages) == 1:
            one = np.ones(len(margins))
            return np.zeros(len(margins), int), one, one
        signal = np.clip(margins * self.gain, -20, 20)
        loss = np.einsum("cb,ncb->nc", self.trust, np.exp(-self.codes[None] * signal[:, None]))
        order = np.sort(loss, 1)
        odds = loss.min(1, keepdims=True) / loss
        return loss.argmin(1), 1 / np.sum(odds**2, 1), (order[:, 1] - order[:, 0]) / (order[:, 1] + order[:, 0])


def _labelled(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", calibration_rows: int = CALIBRATION_ROWS, max_languages: int = MAX_LANGUAGES) -> LanguageModel | None:
    """Fit on all labelled rows; None if there are none. More than ``max_languages`` labels raise: they are no languages.

    The n-gram counts of each language cover every row; each task sends at most languages x BUCKETS counts. The gains and
    trusts of the bits come from a random sample of about ``calibration_rows`` labelled rows, the one bounded sample.
    """
    rows = _labelled(df, text_col, lang_col)
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if not per_lang:
        return None
    if len(per_lang) > max_languages:
        raise ValueError(f"{lang_col} has more than {max_languages} values")
    languages = sorted(per_lang)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, 0):
                bucket, owner, _ = grams(part.column(0).to_pylist())
                langs, at = np.unique(np.array(part.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
                got = np.bincount(at[owner] * BUCKETS + bucket, minlength=len(langs) * BUCKETS).reshape(len(langs), BUCKETS)
                for lang, row in zip(langs, got, strict=True):
                    held[lang] = held.get(lang, 0) + row
        for lang, row in held.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), BUCKETS))
    table[[languages.index(x) for x in counts["lang"]], counts["bucket"]] = counts["n"]
    share = (table + 0.1) / (table.sum(1, keepdims=True) + 0.1 * BUCKETS)
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        weights[:, b] = np.log(share[codes[:, b] > 0].mean(0)) - np.log(share[codes[:, b] < 0].mean(0))
    model = LanguageModel(languages, codes, weights, np.ones(codes.shape[1]), np.full(codes.shape, 1 / max(1, codes.shape[1])))
    if len(languages) == 1:
        return model

    share_of_rows = min(1.0, calibration_rows / sum(per_lang.values()))
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(math.ceil(share_of_rows * 1_000_000)))
    kept = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats

    def judge(batches):
        m = kept.value
        right, size, n = np.zeros(m.codes.shape), np.zeros(m.codes.shape[1]), np.zeros(len(m.languages))
        for batch in batches:
            for part in text_slices(batch, 0):
                signal, letters = m.margins(part.column(0).to_pylist())
                at = np.array([m.languages.index(x) for x in part.column(1).to_pylist()])
                ok = letters > 0
                np.add.at(right, at[ok], (m.codes[at[ok]] * signal[ok] > 0).astype(float))
                np.add.at(n, at[ok], 1)
                size += abs(signal[ok]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([right.ravel().tolist()]), pa.array([size.tolist()]), pa.array([n.tolist()])], names=["right", "size", "n"])

    # vectors of fixed length, added up by position
    parts = sample.mapInArrow(judge, "right array<double>, size array<double>, n array<double>").select(F.posexplode(F.concat("right", "size", "n")))
    sums = np.array([r["v"] for r in parts.groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()])
    right, size, n = np.split(sums, [codes.size, codes.size + codes.shape[1]])
    right = right.reshape(codes.shape)
    accuracy = (right + 1) / (n[:, None] + 2)
    model.trust = accuracy / accuracy.sum(1, keepdims=True)
    model.gain = 2.0 / np.maximum(size / max(1.0, n.sum()), 1e-6)
    return model


def _answers(m: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    if m is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    signal, letters = m.margins(texts)
    best, sure, gap = m.decode(signal)
    lang = [m.languages[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
    return lang, np.where(letters > 0, sure, 0.0), (letters > 0) & (gap < AMBIGUOUS_BELOW)


def identify(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, lang_pred, score and ambiguous.

    A null or empty text, or one without a letter, is ``und`` with score 0 and not ambiguous; so is every text if nothing
    was learned. Equal texts get equal answers. Only the id and the text are read, so other columns cannot clash. Long
    texts are read whole. Of equally near codewords the first language by name is taken. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats, whatever the input

    def predict(batch: pa.RecordBatch) -> dict:
        lang, score, unsure = _answers(shared.value, batch.column(1).to_pylist())
        return {"id": batch.column(0), "lang": pa.array(lang, pa.string()), "score": pa.array(score), "unsure": pa.array(unsure)}

    kind = df.schema[id_col].dataType.simpleString()
    return map_text(df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")), 1, predict, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def keep_identified(df: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text has a language: not ``und`` and not ambiguous.

    All columns pass through whatever their names. Without a model nothing is known and every row with a letter stays.
    Rows are judged by their text alone: repeated rows stay or go together, and ids may be null. Empty tables stay empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at):
                texts = part.column(at).to_pylist()
                if shared.value is None:
                    keep = np.array([any(map(str.isalpha, t or "")) for t in texts])
                else:
                    lang, _, unsure = _answers(shared.value, texts)
                    keep = np.array([x != UNKNOWN for x in lang]) & ~unsure
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs.filter(~F.coalesce(held_out, F.lit(False))).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
