"""Toxicity by a weighted lexicon matched with Aho-Corasick over folded text.

Homoglyphs, accents and digit substitutions fold to one letter each, code point by code point, so matches keep their
places. The lexicon holds words and beginnings of words; weights are learned from labelled rows, and the score's curve on
rows that its lexicon has not seen. A text's score comes from its weighted hits, taken by length, outside exception phrases.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textops import map_text, text_slices

MAX_LABELLED = 20_000
MIN_DOCS = 3
#: An entry counts if it is in more toxic rows than chance would have, by so many standard deviations.
MIN_SIGMA = 6.0
MIN_WEIGHT = 1.5
#: Lengths of the beginnings of words that may be entries; such an entry ends in ``*``.
BEGINNINGS = range(4, 11)
FOLDS = 3
THRESHOLD = 0.7
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "circus clown", "clown fish", "class clown", "village idiot", "sore loser", "pond scum", "soap scum", "sympathetic and pathetic")
#: Look-alike letters that Unicode does not decompose, and digits or signs put for letters.
LOOKALIKE = dict(zip("авеёкмнорстухіјѕԁԛԝղԍαβεηικνορτυχγωıøđłßæœ", "abeekmhopctyxijsdqwngabenikvoptuxywiodlsao", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}


def _fold_one(c: str) -> str:
    low = c.lower()[:1]
    low = LOOKALIKE.get(low, low)
    plain = unicodedata.normalize("NFKD", low)[:1].lower()
    plain = LOOKALIKE.get(plain, plain)
    return {"l": "i"}.get(plain, plain) if plain.isascii() and plain.isalpha() else SIGNS.get(low, c)


class _Fold(dict):
    """A translation table that fills itself: one code point for one."""

    def __missing__(self, code: int) -> str:
        self[code] = out = _fold_one(chr(code))
        return out


FOLD = _Fold()


def fold(text: str) -> str:
    """Lower case, look-alikes and digits as letters, l as i: as long as the text, code point for code point."""
    return text.translate(FOLD)


def words(text: str) -> list[str]:
    """Folded words of a text: runs without blanks, without what is no letter at either end of the original."""
    out = []
    for raw in text.split():
        s, e = 0, len(raw)
        while s < e and not raw[s].isalnum():
            s += 1
        while e > s and not raw[e - 1].isalnum():
            e -= 1
        if e - s > 2 and any(c.isalpha() for c in raw[s:e]):
            out.append(fold(raw[s:e]))
    return out


def entries(text: str) -> set[str]:
    """The words of a text and the beginnings of longer ones, which end in ``*``."""
    found = {*words(text)}
    return found | {w[:k] + "*" for w in found for k in BEGINNINGS if k < len(w)}


@dataclass
class ToxicityModel:
    """Weights by entry (see ``entries``) and the curve: a constant and a factor for each feature."""

    weights: dict[str, float]
    coef: np.ndarray = field(default_factory=lambda: np.zeros(5))
    _automaton: object = None

    def __getstate__(self):
        return {"weights": self.weights, "coef": self.coef, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            found: dict[str, dict] = {}
            for w, x in self.weights.items():
                found.setdefault(w.removesuffix("*"), {})["begins" if w.endswith("*") else "is"] = x
            for p in EXCEPTIONS:
                found.setdefault(fold(p), {})["safe"] = True
            a = ahocorasick.Automaton()
            for w, x in found.items():
                a.add_word(w, (len(w), x.get("is"), x.get("begins"), "safe" in x))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """log weight of hits per 100 words, log weight of hits, hits at all, log number of hits. A word counts once."""
        if not text or not self.weights:
            return 0.0, 0.0, 0.0, 0.0
        hits: dict[int, tuple[float, int]] = {}
        safe = []
        for last, (n, whole, begins, harmless) in self.automaton().iter(fold(text)):
            s, e = last - n + 1, last + 1
            if s and text[s - 1].isalnum():
                continue
            ended = e == len(text) or not text[e].isalnum()
            if harmless and ended:
                safe.append((s, e))
            x = whole if ended else begins
            if x is not None and x > hits.get(s, (0.0, 0))[0] and any(map(str.isalpha, text[s:e])):
                hits[s] = (x, e)
        # a hit is safe in a phrase that begins at or before it and ends at or after it
        safe.sort()
        firsts, reach = [s for s, _ in safe], list(np.maximum.accumulate([e for _, e in safe])) if safe else []
        counted = [x for s, (x, e) in hits.items() if not ((i := bisect.bisect_right(firsts, s)) and reach[i - 1] >= e)]
        total = sum(counted)
        per = 100 * total / (1 + text.count(" ") + text.count("\n"))
        return float(np.log1p(per)), float(np.log1p(total)), float(total > 0), float(np.log1p(len(counted)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coef[1:] + self.coef[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    pull = np.diag([1e-6] + [0.1] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T * (p * (1 - p) + 1e-9) @ a + pull, a.T @ (y - p) - pull @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, min_docs: int = MIN_DOCS, min_sigma: float = MIN_SIGMA, min_weight: float = MIN_WEIGHT) -> ToxicityModel | None:
    """Learn weights and the score's curve from about ``max_labelled`` labelled rows, chosen by a hash of their id.

    That sample is the one bound on what is learned from. An entry's weight is its smoothed log odds between toxic and
    other rows of the sample, by rows that hold it; entries in at least ``min_docs`` toxic rows that stand out from chance
    by ``min_sigma`` and weigh ``min_weight`` are kept. The curve is fitted to features that each of FOLDS parts of the
    rows gets from weights learned on the other parts, so that no row is judged by words it put into the lexicon itself.
    Of repeated labels that contradict each other the toxic one counts. None without rows of both labels.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = known.count()
    if not n:
        return None
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(np.ceil(min(1.0, max_labelled / n) * 1_000_000)))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)).cast("int"))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "y", "part")  # about max_labelled rows of three numbers

    def count(batches):
        for batch in batches:
            for piece in text_slices(batch, 0):
                held: dict[tuple[int, int], Counter] = {}
                for t, y, part in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    held.setdefault((y, part), Counter()).update(entries(t or ""))
                for (y, part), found in held.items():
                    size = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.string()), pa.array([y] * size, pa.int32()), pa.array([part] * size, pa.int32()), pa.array(list(found.values()), pa.int64())], names=["entry", "y", "part", "n"])

    rows = {(r["y"], r["part"]): r["n"] for r in sample.groupBy("y", "part").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 x FOLDS rows
    total = {(y, k): sum(v for (a, part), v in rows.items() if a == y and part != k) for y in (0, 1) for k in range(-1, FOLDS)}
    if not total[1, -1] or not total[0, -1]:
        return None
    # part -1: all rows
    held = {(y, k): F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("part") != k), F.col("n"))), F.lit(0)) for y, k in total}
    counts = sample.mapInArrow(count, "entry string, y int, part int, n long").groupBy("entry").agg(*[c.alias(f"n{y}_{k + 1}") for (y, k), c in held.items()])
    odds = []
    for k in range(-1, FOLDS):
        bad, good = F.col(f"n1_{k + 1}"), F.col(f"n0_{k + 1}")
        weight = F.log(((bad + 0.5) / (total[1, k] + 1)) / ((good + 0.5) / (total[0, k] + 1)))
        expected = (bad + good) * (total[1, k] / max(1, total[1, k] + total[0, k]))
        odds.append(F.when((bad >= min_docs) & (bad - expected > min_sigma * F.sqrt(expected)) & (weight > min_weight), weight).alias(f"w{k + 1}"))
    strong = counts.select("entry", *odds).filter(F.coalesce(*[f"w{k}" for k in range(FOLDS + 1)]).isNotNull()).collect()  # of the entries of the sample, those that stand out
    whole, *others = (ToxicityModel({r["entry"]: float(r[f"w{k}"]) for r in strong if r[f"w{k}"] is not None}) for k in range(FOLDS + 1))

    def measure(batches):
        for batch in batches:
            for piece in text_slices(batch, 0):
                x = [others[k].features(t) for t, k in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(4)), piece.column(1)], names=["a", "b", "c", "d", "y"])

    seen = sample.mapInArrow(measure, "a double, b double, c double, d double, y int").toPandas()  # about max_labelled rows of five numbers
    whole.coef = _logistic(seen[["a", "b", "c", "d"]].to_numpy(), seen["y"].to_numpy(float))
    return whole


def score_toxicity(df: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, score, predicted and hits_per_100_words (weighted, on a log scale).

    A null or empty text has no hits and gets the score of a text without hits; without a model all scores are 0. Equal
    texts get equal scores. Only the id and the text are read, so other columns cannot clash. Texts are matched whole.
    Repeated rows give repeated results. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # what stands out in the labelled sample: some hundred entries

    def judge(batch: pa.RecordBatch) -> dict:
        m, texts = shared.value, batch.column(1).to_pylist()
        x = np.array([m.features(t) for t in texts]).reshape(-1, 4) if m else np.zeros((len(texts), 4))
        score = m.score(x) if m else np.zeros(len(texts))
        return {"id": batch.column(0), "score": pa.array(score), "predicted": pa.array((score >= THRESHOLD).astype(np.int32)), "hits": pa.array(x[:, 0])}

    kind = df.schema[id_col].dataType.simpleString()
    return map_text(df.select(df[id_col].alias("doc_id"), df[text_col].cast("string")), 1, judge, f"doc_id {kind}, score double, predicted int, hits_per_100_words double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "hits_per_100_words")
