"""Quality by a weak-label model: heuristic labellers vote, expectation-maximisation weighs them, a linear scorer learns.

The labellers overlap and abstain. Their accuracies and the share of good texts are estimated from how often they agree,
without any true label; the posterior of each pattern of votes then labels a sample on which a hashed linear scorer is
trained.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textops import map_text

TRAIN_ROWS = 12_000
BUCKETS = 1 << 12
EM_ROUNDS = 200
SLIPS, CATCHES = 0.1, 0.6
THRESHOLD = 0.5
USUAL_LENGTH = 5.5
LABELLERS = ("symbols", "capitals", "variety", "columns", "runs", "lines", "word_length", "size", "regular")
GOOD, BAD, ABSTAIN = "+", "-", "."


_classes: list[np.ndarray] = []
_MARKS = frozenset(".,;:'\"-?!()、。，！？：；「」『』（）")
#: Letters of scripts that put no blanks between words: Thai to Myanmar, Khmer, kana and Han.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_PAIR = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "]{1,2}")


def _class_counts(text: str) -> np.ndarray:
    """Code points of a text that are (letters, capitals, symbols, letters of UNSPACED)."""
    if not _classes:
        bare = [any(a <= c <= b for a, b in UNSPACED) for c in range(0x40000)]
        kinds = [c.isalpha() + 2 * c.isupper() + 4 * (not (c.isalnum() or c.isspace() or c in _MARKS or u)) + 8 * u for c, u in zip(map(chr, range(0x40000)), bare, strict=True)]
        _classes.append(np.array([*kinds, 4], np.uint8))  # beyond: no letters
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_classes[0][np.minimum(codes, 0x40000)], minlength=16)
    return np.array([n[1::2].sum(), sum(n[i] for i in range(16) if i & 2), sum(n[i] for i in range(16) if i & 4), n[8:].sum()])


class _Shapes(dict):
    """The shape of a word: r for a regular one, A in capitals, 0 for digits, else x, with its last sign. Remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        regular = word.rstrip(".,;:?").isalpha() and not (len(word) > 2 and word.isupper())
        kind = "r" if regular else "A" if word.isupper() else "0" if word.isdigit() else "x"
        self[word] = out = kind + (word[-1] if not word[-1].isalnum() else "")
        return out


SHAPES = _Shapes()


@dataclass
class Reading:
    """What labellers and the scorer look at in one text."""

    measures: dict[str, float]
    shapes: Counter
    pairs: Counter

    @classmethod
    def of(cls, text: str | None) -> Reading:
        text = text or ""
        letters, capitals, symbols, bare = _class_counts(text)
        # where words are not divided by blanks, two letters count as a word, and its length says nothing
        words = _PAIR.sub(r" \g<0> ", "".join(" " if c in _MARKS else c for c in text)).split() if 2 * bare > letters else text.split()
        shapes = [*map(SHAPES.__getitem__, words)]
        n, chars, counted = max(1, len(words)), max(1, len(text)), Counter(shapes)
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        return cls(
            {
                "symbols": symbols / chars, "capitals": capitals / max(1, letters), "variety": len(set(words)) / n,
                "columns": (text.count(" | ") + text.count("\t")) / n, "runs": sum(map(eq, words, words[1:])) / n,
                "lines": 1 - len(set(lines)) / max(1, len(lines)), "word_length": USUAL_LENGTH if 2 * bare > letters else chars / n, "size": float(len(words)),
                "letters": letters / chars, "regular": sum(c for k, c in counted.items() if k[0] == "r") / n,
            },
            counted, Counter(zip(shapes, [*shapes[1:], "$"], strict=False)),
        )


def votes(text: str | None, read: Reading | None = None) -> str:
    """One sign for each labeller: good, bad or abstaining. A text without words has bad votes from size, and none else."""
    m = (read or Reading.of(text)).measures
    if not m["size"]:
        return ABSTAIN * (len(LABELLERS) - 1) + BAD
    pick = lambda bad, good: BAD if bad else GOOD if good else ABSTAIN
    return "".join((
        pick(m["symbols"] > 0.04, False),
        pick(m["capitals"] > 0.25, False),
        pick(m["variety"] < 0.45 and m["size"] < 3000 or m["variety"] < 0.2, m["variety"] > 0.6),
        pick(m["columns"] > 0.08, False),
        pick(m["runs"] > 0.08, m["runs"] < 0.03),
        pick(m["lines"] > 0.4, m["lines"] < 0.15),
        pick(m["word_length"] > 8.5 or m["word_length"] < 3, 4 < m["word_length"] < 7.2),
        pick(m["size"] < 4, m["size"] >= 30),
        pick(m["regular"] < 0.75, m["regular"] > 0.9),
    ))


def fit_labellers(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray, dict[str, float]]:
    """EM over counts of vote patterns: the share of good texts, how labellers vote on each class of text, posteriors.

    There is one class of good texts and one of bad ones for each labeller, the fault that it looks for; the table is
    labellers x classes x (good vote, abstains, bad vote). Abstaining tells something, too, as some labellers only know
    faults. Votes are taken as independent given the class. Two bounds settle what the classes mean: a labeller calls at
    most SLIPS of good texts bad, and at least CATCHES of those with its own fault.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([[(GOOD, ABSTAIN, BAD).index(c) for c in k] for k in keys])
    size = v.shape[1]
    hot = (v[:, :, None] == np.arange(3)).astype(float)  # patterns x labellers x votes
    share = np.array([0.8, *[0.2 / size] * size])
    table = np.tile(np.array([0.5, 0.3, 0.2]), (size, size + 1, 1))
    table[:, 0] = [0.6, 0.37, 0.03]
    for j in range(size):
        table[j, j + 1] = [0.05, 0.15, 0.8]
    for _ in range(rounds):
        logs = np.einsum("klv,lcv->kc", hot, np.log(table)) + np.log(share)
        each = np.exp(logs - logs.max(1, keepdims=True))
        each /= each.sum(1, keepdims=True)
        old, w = table, n[:, None] * each
        share = (w.sum(0) + 1) / (n.sum() + size + 1)
        table = np.einsum("kc,klv->lcv", w, hot) + 0.5
        table = table / table.sum(2, keepdims=True)
        table[:, 0] = _bounded(table[:, 0], 0.0, SLIPS)
        for j in range(size):
            table[j, j + 1] = _bounded(table[j, j + 1], CATCHES, 1.0)
        if abs(table - old).max() < 1e-7:
            break
    return float(share[0]), table, dict(zip(keys, each[:, 0].tolist(), strict=True))


def _bounded(p: np.ndarray, low: float, high: float) -> np.ndarray:
    """Shares of votes with that of the bad ones held in bounds and the others scaled to fit."""
    bad = np.clip(p[..., 2:], max(low, 1e-4), min(high, 1 - 1e-3))
    rest = p[..., :2] / p[..., :2].sum(-1, keepdims=True) * (1 - bad)
    return np.concatenate([np.maximum(rest, 1e-6), bad], -1)


def features(read: Reading) -> tuple[list[int], list[float]]:
    """Hashed features with weights: measures by level, shapes of words and of neighbours."""
    out: dict[int, float] = {}
    n = max(1.0, read.measures["size"])
    named = [(f"{k}:{int(4 * np.log2(1 + (x if k in ('size', 'word_length') else 100 * x)))}", 1.0) for k, x in read.measures.items()]
    named += [(f"s{a}", 2.0 * c / n) for a, c in read.shapes.items()] + [(f"p{a} {b}", 2.0 * c / n) for (a, b), c in read.pairs.items()]
    for name, x in named:
        h = zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS
        out[h] = out.get(h, 0.0) + x
    return list(out), list(out.values())


@dataclass
class QualityModel:
    share: float
    table: np.ndarray  # labellers x classes x (good vote, abstains, bad vote)
    posteriors: dict[str, float]  # by pattern of votes: at most 3**labellers of them
    weights: np.ndarray  # BUCKETS and the intercept

    def score(self, read: Reading) -> float:
        at, x = features(read)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ np.array(x) + self.weights[-1], -30, 30))))


def train_linear(rows: list[tuple[list[int], list[float]]], y: np.ndarray, rounds: int = 300, rate: float = 0.3, pull: float = 1e-4) -> np.ndarray:
    """Logistic regression on sparse rows with soft labels, by AdaGrad over all rows."""
    at = np.concatenate([np.array(a, np.int64) for a, _ in rows])
    x = np.concatenate([np.array(v) for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    w, held, b = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    held_b = 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[at] * x, minlength=len(rows)) + b, -30, 30)))
        g = (p - y) / len(rows)
        grad = np.bincount(at, weights=g[owner] * x, minlength=BUCKETS) + pull * w / len(rows)
        held += grad**2
        held_b += g.sum() ** 2
        w -= rate * grad / np.sqrt(held)
        b -= rate * g.sum() / np.sqrt(held_b)
    return np.append(w, b)


def train(df: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel | None:
    """Fit the labellers on the votes of all rows, and the scorer on about ``train_rows`` of them, chosen by a text hash.

    That sample is the one bound on what is learned from. Equal texts are sampled together. None for an empty table.
    """
    texts = df.select(df[text_col].cast("string").alias("text"))

    def vote(batch: pa.RecordBatch) -> dict:
        return {"pattern": pa.array([votes(t) for t in batch.column(0).to_pylist()])}

    # at most 3**labellers rows
    counted = map_text(texts, 0, vote, "pattern string").groupBy("pattern").count().collect()
    if not counted:
        return None
    patterns = {r["pattern"]: r["count"] for r in counted}
    share, table, posteriors = fit_labellers(patterns)

    def sample(batch: pa.RecordBatch) -> dict:
        t = [Reading.of(x) for x in batch.column(0).to_pylist()]
        got = [features(x) for x in t]
        return {"at": pa.array([a for a, _ in got], pa.list_(pa.int32())), "x": pa.array([v for _, v in got], pa.list_(pa.float64())), "pattern": pa.array([votes(None, x) for x in t])}

    part = min(1.0, train_rows / sum(patterns.values()))
    chosen = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(np.ceil(part * 1_000_000))).dropDuplicates(["text"])
    rows = map_text(chosen, 0, sample, "at array<int>, x array<double>, pattern string").collect()
    y = np.array([posteriors[r["pattern"]] for r in rows])
    weights = train_linear([(r["at"], r["x"]) for r in rows], y) if rows else np.zeros(BUCKETS + 1)
    return QualityModel(share, table, posteriors, weights)


def score_quality(df: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, score (0 to 1, higher is better), keep, posterior of its votes, and the votes.

    keep is score >= THRESHOLD. A null or empty text scores as the text without words that it is; without a model (nothing
    to learn from) the score is 0. Equal texts get equal answers. Only the id and the text are read, so other columns
    cannot clash. Texts are read whole. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights and 3**labellers posteriors at most

    def judge(batch: pa.RecordBatch) -> dict:
        m, t = shared.value, [Reading.of(x) for x in batch.column(1).to_pylist()]
        score = np.array([m.score(x) if m else 0.0 for x in t])
        seen = [votes(None, x) for x in t]
        return {"id": batch.column(0), "score": pa.array(score), "keep": pa.array((score >= THRESHOLD).astype(bool)), "posterior": pa.array([m.posteriors.get(v) if m else None for v in seen], pa.float64()), "votes": pa.array(seen, pa.string())}

    kind = df.schema[id_col].dataType.simpleString()
    return map_text(df.select(df[id_col].alias("doc_id"), df[text_col].cast("string")), 1, judge, f"doc_id {kind}, score double, keep boolean, posterior double, votes string")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, train(docs))
