"""Every op query on small folders: names, types, counts and folds as promised, on usual, awkward and empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import fingerprints, registry, tokens, toxicity
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_llm_operators import brute_components

COLUMNS = {
    "op1_decontamination": {"doc_id": "bigint", "item_id": "bigint", "coverage": "double"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_byte_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_quality": {"doc_id": "bigint", "score": "double"},
    "op5_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6_token_counts": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op7_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_mixing": {"doc_id": "bigint", "probability": "double", "weight": "double", "selected": "boolean"},
    "op11_link_graph": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op12_max_tree_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13_va_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
}


PAGES = [
    (1, "https://a.example.net/en/1?q=1", '<a href="https://B.example.com/x">b</a> <img src=//c.example.org/p.png>'),
    (2, "HTTP://A.Example.NET/de/2#x", "<a href='http://b.example.com'>b</a> mail me@mail1.example.com"),
    (3, "http://b.example.com/de/3", '<a href="/x">own</a><a href="https://d.example.com:80/">d</a>'),
    (4, "http://b.example.com/en/4", None),
    (5, "http://c.example.org/fr/5", '<a href="http://d.example.com">d</a>'),
    (6, "http://d.example.com", '<form action="https://c.example.org/z">'),
    (7, None, "<a href='http://b.example.com'>"),
    (8, "no host here", ""),
    (9, "http://net/x", None),
    (10, "http://evilnet/x", None),
    (11, "http://example.net?x", None),
    (None, "ftp://user@e.example.com/a://b", '<a href="http://b.example.com/">'),
    (3, "http://b.example.com/de/3", None),
    (12, "http:///en/", None),
]


def vectors(n):
    rng = np.random.default_rng(5)
    good = [(int(i), [float(np.float32(x)) for x in rng.normal(size=64)], int(i % 3) if i % 7 else None) for i in rng.permutation(n)]
    rows = [*good, *good[:9], (n, None, 1), (n + 1, [float("nan"), *good[0][1][1:]], 1), (n + 2, [None, *good[0][1][1:]], 2), (n + 3, [float("inf"), *good[0][1][1:]], 2)]
    return rows


def folder(spark, path, rows, extra=()):
    from pyspark.sql import functions as F

    add = [F.lit("x").alias(c) for c in extra]
    df = spark.createDataFrame(rows, SCHEMA)
    df.select("*", *add).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(PAGES if rows else [], "page_id long, url string, html string").select("*", *add).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(vectors(150) if rows else [], "vec_id long, embedding array<float>, label int").select("*", *add).write.parquet(f"{path}/embeddings.parquet")
    labels = [(i, int(k % 2), int("idiot" in (t or ""))) for k, (i, t, *_) in enumerate(rows) if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, "how many apples does Onhe hold when seven friends bring nine more apples each"), (2, None), (None, "")]
    spark.createDataFrame(items if rows else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folders(spark, corpus, tmp_path_factory):
    rng = random.Random(12)
    toxic = [(300 + i, prose(rng, "en", 30) + " you idiot " * (i % 3 == 0) + prose(rng, "en", 30), "en", "s1", 1) for i in range(40)]
    usual = [*corpus, *toxic]
    extra = ("range", "row", "cls", "__row", "size", "held_out", "topic", "p")
    base = tmp_path_factory.mktemp("contracts")
    return {"usual": (folder(spark, base / "a", usual, extra), usual), "empty": (folder(spark, base / "b", []), [])}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_meets_its_contract(spark, folders, name):
    assert set(registry.queries()) == set(COLUMNS)
    path, rows = folders["usual"]
    got = registry.queries()[name](spark, path)
    types = dict(got.dtypes)
    assert {c: types[c] for c in COLUMNS[name]} == COLUMNS[name]
    out = got.collect()
    if "doc_id" in types and name not in ("op1_decontamination", "op12_max_tree_search"):
        assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    if "held_out" in types:
        base, rest = (4, 2) if name == "op2_language_id" else (3, 1)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % base == rest) for r in out)
    if types.get("score") == "double":
        assert all(0 <= r["score"] <= 1 for r in out)
    if name == "op3_byte_shards":
        text = {r[0]: r[1] for r in rows}
        assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16 for r in out)
        assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 for r in out if r["doc_id"] is not None)
    if name == "op5_jaccard_join":
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == sorted(brute_components(rows, 4, 85, 100), key=key)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, folders, name):
    duckdb = pytest.importorskip("duckdb")
    for path, rows in folders.values():
        c = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "benchmark"):
            c.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
        got = registry.queries()[name](spark, path)
        want = c.execute(registry.oracle_sql()[name]).fetchall()
        names = [x[0] for x in c.description]
        by_row = lambda x: tuple((v is not None, v) for v in x)
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*names).collect()), key=by_row) == sorted(want, key=by_row) and bool(want) == bool(rows)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_of_empty_tables(spark, folders, name):
    assert registry.queries()[name](spark, folders["empty"][0]).count() == 0


# ---------------------------------------------------------------- separators


@pytest.mark.parametrize("each", [0, 1, 3, 8])
def test_scan_of_very_short_documents(spark, each):
    """A default block of nothing but short documents takes work and memory by its tokens."""
    n = tokens.BLOCK_TOKENS // (each + 1)
    ids = np.tile(np.array([5] * each + [tokens.END], np.uint16), n)
    blocks = spark.createDataFrame([("f", 0, ids[: len(ids) // 2].tobytes()), ("f", 1, ids[len(ids) // 2 :].tobytes()), ("f", 2, b""), ("g", 0, None)], "file string, block long, data binary")
    found = tokens.scan_separators(blocks)
    r = found.selectExpr("count(*) n", "sum(n_tokens) t", "min(n_tokens) a", "max(n_tokens) b", "count(distinct row) r", "sum(start) s").first()
    assert (r["n"], r["t"], r["a"], r["b"], r["r"]) == (n, n * each, each, each, n) and r["s"] == (each + 1) * n * (n - 1) // 2


# ---------------------------------------------------------------- toxicity


def brute_features(text, weights):
    """Weighted hits word by word, without an automaton: for texts without exception phrases."""
    text, found = text or "", []
    folded = toxicity.fold(text)
    for s in range(len(text)):
        if s and text[s - 1].isalnum():
            continue
        best = 0.0
        for w, x in weights.items():
            k = w.removesuffix("*")
            e = s + len(k)
            ended = e == len(text) or (e < len(text) and not text[e].isalnum())
            if folded[s:e] == k and e <= len(text) and ended != w.endswith("*") and any(c.isalpha() for c in text[s:e]):
                best = max(best, x)
        if best:
            found.append(best)
    total = sum(found)
    per = 100 * total / (1 + text.count(" ") + text.count("\n"))
    return np.log1p(per), np.log1p(total), float(total > 0), np.log1p(len(found))


def test_features_against_a_walk():
    rng = random.Random(4)
    words = ["id", "idiot", "idiots", "idiotic", "l0ser", "loser", "in", "1d10t", "réeuxe", "reeux", "REEUXA", "an", "x-idiot"]
    m = toxicity.ToxicityModel({"idiot": 3.0, "idioti*": 2.0, "reeux*": 4.0, "ioser": 2.5, "id*": 1.0})
    for _ in range(300):
        t = rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        assert np.allclose(m.features(t), brute_features(t, m.weights)), t
    assert m.features("trash can " * 50_000)[2] == 0.0


def test_contradicting_and_repeated_labels(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, "en", 30) + (" idiot moron" if i % 4 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i, _ in rows]
    twice = spark.createDataFrame([*labels, *labels, *[(i, 0) for i, y in labels if y], (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, twice)
    assert {"idiot", "moron"} <= set(model.weights)
    once = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert once.weights == model.weights and np.allclose(once.coef, model.coef)


# ---------------------------------------------------------------- likeness


def test_likeness_against_true_dice():
    """Estimates from 64 slots stay near the Dice share of common 16-character spans, counted in full."""
    rng, off = random.Random(21), []
    for i in range(60):
        a = prose(rng, "en", 150)
        cut = rng.randrange(len(a))
        b = a[:cut] + prose(rng, "en", 60) + a[cut + rng.randint(0, 400) :]
        spans = lambda t: {t[j : j + 16] for j in range(len(t) - 15)}
        x, y = spans(a), spans(b)
        marks = [fingerprints.PrefixHash(t).fingerprint() for t in (a, b)]
        off.append(abs(fingerprints.likeness(*marks) - 2 * len(x & y) / (len(x) + len(y))))
    assert sum(off) / len(off) < 0.06 and max(off) < 0.25
