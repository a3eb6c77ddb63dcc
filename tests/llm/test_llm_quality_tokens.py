"""Quality against made-up faults and brute-force EM; token counts against plain tokenisation and real flat files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, tokens


@pytest.fixture(scope="module")
def mixed(spark, corpus):
    rng, rows = random.Random(5), []
    prose = [t for i, t, *_ in corpus if i is not None and i < 90]
    for i in range(300):
        t, fault = rng.choice(prose), i % 6
        if fault == 0:
            t = "".join(w + rng.choice(["&&&", "%%%", "***"]) + " " for w in t.split())
        elif fault == 1 and i % 12 == 1:
            t = " ".join([t.split()[0]] * 60)
        rows.append((i, t, fault == 0 or i % 12 == 1))
    return spark.createDataFrame(rows, "doc_id long, text string, bad boolean")


def test_quality_finds_faults_without_labels(mixed):
    model = quality.train(mixed)
    got = quality.score_quality(mixed, model).join(mixed.select("doc_id", "bad"), "doc_id").collect()
    assert sum(r["keep"] != r["bad"] for r in got) >= 0.97 * len(got)
    assert 0.6 < model.share < 0.9


def test_labeller_accuracies_are_recovered():
    """Votes drawn from known faults: shares, slips and catches come back without a true label."""
    rng = np.random.default_rng(3)
    slips, catches = [0.02, 0.05, 0.01, 0.04], [0.9, 0.8, 0.95, 0.85]
    patterns: dict[str, int] = {}
    for fault in rng.choice(5, 30_000, p=[0.8, 0.06, 0.05, 0.04, 0.05]):
        p = "".join("-" if rng.random() < (catches[j] if fault == j + 1 else 0.3 if fault == (j + 1) % 4 + 1 else slips[j]) else "+" for j in range(4))
        patterns[p] = patterns.get(p, 0) + 1
    share, table, post = quality.fit_labellers(patterns)
    assert abs(share - 0.8) < 0.05 and np.abs(table[:, 0, 2] - slips).max() < 0.02
    assert all(table[j, j + 1, 2] >= 0.7 for j in range(4)) and post["++++"] > 0.95 and max(p for k, p in post.items() if k.count("-") > 2) < 0.05


def test_quality_edges(docs, no_docs, clashing, mixed):
    model = quality.train(mixed)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    assert got[120]["votes"] == got[121]["votes"] == got[122]["votes"] == "........-" and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.train(no_docs) is None and quality.score_quality(no_docs, model).count() == 0
    assert quality.score_quality(clashing, model).count() == docs.count()
    assert {r["score"] for r in quality.score_quality(docs, None).collect()} == {0.0}


def brute_scan(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    return out + ([(len(out), start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [1, 3, 7, 64, 1000])
def test_scan_of_real_flat_files(spark, tmp_path, block):
    rng, want = random.Random(block), {}
    for f in range(6):
        ids = [rng.choice([9, 1, 2, 3]) if f else 5 for _ in range(rng.randint(1, 300))]
        if f == 3:
            ids[-1] = 9
        if f == 4:
            ids = [9, 9, 9]
        np.array(ids, np.uint16).tofile(tmp_path / f"f{f}.bin")
        want[f"f{f}.bin"] = brute_scan(ids, 9)
    (tmp_path / "f9.bin").write_bytes(b"")
    got: dict[str, list] = {}
    for r in tokens.scan_separators(tokens.read_token_files(spark, str(tmp_path), block), end=9).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["row"], r["start"], r["n_tokens"], r["closed"]))
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("block", [50, 1 << 18])
def test_counts_against_plain_tokenisation(docs, corpus, no_docs, clashing, block):
    encode = tokens.encoder().encode_ordinary
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(docs, block_tokens=block).collect()))
    assert got == sorted((i is not None, i, len(encode(t or ""))) for i, t, *_ in corpus)
    if block > 50:
        assert tokens.count_tokens(no_docs).count() == 0 and tokens.count_tokens(clashing).count() == docs.count()


def test_files_are_cut_and_listed(docs, corpus):
    flat = tokens.flat_token_blocks(docs.coalesce(1), block_tokens=64, file_tokens=2000).persist()
    assert flat.filter("data IS NOT NULL").select("file").distinct().count() > 3
    assert flat.filter("ids IS NOT NULL").agg(F.sum(F.size("ids"))).first()[0] == len(corpus)
    assert flat.filter("data IS NOT NULL").agg(F.max(F.length("data"))).first()[0] == 128
    found = tokens.scan_separators(flat.filter("data IS NOT NULL"))
    assert found.count() == len(corpus) and found.filter("NOT closed").count() == 0
