"""The pipeline's stages on a small folder, each against what its operator's brute force says of its own input."""

import random

import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_llm_operators import brute_components


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    leak = "the river runs past the quiet mill while seven children watch the slow boats drift toward the sea"
    rows.append((500, f"{prose(random.Random(77), 'en', 40)} {leak} {prose(random.Random(78), 'en', 40)}", "en", "s1", 10))
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/{len(seen)}.parquet")
        seen[name], docs = ([tuple(r) for r in docs.collect()], spark.read.parquet(f"{folder}/{len(seen)}.parquet")), spark.read.parquet(f"{folder}/{len(seen)}.parquet")
    ids = lambda k: {r[0] for r in seen[k][0]}
    after = lambda k: {r["doc_id"] for r in seen[k][1].collect()}
    assert {r[0] for r in seen["language ID"][0] if len(r[1] or "") > 60} <= after("language ID")
    assert not after("language ID") & {120, 121, 122, 123}
    want = {c for _, _, c in brute_components(seen["n-gram Jaccard join"][0], 5, 80, 100)}
    assert after("n-gram Jaccard join") == want
    assert ids("benchmark decontamination") - after("benchmark decontamination") == {500}
    mixed = after("mixing sources to target weights")
    assert mixed < ids("mixing sources to target weights") and mixed


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert {"doc_id", "text", "shard", "slot", "size"} <= set(out.columns) and rows
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
