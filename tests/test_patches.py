"""Patches are applied whole or refused with the first reason."""

import pytest

from tessera.operators.patches import apply_patches, patch_findings

SEGS = "patch long, street long, seg int, x1 double, y1 double, x2 double, y2 double, width double, surface string, bridge boolean"
OPS = "patch long, kind string, street long, seg int, id string, value double, surface string, x1 double, y1 double, x2 double, y2 double"


def op(kind, street=None, seg=None, id_=None, value=None, surface=None, shape=(None,) * 4):
    return (1, kind, street, seg, id_, value, surface, *shape)


NEW = {"id_": "n", "value": 4.0, "surface": "dirt", "shape": (0.0, 0.0, 5.0, 5.0)}
GOOD = [op("remove", 7, 1), op("width", 7, 2, value=9.0), op("surface", 7, 2, surface="gravel"), op("add", **NEW), op("bridge", **{**NEW, "id_": "b"})]


@pytest.mark.parametrize(("extra", "wrong", "reason"), [
    ([], 0, None),
    ([], 1, "count mismatch"),
    ([op("remove", 8, 9)], 0, "remove conflict"),
    ([op("remove", 7, 1)], 0, "remove conflict"),
    ([op("width", 7, 2, value=3.0)], 0, "width conflict"),
    ([op("width", 7, 3, value=65.0)], 0, "width conflict"),
    ([op("width", 7, 3)], 0, "width conflict"),
    ([op("surface", 7, 3, surface="ice")], 0, "surface conflict"),
    ([op("add", **NEW)], 0, "invalid add"),
    ([op("bridge", **{**NEW, "id_": None})], 0, "invalid bridge"),
    ([op("bridge", **{**NEW, "id_": "c", "shape": (1.0, 1.0, 1.0, 1.0)})], 0, "invalid bridge"),
    ([op("surface", 7, 3, surface="ice"), op("remove", 8, 9)], 0, "remove conflict"),
])
def test_patch_is_whole_or_refused(spark, extra, wrong, reason):
    segs = [(1, 7, i, float(i), 0.0, float(i + 1), 0.0, 5.0, "paved", False) for i in (1, 2, 3)] + [(2, 9, 1, 0.0, 0.0, 1.0, 0.0, 5.0, "paved", False)]
    ops = [*GOOD, *extra]
    headers = [(1, k, sum(o[1] == k for o in ops) + (wrong if k == "add" else 0)) for k in ("remove", "width", "surface", "add", "bridge")] + [(2, "remove", 0)]
    s, o, h = spark.createDataFrame(segs, SEGS), spark.createDataFrame(ops, OPS), spark.createDataFrame(headers, "patch long, kind string, n long")
    assert {r["patch"]: r["refused"] for r in patch_findings(s, o, h).collect()} == {1: reason, 2: None}
    got = sorted((r["patch"], r["street"] or 0, r["seg"] or 0, r["id"] or "", r["width"], r["surface"], r["bridge"]) for r in apply_patches(s, o, h).collect())
    after = [(1, 7, 2, "", 9.0, "gravel", False), (1, 7, 3, "", 5.0, "paved", False), (1, 0, 0, "n", 4.0, "dirt", False), (1, 0, 0, "b", 4.0, "dirt", True)]
    before = [(1, 7, i, "", 5.0, "paved", False) for i in (1, 2, 3)]
    assert got == sorted([*(before if reason else after), (2, 9, 1, "", 5.0, "paved", False)])
