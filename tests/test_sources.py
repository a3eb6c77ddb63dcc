"""File formats: small files are written here and read back; broken ones raise."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as X
from tessera.streaming import replication as L

STREETS = '<streets version="1"><street name="Elm" width="4"><points><point x="1.5" y="2.0"/><point x="3" y="4"/></points></street><street name="Oak" width="{w}"><points><point x="0" y="0"/>{more}</points></street></streets>'


def test_streets(spark, tmp_path):
    good, bad = tmp_path / "a.xml", tmp_path / "b.xml"
    good.write_text(STREETS.format(w=6, more='<point x="9" y="9"/>'))
    bad.write_text(STREETS.format(w=6, more=""))
    rows = X.read_streets(spark, str(good)).orderBy("name").collect()
    assert [(r["name"], r["width"], [(p["x"], p["y"]) for p in r["pts"]]) for r in rows] == [("Elm", 4.0, [(1.5, 2.0), (3.0, 4.0)]), ("Oak", 6.0, [(0.0, 0.0), (9.0, 9.0)])]
    with pytest.raises(Exception, match="two points"):
        X.read_streets(spark, str(bad)).collect()
    loose = X.read_streets_loosely(spark, str(bad)).orderBy("street", "pos").collect()
    assert [(r["name"], r["pos"], r["x"]) for r in loose] == [("Elm", 0, 1.5), ("Elm", 1, 3.0), ("Oak", 0, 0.0)]


def test_surfaces(spark, tmp_path):
    cells = [{"x": 0, "y": 0, "runs": [[0, 65536, 1]]}, {"x": 1, "y": 0, "runs": [[0, 10, 0], [11, 65525, 1]]}]
    (tmp_path / "s.json").write_text(json.dumps({"schemaVersion": 1, "mapId": "m", "cellSize": 256, "classes": ["grass", "road"], "cells": cells}))
    ok = X.read_surfaces(spark, str(tmp_path / "s.json")).groupBy("cx").agg(F.min("ok").alias("ok")).collect()
    assert {r["cx"]: r["ok"] for r in ok} == {0: True, 1: False}


def test_spans(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,5,0,10,20,6,1,12,3\n2\n3,5,0,1,2\n")
    assert sorted((r["frame"], r["key"], r["length"]) for r in X.read_spans(spark, str(tmp_path / "t.csv")).collect()) == [(1, 5, 20), (1, 6, 3), (3, 5, 2)]
    (tmp_path / "u.csv").write_text("1,5,0\n")
    with pytest.raises(Exception, match="bad span line"):
        X.read_spans(spark, str(tmp_path / "u.csv")).collect()


def test_zones_and_buildings(spark, tmp_path):
    (tmp_path / "z.txt").write_text('{ name = "", type = "ParkingStall", x = 1, y = 2, z = 0, width = 3, height = 4 },\n{ name = "q", type = "Other", x = 1, y = 2, z = 0, width = 3, height = 4 },\n{ name = "", type = "ParkingStall", x = 1, y = 2, z = 1, width = 3, height = 4 },\n')
    assert [(r["x"], r["width"]) for r in X.read_zones(spark, str(tmp_path / "z.txt")).collect()] == [(1, 3)]
    (tmp_path / "b.json").write_text(json.dumps({"buildings": [{"id": 1, "rooms": [{"name": "hall", "level": 0, "rects": [[1, 2, 3, 4], [5, 6, 7, 8]]}]}]}))
    assert X.read_buildings(spark, str(tmp_path / "b.json")).count() == 2


def test_cells(spark, tmp_path):
    for n in ("m_3_4.bin", "m_4_5.bin", "m_9_9.bin"):
        (tmp_path / n).write_bytes(b"x")
    assert [(r["a"], r["b"]) for r in X.cells_of_files(spark, str(tmp_path)).collect()] == [(3, 4)]


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\tc"), (1, None)], "k int, v string")
    X.write_store(df, str(tmp_path / "s"), "MARKS", ["k", "v"], ["k"])
    rows = X.read_store(spark, str(tmp_path / "s"), "MARKS").orderBy("n").collect()
    assert [r["fields"] for r in rows] == [["1", ""], ["2", "b%09c"]]
    broken = tmp_path / "broken.txt"
    broken.write_text("MARKS\t1\n1\tx\nEND\t2\n")
    with pytest.raises(Exception, match="not a whole"):
        X.read_store(spark, str(broken), "MARKS").collect()
    assert X.read_prefer_main(spark, str(broken), str(tmp_path / "s"), "MARKS").count() == 2


def test_reset_runs(spark, tmp_path):
    (tmp_path / "r.txt").write_text("RUN b 200 2\nC 1,2;3,4\nRUN a 100 1\nC 5,6\n")
    assert sorted((r["run_id"], r["ms"], r["cx"]) for r in X.read_reset_runs(spark, str(tmp_path / "r.txt")).collect()) == [("a", 100, 5), ("b", 200, 1), ("b", 200, 3)]
    (tmp_path / "q.txt").write_text("RUN a 100 1\nC 5,6\nRUN b 100 1\nC 5,6\n")
    with pytest.raises(Exception, match="newest first"):
        X.read_reset_runs(spark, str(tmp_path / "q.txt")).collect()


def test_strict_json(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ('{"a":NaN}',), (None,)], "t string")
    out = X.load_json_strictly(df, "t", "a int").collect()
    assert [bool(r["error"]) for r in out] == [False, True, True, True] and out[0]["value"]["a"] == 1


def run(stream, tmp_path, mode="append"):
    q = stream.writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    return str(tmp_path / "out")


def events(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, rev long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k string, rev long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streams(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    batches = [[("a", 2, at(0)), ("a", 1, at(0.5))], [("a", 3, at(2)), ("b", 1, at(2))]]
    s = events(spark, tmp_path, batches)
    new = spark.read.parquet(run(L.accept_newer(s, "k", "rev"), tmp_path / "n"))
    kept = {(r["k"], r["rev"]) for r in new.collect()}
    assert {("a", 3), ("b", 1)} <= kept and all(r["rev"] in (1, 2, 3) for r in new.collect())
    slow = spark.read.parquet(run(L.rate_limit(s, "k", "ts"), tmp_path / "r")).collect()
    assert ("a", 1) not in {(r["k"], r["rev"]) for r in slow}
    q = s.writeStream.foreachBatch(L.upsert_to(str(tmp_path / "v"), ["k"], "rev")).option("checkpointLocation", str(tmp_path / "vcp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max((tmp_path / "v").glob("v*"), key=lambda p: int(p.name[1:]))
    assert sorted((r["k"], r["rev"]) for r in spark.read.parquet(str(last)).collect()) == [("a", 3), ("b", 1)]
