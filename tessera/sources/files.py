"""Readers and writers of file formats: street XML, surface JSON, span CSV, zone text, tab stores, reset runs, registries.

Readers give typed rows and say what is wrong instead of dropping it; strict ones raise when an action meets a bad file.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STREET = "_name string, _width double, points struct<point: array<struct<_x: double, _y: double>>>"
RASTER_CELLS = 65_536  # fixed value: squares of a raster cell, 256 by 256


def read_streets(spark: SparkSession, path: str) -> DataFrame:
    """Strict street XML: name, width, pts; raises on a street with fewer than two points or a bad width."""
    raw = spark.read.format("xml").option("rowTag", "street").option("mode", "FAILFAST").schema(STREET).load(path)
    s = raw.select(F.col("_name").alias("name"), F.col("_width").alias("width"), F.transform("points.point", lambda p: F.struct(p["_x"].alias("x"), p["_y"].alias("y"))).alias("pts"))
    bad = F.col("pts").isNull() | (F.size("pts") < 2) | F.col("width").isNull() | (F.col("width") <= 0)
    return s.withColumn("width", F.when(bad, F.raise_error(F.concat(F.lit("street without two points or a width: "), F.coalesce("name", F.lit("(none)"))))).otherwise(F.col("width")))


def read_streets_loosely(spark: SparkSession, path: str) -> DataFrame:
    """Street name, width and points by patterns, from XML that a parser would refuse: pos, x, y in the order written."""
    text = spark.read.text(path, wholetext=True)
    block = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)(<street\b.*?</street>)"), F.lit(1))).alias("street", "b"))
    attr = lambda n: F.regexp_extract("b", rf'<street\b[^>]*\b{n}="([^"]*)"', 1)
    pts = F.arrays_zip(F.regexp_extract_all("b", F.lit(r'<point\b[^>]*\bx="([^"]*)"'), F.lit(1)).alias("x"), F.regexp_extract_all("b", F.lit(r'<point\b[^>]*\by="([^"]*)"'), F.lit(1)).alias("y"))
    return block.select("street", attr("name").alias("name"), attr("width").try_cast("double").alias("width"), F.posexplode_outer(pts).alias("pos", "p")).select("street", "name", "width", "pos", F.col("p.x").try_cast("double").alias("x"), F.col("p.y").try_cast("double").alias("y"))


def read_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """Run-length raster cells: cx, cy, start, end, cls, and ok: whether the cell's runs cover it without gap or overlap."""
    schema = "schemaVersion int, mapId string, cellSize int, classes array<string>, cells array<struct<x:int,y:int,runs:array<array<int>>>>"
    c = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select("classes", F.explode("cells").alias("c"))
    runs = c.select("classes", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.posexplode("c.runs").alias("pos", "r"))
    runs = runs.select("cx", "cy", "pos", F.col("r")[0].alias("start"), (F.col("r")[0] + F.col("r")[1]).alias("end"), F.get("classes", F.col("r")[2]).alias("cls"))
    w = Window.partitionBy("cx", "cy")
    follows = F.coalesce(F.lag("end").over(w.orderBy("pos")), F.lit(0)) == F.col("start")
    return runs.withColumn("__f", follows).withColumn("ok", F.min("__f").over(w) & (F.max("end").over(w) == RASTER_CELLS)).drop("__f", "pos")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Profiler lines ``frame,(key,depth,start,length)*``: one row for each span; a line of another width raises."""
    parts = F.split("value", ",")
    good = (F.size(parts) % 4 == 1) & F.forall(parts, lambda x: F.rlike(x, F.lit("^-?[0-9]+$")))
    rows = spark.read.text(path).filter(F.length("value") > 0).withColumn("p", F.when(good, parts).otherwise(F.raise_error(F.concat(F.lit("bad span line: "), "value"))))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / 4).cast("int") - 1))
    r = rows.filter(F.size("p") > 1).select("p", at.alias("i"))
    field = lambda k: F.get("p", F.col("i") * 4 + 1 + k).cast("long")
    return r.select(F.get("p", F.lit(0)).cast("long").alias("frame"), field(0).alias("key"), field(1).cast("int").alias("depth"), field(2).alias("start"), field(3).alias("length"))


def read_zones(spark: SparkSession, path: str, kind: str = "ParkingStall", excluded: tuple[str, ...] = ()) -> DataFrame:
    """Zone entries ``{ name = "..", type = "..", x = n, ... }``, one on a line, of one type, at level 0 and with a size."""
    text = lambda k: F.regexp_extract("value", rf'\b{k}\s*=\s*"([^"]*)"', 1)
    num = lambda k: F.regexp_extract("value", rf"\b{k}\s*=\s*(-?[0-9]+)", 1).try_cast("int")
    z = spark.read.text(path).select(text("name").alias("name"), text("type").alias("type"), *[num(k).alias(k) for k in ("x", "y", "z", "width", "height")])
    return z.filter((F.col("type") == kind) & (F.col("z") == 0) & (F.col("width") > 0) & (F.col("height") > 0) & ~F.col("name").isin(*excluded)) if excluded else z.filter((F.col("type") == kind) & (F.col("z") == 0) & (F.col("width") > 0) & (F.col("height") > 0))


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """Building JSON with nested rooms and rectangles: one row for each rectangle."""
    schema = "buildings array<struct<id:long,rooms:array<struct<name:string,level:int,rects:array<array<int>>>>>>"
    b = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("buildings").alias("b"))
    r = b.select(F.col("b.id").alias("building_id"), F.explode("b.rooms").alias("r")).select("building_id", F.col("r.name").alias("name"), F.col("r.level").alias("level"), F.explode("r.rects").alias("q"))
    return r.select("building_id", "name", "level", *[F.col("q")[i].alias(c) for i, c in enumerate("xywh")])


def cells_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of cells that a folder's file names ``.._a_b.ext`` own together with the cell diagonally below: both needed."""
    f = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"_(\d+)_(\d+)\.[A-Za-z]+$", 1).try_cast("int").alias("a"), F.regexp_extract("path", r"_(\d+)_(\d+)\.[A-Za-z]+$", 2).try_cast("int").alias("b")).filter("a IS NOT NULL").distinct()
    return f.join(f.select((F.col("a") - 1).alias("a"), (F.col("b") - 1).alias("b")), ["a", "b"], "left_semi")


def load_json_strictly(df: DataFrame, text: str, schema: str, max_bytes: int = 1_000_000) -> DataFrame:
    """Parsed values with an error instead where a text is too long, repeats a key, or has NaN or Infinity."""

    @F.pandas_udf(T.StringType())
    def problem(values: pd.Series) -> pd.Series:
        def look(v: str | None) -> str | None:
            if v is None:
                return "missing"
            if len(v.encode()) > max_bytes:
                return "too long"

            def pairs(p):
                if len({k for k, _ in p}) < len(p):
                    raise ValueError("repeated key")
                return dict(p)

            def number(x):
                raise ValueError(f"not a number: {x}")

            try:
                json.loads(v, object_pairs_hook=pairs, parse_constant=number)
            except ValueError as e:
                return str(e)
            return None

        return values.map(look)

    d = df.withColumn("error", problem(F.col(text)))
    return d.withColumn("value", F.when(F.col("error").isNull(), F.from_json(text, schema)))


def read_store(spark: SparkSession, path: str, tag: str, version: int = 1) -> DataFrame:
    """Rows (n, fields) of a tab store ``TAG version`` .. ``END count``; raises unless head, end and count agree."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\n+$", ""), "\n").alias("l"))
    ok = (F.get("l", F.lit(0)) == f"{tag}\t{version}") & (F.element_at("l", -1) == F.concat(F.lit("END\t"), (F.size("l") - 2).cast("string")))
    body = F.when(ok, F.slice("l", F.lit(2), F.size("l") - 2)).otherwise(F.raise_error(F.lit(f"not a whole {tag} store")))
    return lines.select(F.posexplode(body).alias("n", "line")).select("n", F.split("line", "\t", -1).alias("fields"))


def write_store(df: DataFrame, path: str, tag: str, columns: list[str], order: list[str], version: int = 1) -> None:
    """A tab store in one file, written by Spark: rows in order, then their count. For exports of bounded size."""
    from tessera.functions.scalars import percent_escape

    line = F.concat_ws("\t", *[percent_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    body = df.select(F.lit(1).alias("k"), F.struct(*order).alias("o"), line.alias("value"))
    blank = F.lit(None).cast(body.schema["o"].dataType)
    head = df.sparkSession.range(1).select(F.lit(0).alias("k"), blank.alias("o"), F.lit(f"{tag}\t{version}").alias("value"))
    foot = df.agg(F.concat(F.lit("END\t"), F.count(F.lit(1)).cast("string")).alias("value")).select(F.lit(2).alias("k"), blank.alias("o"), "value")
    head.union(body).union(foot).coalesce(1).sortWithinPartitions("k", "o").select("value").write.mode("overwrite").text(path)


def read_reset_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, ms, cx, cy) of ``RUN id ms count`` and ``C cx,cy;..`` lines; raises unless counts fit and runs get older.

    Every file is a list of its own: its runs come newest first, whatever other files hold.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    w = Window.partitionBy("file").orderBy("pos")
    head, body = F.startswith("line", F.lit("RUN ")), F.startswith("line", F.lit("C "))
    d = lines.filter(head | body).withColumn("run", F.last(F.when(head, F.split("line", " ")), ignorenulls=True).over(w)).withColumn("at", F.sum(head.cast("int")).over(w))
    chunks = F.when(body, F.split(F.substring("line", 3, 1 << 30), ";"))
    per = d.groupBy("file", "at").agg(F.first("run").alias("run"), F.flatten(F.collect_list(chunks)).alias("c"))  # the chunks of one run
    ms = F.get("run", F.lit(2)).cast("long")
    before = F.lag(ms).over(Window.partitionBy("file").orderBy("at"))
    good = F.coalesce(ms < before, before.isNull()) & (F.size("c") == F.get("run", F.lit(3)).cast("int"))
    checked = per.withColumn("ms", F.when(good, ms).otherwise(F.raise_error(F.lit("runs not newest first or chunks missing"))))
    xy = F.split("chunk", ",")
    return checked.select(F.get("run", F.lit(1)).alias("run_id"), "ms", F.explode("c").alias("chunk")).select("run_id", "ms", F.get(xy, F.lit(0)).cast("int").alias("cx"), F.get(xy, F.lit(1)).cast("int").alias("cy"))


def write_registry(df: DataFrame, path: str, order: list[str], online: str) -> None:
    """A registry in one file: a line with the counts, then one JSON entry on a line, in order. For exports of bounded size."""
    body = df.select(F.lit(1).alias("k"), F.struct(*order).alias("o"), F.to_json(F.struct(*df.columns)).alias("value"))
    counts = F.struct(F.count(F.lit(1)).alias("count"), F.count_if(F.col(online)).alias("online"))
    head = df.agg(F.to_json(counts).alias("value")).select(F.lit(0).alias("k"), F.lit(None).cast(body.schema["o"].dataType).alias("o"), "value")
    head.union(body).coalesce(1).sortWithinPartitions("k", "o").select("value").write.mode("overwrite").text(path)


def read_registry(spark: SparkSession, path: str, schema: str, online: str) -> DataFrame:
    """The entries of registries by an explicit schema; raises on a malformed entry, or if a file's counts do not fit."""
    text = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\n+$", ""), "\n").alias("l"))
    head = F.from_json(F.get("l", F.lit(0)), "count long, online long", {"mode": "FAILFAST"})
    entries = F.transform(F.slice("l", F.lit(2), F.size("l") - 1), lambda e: F.from_json(e, schema, {"mode": "FAILFAST"}))
    d = text.select(head.alias("h"), entries.alias("e"))
    fits = (F.size("e") == F.col("h.count")) & (F.size(F.filter("e", lambda e: e[online])) == F.col("h.online"))
    return d.select(F.explode(F.when(fits, F.col("e")).otherwise(F.raise_error(F.lit("registry counts do not fit")))).alias("e")).select("e.*")


def write_sorted_lines(df: DataFrame, path: str, order: list[str], line: Column) -> None:
    """A generated table in one file whose bytes depend on the rows alone: lines in order. For tables of bounded size."""
    df.select(*order, line.alias("__line")).coalesce(1).sortWithinPartitions(*order).select("__line").write.mode("overwrite").text(path)


def grouped_json(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """One JSON text for each key: its rows as objects in order. Groups are what one file entry holds."""
    rows = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v"))))
    return df.groupBy(key).agg(F.to_json(F.transform(rows, lambda r: r["v"])).alias("json"))


def geojson_lines(df: DataFrame, points: str, properties: list[str]) -> Column:
    """A GeoJSON feature of an array of (x, y)."""
    coords = F.transform(points, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def read_prefer_main(spark: SparkSession, main: str, backup: str, tag: str) -> DataFrame:
    """The main store if it reads whole, else its backup."""
    try:
        d = read_store(spark, main, tag)
        d.count()
        return d
    except Exception as e:  # a missing or broken main file; what it was is told by the backup's reader if that fails too
        if "not a whole" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        return read_store(spark, backup, tag)
