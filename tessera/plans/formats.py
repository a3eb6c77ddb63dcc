"""Queries over written files: each writes a format from a table to a folder of its own and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import _ensure_checkpoint_dir
from tessera.plans.base import query
from tessera.sources import files
from tessera.sources.tables import rects, table, vertices, with_views


def new_folder(df: DataFrame) -> str:
    """A folder that the driver and the executors share: a new one below the checkpoint folder."""
    _ensure_checkpoint_dir(df)
    return f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def lines_in_files(df: DataFrame, value: str, key: str | None = None) -> str:
    """The path of text files of a column's lines; with ``key`` each value of it has a file of its own."""
    path = new_folder(df)
    if key:
        df.select(value, key).repartition(key).write.partitionBy(key).text(path)
    else:
        df.select(value).write.text(path)
    return path


def _streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir).groupBy("street").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p")).filter(F.size("p") > 1)
    point = lambda p: F.concat(F.lit('<point x="'), p["x"].cast("string"), F.lit('" y="'), p["y"].cast("string"), F.lit('"/>'))
    head = F.concat(F.lit('<street name="street '), F.col("street").cast("string"), F.lit('" width="'), (2 + F.col("street") % 4).cast("string"), F.lit('.5">'))
    one = F.concat(head, F.lit("<points>"), F.array_join(F.transform("p", point), ""), F.lit("</points></street>"))
    docs = v.groupBy((F.floor(F.col("street") / 2000)).alias("g")).agg(F.array_join(F.collect_list(one), "\n").alias("t"))  # a file of 2,000 streets at most
    return docs.select("g", F.concat(F.lit('<streets version="1">\n'), "t", F.lit("\n</streets>")).alias("value"))


@query(with_views("SELECT 'street ' || street AS name, 2.5 + street % 4 AS width, count(*) AS n, max(CAST(x AS DOUBLE)) FILTER (WHERE pos = 1) AS x0 FROM v_vertex GROUP BY street HAVING count(*) > 1", "v_vertex"))
def street_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = files.read_streets(spark, lines_in_files(_streets(spark, sf_dir), "value", "g"))
    return got.select("name", "width", F.size("pts").cast("long").alias("n"), F.col("pts")[0]["x"].alias("x0"))


@query(with_views("SELECT 'street ' || street AS name, CAST(pos - 1 AS INTEGER) AS pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM v_vertex WHERE street IN (SELECT street FROM v_vertex WHERE pos = 2)", "v_vertex"))
def street_files_loosely(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_streets_loosely(spark, lines_in_files(_streets(spark, sf_dir), "value", "g")).select("name", "pos", "x", "y")


@query("SELECT cx, 7 AS cy, start, stop, cls, cx % 5 <> 0 AS ok FROM (SELECT CAST(p_partkey AS INTEGER) AS cx, 0 AS start, 100 + p_size AS stop, CASE p_size % 3 WHEN 0 THEN 'paved' WHEN 1 THEN 'gravel' ELSE 'dirt' END AS cls FROM part UNION ALL SELECT CAST(p_partkey AS INTEGER), 100 + p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END, 65536, 'paved' FROM part) t")
def surface_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, a = table(spark, sf_dir, "part"), (100 + F.col("p_size")).cast("int")
    gap = F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)
    runs = F.array(F.array(F.lit(0), a, (F.col("p_size") % 3).cast("int")), F.array(a + gap, F.lit(files.RASTER_CELLS) - a - gap, F.lit(0)))
    cells = p.select((F.col("p_partkey") % 8).alias("g"), F.struct(F.col("p_partkey").cast("int").alias("x"), F.lit(7).alias("y"), runs.alias("runs")).alias("c"))
    head = [F.lit(1).alias("schemaVersion"), F.lit("m").alias("mapId"), F.lit(256).alias("cellSize"), F.array(*map(F.lit, ("paved", "gravel", "dirt"))).alias("classes")]
    docs = cells.groupBy("g").agg(F.to_json(F.struct(*head, F.collect_list("c").alias("cells"))).alias("value"))
    got = files.read_surfaces(spark, lines_in_files(docs, "value", "g"))
    return got.select("cx", "cy", "start", F.col("end").alias("stop"), "cls", "ok")


@query(with_views("SELECT 'P' || id AS name, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height FROM v_rect WHERE id % 3 <> 0 AND id % 4 <> 0 AND id % 50 <> 1", "v_rect"))
def zone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k, c: F.concat(F.lit(f", {k} = "), c.cast("string"))
    name = F.when(F.col("id") % 50 == 1, "Private").otherwise(F.concat(F.lit("P"), F.col("id").cast("string")))
    kind = F.when(F.col("id") % 3 == 0, "Forest").otherwise("ParkingStall")
    line = F.concat(F.lit('{ name = "'), name, F.lit('", type = "'), kind, F.lit('"'), n("x", F.col("x")), n("y", F.col("y")), n("z", F.when(F.col("id") % 4 == 0, 1).otherwise(0)), n("width", F.col("w")), n("height", F.col("h")), F.lit(" },"))
    got = files.read_zones(spark, lines_in_files(rects(spark, sf_dir).select(line.alias("value")), "value"), excluded=("Private",))
    return got.select("name", "x", "y", "width", "height")


@query(with_views("SELECT id AS building_id, 'room ' || cat AS name, CAST(id % 3 - 1 AS INTEGER) AS level, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM v_rect UNION ALL SELECT id, 'hall', 0, CAST(y AS INTEGER), CAST(x AS INTEGER), 2, 2 FROM v_rect WHERE id % 2 = 0", "v_rect"))
def building_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda *c: F.array(F.array(*[v.cast("int") for v in c]))
    room = F.struct(F.concat(F.lit("room "), "cat").alias("name"), (F.col("id") % 3 - 1).cast("int").alias("level"), box(*map(F.col, "xywh")).alias("rects"))
    hall = F.struct(F.lit("hall").alias("name"), F.lit(0).alias("level"), box(F.col("y"), F.col("x"), F.lit(2), F.lit(2)).alias("rects"))
    one = F.struct("id", F.when(F.col("id") % 2 == 0, F.array(room, hall)).otherwise(F.array(room)).alias("rooms"))
    docs = rects(spark, sf_dir).groupBy((F.col("id") % 8).alias("g")).agg(F.to_json(F.struct(F.collect_list(one).alias("buildings"))).alias("value"))
    return files.read_buildings(spark, lines_in_files(docs, "value", "g"))


@query("SELECT l_orderkey AS frame, l_partkey AS key, l_linenumber AS depth, l_suppkey AS start, CAST(l_quantity AS BIGINT) AS length FROM lineitem")
def span_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda x: F.col(x).cast("long").cast("string")
    span = F.concat_ws(",", *map(c, ("l_partkey", "l_linenumber", "l_suppkey", "l_quantity")))
    frames = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(",", c("l_orderkey"), F.array_join(F.collect_list(span), ",")).alias("value"))
    return files.read_spans(spark, lines_in_files(frames, "value"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS ok, CASE WHEN event_id % 5 > 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 5
    e = table(spark, sf_dir, "events").select("event_id", F.when(m == 0, '{"k": 1, "k": 2}').when(m == 1, '{"k": NaN}').when(m == 2, F.concat(F.lit('{"k": "'), F.repeat(F.lit("x"), 200), F.lit('"}'))).otherwise(F.col("props")).alias("t"))
    got = files.load_json_strictly(e, "t", "k long", max_bytes=150)
    return got.select("event_id", F.col("error").isNull().alias("ok"), F.col("value.k").alias("k"))


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS n, CAST(s_suppkey AS VARCHAR) AS id, replace(s_name, '#', '%') AS name, '' AS note FROM supplier")
def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.scalars import percent_unescape

    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.replace("s_name", F.lit("#"), F.lit("%")).alias("s_name"), F.lit(None).cast("string").alias("note"))
    path = new_folder(s)
    files.write_store(s, path, "SUPPLIERS", ["s_suppkey", "s_name", "note"], ["s_suppkey"])
    f = lambda i: percent_unescape(F.get("fields", F.lit(i)))
    return files.read_store(spark, path, "SUPPLIERS").select("n", f(0).alias("id"), f(1).alias("name"), f(2).alias("note"))


@query("SELECT p_brand AS run_id, 5000 - CAST(p_size AS BIGINT) AS ms, CAST(p_partkey AS INTEGER) AS cx, p_size AS cy FROM part")
def reset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.collect_list(F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))).alias("c"))
    run = F.concat(F.concat_ws(" ", F.lit("RUN"), "p_brand", (5000 - F.col("p_size")).cast("string"), F.size("c").cast("string")), F.lit("\nC "), F.array_join("c", ";"))
    docs = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_size", run.alias("run")))).alias("r"))  # a file for each brand, newest run first
    text = F.concat(F.lit("MMRESETS\n"), F.array_join(F.transform("r", lambda x: x["run"]), "\n"), F.lit("\nEND "), F.size("r").cast("string"))
    return files.read_reset_runs(spark, lines_in_files(docs.select(F.substring("p_brand", 7, 9).alias("g"), text.alias("value")), "value", "g"))


@query("SELECT c_name AS name, CAST(c_custkey % 4 AS INTEGER) AS idx, c_custkey % 3 = 0 AS online, CAST(c_custkey * 7 AS BIGINT) AS x FROM customer")
def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), (k % 4).cast("int").alias("idx"), (k % 3 == 0).alias("online"), (k * 7).alias("x"))
    path = new_folder(c)
    files.write_registry(c, path, ["name", "idx"], "online")
    return files.read_registry(spark, path, "name string, idx int, online boolean, x long", "online")


@query("SELECT sha256(string_agg('{ id = ' || p_partkey || ', brand = \"' || p_brand || '\" },', chr(10) ORDER BY p_partkey) || chr(10)) AS digest, count(*) AS n FROM part")
def generated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").repartition(7)
    path = new_folder(p)
    line = F.concat(F.lit("{ id = "), F.col("p_partkey").cast("string"), F.lit(', brand = "'), F.col("p_brand"), F.lit('" },'))
    files.write_sorted_lines(p, path, ["p_partkey"], line)
    return spark.read.text(path, wholetext=True).select(F.sha2("value", 256).alias("digest"), (F.size(F.split("value", "\n")) - 1).cast("long").alias("n"))
