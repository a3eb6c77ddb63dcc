"""Tables of a folder, and synthetic geometry, rooms, observations and frames derived from them.

The test tables hold no geometry. These views derive it by integer arithmetic, so that any engine gets the same numbers;
``SQL`` has each view as text for checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Size of the synthetic world of streets; rectangles and points are in its first 1,024 units.
WORLD = 16384
#: Roads cross each other: so many street ids share a block of ROAD_BLOCK x ROAD_DEPTH units, and blocks follow each other along x,
#: so there are as many crossings for each road in a table of any size.
ROAD_BLOCK, ROAD_DEPTH = 512, 768

SQL = {
    "v_rect": "SELECT p_partkey AS id, (p_partkey*37+p_size*101)%1024 AS x, (p_partkey*91+p_size*57)%1024 AS y, 1+p_size%16 AS w, 1+p_partkey%16 AS h, p_brand AS cat, p_name AS name FROM part",
    "v_point": "SELECT s_suppkey AS id, (s_suppkey*53+s_nationkey*17)%1024 AS x, (s_suppkey*29+s_nationkey*41)%1024 AS y FROM supplier",
    "v_probe": f"SELECT c_custkey AS id, (c_custkey*4241)%{WORLD} AS x, (c_custkey*1867)%{WORLD} AS y FROM customer",
    "v_vertex": f"SELECT l_orderkey AS street, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, (l_orderkey*37)%{WORLD} + l_partkey%64 AS x, (l_orderkey*91)%{WORLD} + (l_suppkey*37+l_linenumber*11)%64 AS y FROM lineitem",
    "v_segment": "SELECT * FROM (SELECT street, pos AS seg, x AS x1, y AS y1, lead(x) OVER (PARTITION BY street ORDER BY pos) AS x2, lead(y) OVER (PARTITION BY street ORDER BY pos) AS y2 FROM v_vertex) t WHERE x2 IS NOT NULL AND NOT (x1 = x2 AND y1 = y2)",
    "v_road_vertex": f"SELECT l_orderkey AS street, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, 512 + (l_orderkey//{ROAD_BLOCK})*{ROAD_BLOCK} + (l_orderkey*37)%{ROAD_BLOCK} + (l_linenumber-1)*((l_orderkey*7)%65-32) + l_partkey%7 AS x, 512 + (l_orderkey*91)%{ROAD_DEPTH} + (l_linenumber-1)*((l_orderkey*11)%57-28) + l_suppkey%7 AS y FROM lineitem",
    "v_road": "SELECT street, seg, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, CAST(4 + street % 3 AS DOUBLE) AS width, CASE WHEN (street + seg) % 7 = 0 THEN 'gravel' WHEN street % 5 = 0 THEN 'dirt' ELSE 'paved' END AS surface, street % 13 = 0 AS bridge, CASE WHEN street % 11 = 0 THEN CAST(1 + street % 15 AS INTEGER) END AS mask, street % 11 = 0 AND seg > 1 AS pin1, street % 11 = 0 AND more AS pin2 FROM (SELECT street, pos AS seg, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(x, 2) OVER w IS NOT NULL AS more FROM v_road_vertex WINDOW w AS (PARTITION BY street ORDER BY pos)) t WHERE x2 IS NOT NULL AND NOT (x1 = x2 AND y1 = y2)",
    "v_room": "SELECT l_partkey AS building, l_returnflag || l_linestatus AS room, CAST(l_linenumber % 3 - 1 AS BIGINT) AS level, CAST(1 + l_quantity AS BIGINT) AS w, CAST(1 + l_linenumber AS BIGINT) AS h, l_orderkey AS unit FROM lineitem",
    "v_obs": "SELECT event_id AS seq, user_id AS usr, ts, event_type AS kind, value FROM events",
}
_USES = {"v_segment": ("v_vertex",), "v_road": ("v_road_vertex",)}


def with_views(body: str, *names: str) -> str:
    """A SQL text with the named views as common table expressions."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_USES.get(n, ()), n) if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37 + F.col("p_size") * 101) % 1024).alias("x"), ((F.col("p_partkey") * 91 + F.col("p_size") * 57) % 1024).alias("y"),
        (F.col("p_size") % 16 + 1).cast("long").alias("w"), (F.col("p_partkey") % 16 + 1).alias("h"), F.col("p_brand").alias("cat"), F.col("p_name").alias("name"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 53 + F.col("s_nationkey") * 17) % 1024).alias("x"), ((F.col("s_suppkey") * 29 + F.col("s_nationkey") * 41) % 1024).alias("y"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("id"), (c * 4241 % WORLD).alias("x"), (c * 1867 % WORLD).alias("y"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.sequence import dealt

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dealt(table(spark, sf_dir, "lineitem"), ["l_orderkey"]).select(
        F.col("l_orderkey").alias("street"), F.row_number().over(order).alias("pos"),
        (F.col("l_orderkey") * 37 % WORLD + F.col("l_partkey") % 64).alias("x"), (F.col("l_orderkey") * 91 % WORLD + (F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11) % 64).alias("y"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.sequence import consecutive_pairs

    return consecutive_pairs(vertices(spark, sf_dir), ["street"], "pos", ["x", "y"]).select("street", F.col("pos").alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("next_x").alias("x2"), F.col("next_y").alias("y2")).filter(~((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))))


def road_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.sequence import dealt

    k, n = F.col("l_orderkey"), F.col("l_linenumber") - 1
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dealt(table(spark, sf_dir, "lineitem"), ["l_orderkey"]).select(
        k.alias("street"), F.row_number().over(order).alias("pos"),
        (512 + F.floor(k / ROAD_BLOCK) * ROAD_BLOCK + k * 37 % ROAD_BLOCK + n * (k * 7 % 65 - 32) + F.col("l_partkey") % 7).alias("x"), (512 + k * 91 % ROAD_DEPTH + n * (k * 11 % 57 - 28) + F.col("l_suppkey") % 7).alias("y"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a dense network of roads: (street, seg, x1, y1, x2, y2, width, surface, bridge, mask, pin1, pin2).

    A road with a mask is one that players drew: only those whose bit is set may use it, and its inner vertices are pinned.
    """
    v = road_vertices(spark, sf_dir)
    w = Window.partitionBy("street").orderBy("pos")
    s = v.select("street", F.col("pos").alias("seg"), F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), F.lead("x").over(w).cast("double").alias("x2"), F.lead("y").over(w).cast("double").alias("y2"), F.lead("x", 2).over(w).isNotNull().alias("more"))
    drawn = F.col("street") % 11 == 0
    surface = F.when((F.col("street") + F.col("seg")) % 7 == 0, "gravel").when(F.col("street") % 5 == 0, "dirt").otherwise("paved")
    return s.filter("x2 IS NOT NULL AND NOT (x1 = x2 AND y1 = y2)").select(
        "street", "seg", "x1", "y1", "x2", "y2", (4 + F.col("street") % 3).cast("double").alias("width"), surface.alias("surface"), (F.col("street") % 13 == 0).alias("bridge"),
        F.when(drawn, (1 + F.col("street") % 15).cast("int")).alias("mask"), (drawn & (F.col("seg") > 1)).alias("pin1"), (drawn & F.col("more")).alias("pin2"),
    )


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("building"), F.concat("l_returnflag", "l_linestatus").alias("room"), (F.col("l_linenumber") % 3 - 1).cast("long").alias("level"),
        (F.col("l_quantity") + 1).cast("long").alias("w"), (F.col("l_linenumber") + 1).cast("long").alias("h"), F.col("l_orderkey").alias("unit"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("usr"), "ts", F.col("event_type").alias("kind"), "value")
