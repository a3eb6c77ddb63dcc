"""Queries over filters, predicates, searches and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.spatial import bucketed, clip_segment, outside_circle, point_segment_d2, rect_distance2, split_at_grid
from tessera.plans.base import query
from tessera.sources.tables import points, probes, rects, segments, table, vertices, with_views

D2 = "(x-512)*(x-512)+(y-512)*(y-512)"


def nearest_matching(df: DataFrame, name: str, text: str, x: int, y: int, n: int, tie: list[str]) -> DataFrame:
    """Rows whose name holds a text, whatever its case, nearest first: a literal match, so no character is special."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return df.filter(F.contains(F.lower(name), F.lit(text.strip().lower()))).withColumn("d2", d2).orderBy("d2", *tie).limit(n)


@query(with_views(f"SELECT id, name, x, y, {D2} AS d2 FROM v_rect WHERE contains(lower(name), 'ed') ORDER BY d2, id LIMIT 30", "v_rect"))
def search_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_matching(rects(spark, sf_dir).select("id", "name", "x", "y"), "name", " ED ", 512, 512, 30, ["id"])


@query(with_views(f"SELECT * FROM (SELECT 'street' AS kind, id, name AS label, {D2} AS d2 FROM v_rect WHERE contains(lower(name), 'e') ORDER BY d2, id LIMIT 40) a UNION ALL SELECT * FROM (SELECT 'place', s_suppkey, s_name, (x-512)*(x-512)+(y-512)*(y-512) AS d2 FROM supplier JOIN v_point ON s_suppkey = id WHERE contains(lower(s_name), '1') ORDER BY d2, s_suppkey LIMIT 30) b UNION ALL SELECT * FROM (SELECT 'area', CAST(n_nationkey AS BIGINT), n_name, CAST(n_nationkey AS BIGINT)*CAST(n_nationkey AS BIGINT) AS d2 FROM nation ORDER BY d2, n_nationkey LIMIT 30) c", "v_rect", "v_point"))
def search_union_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = nearest_matching(rects(spark, sf_dir), "name", "e", 512, 512, 40, ["id"]).select(F.lit("street").alias("kind"), "id", F.col("name").alias("label"), "d2")
    s = table(spark, sf_dir, "supplier").join(points(spark, sf_dir), F.col("s_suppkey") == F.col("id"))
    b = nearest_matching(s, "s_name", "1", 512, 512, 30, ["id"]).select(F.lit("place").alias("kind"), "id", F.col("s_name").alias("label"), "d2")
    k = F.col("n_nationkey").cast("long")
    c = table(spark, sf_dir, "nation").select(F.lit("area").alias("kind"), k.alias("id"), F.col("n_name").alias("label"), (k * k).alias("d2")).orderBy("d2", "id").limit(30)
    return a.unionByName(b).unionByName(c)


@query("SELECT o_orderkey, CAST(floor(CAST(regexp_extract_all(q, '[0-9]+')[1] AS DOUBLE)) AS BIGINT) AS x, CAST(floor(CAST(regexp_extract_all(q, '[0-9]+')[2] AS DOUBLE)) AS BIGINT) AS y FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey || ', ' || o_custkey WHEN 1 THEN o_orderkey || ';' || o_custkey || ';' ELSE o_orderpriority || ' ' || o_orderkey END AS q FROM orders) t WHERE o_orderkey % 3 <> 2")
def coord_query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    q = F.when(F.col("o_orderkey") % 3 == 0, F.concat(k, F.lit(", "), c)).when(F.col("o_orderkey") % 3 == 1, F.concat(k, F.lit(";"), c, F.lit(";"))).otherwise(F.concat("o_orderpriority", F.lit(" "), k))
    return o.select("o_orderkey", S.parse_coords(q).alias("p")).filter("p IS NOT NULL").select("o_orderkey", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query(with_views("SELECT id, x, y, w, h, cat FROM v_rect WHERE x < 600 AND 200 < x + w AND y < 700 AND 300 < y + h", "v_rect"))
def rect_range_halfopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings_in(rects(spark, sf_dir), 200, 300, 400, 400).select("id", "x", "y", "w", "h", "cat")


def buildings_in(df: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Half-open boxes that meet a half-open box: an edge that only touches does not count."""
    return df.filter((F.col("x") < x + w) & (F.col("x") + F.col("w") > x) & (F.col("y") < y + h) & (F.col("y") + F.col("h") > y))


@query(with_views("SELECT DISTINCT p.id, p.x, p.y FROM v_point p WHERE EXISTS (SELECT 1 FROM v_rect r WHERE greatest(r.x - p.x, 0, p.x - (r.x + r.w)) * greatest(r.x - p.x, 0, p.x - (r.x + r.w)) + greatest(r.y - p.y, 0, p.y - (r.y + r.h)) * greatest(r.y - p.y, 0, p.y - (r.y + r.h)) <= 144)", "v_rect", "v_point"))
def point_rect_distance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = bucketed(p, F.col("x") - 12, F.col("y") - 12, F.col("x") + 12, F.col("y") + 12, 64)
    r = bucketed(rects(spark, sf_dir).select(F.col("x").alias("rx"), F.col("y").alias("ry"), "w", "h"), F.col("rx"), F.col("ry"), F.col("rx") + F.col("w"), F.col("ry") + F.col("h"), 64)
    hit = near.join(r, ["__bx", "__by"]).filter(rect_distance2(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"), F.col("w"), F.col("h")) <= 144)
    return hit.select("id", "x", "y").distinct()


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#23', 'Brand#3')")
def category_disable_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").filter(S.csv_set_lacks(F.col("p_brand"), "Brand#11, Brand#23,,Brand#3"))


@query(with_views("SELECT street, pos, x, y, contains(n, '7') OR (CAST(floor(x*2+0.5) AS BIGINT) || ':' || CAST(floor(y*2+0.5) AS BIGINT)) IN ('74:182', '6000:9000') AS railroad FROM (SELECT *, 'street ' || street AS n FROM v_vertex) t WHERE pos = 1", "v_vertex"))
def railroad_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir).filter("pos = 1")
    sign = F.concat_ws(":", S.half_units(F.col("x")).cast("string"), S.half_units(F.col("y")).cast("string"))
    return v.withColumn("railroad", F.contains(F.concat(F.lit("street "), F.col("street").cast("string")), F.lit("7")) | sign.isin("74:182", "6000:9000"))


@query("SELECT event_id, event_type, CASE WHEN value > 60 THEN 'open' WHEN user_id % 3 = 0 THEN 'mine' WHEN user_id % 3 = 1 AND value > 20 THEN 'ally' ELSE 'hidden' END AS shown FROM events")
def visibility_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id") % 3
    shown = F.when(F.col("value") > 60, "open").when(u == 0, "mine").when((u == 1) & (F.col("value") > 20), "ally").otherwise("hidden")
    return e.select("event_id", "event_type", shown.alias("shown"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, (CASE WHEN l_quantity < 5 THEN 'short,' ELSE '' END) || (CASE WHEN l_discount > 0.08 THEN 'wide,' ELSE '' END) || (CASE WHEN l_tax > 0.06 THEN 'steep,' ELSE '' END) AS reasons, l_quantity >= 5 AND l_discount <= 0.08 AND l_tax <= 0.06 AS accepted FROM lineitem")
def multi_reason_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = F.array(F.when(F.col("l_quantity") < 5, "short"), F.when(F.col("l_discount") > 0.08, "wide"), F.when(F.col("l_tax") > 0.06, "steep"))
    failed = F.array_compact(gates)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array_join(F.transform(failed, lambda x: F.concat(x, F.lit(","))), "").alias("reasons"), (F.size(failed) == 0).alias("accepted"))


@query(with_views("SELECT street, count(*) AS n FROM v_vertex GROUP BY street HAVING count(*) >= 2 AND max(x) < 16448 AND min(x) >= 0", "v_vertex"))
def valid_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir).groupBy("street").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("pts"))
    good = (F.size("pts") >= 2) & F.forall("pts", lambda p: (p["x"] >= 0) & (p["x"] < 16448))
    return v.filter(good).select("street", F.size("pts").cast("long").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_type = 'SMALL PLATED COPPER' THEN 'paved' WHEN starts_with(p_type, 'STANDARD') THEN 'gravel' WHEN starts_with(p_type, 'SMALL') THEN 'dirt' ELSE 'unknown' END AS surface FROM part")
def surface_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.by_name(F.col("p_type"), {"SMALL PLATED COPPER": "paved"}, [("STANDARD", "gravel"), ("SMALL", "dirt")], "unknown").alias("surface"))


@query("SELECT event_id, CAST(floor(value*2+0.5) AS BIGINT) AS half, CAST(floor(value*4+0.5) AS DOUBLE)/4 AS quarter FROM events")
def quantised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.half_units(F.col("value")).cast("long").alias("half"), S.quarter_units(F.col("value")).alias("quarter"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'cleared' WHEN o_custkey % 2 = 0 THEN 'refreshed' ELSE 'visited' END AS state, o_orderstatus <> 'F' AS relevant, o_totalprice BETWEEN 1000 AND 400000 AS in_bounds FROM orders")
def mark_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_totalprice") >= 300000, "cleared").when(F.col("o_custkey") % 2 == 0, "refreshed").otherwise("visited")
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), (F.col("o_orderstatus") != "F").alias("relevant"), F.col("o_totalprice").between(1000, 400000).alias("in_bounds"))


@query("SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, CASE WHEN o_orderstatus = 'F' THEN false ELSE true END AS flag, coalesce(try_cast(o_orderstatus AS DOUBLE), 1.5) AS factor FROM orders")
def policy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.coerce(F.substring("o_orderpriority", 1, 1), "integer", 0).alias("level"), S.coerce(F.when(F.col("o_orderstatus") == "F", " No ").otherwise("maybe"), "boolean", True).alias("flag"), S.coerce(F.col("o_orderstatus"), "number", 1.5).alias("factor"))


_CLIP = """SELECT street, seg, round(x1 + t0*(x2-x1), 6) AS cx1, round(y1 + t0*(y2-y1), 6) AS cy1, round(x1 + t1*(x2-x1), 6) AS cx2, round(y1 + t1*(y2-y1), 6) AS cy2 FROM (
SELECT *, greatest(0.0, CASE WHEN dx = 0 THEN 0.0 ELSE least((4000-x1)/dx, (9000-x1)/dx) END, CASE WHEN dy = 0 THEN 0.0 ELSE least((3000-y1)/dy, (8000-y1)/dy) END) AS t0,
 least(1.0, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((4000-x1)/dx, (9000-x1)/dx) END, CASE WHEN dy = 0 THEN 1.0 ELSE greatest((3000-y1)/dy, (8000-y1)/dy) END) AS t1
 FROM (SELECT *, CAST(x2-x1 AS DOUBLE) AS dx, CAST(y2-y1 AS DOUBLE) AS dy FROM v_segment) a WHERE (dx <> 0 OR x1 BETWEEN 4000 AND 9000) AND (dy <> 0 OR y1 BETWEEN 3000 AND 8000)) b WHERE t0 <= t1"""


@query(with_views(_CLIP, "v_segment"))
def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clip_segment(segments(spark, sf_dir), 4000, 3000, 9000, 8000)
    return c.select("street", "seg", *[F.round(k, 6).alias(k) for k in ("cx1", "cy1", "cx2", "cy2")])


_SPLITS = """SELECT pieces, count(*) AS n FROM (SELECT street, seg, 1 + count(DISTINCT t) AS pieces FROM (
SELECT street, seg, round((i * 300 - x1) / CAST(x2 - x1 AS DOUBLE), 9) AS t FROM v_segment, LATERAL (SELECT unnest(range(least(x1, x2) // 300 + 1, greatest(x1, x2) // 300 + 1)) AS i) q WHERE i * 300 > least(x1, x2) AND i * 300 < greatest(x1, x2)
UNION ALL SELECT street, seg, round((i * 300 - y1) / CAST(y2 - y1 AS DOUBLE), 9) FROM v_segment, LATERAL (SELECT unnest(range(least(y1, y2) // 300 + 1, greatest(y1, y2) // 300 + 1)) AS i) q WHERE i * 300 > least(y1, y2) AND i * 300 < greatest(y1, y2)
UNION ALL SELECT street, seg, NULL FROM v_segment) c GROUP BY street, seg) d GROUP BY pieces"""


@query(with_views(_SPLITS, "v_segment"))
def grid_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_at_grid(segments(spark, sf_dir)).groupBy((F.size("ts") - 1).alias("pieces")).agg(F.count(F.lit(1)).alias("n"))


_ERASED = """, q AS (SELECT *, CAST((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) AS DOUBLE) AS a, 2.0*((x1-8000)*(x2-x1)+(y1-8000)*(y2-y1)) AS b, CAST((x1-8000)*(x1-8000)+(y1-8000)*(y1-8000)-810000 AS DOUBLE) AS c FROM v_segment),
t AS (SELECT *, b*b-4*a*c AS disc, least(greatest((-b-sqrt(greatest(b*b-4*a*c, 0.0)))/(2*a), 0.0), 1.0) AS i, least(greatest((-b+sqrt(greatest(b*b-4*a*c, 0.0)))/(2*a), 0.0), 1.0) AS o FROM q)
SELECT street, seg, piece, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM (SELECT street, seg, 0 AS piece, 0.0 AS t0, 1.0 AS t1 FROM t WHERE disc <= 0 OR i >= o UNION ALL SELECT street, seg, 0, 0.0, i FROM t WHERE NOT (disc <= 0 OR i >= o) UNION ALL SELECT street, seg, 1, o, 1.0 FROM t WHERE NOT (disc <= 0 OR i >= o)) u WHERE t1 > t0"""


@query(with_views(_ERASED, "v_segment"))
def erased_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outside_circle(segments(spark, sf_dir), 8000, 8000, 900)
    return out.select("street", "seg", "piece", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


@query("SELECT s_suppkey, least(x-300, x+300, y-300) AS x0, greatest(x-300, x+300, y) AS x1, round(0.5*x - 0.25*y + 16, 6) AS sx, round(0.25*x + 0.5*y - 8, 6) AS sy FROM (SELECT s_suppkey, (s_suppkey*53+s_nationkey*17)%1024 AS x, (s_suppkey*29+s_nationkey*41)%1024 AS y FROM supplier) t")
def viewport_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return points(spark, sf_dir).select(F.col("id").alias("s_suppkey"), F.least(x - 300, x + 300, y - 300).alias("x0"), F.greatest(x - 300, x + 300, y).alias("x1"), F.round(0.5 * x - 0.25 * y + 16, 6).alias("sx"), F.round(0.25 * x + 0.5 * y - 8, 6).alias("sy"))


@query("SELECT c_custkey, upper(sha256(c_name)) AS code, replace(replace(c_name, '%', '%25'), '#', '%23') AS escaped, regexp_replace(c_name, '[^A-Za-z0-9._-]', '_', 'g') AS token, len(string_split(c_name, '#')) AS fields FROM customer")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.upper(F.sha2("c_name", 256)).alias("code"), S.percent_escape(F.col("c_name"), "%#").alias("escaped"), S.safe_token(F.col("c_name")).alias("token"), F.size(S.split_fields(F.col("c_name"), "#")).cast("long").alias("fields"))


@query("SELECT c_custkey, c_name AS back, true AS same FROM customer")
def text_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", S.from_utf16_hex(S.utf16_hex(n)).alias("back"), (S.percent_unescape(S.percent_escape(n, "%# C"), "%# C") == n).alias("same"))


@query("SELECT doc_id, CASE WHEN n_chars < 1000 THEN CAST(n_chars AS VARCHAR) || ' m' ELSE printf('%.1f', round(n_chars/1000.0, 1)) || ' km' END AS label FROM documents")
def distance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.distance_label(F.col("n_chars")).alias("label"))


@query()
def name_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.slug("text").alias("slug"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey & 4) <> 0 AS bit2, (l_partkey | l_suppkey) AS joined FROM lineitem")
def bit_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.has_bit(F.col("l_partkey"), 2).alias("bit2"), F.col("l_partkey").bitwiseOR(F.col("l_suppkey")).alias("joined"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts)//1000 AS ms FROM events")
def json_and_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query(with_views("SELECT id, round(sqrt(min((x1+t*(x2-x1)-x)*(x1+t*(x2-x1)-x)+(y1+t*(y2-y1)-y)*(y1+t*(y2-y1)-y))), 6) AS d FROM (SELECT p.id, p.x, p.y, s.*, CASE WHEN n = 0 THEN 0.0 ELSE least(greatest(((x-x1)*dx+(y-y1)*dy)/n, 0.0), 1.0) END AS t FROM v_point p CROSS JOIN (SELECT 0.0 AS x1, 0.0 AS y1, 900.0 AS x2, 500.0 AS y2, 900.0 AS dx, 500.0 AS dy, 1060000.0 AS n UNION ALL SELECT 900.0, 500.0, 1000.0, 20.0, 100.0, -480.0, 240400.0) s) q GROUP BY id", "v_point"))
def distance_to_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = [(0.0, 0.0, 900.0, 500.0), (900.0, 500.0, 1000.0, 20.0)]
    d2 = [point_segment_d2(F.col("x"), F.col("y"), *map(F.lit, r)) for r in route]
    return points(spark, sf_dir).select("id", F.round(F.sqrt(F.least(*d2)), 6).alias("d"))


@query(with_views("SELECT id, x, y FROM v_probe WHERE x BETWEEN 2000 AND 9000 AND y BETWEEN 1000 AND 12000", "v_probe"))
def world_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes(spark, sf_dir).filter(F.col("x").between(2000, 9000) & F.col("y").between(1000, 12000))
