"""Queries over joins, aggregates, graphs, routes and replicated state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import routing as R
from tessera.operators import spatial as P
from tessera.operators import state as T
from tessera.operators.graph import connected_components, stored
from tessera.plans.base import query
from tessera.sources.tables import observations, points, probes, rects, rooms, segments, table, vertices, with_views

def seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000


# ---------------------------------------------------------------- spatial joins

_BUCKETS = "SELECT a.*, gx, gy FROM (SELECT *, least(x1,x2) AS xa, greatest(x1,x2) AS xb, least(y1,y2) AS ya, greatest(y1,y2) AS yb FROM v_segment) a, LATERAL (SELECT unnest(range(xa//64, xb//64 + 1)) AS gx) p, LATERAL (SELECT unnest(range(ya//64, yb//64 + 1)) AS gy) q"
_SIDE = "sign((CAST({b}x2 AS DOUBLE)-{b}x1)*({a}y{i}-{b}y1)-(CAST({b}y2 AS DOUBLE)-{b}y1)*({a}x{i}-{b}x1))"


@query(with_views(f", bk AS ({_BUCKETS}) SELECT DISTINCT a.street AS street_a, a.seg AS seg_a, b.street AS street_b, b.seg AS seg_b FROM bk a JOIN bk b ON a.gx = b.gx AND a.gy = b.gy AND a.street < b.street WHERE {_SIDE.format(b='a.', a='b.', i=1)} * {_SIDE.format(b='a.', a='b.', i=2)} < 0 AND {_SIDE.format(b='b.', a='a.', i=1)} * {_SIDE.format(b='b.', a='a.', i=2)} < 0", "v_segment"))
def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.segment_crossings(segments(spark, sf_dir))


def _closed_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects(spark, sf_dir).select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w") - 1).alias("x2"), (F.col("y") + F.col("h") - 1).alias("y2"))


@query(with_views("SELECT a.id AS a, b.id AS b FROM v_rect a JOIN v_rect b ON a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h", "v_rect"))
def rect_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.meeting_boxes(_closed_rects(spark, sf_dir))


_RINGS = "CASE " + " ".join(f"WHEN kth <= {r * r} THEN {r}" for r in (16, 48, 96, 160, 640, 2560, 10240)) + " ELSE 40960 END"
_NEAREST = f""", s AS (SELECT p.id, p.x AS px, p.y AS py, v.*, least(greatest(((p.x-x1)*CAST(x2-x1 AS DOUBLE)+(p.y-y1)*CAST(y2-y1 AS DOUBLE))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 0.0), 1.0) AS t FROM v_probe p, v_segment v),
d AS (SELECT id, street, seg, round((x1+t*(x2-x1)-px)*(x1+t*(x2-x1)-px)+(y1+t*(y2-y1)-py)*(y1+t*(y2-y1)-py), 6) AS d2 FROM s),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, street, seg) AS rank FROM d) q WHERE rank <= 2),
k AS (SELECT id, max(d2) AS kth FROM r GROUP BY id)
SELECT r.id, street, seg, d2, CAST(rank AS INTEGER) AS rank, {_RINGS} AS ring FROM r JOIN k ON k.id = r.id"""


@query(with_views(_NEAREST, "v_segment", "v_probe"))
def nearest_k_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nearest_in_rings(probes(spark, sf_dir), segments(spark, sf_dir), 2)


@query("SELECT e.event_id, max(r.o_orderkey) AS run FROM events e JOIN orders r ON r.o_custkey = e.user_id AND r.o_orderdate <= e.ts + INTERVAL 0 DAY GROUP BY e.event_id, e.ts HAVING max(r.o_orderdate) <= e.ts")
def asof_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("usr"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("usr"), "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return running_max(e, o, ["usr"], "at", "o_orderkey").filter("o_orderkey IS NOT NULL").select("event_id", F.col("o_orderkey").alias("run"))


@query("SELECT seq, usr, s.start, s.cls FROM (SELECT event_id AS seq, user_id AS usr, event_id % 1000 AS pos FROM events) e ASOF JOIN (SELECT p_partkey % 7 AS cell, p_size * 20 AS start, min(p_brand) AS cls FROM part GROUP BY 1, 2) s ON e.usr % 7 = s.cell AND e.pos >= s.start")
def asof_run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 7).alias("cell"), (F.col("p_size") * 20).alias("start")).agg(F.min("p_brand").alias("cls"))
    e = observations(spark, sf_dir).select("seq", "usr", (F.col("seq") % 1000).alias("pos"), (F.col("usr") % 7).alias("cell"))
    return asof_join(e, runs, ["cell"], "pos", "start", ["cls"]).filter("start IS NOT NULL").select("seq", "usr", F.col("start").cast("int").alias("start"), "cls")


def running_max(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Each left row with the largest value of the right rows of its keys at or before its time: one union and one window."""
    one = left.withColumns({value: F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)})
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(right.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    return both.withColumn(value, F.max(value).over(w)).filter("__side = 1").drop("__side")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, values: list[str]) -> DataFrame:
    """Each left row with the right row of its keys that starts last at or before ``at``: one union and one window."""
    v = F.struct(F.col(start).alias("__s"), *values)
    one = left.select(*left.columns, F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType).alias("__v"), F.col(at).cast("double").alias("__at"), F.lit(1).alias("__side"))
    two = right.select(*[F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], v.alias("__v"), F.col(start).cast("double").alias("__at"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    got = one.unionByName(two).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return got.select(*left.columns, F.col("__v.__s").alias(start), *[F.col(f"__v.{c}").alias(c) for c in values])


_POLY = [(1, [(100, 100), (700, 150), (650, 600), (300, 400), (100, 100)]), (2, [(500, 500), (1000, 520), (900, 1000), (500, 500)])]


def _edge_sql(ring: list[tuple[int, int]]) -> str:
    return " + ".join(f"CASE WHEN (({b[1]} > y) <> ({a[1]} > y)) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1] - a[1]}.0) + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(ring[:-1], ring[1:], strict=True) if a[1] != b[1])


@query(with_views(" UNION ALL ".join(f"SELECT id, {i} AS poly FROM v_point WHERE ({_edge_sql(ring)}) % 2 = 1" for i, ring in _POLY), "v_point"))
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    polys = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in _POLY], "poly int, ring array<struct<x:double,y:double>>")
    ext = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    cells = P.bucketed(polys, ext(F.array_min, "x"), ext(F.array_min, "y"), ext(F.array_max, "x"), ext(F.array_max, "y"), 64)
    pts = P.bucketed(points(spark, sf_dir), F.col("x"), F.col("y"), F.col("x"), F.col("y"), 64)
    return pts.join(cells, ["__bx", "__by"]).filter(P.in_polygon(F.col("x").cast("double"), F.col("y").cast("double"), F.col("ring"))).select("id", "poly")


@query(with_views("SELECT cat, cx, cy, count(*) AS n FROM (SELECT cat, cx, cy FROM v_rect, LATERAL (SELECT unnest(range(x//8, (x+w-1)//8 + 1)) AS cx) p, LATERAL (SELECT unnest(range(y//8, (y+h-1)//8 + 1)) AS cy) q) t GROUP BY cat, cx, cy", "v_rect"))
def chunk_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.bucketed(rects(spark, sf_dir), F.col("x"), F.col("y"), F.col("x") + F.col("w") - 1, F.col("y") + F.col("h") - 1, 8)
    return r.groupBy("cat", F.col("__bx").cast("long").alias("cx"), F.col("__by").cast("long").alias("cy")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT a.id AS a, b.id AS b FROM v_rect a JOIN v_rect b ON a.id < b.id AND a.x*2+a.w >= b.x*2 AND a.x*2+a.w < (b.x+b.w)*2 AND a.y*2+a.h >= b.y*2 AND a.y*2+a.h < (b.y+b.h)*2 AND b.x*2+b.w >= a.x*2 AND b.x*2+b.w < (a.x+a.w)*2 AND b.y*2+b.h >= a.y*2 AND b.y*2+b.h < (a.y+a.h)*2", "v_rect"))
def same_building_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir).select("id", "x", "y", "w", "h", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    def centre_in(a: str, b: str):
        ok = F.lit(True)
        for p, s in (("x", "w"), ("y", "h")):
            c = F.col(f"{a}{p}") * 2 + F.col(f"{a}{s}")
            ok = ok & (c >= F.col(f"{b}{p}") * 2) & (c < (F.col(f"{b}{p}") + F.col(f"{b}{s}")) * 2)
        return ok
    return P.meeting_boxes(r, meet=lambda a, b: centre_in(a, b) & centre_in(b, a))


# ---------------------------------------------------------------- equi, anti and precedence joins


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def names_not_matched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.filter("p_size = 1").select("p_name").distinct()
    return p.select("p_partkey", "p_name").join(a, "p_name", "left_anti").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey", "p_name")


@query(with_views("SELECT id, x, y, rk FROM (SELECT *, min(rk) OVER (PARTITION BY x // 300, y // 300, cat) AS best FROM (SELECT id, x, y, cat, CAST(id % 5 AS BIGINT) AS rk FROM v_rect) t) q WHERE rk <= best", "v_rect"))
def map_priority_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir).select("id", "x", "y", "cat", (F.col("id") % 5).alias("rk"), F.floor(F.col("x") / 300).alias("cx"), F.floor(F.col("y") / 300).alias("cy"))
    return J.highest_owner(r, ["cx", "cy", "cat"], "rk").select("id", "x", "y", "rk")


@query("SELECT l_partkey, l_linenumber, l_orderkey, l_suppkey, coalesce(c.cat, 'other') AS cat FROM lineitem LEFT JOIN (SELECT * FROM (VALUES ('AF', 'home'), ('RF', 'shop'), ('NO', 'work')) t(room, cat)) c ON l_returnflag || l_linestatus = c.room")
def room_category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = spark.createDataFrame([("AF", "home"), ("RF", "shop"), ("NO", "work")], "room string, cat string")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("room"))
    return J.with_lookup(li, cats, ["room"], "cat", F.lit("other")).drop("room")


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'big' ELSE p_brand END AS p_brand, true AS applied FROM part")
def patch_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    patch = table(spark, sf_dir, "part").filter("p_size <= 10").select("p_partkey", F.lit("big").alias("p_brand"))
    return J.all_or_nothing(p, patch, ["p_partkey"], ["p_brand"])


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def ambiguous_lookup_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unambiguous(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("SELECT user_id AS usr, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS seq, true AS online FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0 UNION ALL SELECT user_id, max(event_id), false FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') = 0")
def offline_anti_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    live = o.filter("kind = 'purchase'").groupBy("usr").agg(F.max("seq").alias("seq"))
    return J.live_wins(live, o.groupBy("usr").agg(F.max("seq").alias("seq")), ["usr"])


@query("SELECT l_partkey, min_by(l_orderkey, (CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) * 1000000000 + l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey")
def precedence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return J.by_precedence(table(spark, sf_dir, "lineitem"), ["l_partkey"], rank, ["l_orderkey"])


@query("SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND CAST(s_acctbal AS BIGINT) % 50 = c_custkey % 50 OR s_suppkey = c_custkey")
def viewers_by_either_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(":", F.col("s_nationkey").cast("string"), (F.bround("s_acctbal").cast("long") % 50).cast("string")).alias("g1"), F.col("s_suppkey").alias("g2"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(":", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 50).cast("string")).alias("h1"), F.col("c_custkey").alias("h2"))
    return J.either_key(s, c, [("g1", "h1"), ("g2", "h2")], ["s_suppkey", "c_custkey"])


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE (s_nationkey = a.n_nationkey AND s_suppkey % 25 = b.n_nationkey) OR (s_nationkey = b.n_nationkey AND s_suppkey % 25 = a.n_nationkey))")
def exclusion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    pairs = n.select("n_regionkey", F.col("n_nationkey").alias("a")).join(n.select("n_regionkey", F.col("n_nationkey").alias("b")), "n_regionkey").filter("a <> b").select("a", "b")
    ex = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 25).cast("int").alias("b"))
    return J.without_pairs(pairs, ex, "a", "b")


# ---------------------------------------------------------------- aggregates


@query("SELECT event_type AS kind, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY event_type")
def summary_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(observations(spark, sf_dir), ["kind"], "value")


@query("SELECT kind, count(*) FILTER (WHERE v > 0) AS hits, round(sum(v) / (SELECT count(DISTINCT event_id // 50) FROM events), 6) AS amortised, round(median(v) FILTER (WHERE v > 0), 6) AS median_nonzero, round(count(*) FILTER (WHERE v > 0) * 1.0 / (SELECT count(DISTINCT event_id // 50) FROM events), 6) AS rate FROM (SELECT event_type AS kind, event_id // 50 AS f, sum(value) AS v FROM events GROUP BY 1, 2) t GROUP BY kind")
def phase_amortised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.amortised(observations(spark, sf_dir).withColumn("f", F.floor(F.col("seq") / 50)), ["kind"], "f", "value")


@query("SELECT k AS l_suppkey, sum(n) AS total, max(n) AS most, CASE WHEN max(n) >= 0.4 * sum(n) AND count(*) FILTER (WHERE n = m) = 1 THEN max(CASE WHEN n = m THEN c END) ELSE 'unknown' END AS cls FROM (SELECT *, max(n) OVER (PARTITION BY k) AS m FROM (SELECT l_suppkey AS k, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY 1, 2) t) q GROUP BY k")
def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dominant_class(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", 0.4)


@query("SELECT k AS l_partkey, c AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, c) AS r FROM (SELECT l_partkey AS k, l_shipdate AS d0, l_linestatus AS c, count(*) OVER (PARTITION BY l_partkey, l_linestatus) AS n FROM lineitem) t) q WHERE r = 1")
def class_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.class_mode(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_linestatus")


@query(with_views("SELECT cat, n, round(mx, 4) AS mx, round(my, 4) AS my, round((a+c)/2 + sqrt((a-c)/2*(a-c)/2 + b*b), 4) AS l1, round((a+c)/2 - sqrt((a-c)/2*(a-c)/2 + b*b), 4) AS l2, round(0.5 * atan2(2*b, a-c), 4) AS angle FROM (SELECT cat, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM v_rect GROUP BY cat) t", "v_rect"))
def principal_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.principal_axis(rects(spark, sf_dir), ["cat"], "x", "y")


@query(with_views("SELECT cat, count(*) AS bins, round(median(w), 6) AS median_width, round(quantile_cont(w, 0.95), 6) AS p95_width FROM (SELECT cat, x // 32 AS b, max(y) - min(y) AS w FROM v_rect GROUP BY 1, 2) t GROUP BY cat", "v_rect"))
def width_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.axis_profile(rects(spark, sf_dir), ["cat"], F.col("x"), F.col("y"), 32)


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) t WHERE r = 1")
def argbest_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_row(table(spark, sf_dir, "part"), ["p_brand"], [-F.col("p_size"), F.col("p_partkey")], ["p_partkey", "p_size"])


@query("SELECT p_brand, CAST(sum((((p_size % 2147483647) * 31 + p_partkey) % 2147483647 * 31 + CAST(round(p_retailprice * 100) AS BIGINT)) % 2147483647) % 2147483647 AS BIGINT) AS digest FROM part GROUP BY p_brand")
def digest_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.polynomial_digest(F.col("p_size").cast("long"), F.col("p_partkey"), F.round(F.col("p_retailprice") * 100).cast("long"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.pmod(F.sum(d), F.lit(S.DIGEST_MOD)).cast("long").alias("digest"))


@query("SELECT l_orderkey, CASE WHEN 2 * count(m) < count(*) THEN 4 ELSE CAST(floor(median(m) + 0.5) AS BIGINT) END AS width, max(l_linenumber) AS surface FROM (SELECT *, CASE WHEN l_quantity > 20 THEN l_quantity END AS m FROM lineitem) t GROUP BY l_orderkey")
def median_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when(F.col("l_quantity") > 20, F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(2 * F.count(m) < F.count(F.lit(1)), F.lit(4).cast("long")).otherwise(F.floor(F.median(m) + 0.5).cast("long")).alias("width"), F.max("l_linenumber").alias("surface"))


@query("SELECT least(l_partkey % 500, l_suppkey % 500) AS lo, greatest(l_partkey % 500, l_suppkey % 500) AS hi, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'unknown' END AS surface, min(l_quantity) AS width, bit_or(CAST(l_linenumber AS BIGINT)) AS mask, bool_and(l_linestatus = 'F') AS bridge, count(*) AS n FROM lineitem GROUP BY 1, 2")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("a"), (F.col("l_suppkey") % 500).alias("b"), F.col("l_returnflag").alias("surface"), F.col("l_quantity").alias("width"), F.col("l_linenumber").cast("long").alias("mask"), (F.col("l_linestatus") == "F").alias("bridge"))
    return A.merge_edges(e, "a", "b")


@query("SELECT c_mktsegment AS author, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY c_mktsegment")
def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("author")).agg(F.count(F.lit(1)).alias("n")).orderBy("author")


@query("SELECT n_nationkey, count(DISTINCT m) AS members FROM nation JOIN (SELECT s_nationkey AS k, s_suppkey AS m FROM supplier UNION SELECT c_nationkey, c_custkey FROM customer) t ON k = n_nationkey AND m <> n_nationkey GROUP BY n_nationkey")
def member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("m")).union(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"))
    return m.join(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey").filter("m <> n_nationkey").groupBy("n_nationkey").agg(F.count_distinct("m").alias("members"))


@query(with_views("SELECT cx, cy, count(DISTINCT cat) AS authors, string_agg(DISTINCT cat, ',' ORDER BY cat) AS who FROM (SELECT x // 64 AS cx, y // 64 AS cy, cat FROM v_rect) t GROUP BY cx, cy", "v_rect"))
def inverted_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir).select(F.floor(F.col("x") / 64).alias("cx"), F.floor(F.col("y") / 64).alias("cy"), "cat")
    return r.groupBy("cx", "cy").agg(F.count_distinct("cat").alias("authors"), F.array_join(F.sort_array(F.collect_set("cat")), ",").alias("who"))


@query(with_views("SELECT building, min(level) AS low, max(level) AS high, sum(w*h) AS area, max(w) AS widest FROM v_room GROUP BY building", "v_room"))
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms(spark, sf_dir).groupBy("building").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.sum(F.col("w") * F.col("h")).alias("area"), F.max("w").alias("widest"))


@query(with_views("SELECT building, level, area FROM (SELECT *, row_number() OVER (PARTITION BY building ORDER BY area DESC, level) AS r FROM (SELECT building, level, sum(w*h) AS area FROM v_room GROUP BY 1, 2) t) q WHERE r = 1", "v_room"))
def dominant_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = rooms(spark, sf_dir).groupBy("building", "level").agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    return A.best_row(per, ["building"], [-F.col("area"), F.col("level")], ["level", "area"])


_CATS = [("NO", "shop", 2, False), ("RF", "house", 1, True), ("AF", "office", 3, True)]


@query(with_views("SELECT building, cat, total AS area FROM (SELECT *, row_number() OVER (PARTITION BY building ORDER BY pr, cat) AS r FROM (SELECT v.building, c.cat, c.pr, c.acc, sum(w*h) AS part, max(t.total) AS total FROM v_room v JOIN (SELECT * FROM (VALUES ('NO','shop',2,false), ('RF','house',1,true), ('AF','office',3,true)) q(room,cat,pr,acc)) c ON v.room = c.room JOIN (SELECT building, sum(w*h) AS total FROM v_room GROUP BY building) t ON t.building = v.building GROUP BY 1, 2, 3, 4) u WHERE CASE WHEN cat = 'house' THEN total <= 4000 AND part >= 0.1 * total ELSE NOT acc OR part >= 0.1 * total END) z WHERE r = 1", "v_room"))
def building_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = spark.createDataFrame(_CATS, "room string, cat string, priority int, accessory boolean")
    return A.best_category(rooms(spark, sf_dir).select("building", "room", (F.col("w") * F.col("h")).alias("area")), cats, house_area=4000)


# ---------------------------------------------------------------- graphs


_OVERLAPS = "SELECT a.id AS a, b.id AS b FROM v_rect a JOIN v_rect b ON a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"
_REACH = "r(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node)"


@query(with_views(f", p AS ({_OVERLAPS}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), {_REACH} SELECT node, min(seen) AS component FROM r GROUP BY node", "v_rect").replace("WITH ", "WITH RECURSIVE ", 1))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = P.meeting_classes(_closed_rects(spark, sf_dir))  # sides are 1 at least, so equal boxes meet
    return connected_components(pairs.union(members), "ra", "rb")


@query(with_views(f", p AS (SELECT building AS a, min(building) OVER (PARTITION BY unit, room, w, h) AS b FROM v_room), e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b), {_REACH} SELECT q.building, coalesce(min(seen), q.building) AS component FROM (SELECT DISTINCT building FROM v_room) q LEFT JOIN r ON r.node = q.building GROUP BY q.building", "v_room").replace("WITH ", "WITH RECURSIVE ", 1))
def building_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = rooms(spark, sf_dir).select("building", "unit", "room", "w", "h")
    return A.group_by_shared(shared, "building", ["unit", "room", "w", "h"])


@query()
def street_graph_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contract_chains(R.build_edges(segments(spark, sf_dir))).select("a", "b", F.round("cost", 4).alias("cost"), "n")


@query()
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = stored(segments(spark, sf_dir))
    edges = R.build_edges(segs)
    ends = segs.groupBy("street").agg(F.min_by(F.struct("x1", "y1"), "seg").alias("s"), F.max_by(F.struct("x2", "y2"), "seg").alias("t"))
    key = lambda c, x, y: (F.floor(F.col(f"{c}.{x}") * 2 + 0.5) * F.lit(1 << 32) + F.floor(F.col(f"{c}.{y}") * 2 + 0.5))
    q = ends.select(F.col("street").alias("query"), key("s", "x1", "y1").alias("start"), key("t", "x2", "y2").alias("end")).filter("start <> end")
    return R.routes(q, edges).select("query", "cost", "hops")


@query()
def landmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(R.build_edges(segments(spark, sf_dir)))
    comps = stored(connected_components(edges.filter("a < b"), "a", "b"))  # every edge is there both ways
    return R.landmark_bounds(edges, R.extreme_nodes(edges, comps=comps), 1e6, comps=comps)


# ---------------------------------------------------------------- replicated state


@query("SELECT user_id AS usr, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_revision_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_revision(observations(spark, sf_dir), ["usr"], ["seq"]).select("usr", "seq", "value")


_ACCEPTED = """WITH RECURSIVE e AS (SELECT event_id AS seq, user_id AS usr, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
acc(seq, usr, t, rn) AS (SELECT seq, usr, t, rn FROM e WHERE rn = 1
 UNION ALL SELECT e.seq, e.usr, e.t, e.rn FROM (SELECT acc.usr, min(e.rn) AS rn FROM acc JOIN e ON e.usr = acc.usr AND e.t - acc.t >= 3600000000 GROUP BY acc.usr) n JOIN e ON e.usr = n.usr AND e.rn = n.rn)
SELECT seq, usr FROM acc"""


@query(_ACCEPTED)
def rate_limit_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rate_limited(observations(spark, sf_dir), ["usr"], seconds(), 3600).select("seq", "usr")


@query("SELECT usr, s AS session, count(*) AS n FROM (SELECT usr, sum(nw) OVER (PARTITION BY usr ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id AS seq, user_id AS usr, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000 THEN 1 ELSE 0 END AS nw FROM events) a) b GROUP BY usr, s")
def session_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sessions(observations(spark, sf_dir), ["usr"], seconds(), 86400).groupBy("usr", "session").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT usr, seq, max(k - i) OVER (PARTITION BY usr ORDER BY seq ROWS UNBOUNDED PRECEDING) + i AS sequence FROM (SELECT user_id AS usr, event_id AS seq, CAST(value AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) t")
def sequence_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).withColumn("now", F.bround("value").cast("long"))
    return T.monotone_sequence(o, ["usr"], "now", "seq").select("usr", "seq", "sequence")


@query("SELECT e.event_id AS seq, e.user_id AS usr FROM events e LEFT JOIN (SELECT o_custkey AS usr, max(o_orderkey) AS mark FROM orders GROUP BY o_custkey) m ON m.usr = e.user_id WHERE m.mark IS NULL OR e.event_id > m.mark")
def run_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("usr")).agg(F.max("o_orderkey").alias("watermark"))
    return T.after_watermark(observations(spark, sf_dir), mark, ["usr"], "seq").select("seq", "usr")


@query("SELECT seq, usr FROM (SELECT event_id AS seq, user_id AS usr, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS r FROM events) t WHERE r IS NULL OR seq > r")
def reupload_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reuploads(observations(spark, sf_dir), ["usr"], F.col("kind") == "signup", "seq").select("seq", "usr")


@query("SELECT usr, seq FROM (SELECT user_id AS usr, max(event_id) AS seq, arg_max(event_type, event_id) AS k FROM events GROUP BY user_id) t WHERE k <> 'error' UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def changelog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("usr"))
    ch = observations(spark, sf_dir).select("usr", "seq", (F.col("kind") == "error").alias("gone"))
    return T.apply_changes(snap, ch, ["usr"], "seq", "gone")


@query("SELECT k, on_, od, tn, td FROM (SELECT coalesce(a.k, b.k) AS k, a.n AS on_, a.d AS od, b.n AS tn, b.d AS td FROM (SELECT o_custkey AS k, count(*) AS n, CAST(sum(o_orderkey % 2147483647) % 2147483647 AS BIGINT) AS d FROM orders GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n, CAST(sum(o_orderkey % 2147483647) % 2147483647 AS BIGINT) AS d FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) b ON a.k = b.k) t WHERE NOT (on_ IS NOT DISTINCT FROM tn AND od IS NOT DISTINCT FROM td)")
def store_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    return T.reconcile(o, o.filter("o_orderstatus <> 'P'"), ["k"], S.polynomial_digest(F.col("o_orderkey"))).select("k", F.col("ours_n").alias("on_"), F.col("ours_digest").cast("long").alias("od"), F.col("theirs_n").alias("tn"), F.col("theirs_digest").cast("long").alias("td"))


@query("SELECT usr, seq FROM (SELECT user_id AS usr, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value >= 10) t WHERE r <= 4")
def origin_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.evict(observations(spark, sf_dir).filter("value >= 10"), ["usr"], F.col("ts"), 4).select("usr", "seq")


@query("SELECT DISTINCT user_id AS usr, event_type AS kind, event_id // 100 AS tick FROM events")
def chunk_event_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("usr", "kind", F.floor(F.col("seq") / 100).alias("tick")).distinct()


@query("SELECT usr, seq, CASE WHEN s * 100 >= 60 * seq_total THEN 'cleared' ELSE 'open' END AS state FROM (SELECT user_id AS usr, event_id AS seq, sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY user_id) AS seq_total FROM events) t")
def threshold_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("usr")
    s = F.sum(F.when(F.col("value") > 30, 1).otherwise(0)).over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return observations(spark, sf_dir).select("usr", "seq", F.when(s * 100 >= 60 * F.count(F.lit(1)).over(w), "cleared").otherwise("open").alias("state"))


_EDITS = """WITH RECURSIVE e AS (SELECT user_id AS usr, event_id AS seq, event_id % 4 AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f(usr, seq, expected, i, rev, accepted) AS (SELECT usr, seq, expected, i, CASE WHEN expected = 0 THEN 1 ELSE 0 END, expected = 0 FROM e WHERE i = 1
 UNION ALL SELECT e.usr, e.seq, e.expected, e.i, f.rev + CASE WHEN e.expected = f.rev THEN 1 ELSE 0 END, e.expected = f.rev FROM f JOIN e ON e.usr = f.usr AND e.i = f.i + 1)
SELECT usr, seq, expected, accepted FROM f"""


@query(_EDITS)
def itinerary_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select("usr", "seq", (F.col("seq") % 4).alias("expected"))
    return T.optimistic_updates(o, ["usr"], "seq", "expected")


@query("SELECT DISTINCT user_id AS usr, count(*) AS n, date_trunc('hour', ts) AS h FROM events GROUP BY user_id, date_trunc('hour', ts)")
def hourly_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("usr", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- exports


@query("SELECT n_regionkey, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation GROUP BY n_regionkey")
def grouped_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.files import grouped_json

    return grouped_json(table(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey", "n_name"], ["n_nationkey"])


@query()
def geojson_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.files import geojson_lines

    v = vertices(spark, sf_dir).groupBy("street").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    return v.select("street", geojson_lines(v, "pts", ["street"]).alias("feature"))
