"""Queries over ordered sequences, top-k, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import sequence as Q
from tessera.operators.state import retained
from tessera.plans.base import query
from tessera.sources.tables import observations, rects, segments, table, vertices, with_views



@query(with_views("SELECT street, seg, x1, y1, x2, y2 FROM v_segment", "v_segment"))
def vertex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir)


@query("SELECT l_suppkey, s AS start, max(e) AS \"end\", count(*) AS n FROM (SELECT *, min(a) OVER (PARTITION BY l_suppkey, g) AS s FROM (SELECT *, sum(nw) OVER (PARTITION BY l_suppkey ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a <= max(e) OVER (PARTITION BY l_suppkey ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM (SELECT l_suppkey, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem) t) u) v) w GROUP BY l_suppkey, g, s")
def coalesce_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return Q.merge_intervals(Q.dealt(t, ["l_suppkey"]), ["l_suppkey"], "start", "end")


@query("SELECT cat, a AS start, a + 1 AS stop FROM (SELECT DISTINCT p_brand AS cat, p_partkey % 997 + i AS a FROM part, range(0, 40) r(i) WHERE i < 1 + p_size) t WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = t.cat AND q.p_partkey % 2 = 0 AND t.a >= (q.p_partkey * 7) % 997 AND t.a < (q.p_partkey * 7) % 997 + q.p_size % 7)")
def interval_subtract_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    spans = p.select(F.col("p_brand").alias("cat"), (k % 997).alias("start"), (k % 997 + F.least(F.col("p_size") + 1, F.lit(40))).alias("end"))
    cover = p.filter(k % 2 == 0).select(F.col("p_brand").alias("cat"), (k * 7 % 997).alias("start"), (k * 7 % 997 + F.col("p_size") % 7).alias("end"))
    left = Q.subtract_intervals(spans, cover, ["cat"], "start", "end")
    return left.select("cat", F.explode(F.sequence("start", F.col("end") - 1)).alias("start")).select("cat", "start", (F.col("start") + 1).alias("stop"))


@query(with_views("SELECT cat, y, h, min(x) AS x, sum(w) AS w FROM (SELECT *, sum(nw) OVER (PARTITION BY cat, y, h ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN lag(x + w) OVER (PARTITION BY cat, y, h ORDER BY x) = x THEN 0 ELSE 1 END AS nw FROM (SELECT DISTINCT cat, x // 8 * 8 AS x, y // 8 * 8 AS y, CAST(8 AS BIGINT) AS w, CAST(8 AS BIGINT) AS h FROM v_rect) t) u) v GROUP BY cat, y, h, g", "v_rect"))
def rect_coalesce_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir).select("cat", (F.floor(F.col("x") / 8) * 8).alias("x"), (F.floor(F.col("y") / 8) * 8).alias("y"), F.lit(8).cast("long").alias("w"), F.lit(8).cast("long").alias("h")).distinct()
    return Q.coalesce_adjacent(r, ["cat"], ["y", "h"], "x", "w")


@query()
def rect_coalesce_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir).select("cat", (F.floor(F.col("x") / 8) * 8).alias("x"), (F.floor(F.col("y") / 8) * 8).alias("y"), F.lit(8).cast("long").alias("w"), F.lit(8).cast("long").alias("h"))
    return Q.coalesce_rects(r, ["cat"])


@query("SELECT seq, usr, last_value(m IGNORE NULLS) OVER (PARTITION BY usr ORDER BY seq ROWS BETWEEN 16 PRECEDING AND CURRENT ROW) AS carried FROM (SELECT event_id AS seq, user_id AS usr, CASE WHEN event_type = 'purchase' THEN value END AS m FROM events) t")
def carry_forward_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return Q.carry_forward(o, ["usr"], "seq", F.when(F.col("kind") == "purchase", F.col("value")), 16, "carried").select("seq", "usr", "carried")


@query("SELECT seq, usr, CASE WHEN bv IS NULL THEN av WHEN av IS NULL THEN bv WHEN seq - bs <= xs - seq THEN bv ELSE av END AS filled FROM (SELECT seq, usr, last_value(m IGNORE NULLS) OVER b AS bv, last_value(CASE WHEN m IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS bs, first_value(m IGNORE NULLS) OVER a AS av, first_value(CASE WHEN m IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS xs FROM (SELECT event_id AS seq, user_id AS usr, CASE WHEN event_type = 'purchase' THEN value END AS m FROM events) t WINDOW b AS (PARTITION BY usr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY usr ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) q")
def fill_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return Q.fill_nearest(o, ["usr"], "seq", "seq", F.when(F.col("kind") == "purchase", F.col("value")), "filled").select("seq", "usr", "filled")


@query(with_views("SELECT street, count(*) AS n, max(pos) - min(pos) + 1 = count(DISTINCT pos) AS contiguous FROM v_vertex GROUP BY street", "v_vertex"))
def sequence_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices(spark, sf_dir).groupBy("street").agg(F.count(F.lit(1)).alias("n"), (F.max("pos") - F.min("pos") + 1 == F.count_distinct("pos")).alias("contiguous"))


@query("SELECT usr, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT e.user_id AS usr, e.value AS v FROM events e JOIN (SELECT user_id, min(event_id) AS a FROM events WHERE value > 90 GROUP BY user_id) f ON e.user_id = f.user_id WHERE e.event_id >= f.a - 270 AND e.event_id < f.a - 2) t GROUP BY usr")
def anchored_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("usr")
    o = observations(spark, sf_dir).withColumn("anchor", F.min(F.when(F.col("value") > 90, F.col("seq"))).over(w))
    return o.filter((F.col("seq") >= F.col("anchor") - 270) & (F.col("seq") < F.col("anchor") - 2)).groupBy("usr").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT seq, usr, bucket FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY bucket, seq) AS r FROM (SELECT event_id AS seq, user_id AS usr, CASE WHEN value > 90 THEN 0 WHEN value > 50 THEN 1 ELSE 2 END AS bucket FROM events) t) q WHERE r <= 5")
def bucket_priority_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("value") > 90, 0).when(F.col("value") > 50, 1).otherwise(2)
    return Q.priority_fill(observations(spark, sf_dir).withColumn("bucket", b), "bucket", ["seq"], 5, ["usr"]).select("seq", "usr", "bucket")


@query("SELECT o_custkey, o_orderkey, running FROM (SELECT *, max(CASE WHEN running > 600000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS ov FROM (SELECT o_custkey, o_orderkey, sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders) t) q WHERE ov = 0")
def running_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.bround("o_totalprice").cast("long").alias("cost"))
    return Q.budget_prefix(o, ["o_custkey"], ["o_orderkey"], "cost", 600000).select("o_custkey", "o_orderkey", "running")


@query(with_views("SELECT id, x, y, cat FROM (SELECT *, row_number() OVER (PARTITION BY x // 32, y // 32 ORDER BY id) AS r FROM v_rect) t WHERE r = 1", "v_rect"))
def declutter_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir)
    w = Window.partitionBy(F.floor(F.col("x") / 32), F.floor(F.col("y") / 32)).orderBy("id")
    return r.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", "x", "y", "cat")


@query("SELECT c_name, c_custkey, c_acctbal, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY place LIMIT 200")
def multi_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "customer").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey"))).select("c_name", "c_custkey", "c_acctbal", "place")  # 200 rows


@query("SELECT seq, CASE WHEN n > 2000 THEN true ELSE false END AS truncated FROM (SELECT event_id AS seq, row_number() OVER (ORDER BY ts DESC, event_id) AS r, count(*) OVER () AS n FROM events) t WHERE n <= 2000 OR r <= 1800")
def retention_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(observations(spark, sf_dir), F.col("ts"), "seq", 2000, 1800).select("seq", "truncated")


@query("SELECT n_regionkey, n_nationkey, n_name, CASE WHEN rk IS NULL THEN slot ELSE k END AS new_slot FROM (SELECT a.*, b.slot AS k FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN rk IS NULL THEN 1 ELSE 0 END, rk, slot) AS i FROM (SELECT *, CAST(n_nationkey AS BIGINT) AS slot, CASE WHEN n_nationkey % 2 = 0 THEN length(n_name) END AS rk FROM nation) t) a LEFT JOIN (SELECT n_regionkey AS g, CAST(n_nationkey AS BIGINT) AS slot, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation WHERE n_nationkey % 2 = 0) b ON a.n_regionkey = b.g AND a.i = b.i AND a.rk IS NOT NULL) q")
def known_slot_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumns({"slot": F.col("n_nationkey").cast("long"), "rk": F.when(F.col("n_nationkey") % 2 == 0, F.length("n_name"))})
    return Q.reorder_known(n, "n_regionkey", "slot", "rk").select("n_regionkey", "n_nationkey", "n_name", "new_slot")


@query("SELECT p_brand, p_partkey, CAST((r - 1) // 64 AS INTEGER) AS part, CAST((r - 1) % 64 AS INTEGER) AS place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) t")
def batch_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.in_batches(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 64)


@query("SELECT s_suppkey, s_name, CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT) AS suffix FROM supplier ORDER BY suffix DESC LIMIT 50")
def suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.regexp_extract("s_name", r"([0-9]+)$", 1).cast("long").alias("suffix")).orderBy(F.desc("suffix")).limit(50)


_CAPPED = """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f(o_custkey, o_orderkey, o_totalprice, i, part, held) AS (SELECT o_custkey, o_orderkey, o_totalprice, i, 0, o_totalprice FROM o WHERE i = 1
 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.o_totalprice, o.i, CASE WHEN f.held + o.o_totalprice > 400000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.held + o.o_totalprice > 400000 THEN o.o_totalprice ELSE f.held + o.o_totalprice END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1)
SELECT o_custkey, o_orderkey, o_totalprice, part FROM f"""


@query(_CAPPED)
def size_capped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.size_capped_batches(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "o_totalprice", 400000)


@query("SELECT usr, seq, high FROM (SELECT *, lag(high) OVER (PARTITION BY usr ORDER BY seq) AS before FROM (SELECT user_id AS usr, event_id AS seq, value > 40 AS high, lead(value > 40, 1) OVER z AS h1, lead(value > 40, 2) OVER z AS h2 FROM events WINDOW z AS (PARTITION BY user_id ORDER BY event_id)) t WHERE h1 = high AND h2 = high) q WHERE before IS NULL OR before <> high")
def debounced_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).withColumn("high", F.col("value") > 40)
    return Q.debounced_changes(o, ["usr"], "seq", "high")


@query()
def reversal_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.drop_reversals(vertices(spark, sf_dir), ["street"], "pos", max_leg=24.0)


_GREEDY = """, b AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS i FROM v_rect),
near AS MATERIALIZED (SELECT b.i, coalesce(list(a.i) FILTER (WHERE a.i IS NOT NULL), []) AS earlier FROM b LEFT JOIN b a ON a.i < b.i AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h GROUP BY b.i),
taken(i, won) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT near.i, CASE WHEN list_has_any(near.earlier, taken.won) THEN taken.won ELSE list_append(taken.won, near.i) END FROM taken JOIN near ON near.i = taken.i + 1)
SELECT id, x, y, w, h FROM b WHERE i IN (SELECT unnest(won) FROM (SELECT won FROM taken ORDER BY i DESC LIMIT 1) t)"""


@query(with_views(_GREEDY, "v_rect").replace("WITH ", "WITH RECURSIVE ", 1))
def greedy_label_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.greedy_labels(rects(spark, sf_dir), [], ["id"]).select("id", "x", "y", "w", "h")


@query()
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.simplify_lines(vertices(spark, sf_dir), ["street"], "pos", 12.0)


@query("SELECT DISTINCT p_brand AS name, 'brand' AS src FROM part UNION ALL SELECT DISTINCT c_mktsegment, 'segment' FROM customer")
def union_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct().withColumn("src", F.lit("brand"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct().withColumn("src", F.lit("segment")))


@query("SELECT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 25")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).join(p, F.col("k") == F.col("p_partkey"), "left_anti").distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = lambda x: o.filter(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k"))
    return s("F").intersect(s("O"))


@query(with_views("SELECT cat, x, y, w, h, min(id) AS id FROM v_rect GROUP BY cat, x, y, w, h", "v_rect"))
def keep_first_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects(spark, sf_dir).groupBy("cat", "x", "y", "w", "h").agg(F.min("id").alias("id"))


@query(with_views("SELECT street, pos, x, y, round(coalesce(sum(d) OVER (PARTITION BY street ORDER BY pos ROWS UNBOUNDED PRECEDING), 0), 6) AS run FROM (SELECT *, sqrt(power(x - lag(x) OVER (PARTITION BY street ORDER BY pos), 2) + power(y - lag(y) OVER (PARTITION BY street ORDER BY pos), 2)) AS d FROM v_vertex) t", "v_vertex"))
def cumulative_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("street").orderBy("pos")
    d = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    v = vertices(spark, sf_dir).withColumn("d", d)
    return v.withColumn("run", F.round(F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), 6)).drop("d")
