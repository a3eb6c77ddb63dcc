"""Queries over lookups, polyline matching, outlines, checks of records, and both sides of replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import joins as J
from tessera.operators import matching as M
from tessera.operators import routing as R
from tessera.operators import sequence as Q
from tessera.operators import state as T
from tessera.operators.spatial import bucketed, point_segment_d2
from tessera.plans.base import query
from tessera.sources.tables import observations, points, rects, segments, table, vertices, with_views

# ---------------------------------------------------------------- lookups and repairs


@query("SELECT o_orderkey, f AS l_returnflag FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS f FROM lineitem GROUP BY 1 HAVING min(l_returnflag) = max(l_returnflag)) q ON l_orderkey = o_orderkey")
def ambiguous_lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return J.lookup_unless_ambiguous(o, flags, ["o_orderkey"], "l_returnflag")


@query("SELECT p_partkey, coalesce(t, p_type) AS label FROM part LEFT JOIN (SELECT p_type AS k, min(t) AS t FROM (SELECT p_type, 'T' || CAST(p_size % 9 // 3 AS VARCHAR) || p_type AS t FROM part WHERE p_size % 3 = 0) a GROUP BY 1 HAVING min(t) = max(t)) q ON k = p_type")
def translated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.select("p_type", F.concat(F.lit("src"), (F.col("p_size") % 3).cast("string")).alias("source"), F.concat(F.lit("T"), F.floor(F.col("p_size") % 9 / 3).cast("string"), F.col("p_type")).alias("text"))
    return J.translated(p.select("p_partkey", "p_type"), names, ["p_type"], "text", F.col("source") == "src0", F.col("p_type")).select("p_partkey", F.col("text").alias("label"))


_REPAIRS = """, st AS (SELECT street, list({'x': x, 'y': y} ORDER BY pos) AS pts, 4 + street % 3 AS width FROM v_vertex GROUP BY street),
op AS (SELECT street, list({'x': CASE WHEN street % 4 = 0 THEN x ELSE x + 1 END, 'y': y} ORDER BY pos) AS pin, 4 + street % 3 + CASE WHEN street % 8 = 0 THEN 1 ELSE 0 END AS w, list({'x': x, 'y': y} ORDER BY pos DESC) AS put FROM v_vertex WHERE street % 2 = 0 GROUP BY street)
SELECT st.street, op.street IS NOT NULL AS repaired, (CASE WHEN op.street IS NULL THEN st.pts ELSE op.put END)[1].x AS x0 FROM st LEFT JOIN op ON op.street = st.street AND op.w = st.width AND op.pin = st.pts"""


@query(with_views(_REPAIRS, "v_vertex"))
def pinned_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir).groupBy("street").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    pts = lambda dx: F.transform("p", lambda q: F.struct((q["x"] + dx).alias("x"), q["y"].alias("y")))
    width = 4 + F.col("street") % 3
    st = v.select("street", pts(F.lit(0)).alias("pts"), width.alias("width"))
    op = v.filter("street % 2 = 0").select("street", (width + F.when(F.col("street") % 8 == 0, 1).otherwise(0)).alias("pin_width"), pts(F.when(F.col("street") % 4 == 0, 0).otherwise(1)).alias("pin_pts"), F.reverse(pts(F.lit(0))).alias("new_pts"))
    return M.pinned_repair(st, op, ["street"], ["width", "pts"], "pts").select("street", "repaired", F.col("pts")[0]["x"].alias("x0"))


# ---------------------------------------------------------------- polylines and areas

_RUNS = """, r AS (SELECT street AS run, CASE WHEN street % 2 = 0 THEN 3 - pos ELSE pos - 2 END AS k, x + 0.25 AS x, y - 0.25 AS y FROM v_vertex WHERE street % 3 = 0 AND pos IN (2, 3) AND street IN (SELECT street FROM v_vertex WHERE pos = 3)),
h AS (SELECT r.run, v.street AS line, v.street % 5 = 0 AS named, v.pos - r.k AS f, v.pos + r.k AS b FROM r JOIN v_vertex v ON v.x = CAST(floor(r.x + 0.5) AS BIGINT) AND v.y = CAST(floor(r.y + 0.5) AS BIGINT)),
w AS (SELECT run, line, named, f AS start, false AS backward FROM h UNION ALL SELECT run, line, named, b, true FROM h),
g AS (SELECT run, line, named, start, backward FROM w GROUP BY ALL HAVING count(*) = 2)
SELECT run, line, start, backward FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY named DESC, line, backward, start) AS i FROM g) t WHERE i = 1"""


@query(with_views(_RUNS, "v_vertex"))
def subsequence_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir)
    r = v.filter((F.col("street") % 3 == 0) & F.col("pos").isin(2, 3)).join(v.filter("pos = 3").select("street"), "street", "left_semi")
    k = F.when(F.col("street") % 2 == 0, 3 - F.col("pos")).otherwise(F.col("pos") - 2)
    runs = r.select(F.col("street").alias("run"), k.alias("k"), F.lit(2).alias("m"), (F.col("x") + 0.25).alias("x"), (F.col("y") - 0.25).alias("y"))
    lines = v.select(F.col("street").alias("line"), "pos", "x", "y", (F.col("street") % 5 == 0).alias("named"))
    return M.match_runs(runs, lines).withColumn("start", F.col("start").cast("long"))


_ALONG = """, p AS (SELECT street AS ext, pos, x + 3 AS x, y + 2 AS y FROM v_vertex WHERE street % 2 = 1), s AS (SELECT *, CAST(x2 - x1 AS DOUBLE) AS dx, CAST(y2 - y1 AS DOUBLE) AS dy FROM v_segment),
c AS (SELECT p.ext, p.pos, s.street, x, y, x1, y1, x2, y2, least(greatest(((x-x1)*dx+(y-y1)*dy)/(dx*dx+dy*dy), 0.0), 1.0) AS t FROM p JOIN s ON p.x BETWEEN least(x1, x2) - 6 AND greatest(x1, x2) + 6 AND p.y BETWEEN least(y1, y2) - 6 AND greatest(y1, y2) + 6),
d AS (SELECT ext, pos, street, min((x1+t*(x2-x1)-x)*(x1+t*(x2-x1)-x)+(y1+t*(y2-y1)-y)*(y1+t*(y2-y1)-y)) AS d2 FROM c GROUP BY ALL),
f AS (SELECT ext, street, round(count(*) * 1.0 / n, 6) AS ratio, round(avg(sqrt(d2)), 6) AS mean FROM d JOIN (SELECT ext AS e, count(*) AS n FROM p GROUP BY 1) q ON e = ext WHERE d2 <= 36 GROUP BY ext, street, n HAVING count(*) * 2 >= n)
SELECT ext, street, ratio, mean FROM (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY ratio DESC, mean, street) AS i FROM f) t WHERE i = 1"""


@query(with_views(_ALONG, "v_segment"))
def overlap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vertices(spark, sf_dir).filter("street % 2 = 1").select(F.col("street").alias("ext"), "pos", (F.col("x") + 3).alias("x"), (F.col("y") + 2).alias("y"))
    return M.overlapping_lines(p, segments(spark, sf_dir))


_CELLS = "SELECT DISTINCT cat, x // 8 AS cx, y // 8 AS cy FROM v_rect"


@query(with_views(f", c AS ({_CELLS}), e AS (SELECT cat, 'h' AS side, cx AS ex, cy AS ey FROM c UNION ALL SELECT cat, 'h', cx, cy + 1 FROM c UNION ALL SELECT cat, 'v', cx, cy FROM c UNION ALL SELECT cat, 'v', cx + 1, cy FROM c) SELECT cat, side, ex, ey FROM e GROUP BY ALL HAVING count(*) = 1", "v_rect"))
def owner_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.outlines(rects(spark, sf_dir).select("cat", F.floor(F.col("x") / 8).alias("cx"), F.floor(F.col("y") / 8).alias("cy")), "cat")


@query(with_views("SELECT cat, id AS label_id, w * h AS area FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY w * h DESC, id) AS r FROM v_rect) t WHERE r = 1", "v_rect"))
def owner_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir).withColumn("area", F.col("w") * F.col("h"))
    return r.groupBy("cat").agg(F.min_by(F.struct(F.col("id").alias("label_id"), "area"), F.struct(-F.col("area"), "id")).alias("b")).select("cat", "b.*")


@query(with_views("SELECT cat, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2, sum(w * h) AS area FROM v_rect GROUP BY cat", "v_rect"))
def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = map(F.col, "xywh")
    return rects(spark, sf_dir).groupBy("cat").agg(F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x + w).alias("x2"), F.max(y + h).alias("y2"), F.sum(w * h).alias("area"))


_CUT = """, g AS (SELECT *, least(x1,x2)//64 AS gx1, greatest(x1,x2)//64 AS gx2, least(y1,y2)//64 AS gy1, greatest(y1,y2)//64 AS gy2 FROM (SELECT street, seg, CAST(x1 AS DOUBLE) AS u1, CAST(y1 AS DOUBLE) AS v1, CAST(x2 AS DOUBLE) AS u2, CAST(y2 AS DOUBLE) AS v2, x1, y1, x2, y2 FROM v_segment) q),
bk AS (SELECT g.*, gx, gy FROM g, LATERAL (SELECT unnest(range(gx1, gx2 + 1)) AS gx) p, LATERAL (SELECT unnest(range(gy1, gy2 + 1)) AS gy) r),
m AS (SELECT DISTINCT a.street AS sa, a.seg AS ga, b.street AS sb, b.seg AS gb, a.u1, a.v1, a.u2, a.v2, (b.u2-b.u1)*(a.v1-b.v1)-(b.v2-b.v1)*(a.u1-b.u1) AS ca, (b.u2-b.u1)*(a.v2-b.v1)-(b.v2-b.v1)*(a.u2-b.u1) AS cb, (a.u2-a.u1)*(b.v1-a.v1)-(a.v2-a.v1)*(b.u1-a.u1) AS ac, (a.u2-a.u1)*(b.v2-a.v1)-(a.v2-a.v1)*(b.u2-a.u1) AS ad FROM bk a JOIN bk b ON a.gx = b.gx AND a.gy = b.gy AND a.street < b.street),
k AS (SELECT *, round(u1 + ca/(ca-cb)*(u2-u1), 4) AS px, round(v1 + ca/(ca-cb)*(v2-v1), 4) AS py FROM m WHERE sign(ca)*sign(cb) < 0 AND sign(ac)*sign(ad) < 0),
c AS (SELECT sa AS street, ga AS seg, px, py FROM k UNION SELECT sb, gb, px, py FROM k),
v AS (SELECT street, seg, u1 AS x, v1 AS y, 0 AS o, 0.0 AS pl FROM g UNION ALL SELECT street, seg, u2, v2, 2, 0.0 FROM g UNION ALL SELECT street, seg, px, py, 1, (px-u1)*(u2-u1)+(py-v1)*(v2-v1) FROM c JOIN g USING (street, seg)),
w AS (SELECT street, seg, row_number() OVER z - 1 AS piece, x AS x1, y AS y1, lead(x) OVER z AS x2, lead(y) OVER z AS y2 FROM v WINDOW z AS (PARTITION BY street, seg ORDER BY o, pl, x, y))
SELECT street, seg, CAST(piece AS INTEGER) AS piece, x1, y1, x2, y2 FROM w WHERE x2 IS NOT NULL"""


@query(with_views(_CUT, "v_segment"))
def cut_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cut_at_crossings(segments(spark, sf_dir))


_FINDINGS = """SELECT 'single' AS kind, count(*) AS n FROM (SELECT street FROM v_vertex GROUP BY street HAVING count(*) = 1) a
UNION ALL SELECT 'short', count(*) FROM v_segment WHERE (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) < 9
UNION ALL SELECT 'revisit', count(*) FROM (SELECT street FROM v_vertex GROUP BY street, x, y HAVING count(*) > 1) b
UNION ALL SELECT 'shared', count(*) FROM (SELECT x, y FROM v_vertex GROUP BY x, y HAVING count(DISTINCT street) > 1) c"""


@query(with_views(_FINDINGS, "v_segment"))
def topology_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = vertices(spark, sf_dir), segments(spark, sf_dir)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    found = {
        "single": v.groupBy("street").agg(F.count(F.lit(1)).alias("n")).filter("n = 1"),
        "short": s.filter(dx * dx + dy * dy < 9),
        "revisit": v.groupBy("street", "x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "shared": v.groupBy("x", "y").agg(F.min("street").alias("a"), F.max("street").alias("b")).filter("a < b"),
    }
    out = None
    for kind, rows in found.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_ROAD = "(x * 7 + y * 13) % 101 < 2"
_AROUND = " OR ".join(f"((x + {i}) * 7 + (y + {j}) * 13) % 101 < 2" for i in (-1, 0, 1) for j in (-1, 0, 1))
_PARKING = f""", q AS (SELECT p_brand AS cat, v.x, v.y, v.w, v.h, p_size FROM v_rect v JOIN part ON p_partkey = v.id),
sq AS (SELECT cat, a AS x, b AS y FROM q, LATERAL (SELECT unnest(range(q.x + 1, q.x + 1 + w)) AS a) s, LATERAL (SELECT unnest(range(q.y + 1, q.y + 1 + h)) AS b) t),
n AS (SELECT cat, avg(CASE WHEN {_AROUND} THEN 1.0 ELSE 0.0 END) AS share FROM sq GROUP BY cat),
a AS (SELECT cat, CAST(sum(round_even(w * h / 15.0, 0)) AS BIGINT) AS cap, count(*) FILTER (WHERE p_size % 10 = 0) AS stripes, coalesce(sum(w * h) FILTER (WHERE p_size % 3 = 0), 0) AS wild, sum(w * h) AS floors FROM q GROUP BY cat)
SELECT cat, cap, round(share, 6) AS share, cap >= 3 AND (stripes > 0 OR cap >= 20) AND wild * 2 < greatest(1, floors) AND share < 0.5 AS parking FROM a JOIN n USING (cat)"""


@query(with_views(_PARKING, "v_rect"))
def parking_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    r = rects(spark, sf_dir).join(sizes, "id")
    squares = r.select("cat", F.explode(F.sequence(F.col("x") + 1, F.col("x") + F.col("w"))).alias("x"), "y", "h").select("cat", "x", F.explode(F.sequence(F.col("y") + 1, F.col("y") + F.col("h"))).alias("y"))
    side = 1100  # beyond every square and its surroundings
    road = spark.range(side * side).select((F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y")).filter(_ROAD)
    area = F.col("w") * F.col("h")
    per = r.groupBy("cat").agg(F.sum(F.bround(area / 15)).cast("long").alias("cap"), F.count_if(F.col("p_size") % 10 == 0).alias("stripes"), F.coalesce(F.sum(F.when(F.col("p_size") % 3 == 0, area)), F.lit(0)).alias("wild"), F.sum(area).alias("floors"))
    ok = (F.col("cap") >= 3) & ((F.col("stripes") > 0) | (F.col("cap") >= 20)) & (F.col("wild") * 2 < F.greatest(F.lit(1), "floors")) & (F.col("share") < 0.5)
    return per.join(M.near_share(squares, road, ["cat"]), "cat").select("cat", "cap", F.round("share", 6).alias("share"), ok.alias("parking"))


_PROGRESS = """, p AS (SELECT street, min(x) FILTER (WHERE pos = 1) + 20 AS px, min(y) FILTER (WHERE pos = 1) + 10 AS py, 1 + street % 5 AS near FROM v_vertex GROUP BY street),
d AS (SELECT s.street, s.seg, round((x1+t*(x2-x1)-px)*(x1+t*(x2-x1)-px)+(y1+t*(y2-y1)-py)*(y1+t*(y2-y1)-py), 6) AS d2 FROM (SELECT *, least(greatest(((px-x1)*dx+(py-y1)*dy)/(dx*dx+dy*dy), 0.0), 1.0) AS t FROM (SELECT v.*, px, py, near, CAST(x2-x1 AS DOUBLE) AS dx, CAST(y2-y1 AS DOUBLE) AS dy FROM v_segment v JOIN p USING (street)) a) s WHERE abs(seg - near) <= 2)
SELECT street, seg, round(sqrt(d2), 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY street ORDER BY d2, seg) AS r FROM d) q WHERE r = 1"""


@query(with_views(_PROGRESS, "v_segment"))
def route_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda c: F.min(F.when(F.col("pos") == 1, F.col(c)))
    p = vertices(spark, sf_dir).groupBy("street").agg((first("x") + 20).alias("px"), (first("y") + 10).alias("py")).withColumn("near", 1 + F.col("street") % 5)
    near = segments(spark, sf_dir).join(p, "street").filter(F.abs(F.col("seg") - F.col("near")) <= 2)
    d2 = F.round(point_segment_d2(*map(F.col, ("px", "py", "x1", "y1", "x2", "y2"))), 6)
    best = near.withColumn("d2", d2).groupBy("street").agg(F.min_by(F.struct("seg", "d2"), F.struct("d2", "seg")).alias("b"))
    return best.select("street", "b.seg", F.round(F.sqrt("b.d2"), 4).alias("dist"))


@query(with_views("SELECT street, count(*) AS n, round(max(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))), 6) AS longest, max(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) <= 60 AS valid FROM v_segment GROUP BY street", "v_segment"))
def segment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("d", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return s.groupBy("street").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("d"), 6).alias("longest"), (F.max("d") <= 60).alias("valid"))


@query(with_views("SELECT street, seg, round(d * CASE WHEN street % 4 = 1 THEN 1.05 WHEN street % 4 = 2 THEN 1.1 ELSE 1.0 END * CASE WHEN seg % 3 = 0 THEN 1.1 ELSE 1.0 END, 6) AS cost FROM (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS d FROM v_segment) t", "v_segment"))
def travel_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = F.when(F.col("street") % 4 == 1, "gravel").when(F.col("street") % 4 == 2, "dirt").otherwise("paved")
    s = segments(spark, sf_dir).withColumn("d", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return s.select("street", "seg", F.round(S.travel_cost(F.col("d"), surface, F.col("seg") % 3 == 0), 6).alias("cost"))


# ---------------------------------------------------------------- checks of records


@query(with_views("SELECT p.id, CASE WHEN r.id IS NULL THEN 'outside' WHEN r.id % 4 = 0 THEN 'all' WHEN r.id % 4 = 1 AND p.id % 2 = 0 THEN 'owner' WHEN r.id % 4 = 2 THEN 'group' ELSE 'hidden' END AS shown FROM v_point p LEFT JOIN (SELECT p.id AS pid, min(r.id) AS id FROM v_point p JOIN v_rect r ON p.x >= r.x - 8 AND p.x < r.x + r.w + 8 AND p.y >= r.y - 8 AND p.y < r.y + r.h + 8 GROUP BY p.id) r ON pid = p.id", "v_rect", "v_point"))
def first_rect_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, x, y = points(spark, sf_dir), F.col("x"), F.col("y")
    r = rects(spark, sf_dir).select(F.col("id").alias("rect"), (x - 8).alias("x1"), (y - 8).alias("y1"), (x + F.col("w") + 8).alias("x2"), (y + F.col("h") + 8).alias("y2"))
    inside = bucketed(p, x, y, x, y, 64).join(bucketed(r, *map(F.col, ("x1", "y1", "x2", "y2")), 64), ["__bx", "__by"]).filter("x >= x1 AND x < x2 AND y >= y1 AND y < y2")
    first = inside.groupBy("id").agg(F.min("rect").alias("rect"))
    mode = F.when(F.col("rect").isNull(), "outside").when(F.col("rect") % 4 == 0, "all").when((F.col("rect") % 4 == 1) & (F.col("id") % 2 == 0), "owner").when(F.col("rect") % 4 == 2, "group").otherwise("hidden")
    return p.join(first, "id", "left").select("id", mode.alias("shown"))


@query("SELECT o_custkey, CASE WHEN ch > 0 THEN 'cleared' WHEN rh > 0 THEN 'refreshed' ELSE 'visited' END AS state, ch > 0 OR seen > 1 AS relevant, round(open_n * 1.0 / seen, 6) AS progress FROM (SELECT o_custkey, count(*) AS seen, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 250000) AS ch, count(*) FILTER (WHERE o_orderstatus = 'P') AS rh, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_n FROM orders GROUP BY o_custkey) t")
def mark_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("seen"), F.count_if((s == "F") & (F.col("o_totalprice") > 250000)).alias("ch"), F.count_if(s == "P").alias("rh"), F.count_if(s == "O").alias("open_n"))
    return m.select("o_custkey", F.when(F.col("ch") > 0, "cleared").when(F.col("rh") > 0, "refreshed").otherwise("visited").alias("state"), ((F.col("ch") > 0) | (F.col("seen") > 1)).alias("relevant"), F.round(F.col("open_n") / F.col("seen"), 6).alias("progress"))


@query(r"""SELECT p_partkey, body, body IS NOT NULL AS fits FROM (SELECT p_partkey, CASE WHEN length(t) BETWEEN 1 AND 30 THEN replace(replace(t, '\', '\\'), '"', '\"') END AS body FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name || '"\' || p_brand END AS t FROM part) q) r""")
def json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat("p_name", F.lit('"\\'), "p_brand"))
    p = table(spark, sf_dir, "part").select("p_partkey", S.json_body(t, 30).alias("body"))
    return p.select("p_partkey", "body", F.coalesce(S.is_json_body(F.col("body")), F.lit(False)).alias("fits"))


@query("SELECT c_custkey, nullif(trim(t), '') AS name, length(trim(t)) <= 18 AS fits FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '   ' WHEN c_custkey % 5 = 1 THEN c_name || ' and more  ' ELSE '  ' || c_name || ' ' END AS t FROM customer) q")
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    t = F.when(k == 0, "   ").when(k == 1, F.concat("c_name", F.lit(" and more  "))).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.clean_name(t).alias("name"), (F.coalesce(F.char_length(S.clean_name(t)), F.lit(0)) <= 18).alias("fits"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN length(d) <= 6 AND v BETWEEN -500000 AND 400000 THEN v END AS num FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) || CAST(l_suppkey AS VARCHAR) AS d, CAST((CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END) || CAST(l_partkey AS VARCHAR) || CAST(l_suppkey AS VARCHAR) AS BIGINT) AS v FROM lineitem) q")
def bounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(""), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.number_in(text, -500000, 400000, 6).alias("num"))


@query("SELECT c_custkey, t AS claimed, length(t) = 17 AND t >= '76561197960265728' AS valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '7656119' ELSE '76561197' END || CAST(c_custkey * 7919 % 900000000 + 100000000 AS VARCHAR) AS t FROM customer) q")
def account_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.when(F.col("c_custkey") % 6 == 0, "7656119").otherwise("76561197"), (F.col("c_custkey") * 7919 % 900000000 + 100000000).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", t.alias("claimed"), S.is_account_id(t).alias("valid"))


@query("SELECT usr, seq, CASE WHEN v >= b THEN v - b END AS passed FROM (SELECT user_id AS usr, event_id AS seq, CAST(value AS BIGINT) AS v, lag(CAST(value AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) t WHERE b IS NOT NULL")
def elapsed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).withColumn("v", F.bround("value").cast("long"))
    b = F.lag("v").over(Window.partitionBy("usr").orderBy("seq"))
    return o.withColumn("b", b).filter("b IS NOT NULL").select("usr", "seq", S.elapsed_since(F.col("v"), F.col("b")).alias("passed"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') THEN 'metal' WHEN starts_with(p_type, 'SMALL') THEN 'small' WHEN contains(p_type, 'COPPER') THEN 'copper' WHEN contains(p_name, 'a') THEN 'named' END AS tag FROM part")
def first_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    tags = [("metal", F.contains(t, F.lit("BRASS"))), ("small", F.startswith(t, F.lit("SMALL"))), ("copper", F.contains(t, F.lit("COPPER"))), ("named", F.contains(F.col("p_name"), F.lit("a"))), ("fifth", F.lit(True))]
    return table(spark, sf_dir, "part").select("p_partkey", S.first_tag(tags, most=4).alias("tag"))


@query("SELECT seq, usr, CASE WHEN bv IS NULL THEN av WHEN av IS NULL THEN bv WHEN xs - seq < seq - bs OR (xs - seq = seq - bs AND ak = kind AND bk <> kind) THEN av ELSE bv END AS filled FROM (SELECT seq, usr, kind, last_value(m IGNORE NULLS) OVER b AS bv, last_value(s IGNORE NULLS) OVER b AS bs, last_value(k IGNORE NULLS) OVER b AS bk, first_value(m IGNORE NULLS) OVER a AS av, first_value(s IGNORE NULLS) OVER a AS xs, first_value(k IGNORE NULLS) OVER a AS ak FROM (SELECT event_id AS seq, user_id % 20 AS usr, event_id % 3 AS kind, CASE WHEN value > 70 THEN value END AS m, CASE WHEN value > 70 THEN event_id END AS s, CASE WHEN value > 70 THEN event_id % 3 END AS k FROM events) t WINDOW b AS (PARTITION BY usr ORDER BY seq ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY usr ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) q")
def fill_nearest_same_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select("seq", (F.col("usr") % 20).alias("usr"), (F.col("seq") % 3).alias("kind"), "value")
    return Q.fill_nearest_alike(o, ["usr"], "seq", "seq", F.when(F.col("value") > 70, F.col("value")), "kind", "filled").select("seq", "usr", "filled")


@query("SELECT l_partkey AS building, count(DISTINCT l_orderkey * 10 + l_linenumber) AS containers, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END) AS looted, CAST(sum(l_quantity) AS BIGINT) AS items FROM lineitem GROUP BY l_partkey")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("building")).agg(F.count_distinct(c).alias("containers"), F.count_distinct(F.when(F.col("l_returnflag") == "R", c)).alias("looted"), F.sum("l_quantity").cast("long").alias("items"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE w > 8 AND h > 8) AS kept, count(*) FILTER (WHERE NOT (w > 8 AND h > 8)) AS skipped, sum(w * h) FILTER (WHERE w > 8 AND h > 8) AS area FROM (SELECT 1 + p_size % 16 AS w, 1 + p_partkey % 16 AS h FROM part) t")
def conversion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("w") > 8) & (F.col("h") > 8)
    kept, skipped = J.converted(rects(spark, sf_dir), ok)
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("w") * F.col("h")).alias("area")).crossJoin(F.broadcast(skipped)).select("total", "kept", "skipped", "area")  # one row beside one


# ---------------------------------------------------------------- replication


@query("SELECT p_brand, p_partkey, CAST((r - 1) // 64 + 1 AS INTEGER) AS part, CAST((n + 63) // 64 AS INTEGER) AS parts FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) t")
def snapshot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.snapshot_parts(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 64)


@query("SELECT origin, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY seq DESC) AS r FROM (SELECT p_brand AS origin, p_size AS seq, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey % 2) = 2) t) q WHERE r = 1")
def assembled_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("origin"), F.col("p_size").alias("seq"), (F.col("p_partkey") % 2).alias("part"), F.lit(2).alias("parts"))
    return T.whole_snapshots(p, ["origin"], "seq", "part", "parts").groupBy("origin", "seq").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT seq, usr FROM (SELECT event_id AS seq, user_id AS usr, event_type AS kind, max(CASE WHEN event_type = 'click' THEN event_id - 500 END) OVER (PARTITION BY user_id) AS ack FROM events) t WHERE kind = 'purchase' AND (ack IS NULL OR seq > ack)")
def pending_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    acks = o.filter("kind = 'click'").groupBy("usr").agg(F.max(F.col("seq") - 500).alias("watermark"))
    return T.after_watermark(o.filter("kind = 'purchase'"), acks, ["usr"], "seq").select("seq", "usr")


@query("SELECT usr, idx, seq, claimed FROM (SELECT *, row_number() OVER (PARTITION BY usr, idx ORDER BY seq DESC) AS r FROM (SELECT user_id AS usr, event_id % 4 AS idx, event_id AS seq, user_id * 10 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS claimed FROM events) t WHERE claimed = usr * 10) q WHERE r = 1")
def identity_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select("usr", (F.col("seq") % 4).alias("idx"), "seq", (F.col("usr") * 10 + F.when(F.col("seq") % 7 == 0, 1).otherwise(0)).alias("claimed"))
    return T.latest_revision(o.filter(F.col("claimed") == F.col("usr") * 10), ["usr", "idx"], ["seq"])


@query("SELECT usr, s AS session, count(*) FILTER (WHERE kind = 'click') AS items, count(*) FILTER (WHERE kind = 'purchase') > 0 AS done FROM (SELECT *, sum(nw) OVER (PARTITION BY usr ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id AS seq, user_id AS usr, ts, event_type AS kind, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000 THEN 1 ELSE 0 END AS nw FROM events) a) b GROUP BY usr, s")
def abandoned_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    s = T.sessions(observations(spark, sf_dir), ["usr"], t, 86400)
    return s.groupBy("usr", "session").agg(F.count_if(F.col("kind") == "click").alias("items"), (F.count_if(F.col("kind") == "purchase") > 0).alias("done"))


@query("SELECT usr, seq, CASE WHEN s * 100 >= 60 * n THEN 'cleared' WHEN was > 0 THEN 'refreshed' ELSE 'visited' END AS state FROM (SELECT *, sum(CASE WHEN s * 100 >= 60 * n THEN 1 ELSE 0 END) OVER (PARTITION BY usr ORDER BY seq ROWS UNBOUNDED PRECEDING) AS was FROM (SELECT user_id AS usr, event_id AS seq, sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) OVER z AS s, count(*) OVER z AS n FROM events WINDOW z AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) t) q")
def auto_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.running_states(observations(spark, sf_dir), ["usr"], "seq", F.col("value") > 30, 60).select("usr", "seq", "state")


@query("SELECT usr, count(*) AS n, max(seq) AS last_seq FROM (SELECT user_id AS usr, event_id AS seq, epoch_us(ts) AS t, max(epoch_us(ts)) OVER () AS now, event_type AS kind FROM events) q GROUP BY usr HAVING NOT (max(now) - max(t) > 432000000000 AND count(*) FILTER (WHERE kind = 'error') = 0)")
def idle_clean_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return T.keep_active(observations(spark, sf_dir).withColumn("t", t), ["usr"], "t", F.col("kind") == "error", 432_000_000_000).select("usr", "n", F.col("last_seq"))


@query("SELECT usr, slot, seq FROM (SELECT user_id AS usr, epoch_us(ts) // 7200000000 AS slot, event_id AS seq, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 7200000000 ORDER BY ts, event_id) AS r FROM events) t WHERE r = 1")
def throttled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    o = observations(spark, sf_dir).withColumns({"slot": F.floor(t / 7_200_000_000), "t": t})
    return o.groupBy("usr", "slot").agg(F.min_by("seq", F.struct("t", "seq")).alias("seq"))


# ---------------------------------------------------------------- routes

_WAYS = """, g AS (SELECT street, seg, CAST(floor(x1*2+0.5) AS BIGINT) * 4294967296 + CAST(floor(y1*2+0.5) AS BIGINT) AS a, CAST(floor(x2*2+0.5) AS BIGINT) * 4294967296 + CAST(floor(y2*2+0.5) AS BIGINT) AS b, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 6) AS cost FROM v_segment),
e AS MATERIALIZED (SELECT a, b, min(cost) AS cost FROM (SELECT a, b, cost FROM g WHERE a <> b UNION ALL SELECT b, a, cost FROM g WHERE a <> b) t GROUP BY a, b),
st AS (SELECT street AS query, min_by(a, seg) AS u, max_by(b, seg) AS z FROM g WHERE street % 7 = 0 GROUP BY street),
s AS (SELECT query, u AS node, 5.0 AS extra FROM st UNION ALL SELECT query, z, 1.0 FROM st),
t AS (SELECT query, b AS node, CAST(seg AS DOUBLE) AS extra FROM st JOIN g ON g.street = st.query),
w(start, node, cost, hops) AS (SELECT DISTINCT node, node, CAST(0.0 AS DOUBLE), 0 FROM s UNION ALL SELECT w.start, e.b, w.cost + e.cost, w.hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.cost + e.cost <= 90 AND w.hops < 12),
d AS (SELECT start, node, min(cost) AS cost FROM w GROUP BY start, node),
c AS (SELECT s.query, s.node AS start, t.node AS "end", round(s.extra + d.cost + t.extra, 4) AS cost FROM s JOIN d ON d.start = s.node JOIN t ON t.query = s.query AND t.node = d.node)
SELECT query, start, "end", cost FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cost, start, "end") AS r FROM c WHERE cost <= 90) q WHERE r = 1"""


@query(with_views(_WAYS, "v_segment").replace("WITH ", "WITH RECURSIVE ", 1))
def routes_between_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    ends = seg.filter("street % 7 = 0").select(F.col("street").alias("query"), "seg", R.node_key("x1", "y1").alias("a"), R.node_key("x2", "y2").alias("b"))
    st = ends.groupBy("query").agg(F.min_by("a", "seg").alias("u"), F.max_by("b", "seg").alias("z"))
    starts = st.select("query", F.col("u").alias("node"), F.lit(5.0).alias("extra")).union(st.select("query", "z", F.lit(1.0)))
    goals = ends.select("query", F.col("b").alias("node"), F.col("seg").cast("double").alias("extra"))
    return R.routes_between(starts, goals, R.build_edges(seg), 90)
