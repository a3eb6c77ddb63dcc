"""URL rules and link-graph propagation over hosts, in DataFrame operations only.

Trust walks along the links between hosts from those that allow rules name, distrust walks against the links from those
that block rules name; a host is blocked where its distrust outweighs its trust and its share of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textops import shared_folder

#: (host, path, verdict) of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SCALE = 10**12
DAMPING = 85
ROUNDS = 20
TRUST_WEIGHT = 3
BROADCAST_HOSTS = 200_000
LINK = r"(?:href|src|action)\s*=\s*[\"']?(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\"'\s<>]*)"
ADDRESS = r"[A-Za-z0-9._%+-]@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; without ``://`` or of null, empty."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The part after the host up to ``?``, ``#`` or the end; without ``://`` or of null, empty."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def host_links(pages: DataFrame, addresses: bool = True) -> DataFrame:
    """(src, dst): each pair of different hosts once, where a page of one links to the other or names it in a mail address.

    ``pages`` has host and html. Links are the values of href, src and action with a host; relative links stay within
    their host and count for nothing. A null html has no links.
    """
    found = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    if addresses:
        found = F.concat(found, F.regexp_extract_all("html", F.lit(ADDRESS), F.lit(1)))
    named = pages.filter("html is not null and host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(found, lambda h: F.translate(h, _UPPER, _LOWER)))).alias("dst"))
    return named.filter("dst <> '' and src <> dst").distinct()


def _ensure_checkpoints(spark: SparkSession) -> None:
    if not spark.conf.get("spark.checkpoint.dir", None):
        shared_folder(spark)


def walks(seeds: DataFrame, links: DataFrame, damping: int = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass): what arrives at each host on walks of up to ``rounds`` links from the seeds.

    ``seeds`` is (kind, host, mass), masses whole numbers; ``links`` is (kind, a, b), without repeats. At each step the mass
    of a host is damped and shared out evenly among its links, rounding down; this is personalised PageRank, to a constant
    factor, with restarts at the seeds. What is cut by ending after 20 links is at most 4 % of the whole. A round moves only
    the mass that still walks: one join and one sum, combined before the shuffle.
    """
    _ensure_checkpoints(seeds.sparkSession)
    out_degree = links.groupBy("kind", "a").agg(F.count(F.lit(1)).alias("degree"))
    step = links.join(out_degree, ["kind", "a"]).checkpoint()
    front, all_ = seeds.filter("mass > 0").checkpoint(), None
    for _ in range(rounds):
        all_ = front if all_ is None else all_.union(front)
        moved = front.join(step, (front["kind"] == step["kind"]) & (front["host"] == step["a"])).select(front["kind"], F.col("b").alias("host"), F.expr(f"mass * {damping} div (100 * degree)").alias("mass"))
        front = moved.filter("mass > 0").groupBy("kind", "host").agg(F.sum("mass").alias("mass")).checkpoint()
        if front.isEmpty():
            break
    else:
        all_ = all_.union(front)
    return all_.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", trust_weight: int = TRUST_WEIGHT, damping: int = DAMPING, rounds: int = ROUNDS, addresses: bool = True, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Every page with host, path, rule, verdict, trust and distrust.

    A rule (host, path, verdict) fits the urls of its host and of all subdomains whose path starts with its path; of
    several the longest decides, and of equally long ones the first by name. Where none fits, the host decides: seeds share
    ``SCALE`` among hosts by their pages under allow rules (trust) and block rules (distrust), trust walks along the links
    and distrust against them, and a host is blocked if its distrust is at least ``trust_weight`` times its trust plus
    its share of all pages, and more than nothing. Urls that are null or have no ``://`` have an empty host, which no link
    names. Null html has no links; repeated pages count as often as they come. Columns of other names are not carried; an
    empty table gives no rows.

    Per-host tables are broadcast to the pages while there are at most ``broadcast_hosts``; beyond that Spark joins on
    the host, one row on that side, and AQE splits hot hosts on the other.
    """
    spark = pages.sparkSession
    _ensure_checkpoints(spark)
    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    named = [F.struct(F.lit(h).alias("of"), F.lit(p).alias("start"), F.lit(v).alias("verdict")) for h, p, v in rules]
    hosts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    fits = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("of"))
    if named:
        listed = spark.range(1).select(F.inline(F.array(*named)))
        fit = fits.join(F.broadcast(listed), "of").groupBy("host").agg(F.collect_set(F.struct((-F.length(F.concat("of", "start"))).alias("n"), F.concat("of", "start").alias("rule"), "start", "verdict")).alias("fits"))  # the driver's own list
    else:
        fit = fits.select("host", F.array().cast("array<struct<n:int,rule:string,start:string,verdict:string>>").alias("fits")).limit(0)
    known = hosts.join(fit, "host", "left").checkpoint()
    few = known.count() <= broadcast_hosts
    small = F.broadcast if few else (lambda df: df)
    best = F.array_min(F.filter("fits", lambda f: F.col("path").startswith(f["start"])))
    ruled = urls.join(small(known.select("host", "fits").withColumnRenamed("host", "__host")), F.col("host") == F.col("__host"), "left").withColumn("best", best).select("page_id", "host", "path", "best.rule", F.col("best.verdict").alias("ruled"))

    tally = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")).checkpoint()
    n, allow, block = tally.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("pages", "allow", "block")]).first()
    part = lambda c, total: F.expr(f"CAST(CAST({c} AS DECIMAL(20,0)) * {SCALE} div {max(1, total)} AS BIGINT)")
    seeds = tally.select(F.lit(0).alias("kind"), "host", part("allow", allow).alias("mass")).union(tally.select(F.lit(1), "host", part("block", block)))
    links = host_links(pages.select(host_of(url).alias("host"), F.col(html_col).cast("string").alias("html")), addresses).checkpoint()
    both = links.select(F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).union(links.select(F.lit(1), "dst", "src"))
    mass = walks(seeds, both, damping, rounds)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0))
    scored = tally.select("host", part("pages", n).alias("share")).join(mass.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust")), "host", "left").na.fill(0, ["trust", "distrust"])
    scored = scored.select(F.col("host").alias("__host"), "trust", "distrust", F.when((F.col("distrust") > 0) & (F.col("distrust") >= trust_weight * F.col("trust") + F.col("share")), "block").otherwise("allow").alias("__verdict"))
    return ruled.join(small(scored), F.col("host") == F.col("__host"), "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "__verdict").alias("verdict"), "trust", "distrust")


_URLS = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_DOWN = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_SQL_LINK, _SQL_ADDRESS = (x.replace("'", "''") for x in (LINK, ADDRESS))
#: The query's rows in DuckDB: the same walks by a recursive common table expression.
LINKS_SQL = f"""WITH RECURSIVE rules(of_host, start, verdict) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, html, coalesce({_URLS}, '') AS rest FROM pages),
p AS (SELECT row_number() OVER () AS row, page_id, html, {_DOWN.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.row, of_host || start AS rule, verdict AS ruled, row_number() OVER (PARTITION BY p.row ORDER BY length(of_host || start) DESC, of_host || start) AS best FROM p JOIN rules ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, start)),
r AS (SELECT p.page_id, p.host, p.path, p.html, f.rule, f.ruled FROM p LEFT JOIN f ON p.row = f.row AND best = 1),
t AS (SELECT host, count(*) AS pages, count(*) FILTER (WHERE ruled = 'allow') AS allow, count(*) FILTER (WHERE ruled = 'block') AS block FROM r GROUP BY 1),
a AS (SELECT CAST(greatest(1, sum(pages)) AS HUGEINT) AS pages, CAST(greatest(1, sum(allow)) AS HUGEINT) AS allow, CAST(greatest(1, sum(block)) AS HUGEINT) AS block FROM t),
seeds AS (SELECT 0 AS kind, host, CAST(t.allow * {SCALE}::HUGEINT // a.allow AS BIGINT) AS mass FROM t, a UNION ALL SELECT 1, host, CAST(t.block * {SCALE}::HUGEINT // a.block AS BIGINT) FROM t, a),
l AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, {_DOWN.format("unnest(regexp_extract_all(html, '" + _SQL_LINK + "', 1) || regexp_extract_all(html, '" + _SQL_ADDRESS + "', 1))")} AS dst FROM r WHERE host <> '') x WHERE dst <> '' AND src <> dst),
b AS (SELECT 0 AS kind, src AS a, dst AS b FROM l UNION ALL SELECT 1, dst, src FROM l),
s AS (SELECT b.*, count(*) OVER (PARTITION BY kind, a) AS degree FROM b),
w AS (SELECT 0 AS step, kind, host, mass FROM seeds WHERE mass > 0 UNION ALL SELECT step + 1, kind, host, CAST(sum(mass) AS BIGINT) FROM (SELECT w.step, s.kind, s.b AS host, w.mass * {DAMPING} // (100 * degree) AS mass FROM w JOIN s ON s.kind = w.kind AND s.a = w.host WHERE w.step < {ROUNDS}) m WHERE mass > 0 GROUP BY 1, 2, 3),
v AS (SELECT t.host, CAST(t.pages * {SCALE}::HUGEINT // a.pages AS BIGINT) AS share, CAST(coalesce(sum(mass) FILTER (WHERE kind = 0), 0) AS BIGINT) AS trust, CAST(coalesce(sum(mass) FILTER (WHERE kind = 1), 0) AS BIGINT) AS distrust FROM t CROSS JOIN a LEFT JOIN w ON w.host = t.host GROUP BY 1, 2)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN distrust > 0 AND distrust >= {TRUST_WEIGHT} * trust + share THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust FROM r JOIN v ON r.host = v.host"""


def op11_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
