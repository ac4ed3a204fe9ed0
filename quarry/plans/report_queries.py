"""Prose, endpoints, domains, plans, obligations and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import report as R
from quarry.operators import plans as P
from quarry.plans.registry import query
from quarry.sources.code import CODE_SQL, code
from quarry.sources.leads import LEADS_SQL, leads
from quarry.sources.tables import table

_PROSE = "concat(CASE p_partkey % 4 WHEN 0 THEN 'ENGINE CONFIRMED | ' WHEN 1 THEN 'Harness iteration 3 | ' WHEN 2 THEN '| ' ELSE '' END, 'POST to /api/v1/items  by ', p_name, CASE p_partkey % 3 WHEN 0 THEN ' conviction_level=2' WHEN 1 THEN ' user=1 q=2 | qualification: QUALIFIED' ELSE ' parameter: page |' END)"
_N = R.noise().replace("'", "''")


@query(f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PROSE}, '{_N}', '', 'g'), '\\|\\s*\\|', '|', 'g'), '^\\s*[|·]\\s*', '', 'g'), '\\s*[|·]\\s*$', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' |·' || chr(10) || chr(9)) AS prose FROM part""")
def cleaned_prose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", R.clean_prose(F.expr(_PROSE)).alias("prose"))


@query(f"""SELECT p_partkey, 'POST' AS method, '/api/v1/items' AS path, CASE p_partkey % 3 WHEN 0 THEN 'conviction_level' WHEN 1 THEN 'q' ELSE 'page' END AS param FROM part""")
def endpoints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", R.endpoint(F.expr(_PROSE)).alias("e")).select("p_partkey", "e.*")


_HOST = "CASE page_id % 6 WHEN 0 THEN concat('Host', page_id, '.Example.com.') WHEN 1 THEN concat('https://h', page_id, '.example.org/') WHEN 2 THEN concat('https://h', page_id, '.example.org/path') WHEN 3 THEN '10.0.0.1' WHEN 4 THEN concat('-bad', page_id, '.com') ELSE url END"


@query(f"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim({_HOST})), '[.]$', ''), '^https?://([^/?#:@]*)/?$', '\\1') AS host FROM pages) SELECT page_id, CASE WHEN regexp_full_match(host, '{R.DOMAIN}') THEN host END AS domain FROM h""")
def recon_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", R.domain(F.expr(_HOST)).alias("domain"))


@query(f"""WITH {LEADS_SQL} SELECT title, file, line, arg_max(id, (cvss, -id)) AS id, max(cvss) AS cvss, count(*)::BIGINT AS leads, CASE WHEN max(cvss) >= 9 THEN 'critical' WHEN max(cvss) >= 7 THEN 'high' WHEN max(cvss) >= 4 THEN 'medium' ELSE 'informational' END AS band
FROM leads WHERE status <> 'below-threshold' GROUP BY title, file, line""")
def planned_tasks(spark: SparkSession, d: str) -> DataFrame:
    return P.planned_tasks(leads(spark, d), ["title", "file", "line"], 7.0, F.col("status") == "below-threshold")


_PRIORITY = "CASE WHEN cvss >= 9 THEN 0 WHEN cvss >= 7 THEN 1 WHEN cvss >= 4 THEN 2 ELSE 3 END"


@query(f"""WITH {LEADS_SQL} SELECT id, tool, row_number() OVER (ORDER BY tool <> 'semgrep', {_PRIORITY}, id)::INT AS place FROM leads QUALIFY place <= 100""")
def plan_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred: native tools before others, then by priority, stable."""
    rank = [F.when(F.col("tool") == "semgrep", 0).otherwise(1), F.expr(_PRIORITY), F.col("id")]
    top = leads(spark, d).select("id", "tool", "cvss").orderBy(*rank).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*rank))).select("id", "tool", "place")


@query(f"""WITH {LEADS_SQL}, t AS (SELECT id AS task_id, CASE WHEN id % 15 = 0 THEN id + 1 END AS source_ref, title, file FROM leads WHERE id % 5 = 0), r AS (SELECT source_ref, min(task_id) AS x FROM t WHERE source_ref IS NOT NULL GROUP BY 1), k AS (SELECT title, file, min(task_id) AS y, count(*) AS n FROM t GROUP BY 1, 2)
SELECT id, CASE WHEN x IS NOT NULL THEN x WHEN n = 1 THEN y END AS task_id, CASE WHEN x IS NOT NULL THEN 'reference' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS how FROM leads l LEFT JOIN r ON r.source_ref = l.id LEFT JOIN k ON k.title = l.title AND k.file = l.file""")
def matched_obligations(spark: SparkSession, d: str) -> DataFrame:
    own = leads(spark, d)
    tasks = own.where("id % 5 = 0").select(F.col("id").alias("task_id"), F.expr("CASE WHEN id % 15 = 0 THEN id + 1 END").alias("source_ref"), "title", "file")
    return P.matched_obligations(own.select("id", "title", "file"), tasks, ["title", "file"])


_OWNERS = ["src", "src/core", "web", "config", "deploy", "app/models"]


@query(f"""WITH {CODE_SQL}, o(owner) AS (VALUES {', '.join(f"('{x}')" for x in _OWNERS)}), b AS (SELECT path, arg_max(owner, length(owner)) AS owner FROM code JOIN o ON starts_with(path, owner || '/') GROUP BY path)
SELECT owner, kind, count(*)::BIGINT AS files FROM code LEFT JOIN b USING (path) GROUP BY owner, kind""")
def component_rollup(spark: SparkSession, d: str) -> DataFrame:
    owners = spark.createDataFrame([(x,) for x in _OWNERS], "owner string")
    return P.owned_by(code(spark, d).select("path", "kind"), "path", owners, "owner").groupBy("owner", "kind").agg(F.count("*").alias("files"))


_MANIFEST = """concat('{"findings": [{"id": ', CAST(o_orderkey % 100 + 1 AS STRING), ', "eligible": true}, {"id": ', CAST(o_orderkey * 7 % 100 + 1 AS STRING), ', "eligible": ', CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END, '}, null]}')"""


@query("""SELECT DISTINCT finding_id, report_id FROM (SELECT o_orderkey % 100 + 1 AS finding_id, o_orderkey AS report_id FROM orders UNION ALL SELECT o_orderkey * 7 % 100 + 1, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) WHERE finding_id IN (SELECT p_partkey FROM part)""")
def report_links(spark: SparkSession, d: str) -> DataFrame:
    """Which reports list a finding as eligible; a row a link, so a finding of many reports is no large group."""
    reports = table(spark, d, "orders").selectExpr("o_orderkey AS report_id", f"{_MANIFEST} AS manifest")
    listed = reports.select("report_id", F.explode(F.from_json("manifest", "findings array<struct<id:bigint,eligible:boolean>>")["findings"]).alias("f")).where("f.eligible")
    return listed.select(F.col("f.id").alias("finding_id"), "report_id").join(leads(spark, d).select(F.col("id").alias("finding_id")), "finding_id", "left_semi").distinct()


_AREAS = [f"A{i:02d}" for i in range(1, 11)]


@query(f"""WITH {LEADS_SQL}, a(area) AS (VALUES {', '.join(f"('{x}')" for x in _AREAS)}), n AS (SELECT concat('A', lpad((id % 7 + 1)::VARCHAR, 2, '0')) AS area, count(*) AS n FROM leads GROUP BY 1)
SELECT area, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) > 0 AS covered, round_even(100.0::DOUBLE * count(n) OVER () / count(*) OVER (), 1) AS covered_pct FROM a LEFT JOIN n USING (area)""")
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every category, those without a lead as 0, and the share that is covered."""
    own = leads(spark, d).select(F.concat(F.lit("A"), F.lpad((F.col("id") % 7 + 1).cast("string"), 2, "0")).alias("area"))
    areas = spark.createDataFrame([(x,) for x in _AREAS], "area string")
    return P.zero_filled(areas, own.groupBy("area").agg(F.count("*").alias("n")), "area")


_REVISION = {"captured": "CASE WHEN o_orderkey % 4 = 0 THEN concat('c', CAST(o_orderkey AS STRING)) ELSE '' END", "output": "CASE o_orderkey % 5 WHEN 0 THEN concat('{\"target\": {\"revision\": \"j', CAST(o_orderkey AS STRING), '\"}}') WHEN 1 THEN '{broken' ELSE '{}' END", "observed": "CASE WHEN o_orderkey % 7 = 0 THEN concat('o', CAST(o_orderkey AS STRING)) END"}


@query(f"""WITH r AS (SELECT o_custkey % 50 AS repo_id, o_orderkey AS id, coalesce(nullif({_REVISION['captured']}, ''), CASE WHEN o_orderkey % 5 = 0 THEN concat('j', o_orderkey) END, {_REVISION['observed']}) AS revision FROM orders)
SELECT repo_id, max(id) AS id, arg_max(revision, id) AS revision FROM r WHERE revision IS NOT NULL GROUP BY repo_id""")
def latest_revisions(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").selectExpr("o_custkey % 50 AS repo_id", "o_orderkey AS id", *(f"{e} AS {c}" for c, e in _REVISION.items()))
    return P.latest_with(jobs, "repo_id", "id", [F.col("captured"), F.get_json_object("output", "$.target.revision"), F.col("observed")], "revision")
