"""Static signatures of stored audits, and deployments against their baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import deployments as D
from quarry.plans.json_queries import _TREE_SQL, _stored
from quarry.plans.registry import query
from quarry.sources.services import _pick
from quarry.sources.tables import table

_PATH = r"""CASE WHEN regexp_matches(raw, '^https?://') THEN coalesce(nullif(regexp_extract(raw, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') ELSE raw END"""


@query(rf"""{_TREE_SQL}, v AS (SELECT event_id, trim(atom) AS raw FROM n WHERE type = 'VARCHAR' AND state IN ('value', 'item')), b AS (SELECT event_id, raw, {_PATH} AS bare FROM v),
p AS (SELECT DISTINCT event_id, CASE WHEN x = '/' THEN x ELSE regexp_replace(x, '/$', '') END AS path FROM (SELECT *, regexp_replace(split_part(split_part(bare, '?', 1), '#', 1), '/+', '/', 'g') AS x FROM b WHERE raw <> '' AND length(raw) <= 256 AND bare LIKE '/%') WHERE NOT contains(x, '..') AND NOT regexp_matches(x, '[{{}}\[\];|&$`\\"'']') AND NOT regexp_matches(x, '(?i)\.(py|rb|go|java|js|ts|php|c|h|rs|cs|sql|md)$')),
s AS (SELECT event_id, coalesce(string_agg(path, ',' ORDER BY path) FILTER (path IN ({", ".join(f"'{x}'" for x in D.SAFE_PATHS)})), '') AS paths, count(*)::BIGINT AS route_count, count(*) FILTER (path NOT IN ({", ".join(f"'{x}'" for x in D.SAFE_PATHS)}))::BIGINT AS excluded FROM p GROUP BY event_id)
SELECT event_id, paths, route_count, excluded, sha256('{{"excluded":' || excluded || ',"paths":"' || paths || '","route_count":' || route_count || '}}') AS signature FROM s""")
def static_signatures(spark: SparkSession, d: str) -> DataFrame:
    return D.static_signatures(_stored(spark, d), "event_id", "doc")


_ROUTES = ["/", "/health", "/version", "/status?x", "https://h.example/openapi.json#a", "//api//v1/", "/a/../b", "/x/{id}", "main.py", "/src/main.py", "", "/swagger.json"]


@query(rf"""WITH r AS (SELECT c_custkey, {_pick(_ROUTES, 'c_custkey')} AS raw FROM customer), b AS (SELECT c_custkey, raw, {_PATH} AS bare FROM r), x AS (SELECT c_custkey, raw, bare, regexp_replace(split_part(split_part(bare, '?', 1), '#', 1), '/+', '/', 'g') AS x FROM b)
SELECT c_custkey, CASE WHEN raw = '' OR bare NOT LIKE '/%' OR contains(x, '..') OR contains(x, '{{') OR x LIKE '%.py' THEN NULL WHEN x = '/' THEN x ELSE regexp_replace(x, '/$', '') END AS path FROM x""")
def normal_routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey", f"{_pick(_ROUTES, 'c_custkey')} AS raw").select("c_custkey", D.normal_path(F.col("raw")).alias("path"))


def _answers(k: int) -> str:
    n = f"c_custkey * {k} + j * c_nationkey"
    marks = ["product:shop~title:welcome shop", "product:shop", "", "server:x", "title:other", "product:shop~server:x"]
    listed = "|".join(marks).replace("~", ";")
    return (
        f"c_custkey AS profile, j, {_pick(D.SAFE_PATHS[:4], 'j')} AS path, CASE WHEN ({n}) % 31 = 0 THEN 'POST' ELSE 'GET' END AS method, CAST({_pick(['200', '204', '404', '200', '0', '200', '200'], n)} AS INT) AS status, "
        f"split_part('{listed}', '|', CAST((c_custkey + j * {k} * (c_custkey % 3)) % 6 + 1 AS INT)) AS marks, CASE WHEN ({n}) % 5 = 0 THEN '' ELSE concat('h', CAST(c_custkey % 4 + j AS STRING)) END AS body_hash, ({n}) % 29 = 0 AS truncated"
    )


_SIDES = ("base", 1, "c_custkey % 13 <> 0"), ("seen", 2, "c_custkey % 11 <> 0 AND (c_custkey + j) % 5 <> 0")
_SIDES_SQL = ", ".join(f"{name} AS (SELECT {_answers(k)} FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS j FROM customer) WHERE {where})" for name, k, where in _SIDES)


def _side(spark: SparkSession, d: str, k: int, where: str) -> DataFrame:
    shaped = table(spark, d, "customer").selectExpr("*", "explode(array(0, 1, 2, 3, 4)) AS j").where(where)
    return spark.sql(f"SELECT {_answers(k)} FROM {{rows}}", rows=shaped).withColumn("markers", F.filter(F.split("marks", ";"), lambda m: m != ""))


@query(f"""WITH {_SIDES_SQL}, safe AS (SELECT * FROM (VALUES {", ".join(f"('{p}')" for p in D.SAFE_PATHS)}) t(path)),
e AS (SELECT *, list_filter(string_split(marks, ';'), lambda m: m <> '') AS m FROM base SEMI JOIN safe USING (path) WHERE method = 'GET' AND status BETWEEN 200 AND 299 QUALIFY row_number() OVER (PARTITION BY profile, path ORDER BY j DESC) = 1),
a AS (SELECT *, list_filter(string_split(marks, ';'), lambda m: m <> '') AS m FROM seen SEMI JOIN safe USING (path) WHERE method = 'GET' QUALIFY row_number() OVER (PARTITION BY profile, path ORDER BY j DESC) = 1),
b AS (SELECT e.profile, e.body_hash AS body, coalesce(a.status, 0) AS status, list_sort(list_filter(list_intersect(e.m, a.m), lambda m: m LIKE 'product:%' OR m LIKE 'title:%')) AS strong, len(e.m) > 0 AND len(a.m) > 0 AS told, NOT coalesce(a.truncated, false) AND NOT e.truncated AS whole FROM e LEFT JOIN a USING (profile, path)),
p AS (SELECT profile, count(DISTINCT CASE WHEN status BETWEEN 200 AND 299 AND whole AND len(strong) > 0 THEN array_to_string(strong, ';') || '#' || body END) AS n, count(*) FILTER (told AND len(coalesce(strong, [])) = 0) AS x, avg((status > 0)::INT::DOUBLE) AS c FROM b GROUP BY profile),
h AS (SELECT DISTINCT profile FROM seen SEMI JOIN safe USING (path) WHERE method = 'GET' AND status <> 0),
q AS (SELECT k.profile, coalesce(n, 0) AS n, coalesce(x, 0) AS x, coalesce(c, 0) AS c, CASE WHEN n > 0 THEN least(CASE WHEN x > 0 THEN 0.3 ELSE 0.95 END, 0.35::DOUBLE + 0.25 * n + 0.1 * c) WHEN n IS NOT NULL AND k.profile IN (SELECT profile FROM h) THEN 0.1 ELSE 0 END::DOUBLE AS confidence FROM (SELECT DISTINCT profile FROM base) k LEFT JOIN p USING (profile))
SELECT profile, n::BIGINT AS anchors, x::BIGINT AS contradictions, round(c, 3) AS coverage, round(confidence, 3) AS confidence, CASE WHEN round(confidence, 3) >= 0.85 THEN 'high' WHEN round(confidence, 3) >= 0.55 THEN 'medium' WHEN confidence > 0 THEN 'low' ELSE 'unavailable' END AS label, n > 0 AND x = 0 AND round(confidence, 3) >= 0.55 AS matched FROM q""")
def deployment_matches(spark: SparkSession, d: str) -> DataFrame:
    base, seen = (_side(spark, d, k, where) for _, k, where in _SIDES)
    return D.compared(base, seen, ["profile"], "j")
