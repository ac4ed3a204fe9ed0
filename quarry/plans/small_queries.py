"""Queries of single functions and sinks: names, times, sizes, titles, nesting, bounded fields, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import json as J
from quarry.functions import text as T
from quarry.operators import dedup as D
from quarry.operators import patterns as P
from quarry.plans.code_queries import CODE_LINES_SQL
from quarry.plans.json_queries import STORED
from quarry.plans.registry import query
from quarry.sources import sinks
from quarry.sources import text as X
from quarry.sources.code import code
from quarry.sources.scratch import folder
from quarry.sources.tables import FINDINGS_SQL, findings, table


@query("""WITH t AS (SELECT o_orderkey, o_totalprice * 3 % 20000 AS raw FROM orders), s AS (SELECT o_orderkey, round(raw, 1) AS s FROM t)
SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm %.1fs', floor(s / 60)::BIGINT, s - floor(s / 60) * 60) ELSE printf('%dh %dm %ds', floor(s / 3600)::BIGINT, (floor(s / 60) % 60)::BIGINT, floor(s % 60)::BIGINT) END AS spent FROM s""")
def human_durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.duration(F.col("o_totalprice") * 3 % 20_000).alias("spent"))


@query("""SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824) ELSE printf('%.1f MiB', n / 1048576) END AS size FROM (SELECT o_orderkey, (o_orderkey * 7919 % 5000) * 700001.0::DOUBLE AS n FROM orders)""")
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.mebibytes((F.col("o_orderkey") * 7919 % 5000) * F.lit(700_001.0)).alias("size"))


_PACKAGE = "CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN concat('@scope/', replace(p_name, ' ', '-')) WHEN 1 THEN concat('github.com/Acme/', replace(p_name, ' ', '-')) WHEN 2 THEN replace(p_name, ' ', '-') WHEN 3 THEN upper(replace(p_name, ' ', '_')) END"


@query(f"SELECT p_partkey, CASE WHEN p IS NULL THEN NULL ELSE replace(lower(string_split(regexp_replace(p, '^@[^/]+/', ''), '/')[-1]), '-', '_') END AS name FROM (SELECT p_partkey, {_PACKAGE} AS p FROM part)")
def normalised_packages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", f"{_PACKAGE} AS p").select("p_partkey", T.package_name(F.col("p")).alias("name"))


_PRIOR = "CASE CAST(id % 7 AS INT) WHEN 0 THEN upper(title) WHEN 1 THEN concat(title, ' (again)') WHEN 2 THEN 'injection command os via system!' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN 'xss' ELSE concat('Path traversal in ', tool) END"
_NORMAL = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"


@query(f"""WITH {FINDINGS_SQL}, p AS (SELECT id, title, {_PRIOR} AS prior FROM findings), n AS (SELECT *, {_NORMAL.format('title')} AS x, {_NORMAL.format('prior')} AS y, {_TOKENS.format('title')} AS a, {_TOKENS.format('prior')} AS b FROM p)
SELECT id, x AS normal_title, x <> '' AND (x = y OR (length(x) >= 8 AND length(y) >= 8 AND (contains(x, y) OR contains(y, x) OR len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) >= 0.65))) AS known FROM n""")
def fuzzy_title_matches(spark: SparkSession, d: str) -> DataFrame:
    """Is a finding's title that of an earlier one: equal, within it, or of nearly the same words?"""
    f = findings(spark, d).withColumn("prior", F.expr(_PRIOR))
    return f.select("id", D.normal_title(F.col("title")).alias("normal_title"), D.titles_match(F.col("title"), F.col("prior")).alias("known"))


@query(rf"""WITH {CODE_LINES_SQL}, s AS (SELECT path, line, len(regexp_extract_all(line_text, '\b(if|for|while|case|catch|elif)\b')) AS b, len(regexp_extract_all(line_text, '\{{')) - len(regexp_extract_all(line_text, '\}}')) AS step FROM lines),
x AS (SELECT *, sum(step) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) AS depth FROM s), g AS (SELECT path, sum(b)::BIGINT AS branches, count(*)::BIGINT AS n, greatest(max(depth), 0)::BIGINT AS nesting FROM x GROUP BY path)
SELECT path, branches, n, nesting, round(branches / n * 50 + 2 * nesting + ln(1 + n), 6) AS score FROM g WHERE branches / n * 50 + 2 * nesting + ln(1 + n) >= 5 ORDER BY score DESC, path LIMIT 30""")
def complex_files(spark: SparkSession, d: str) -> DataFrame:
    """The thirty most complex files, by branches, deepest nesting and length."""
    scored = P.complexity(X.lines(code(spark, d)), "path", 5.0)
    return scored.select("path", "branches", "n", F.col("nesting").cast("long").alias("nesting"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "path").limit(30)


@query(f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN concat('{{"target": "', repeat('x', 300), '"}}') ELSE {STORED} END AS doc FROM events)
SELECT event_id, CASE WHEN coalesce(doc, '') = '' THEN 'not_recorded' WHEN strlen(doc) > 300 THEN 'oversized' WHEN event_id % 12 IN (2, 5) AND event_id % 50 <> 0 THEN 'malformed'
 WHEN json_type(regexp_replace(doc, ' trailing .*$', ''), '$.target') IS NULL THEN 'absent' WHEN json_type(regexp_replace(doc, ' trailing .*$', ''), '$.target') = 'NULL' THEN 'null' ELSE 'present' END AS state FROM s""")
def bounded_fields(spark: SparkSession, d: str) -> DataFrame:
    """The state of one field of each stored document of up to 300 bytes. Repeated names count as malformed."""
    own = table(spark, d, "events").selectExpr("event_id", f"CASE WHEN event_id % 50 = 0 THEN concat('{{\"target\": \"', repeat('x', 300), '\"}}') ELSE {STORED} END AS doc")
    return own.select("event_id", J.bounded_state(F.col("doc"), "$.target", 300).alias("state"))


@query(f"WITH {FINDINGS_SQL} SELECT tool, status, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM findings GROUP BY ALL")
def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Findings written as JSON, a folder a tool and status, and read back."""
    path = f"{folder(spark)}/snapshot-{uuid.uuid4().hex}"
    own = findings(spark, d).select("id", "tool", "status", "title", "cvss")
    sinks.write_snapshot(own, path, "tool", "status")
    back = spark.read.schema(own.schema).json(path)
    return back.groupBy("tool", "status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""SELECT n.c_custkey, n.generation FROM (SELECT c_custkey, c_custkey % 5 AS generation FROM customer) n LEFT JOIN (SELECT c_custkey, c_custkey % 3 AS g FROM customer WHERE c_custkey % 4 <> 0) o USING (c_custkey) WHERE g IS NULL OR g < generation""")
def cache_updates(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a cache takes: those it hasn't, or has in an earlier generation."""
    c = table(spark, d, "customer")
    return sinks.changed_only(c.selectExpr("c_custkey", "c_custkey % 5 AS generation"), c.where("c_custkey % 4 <> 0").selectExpr("c_custkey", "c_custkey % 3 AS generation"), "c_custkey", "generation")
