"""Scanner reports, made from ``supplier`` with malformed, partial and failed ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.sources import tools as T
from quarry.sources.tables import table
from quarry.sources.text import concatenated_json


def _reports(spark: SparkSession, d: str, output: str) -> DataFrame:
    """``output`` is SQL over k, the report's number."""
    return table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS k").selectExpr("k", f"{output} AS output")


_K = "(SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier)"
_N = "CAST(k AS STRING)"
_SEMGREP = f"""CASE WHEN k % 11 = 0 THEN '{{broken' ELSE concat('{{"results": [{{"check_id": "r', {_N}, '", "path": "src/a', {_N}, '.py", "start": {{"line": ', {_N}, '}}, "extra": {{"message": "m"}}}}, {{"check_id": "s", "path": "b.py", "start": {{"line": ', CASE WHEN k % 3 = 0 THEN '0' ELSE '7' END, '}}, "extra": {{}}}}',
 CASE WHEN k % 5 = 0 THEN ', {{"check_id": "t", "path": "c.py", "start": {{"line": 3}}}}' ELSE '' END, '], "errors": [', CASE WHEN k % 13 = 0 THEN '"e"' ELSE '' END, ']}}') END"""


@query(f"""SELECT k, 0 AS ordinal, concat('r', k) AS rule, concat('src/a', k, '.py') AS path, k::INT AS line, 'm' AS message FROM {_K} WHERE k % 11 <> 0
UNION ALL SELECT k, 1, 's', 'b.py', 7, '' FROM {_K} WHERE k % 11 <> 0 AND k % 3 <> 0""")
def semgrep_findings(spark: SparkSession, d: str) -> DataFrame:
    return T.semgrep(_reports(spark, d, _SEMGREP), "k")


@query(f"""SELECT k, CASE WHEN k % 11 = 0 THEN 0 WHEN k % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS kept, CASE WHEN k % 7 = 0 THEN 'semgrep execution failed (rc=2)' WHEN k % 11 = 0 THEN 'semgrep returned no usable JSON results list'
 WHEN k % 3 = 0 OR k % 5 = 0 THEN 'semgrep returned ' || ((k % 3 = 0)::INT + (k % 5 = 0)::INT) || ' malformed result rows' WHEN k % 13 = 0 THEN 'semgrep recorded 1 scan errors' END AS reason FROM {_K}""")
def semgrep_failures(spark: SparkSession, d: str) -> DataFrame:
    return T.semgrep_failure(_reports(spark, d, _SEMGREP).withColumn("code", F.when(F.col("k") % 7 == 0, 2).otherwise(0)), "k", "code")


_NPM = f"""CASE k % 5 WHEN 0 THEN '{{"error": {{"summary": "ENOLOCK"}}}}' WHEN 1 THEN '{{"message": "registry down"}}' WHEN 2 THEN '[]' ELSE concat('{{"vulnerabilities": {{"pkg', {_N}, '": {{"severity": "high", "via": [{{"title": "t', {_N}, '"}}]}}, "other": {{"via": ["pkg"]}}}}}}') END"""


@query(f"SELECT k, concat('pkg', k) AS package, 'high' AS severity, concat('t', k) AS via_title FROM {_K} WHERE k % 5 > 2 UNION ALL SELECT k, 'other', 'unknown', '' FROM {_K} WHERE k % 5 > 2")
def npm_findings(spark: SparkSession, d: str) -> DataFrame:
    return T.npm_audit(_reports(spark, d, _NPM), "k")


@query(f"SELECT k, CASE WHEN k % 5 = 2 THEN 'npm audit returned a non-object JSON document' ELSE 'npm audit could not analyze the dependency graph' END AS reason FROM {_K} WHERE k % 5 < 3")
def npm_failures(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d, _NPM).select("k", T.npm_audit_failure(F.col("output")).alias("reason")).where("reason is not null")


_OWASP = f"""CASE WHEN k % 6 = 0 THEN '{{}}' ELSE concat('{{"dependencies": [{{"fileName": "lib', {_N}, '.jar", "vulnerabilities": [{{"name": "CVE-', {_N}, '", "cvssv3": {{"baseScore": ', CAST(k % 12 AS STRING), '}}}}, {{"id": "X-1", "cvssv2": {{"score": 5.5}}}}]}}, {{"fileName": "app.gradle", "vulnerabilities": [{{}}]}}, {{"fileName": "clean.jar"}}]}}') END"""


@query(f"""SELECT k, concat('lib', k, '.jar') AS dependency, concat('CVE-', k) AS advisory, CASE WHEN k % 12 = 0 THEN 7.0 ELSE least(k % 12, 10) END::DOUBLE AS cvss, 'pom.xml' AS file FROM {_K} WHERE k % 6 <> 0
UNION ALL SELECT k, concat('lib', k, '.jar'), 'X-1', 5.5, 'pom.xml' FROM {_K} WHERE k % 6 <> 0 UNION ALL SELECT k, 'app.gradle', 'unknown-advisory', 7.0, 'build.gradle' FROM {_K} WHERE k % 6 <> 0""")
def dependency_check_findings(spark: SparkSession, d: str) -> DataFrame:
    return T.dependency_check(_reports(spark, d, _OWASP), "k")


_TRUFFLE = f"""concat('{{"DetectorName": "AWS", "DetectorType": 2, "Raw": "x", "SourceMetadata": {{"Data": {{"Filesystem": {{"file": "f', {_N}, '", "line": ', CASE WHEN k % 7 = 0 THEN '-1' ELSE {_N} END, '}}}}}}}}', chr(10), '{{"level": "info-0", "msg": "m", "logger": "l"}}', chr(10), ' ', chr(10),
 CASE WHEN k % 5 = 0 THEN '{{"level": "error", "msg": "m", "logger": "l"}}' ELSE '{{"level": "info", "msg": "m", "logger": "l"}}' END, chr(10), CASE WHEN k % 3 = 0 THEN 'garbage' ELSE '' END)"""


@query(f"""SELECT k, 0 AS ordinal, CASE WHEN k % 7 = 0 THEN 'invalid' ELSE 'detection' END AS kind, CASE WHEN k % 7 <> 0 THEN 'AWS' END AS detector, CASE WHEN k % 7 <> 0 THEN concat('f', k) END AS file, CASE WHEN k % 7 <> 0 THEN k END AS line FROM {_K}
UNION ALL SELECT k, 1, 'information', NULL, NULL, NULL FROM {_K} UNION ALL SELECT k, 3, CASE WHEN k % 5 = 0 THEN 'error' ELSE 'information' END, NULL, NULL, NULL FROM {_K} UNION ALL SELECT k, 4, 'invalid', NULL, NULL, NULL FROM {_K} WHERE k % 3 = 0""")
def trufflehog_records(spark: SparkSession, d: str) -> DataFrame:
    return T.trufflehog(_reports(spark, d, _TRUFFLE), "k")


_GOVULN = f"""concat('{{"config": 1}} {{"osv": {{"id": "GO-', {_N}, '", "summary": "brace }} in text"}}}}', chr(10), '{{"finding": {{"osv": "GO-', {_N}, '", "trace": [{{"module": "m"}}]}}}}',
 CASE WHEN k % 2 = 0 THEN concat(chr(10), '{{"finding": {{"osv": "GO-', {_N}, '", "trace": [{{"package": "p", "function": "F", "position": {{"filename": "a.go", "line": 12}}}}]}}}}') ELSE '' END)"""


@query(f"""SELECT k, concat('GO-', k) AS osv, k % 2 = 0 AS reachable, CASE WHEN k % 2 = 0 THEN 'p' ELSE 'm' END AS package, CASE WHEN k % 2 = 0 THEN 'F' ELSE '' END AS "function", CASE WHEN k % 2 = 0 THEN 12 ELSE 0 END::BIGINT AS line, 'brace }} in text' AS summary, CASE WHEN k % 2 = 0 THEN 8.0 ELSE 5.0 END::DOUBLE AS cvss FROM {_K}""")
def govulncheck_findings(spark: SparkSession, d: str) -> DataFrame:
    reports = _reports(spark, d, _GOVULN).withColumnsRenamed({"k": "path", "output": "content"})
    return T.govulncheck(concatenated_json(reports).withColumnRenamed("path", "k"), "k")
