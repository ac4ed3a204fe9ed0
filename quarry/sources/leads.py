"""Leads and ground truth made from ``part`` and ``supplier``, in SQL that
Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import _select, _shaped, spread, table

TITLES = [
    "SQLi in login form", "Command injection via os.system", "OOB read in parser", "DoS: parser hang on long input", "Hardcoded JWT secret", "Path traversal in download", "Zip slip on extract", "SSRF to metadata host",
    "Reflected XSS in search", "IDOR on invoice policy", "Unsafe pickle of session token", "XXE in import", "Buffer overflow in strcpy call", "Integer overflow feeding malloc", "Template injection in jinja view", "eval( of expression",
    "Sibling route without guard", "Weak PRNG for tokens", "Exposed v1/shell endpoint", "Strange log line", "Rhodos island of no concern", "Unbounded loop in upstream proxy", "YAML.load of body (deserialization gadget)", "Broken access control in admin RBAC",
]
_TITLE = "CASE p_partkey % 24 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES)) + " END"
LEAD = {
    "id": "CAST(p_partkey AS BIGINT)",
    "repo_id": "CAST(p_partkey % 12 AS BIGINT)",
    "job_id": "CAST(p_size % 7 AS BIGINT)",
    "title": _TITLE,
    "tool": "CASE p_partkey % 5 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'taint-proximity' WHEN 2 THEN 'guard-alternate-path' WHEN 3 THEN 'methodology-patterns' ELSE 'secret-grep' END",
    "description": "concat('seen near input, file=svc', CAST(p_size % 9 AS STRING), '.py:', CAST(p_partkey % 60 AS STRING))",
    "file": "concat('svc/core/svc', CAST(p_size % 9 AS STRING), '.py')",
    "line": "CAST(p_partkey % 60 AS BIGINT)",
    "cvss": "CAST(p_partkey * 37 % 101 AS DOUBLE) / 1e1",
    "status": "CASE p_partkey % 5 WHEN 0 THEN 'report-eligible' WHEN 1 THEN 'latent' WHEN 2 THEN 'unproven' WHEN 3 THEN 'proven' ELSE 'below-threshold' END",
    "qualification": "CASE p_size % 3 WHEN 0 THEN 'QUALIFIED' WHEN 1 THEN 'LATENT' ELSE '' END",
    "lead_depth": "CAST(p_size % 5 AS BIGINT)",
    "conviction": "CAST(p_partkey % 4 AS BIGINT)",
    "confirmed": "p_partkey % 5 = 0 OR p_size % 10 = 1",
}
TRUTH = {
    "gt_id": "CAST(s_suppkey AS BIGINT)",
    "repo_id": "CAST(s_suppkey % 12 AS BIGINT)",
    "bug_class": "CASE s_suppkey % 7 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'command_injection' WHEN 2 THEN 'path_traversal_write' WHEN 3 THEN 'weak_secret' WHEN 4 THEN 'integer_overflow' WHEN 5 THEN 'authz_bypass' ELSE 'code_injection' END",
    "file": "concat('src/svc', CAST(s_suppkey % 9 AS STRING), '.py')",
    "line": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey * 7 % 60 AS BIGINT) END",
    "expected_status": "CASE s_suppkey % 3 WHEN 0 THEN 'report-eligible' WHEN 1 THEN 'latent' ELSE 'unproven' END",
}
LEADS_SQL = f"leads AS (SELECT {_select(LEAD)} FROM part)"
TRUTH_SQL = f"truth AS (SELECT {_select(TRUTH)} FROM supplier)"


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spread(table(spark, sf_dir, "part")), LEAD)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(table(spark, sf_dir, "supplier"), TRUTH)
