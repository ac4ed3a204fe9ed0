"""Tables of a dataset folder, and audit-shaped projections of them.

The projections give the operators findings, jobs and files to work on. They
are written in SQL that Spark and DuckDB read alike, so that both sides start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if they are in fewer parts than that: a file of
    many small rows is one task's, whatever is then made of each row."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(2 * n)


#: Columns of a finding, from events.
FINDING = {
    "id": "event_id",
    "repo_id": "user_id % 50",
    "tool": "CASE event_id % 5 WHEN 0 THEN 'taint-proximity' WHEN 1 THEN 'semgrep' WHEN 2 THEN 'config-audit' WHEN 3 THEN 'grep' ELSE 'secret-grep' END",
    "title": "CASE event_type WHEN 'click' THEN 'Command injection via os.system' WHEN 'view' THEN 'Path traversal in download' WHEN 'signup' THEN 'Hardcoded API_KEY secret' "
    "WHEN 'purchase' THEN 'SQL concat in report query' ELSE 'Resource exhaustion: unbounded loop' END",
    "cvss": "CAST(event_id * 7919 % 101 AS DOUBLE) / 1e1",
    "confidence": "CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END",
    "file": "concat(CASE event_id % 3 WHEN 0 THEN './' ELSE '' END, 'app/', CASE user_id % 6 WHEN 0 THEN 'tests' WHEN 1 THEN 'core' WHEN 2 THEN 'api' ELSE 'lib' END, '/f', CAST(user_id % 20 AS STRING), '.py')",
    "line": "CAST(event_id % 97 AS BIGINT) - 3",
    "description": "concat('sink near input, file=f', CAST(user_id % 20 AS STRING), '.py:', CAST(event_id % 97 AS STRING), CASE WHEN event_id % 11 = 0 THEN ' in a comment' ELSE '' END)",
    "status": "CASE event_id % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'report-eligible' WHEN 2 THEN 'latent' ELSE 'unproven' END",
    "report_eligible": "event_id % 6 = 1",
    "triage": "CASE event_id % 9 WHEN 0 THEN 'accepted' WHEN 1 THEN 'suppressed' ELSE '' END",
    "created_at": "ts",
    "scan_job_id": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 500 + 1 END",
}
#: Columns of a scan job, from orders.
JOB = {
    "id": "o_orderkey",
    "repo_id": "o_custkey % 50",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END",
    "started_at": "o_orderdate",
    "cost": "o_totalprice",
}
#: Columns of a source file, from documents.
FILE = {
    "path": "concat('src/', source, '/', CASE doc_id % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN 'vendor/' ELSE '' END, 'd', CAST(doc_id AS STRING), '.', CASE WHEN doc_id % 4 = 0 THEN 'py' WHEN doc_id % 4 = 1 THEN 'go' WHEN doc_id % 4 = 2 THEN 'js' ELSE 'md' END)",
    "doc_id": "doc_id",
    "content": "coalesce(text, '')",
}


def _select(shape: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in shape.items())


#: The same as common table expressions of an oracle's WITH.
FINDINGS_SQL = f"findings AS (SELECT {_select(FINDING)} FROM events)"
JOBS_SQL = f"jobs AS (SELECT {_select(JOB)} FROM orders)"
FILES_SQL = f"files AS (SELECT {_select(FILE)} FROM documents)"


def _shaped(df: DataFrame, shape: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{e} AS {c}" for c, e in shape.items()))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(table(spark, sf_dir, "events"), FINDING)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(table(spark, sf_dir, "orders"), JOB)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(table(spark, sf_dir, "documents"), FILE)
