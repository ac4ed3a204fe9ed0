"""Filters, joins, aggregates, ranking and sets over audit-shaped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.plans.registry import query
from quarry.sources.tables import FINDINGS_SQL, JOBS_SQL, findings, jobs, table

STATUSES = ["completed", "running", "queued", "paused", "failed", "cancelled"]
VALUES = ", ".join(f"('{s}')" for s in STATUSES)


@query(f"""WITH {JOBS_SQL}, latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY id DESC) = 1),
s(status) AS (VALUES {VALUES}) SELECT s.status, count(l.id)::BIGINT AS n FROM s LEFT JOIN latest l USING (status) GROUP BY s.status""")
def dashboard_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.zero_filled_counts(R.latest_per_group(jobs(spark, d), "repo_id", "id"), "status", STATUSES)


@query(f"WITH {JOBS_SQL} SELECT id, repo_id, status, started_at, cost FROM jobs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, id DESC) = 1")
def latest_job_per_repo(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_per_group(jobs(spark, d), "repo_id", "started_at", "id")


@query(f"WITH {JOBS_SQL} SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, id ASC)::INT AS rank FROM jobs QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY started_at DESC, id ASC) <= 2")
def two_latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked_per_group(jobs(spark, d), ["repo_id"], [F.desc("started_at"), F.asc("id")], 2).select("repo_id", "id", "rank")


@query(f"""WITH {FINDINGS_SQL}, cur AS (SELECT DISTINCT lower(trim(concat(title, ' ', file))) AS key FROM findings WHERE created_at >= TIMESTAMP '2024-01-20'),
prev AS (SELECT DISTINCT lower(trim(concat(title, ' ', file))) AS key FROM findings WHERE created_at < TIMESTAMP '2024-01-02')
SELECT coalesce(cur.key, prev.key) AS key, CASE WHEN prev.key IS NULL THEN 'new' WHEN cur.key IS NULL THEN 'resolved' ELSE 'persistent' END AS state FROM cur FULL JOIN prev ON cur.key = prev.key""")
def findings_diff(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).withColumn("key", F.lower(F.trim(F.concat_ws(" ", "title", "file"))))
    return R.key_diff(f.where("created_at >= '2024-01-20'"), f.where("created_at < '2024-01-02'"), "key")


@query(f"""WITH {FINDINGS_SQL}, {JOBS_SQL}, latest AS (SELECT repo_id, max(id % 500 + 1) AS job_id, TIMESTAMP '2024-01-15' AS started_at FROM jobs GROUP BY repo_id)
SELECT f.id, f.repo_id, f.scan_job_id FROM findings f LEFT JOIN latest l USING (repo_id)
WHERE CASE WHEN f.scan_job_id IS NULL THEN l.started_at IS NULL OR epoch_us(l.started_at) - epoch_us(f.created_at) <= 1000000 ELSE coalesce(f.scan_job_id = l.job_id, false) END""")
def current_audit_findings(spark: SparkSession, d: str) -> DataFrame:
    latest = jobs(spark, d).groupBy("repo_id").agg(F.max(F.col("id") % 500 + 1).alias("job_id")).withColumn("started_at", F.lit("2024-01-15").cast("timestamp_ntz"))
    return R.current_scope(findings(spark, d), latest).select("id", "repo_id", "scan_job_id")


@query(f"WITH {FINDINGS_SQL} SELECT id, cvss, title FROM findings WHERE repo_id IN (3, 4, 5) AND triage = '' AND (scan_job_id IS NULL OR cvss >= 7) ORDER BY cvss DESC, created_at DESC, id DESC LIMIT 50 OFFSET 20")
def findings_page(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where(F.col("repo_id").isin(3, 4, 5) & (F.col("triage") == "") & (F.col("scan_job_id").isNull() | (F.col("cvss") >= 7)))
    return R.page(f, [F.desc("cvss"), F.desc("created_at"), F.desc("id")], 50, 20).select("id", "cvss", "title")


@query(f"WITH {FINDINGS_SQL} SELECT id, tool FROM findings WHERE id > 1000 ORDER BY id LIMIT 256")
def findings_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return R.keyset_page(findings(spark, d), "id", 1000, 256).select("id", "tool")


@query(f"WITH {FINDINGS_SQL} SELECT id, tool FROM findings WHERE id < 5000 ORDER BY id DESC LIMIT 64")
def findings_reverse_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return R.page(findings(spark, d).where("id < 5000"), [F.desc("id")], 64).select("id", "tool")


@query(f"""WITH {FINDINGS_SQL} SELECT repo_id, count(*)::BIGINT AS findings, count(*) FILTER (cvss >= 9)::BIGINT AS critical, count(*) FILTER (cvss >= 7 AND cvss < 9)::BIGINT AS high,
count(*) FILTER (cvss >= 4 AND cvss < 7)::BIGINT AS medium, count(*) FILTER (cvss < 4)::BIGINT AS low, count(*) FILTER (status = 'confirmed')::BIGINT AS confirmed, round(avg(cvss), 6) AS mean_cvss FROM findings GROUP BY repo_id""")
def audit_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cvss")
    return findings(spark, d).groupBy("repo_id").agg(
        F.count("*").alias("findings"), F.count_if(c >= 9).alias("critical"), F.count_if((c >= 7) & (c < 9)).alias("high"), F.count_if((c >= 4) & (c < 7)).alias("medium"),
        F.count_if(c < 4).alias("low"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.round(F.avg("cvss"), 6).alias("mean_cvss"),
    )


@query("""SELECT c_custkey AS repo_id, coalesce(n, 0)::BIGINT AS n_jobs, coalesce(done, 0)::BIGINT AS n_done FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def repos_with_job_counts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return table(spark, d, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("repo_id"), zero("n").alias("n_jobs"), zero("done").alias("n_done"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def repos_with_active_job(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(live, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def repos_without_job(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(f"WITH {JOBS_SQL} SELECT repo_id, count(*)::BIGINT AS active FROM jobs WHERE status = 'running' GROUP BY repo_id HAVING count(*) > 1")
def duplicate_active_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The check that stands in for a partial unique index."""
    return jobs(spark, d).where("status = 'running'").groupBy("repo_id").agg(F.count("*").alias("active")).where("active > 1")


@query("""SELECT DISTINCT p.event_id AS purchase, e.event_id AS error FROM events p JOIN events e ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.event_type = 'error'
AND abs(epoch_us(p.ts) // 1000000 - epoch_us(e.ts) // 1000000) <= 600""")
def tolerance_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("s").alias("bought"))
    b = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error"), F.col("s").alias("failed"))
    return R.tolerance_join(a, b, "user_id", "bought", "failed", 600).select("purchase", "error")


@query("""WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT p.event_id AS purchase, arg_max(c.event_id, (c.ts, c.event_id)) AS click FROM p LEFT JOIN c ON c.user_id = p.user_id AND (c.ts < p.ts OR (c.ts = p.ts AND c.event_id < p.event_id)) GROUP BY p.event_id""")
def nearest_click_before_purchase(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('click', 'purchase')")
    near = R.nearest_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_id"), "click")
    return near.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "click")


@query(f"""WITH {FINDINGS_SQL}, r AS (SELECT id, tool, repo_id, row_number() OVER (PARTITION BY repo_id, tool ORDER BY cvss DESC, id) AS a FROM findings),
s AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY a, tool, id) AS b FROM r WHERE a <= 5) SELECT id, tool, repo_id FROM s WHERE b <= 12""")
def per_group_caps(spark: SparkSession, d: str) -> DataFrame:
    first = R.ranked_per_group(findings(spark, d), ["repo_id", "tool"], [F.desc("cvss"), F.asc("id")], 5, "a")
    return R.ranked_per_group(first, ["repo_id"], [F.asc("a"), F.asc("tool"), F.asc("id")], 12, "b").select("id", "tool", "repo_id")


@query(f"WITH {FINDINGS_SQL} SELECT repo_id, file, line, id, ((row_number() OVER (PARTITION BY repo_id ORDER BY file, line, id) - 1) // 32)::BIGINT AS batch FROM findings")
def review_batches(spark: SparkSession, d: str) -> DataFrame:
    return R.batches(findings(spark, d), ["file", "line", "id"], 32, "repo_id").select("repo_id", "file", "line", "id", F.col("batch").cast("long").alias("batch"))


@query(f"""WITH {FINDINGS_SQL}, u AS (SELECT *, 0 AS part FROM findings WHERE tool = 'semgrep' UNION ALL SELECT *, 1 FROM findings WHERE tool = 'grep')
SELECT tool, file, title, id FROM u QUALIFY row_number() OVER (PARTITION BY file, title ORDER BY part, id) = 1""")
def detector_union_first(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).select("tool", "file", "title", "id")
    return R.first_of_union([f.where("tool = 'semgrep'"), f.where("tool = 'grep'")], ["file", "title"], "id").select("tool", "file", "title", "id")


@query(f"WITH {FINDINGS_SQL} SELECT file, title FROM findings WHERE tool = 'semgrep' INTERSECT SELECT file, title FROM findings WHERE tool = 'grep'")
def tool_agreement(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return f.where("tool = 'semgrep'").select("file", "title").intersect(f.where("tool = 'grep'").select("file", "title"))


@query(f"WITH {FINDINGS_SQL} SELECT file, title FROM findings WHERE tool = 'semgrep' EXCEPT SELECT file, title FROM findings WHERE tool = 'grep'")
def tool_gain(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return f.where("tool = 'semgrep'").select("file", "title").subtract(f.where("tool = 'grep'").select("file", "title"))


@query(f"""WITH {JOBS_SQL} SELECT id, row_number() OVER (PARTITION BY repo_id ORDER BY id)::INT AS place FROM jobs WHERE status = 'queued'""")
def queue_positions(spark: SparkSession, d: str) -> DataFrame:
    queued = jobs(spark, d).where("status = 'queued'")
    return R.numbered(queued, ["repo_id"], ["id"], F.floor(F.col("id") / 100_000), "place").select("id", F.col("place").cast("int").alias("place"))


@query(f"WITH {JOBS_SQL} SELECT repo_id, median(cost) AS median_cost, avg(cost) AS mean_cost, count(*)::BIGINT AS n FROM jobs GROUP BY repo_id")
def duration_estimates(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).groupBy("repo_id").agg(F.median("cost").alias("median_cost"), F.avg("cost").alias("mean_cost"), F.count("*").alias("n"))


@query(f"WITH {FINDINGS_SQL} SELECT tool, count(*)::BIGINT AS n, count(DISTINCT file)::BIGINT AS files, max(created_at) AS last_seen FROM findings GROUP BY tool")
def counts_by_tool(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("tool").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.max("created_at").alias("last_seen"))


@query(f"WITH {FINDINGS_SQL} SELECT file, count(*)::BIGINT AS n FROM findings WHERE contains(lower(file), lower('API')) GROUP BY file ORDER BY file LIMIT 25")
def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    hit = findings(spark, d).where(F.contains(F.lower("file"), F.lower(F.lit("API")))).groupBy("file").agg(F.count("*").alias("n"))
    return R.page(hit, [F.asc("file")], 25)


@query("""SELECT doc_id, substr(text, 1, 200) AS head, length(text) > 200 AS clipped FROM documents""")
def clipped_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("head"), (F.length("text") > 200).alias("clipped"))


@query(f"""WITH {FINDINGS_SQL}, x AS (SELECT f.*, floor(cvss) AS b FROM findings f) SELECT repo_id, arg_max(id, (cvss, -id)) AS best, max(cvss) AS cvss FROM x GROUP BY repo_id""")
def best_usage_per_package(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy("repo_id").agg(F.max_by("id", F.struct("cvss", -F.col("id"))).alias("best"), F.max("cvss").alias("cvss"))


@query("""SELECT r_name, n_name, count(s_suppkey)::BIGINT AS suppliers, sum(coalesce(s_acctbal, 0)) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_extension(spark: SparkSession, d: str) -> DataFrame:
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    wide = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return wide.rollup("r_name", "n_name").agg(F.count("s_suppkey").alias("suppliers"), F.sum(F.coalesce("s_acctbal", F.lit(0.0))).alias("balance"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )
