"""Dedup, classification, severity, coverage and scoring of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import coverage as C
from quarry.operators import dedup as D
from quarry.operators import scoring as S
from quarry.plans.registry import query
from quarry.sources.sinks import metric_lines
from quarry.sources.tables import FINDINGS_SQL, JOBS_SQL, findings, jobs, table

PATH = r"ltrim(regexp_replace(trim(replace(file, '\', '/')), '/+(\./)*', '/', 'g'), './')"
CLASS = """CASE WHEN contains(lower(title), 'command injection') OR contains(lower(title), 'os.system') OR contains(lower(title), 'popen') THEN 'command_injection'
 WHEN contains(lower(title), 'code injection') OR contains(lower(title), 'eval') OR contains(lower(title), 'rce') THEN 'code_injection'
 WHEN contains(lower(title), 'path traversal') OR contains(lower(title), 'directory traversal') THEN 'path_traversal' ELSE 'unknown' END"""
KEY = f"CASE WHEN {PATH} <> '' AND line > 0 THEN concat_ws('|', 'location', {PATH}, line, {CLASS}) ELSE concat_ws('|', 'unlocated', {PATH}, {CLASS}, lower(trim(title))) END"
LEVEL = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
BLOB = "lower(title || ' ' || description)"


def _first(rules: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({BLOB}, '{k.lower()}') THEN '{v}'" for k, v in rules.items()) + f" ELSE '{otherwise}' END"


@query(f"""WITH {FINDINGS_SQL}, k AS (SELECT *, {KEY} AS key, {LEVEL} AS level FROM findings)
SELECT key, arg_max(id, (level, cvss, length(description), -id)) AS id, arg_max(cvss, (level, cvss, length(description), -id)) AS cvss, min(id) AS first_seen, count(*)::BIGINT AS reports,
 coalesce(arg_max(coalesce(scan_job_id, -1), (level, cvss, length(description), -id)), -1) AS best_job, array_to_string(list_sort(list_distinct(list(tool))), ',') AS tools FROM k GROUP BY key""")
def observation_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    merged = D.merge_best(f, D.observation_key(F.col("file"), F.col("line"), D.canonical_class(F.lit(None).cast("string"), F.col("title")), F.col("title")), "id", [])
    return merged.select("key", "id", "cvss", "first_seen", "reports", F.coalesce("scan_job_id", F.lit(-1).cast("long")).alias("best_job"), F.array_join("tools", ",").alias("tools"))


@query(f"""WITH {FINDINGS_SQL}, a AS (SELECT * FROM findings WHERE id % 3 <> 0), b AS (SELECT DISTINCT tool, file, line, title FROM findings WHERE id % 3 = 0)
SELECT a.id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tool = a.tool AND b.file = a.file AND b.line = a.line AND b.title = a.title)""")
def ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return D.unseen(f.where("id % 3 <> 0"), f.where("id % 3 = 0"), ["tool", "file", "line", "title"]).select("id")


@query(f"""WITH {FINDINGS_SQL} SELECT id, {_first(S.KEYWORD_CATEGORY, 'A04')} AS category, {_first({k: S.DOMAIN_OF[v] for k, v in S.KEYWORD_CATEGORY.items() if v in S.DOMAIN_OF}, 'injection')} AS domain,
 CASE WHEN contains({BLOB}, 'command') OR contains({BLOB}, 'exec') OR contains({BLOB}, 'system') THEN 'X-1' WHEN contains({BLOB}, 'travers') THEN 'R-3' WHEN contains({BLOB}, 'sql') THEN 'R-2' ELSE 'X-13' END AS primitive FROM findings""")
def promoted_leads(spark: SparkSession, d: str) -> DataFrame:
    t = S.blob("title", "description")
    return findings(spark, d).select("id", S.category(t).alias("category"), S.domain(t).alias("domain"), S.primitive(t).alias("primitive"))


@query(f"""WITH {FINDINGS_SQL}, p AS (SELECT id, CASE tool WHEN 'taint-proximity' THEN 3 WHEN 'semgrep' THEN 2 WHEN 'config-audit' THEN 1 ELSE 0 END
 + CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END + CASE WHEN cvss >= 8 THEN 2 WHEN cvss >= 6 THEN 1 ELSE 0 END AS n FROM findings)
SELECT id, CASE WHEN n >= 5 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS level FROM p""")
def lead_confidence(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("id", S.confidence(F.col("tool"), F.col("confidence"), F.col("cvss")).alias("level"))


@query(f"""WITH {FINDINGS_SQL}, c AS (SELECT *, CASE WHEN contains(title, 'exhaustion') THEN 'denial_of_service' WHEN contains(title, 'Command') THEN 'command_injection' WHEN contains(title, 'SQL') THEN 'sql_injection' ELSE 'generic' END AS cls FROM findings)
SELECT id, CASE WHEN cls = 'denial_of_service' THEN least(cvss, 5.3) WHEN cls = 'command_injection' AND (cvss >= 7 OR tool = 'secret-grep') THEN greatest(cvss, 9.0)
 WHEN cls = 'sql_injection' AND (cvss >= 7 OR tool = 'secret-grep') THEN greatest(cvss, 8.0) ELSE cvss END AS score,
 CASE WHEN cls = 'denial_of_service' THEN 'deprioritized_dos' WHEN cls IN ('command_injection', 'sql_injection') AND (cvss >= 7 OR tool = 'secret-grep') THEN 'high_severity' ELSE 'normal' END AS priority FROM c""")
def severity_policy(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    cls = F.when(F.contains(t, F.lit("exhaustion")), "denial_of_service").when(F.contains(t, F.lit("Command")), "command_injection").when(F.contains(t, F.lit("SQL")), "sql_injection").otherwise("generic")
    score, priority = S.severity(F.col("cvss"), cls, F.col("tool"), ["secret-grep"])
    return findings(spark, d).select("id", score.alias("score"), priority.alias("priority"))


@query(f"""WITH {FINDINGS_SQL}, e AS (SELECT *, CASE WHEN contains(file, '/tests/') THEN 'In tests/ directory' WHEN contains(description, 'comment') THEN 'comment_or_string' END AS early FROM findings),
f AS (SELECT *, min(CASE WHEN early IS NULL THEN id END) OVER (PARTITION BY file, line, title) AS first_id FROM e)
SELECT id, coalesce(early, CASE WHEN id > first_id THEN 'duplicate' END) AS reason FROM f""")
def tier0_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return S.prefilter_reason(findings(spark, d), "id").select("id", "reason")


@query("""WITH m AS (SELECT p_partkey, [0.85, 0.62, 0.55, 0.20][(p_partkey % 4 + 1)::INT]::DOUBLE AS av, [0.77, 0.44][(p_partkey // 4 % 2 + 1)::INT]::DOUBLE AS ac, p_partkey // 8 % 2 = 1 AS changed,
 (CASE WHEN p_partkey // 8 % 2 = 1 THEN [0.85, 0.68, 0.50] ELSE [0.85, 0.62, 0.27] END)[(p_partkey % 3 + 1)::INT]::DOUBLE AS pr, [0.85, 0.62][(p_partkey // 3 % 2 + 1)::INT]::DOUBLE AS ui,
 [0.0, 0.22, 0.56][(p_size % 3 + 1)::INT]::DOUBLE AS c, [0.0, 0.22, 0.56][(p_size // 3 % 3 + 1)::INT]::DOUBLE AS i, [0.0, 0.22, 0.56][(p_size // 9 % 3 + 1)::INT]::DOUBLE AS a FROM part),
s AS (SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM m),
t AS (SELECT *, CASE WHEN changed THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42 * iss END AS impact, 8.22 * av * ac * pr * ui AS ease FROM s)
SELECT p_partkey, CASE WHEN impact <= 0 THEN 0.0::DOUBLE ELSE ceil((least(CASE WHEN changed THEN 1.08 * (impact + ease) ELSE impact + ease END, 10.0) - 1e-10) * 10) / 10 END AS score FROM t""")
def cvss_base_score(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    k, z = F.col("p_partkey"), F.col("p_size")
    div = lambda c, n: F.floor(c / n)
    score = S.cvss3(
        pick("NALP", k), pick("LH", div(k, 4)), pick("NLH", k), pick("NR", div(k, 3)), pick("UC", div(k, 8)), pick("NLH", z), pick("NLH", div(z, 3)), pick("NLH", div(z, 9))
    )
    return table(spark, d, "part").select("p_partkey", score.alias("score"))


@query(f"""WITH {FINDINGS_SQL}, f AS (SELECT file, {_first(S.KEYWORD_CATEGORY, 'A04')} AS category FROM findings)
SELECT file, {", ".join(f"CASE WHEN bool_or(category = '{c}') THEN 'covered' ELSE 'not_tested' END AS {c}" for c in S.CATEGORIES)} FROM f GROUP BY file""")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).withColumn("category", S.category(S.blob("title", "description")))
    return C.matrix(f, "file", "category", S.CATEGORIES)


_STATUS = "CASE WHEN line > 3 THEN 'covered' WHEN line > 1 THEN 'pending' WHEN line = 1 THEN 'running' ELSE 'blocked' END"


@query(f"""WITH {FINDINGS_SQL}, n AS (SELECT file, {_STATUS} AS status FROM findings),
t AS (SELECT file, count(*) AS total, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'blocked') AS blocked FROM n GROUP BY file)
SELECT *, CASE WHEN covered >= total THEN 100.0::DOUBLE ELSE least(round_even(100.0::DOUBLE * covered / total, 1), 99.9::DOUBLE) END AS percent, covered = total AS complete FROM t""")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.summary(findings(spark, d).select("file", F.expr(_STATUS).alias("status")), ["file"])


_TOOLSTATUS = "CASE id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' ELSE 'not-installed' END"


@query(f"""WITH {FINDINGS_SQL}, t AS (SELECT repo_id, {_TOOLSTATUS} AS status FROM findings)
SELECT repo_id, count(*)::BIGINT AS total, count(*) FILTER (status IN ('skipped', 'not-installed'))::BIGINT AS not_applicable, count(*) FILTER (status = 'completed')::BIGINT AS completed,
 round_even(100.0::DOUBLE * count(*) FILTER (status = 'completed') / greatest(count(*) FILTER (status NOT IN ('skipped', 'not-installed')), 1), 1) AS percent FROM t GROUP BY repo_id""")
def tool_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.tool_ledger(findings(spark, d).select("repo_id", F.expr(_TOOLSTATUS).alias("status")), ["repo_id"])


#: The five gates and the tools that open each. Fixed values.
GATES = {
    "forward_taint": ["taint-proximity", "cross-file-taint", "joern-cpg"],
    "sink_first": ["sink-first", "entry-point-dataflow", "api-surface"],
    "error_paths": ["methodology-patterns", "error-path-residue"],
    "dynamic_trace": ["dynamic-recon", "dynamic-path-exploration", "native-fuzzing"],
    "variant_analysis": ["silent-fix-variants", "sibling-variant", "pattern-transfer", "check-referent-mismatch"],
}
_TOOLS = [t for ts in GATES.values() for t in ts]
_RAN = "CASE id % 60 " + " ".join(f"WHEN {i * 2 + 1} THEN '{t}'" for i, t in enumerate(_TOOLS)) + " ELSE 'grep' END"


@query(f"""WITH {JOBS_SQL}, t AS (SELECT repo_id, list_distinct(list({_RAN})) AS tools FROM jobs WHERE status = 'completed' GROUP BY repo_id)
SELECT repo_id, {', '.join(f"list_has_any(tools, {ts!r}) AS {g}" for g, ts in GATES.items())}, {' AND '.join(f"list_has_any(tools, {ts!r})" for ts in GATES.values())} AS all_gates FROM t""")
def exhaustion_gates(spark: SparkSession, d: str) -> DataFrame:
    ran = jobs(spark, d).where("status = 'completed'").select("repo_id", F.expr(_RAN).alias("tool"))
    t = ran.groupBy("repo_id").agg(F.collect_set("tool").alias("tools"))  # at most the sixteen names
    return C.gates(t, "tools", GATES).drop("tools")


@query("""WITH x AS (SELECT d.lang, length(d.text) > 1500 AS p, l.quality = 1 AS a FROM documents d JOIN labels l USING (doc_id)),
t AS (SELECT lang, count(*) FILTER (p AND a)::BIGINT AS tp, count(*) FILTER (p AND NOT a)::BIGINT AS fp, count(*) FILTER (NOT p AND a)::BIGINT AS fn FROM x GROUP BY lang),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall FROM t),
g AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM r)
SELECT *, CASE WHEN f1 IS NULL THEN 'N/A' WHEN f1 >= 0.9 THEN 'A' WHEN f1 >= 0.75 THEN 'B' WHEN f1 >= 0.6 THEN 'C' WHEN f1 >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM g""")
def rule_scorecard(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    scored = S.precision_recall(x, ["lang"], F.length("text") > 1500, F.col("quality") == 1)
    return scored.withColumn("grade", S.grade(F.col("f1")))


@query(f"""WITH {FINDINGS_SQL} SELECT id, concat('f', part) AS name, spot AS line FROM (SELECT id, CAST(regexp_extract(description, ':([0-9]+)', 1) AS BIGINT) AS spot, regexp_extract(description, 'file=f([0-9]+[.]py)', 1) AS part FROM findings)""")
def parsed_locations(spark: SparkSession, d: str) -> DataFrame:
    path, line = T.location(F.lit(None).cast("string"), F.col("description"))
    return findings(spark, d).select("id", T.basename(path).alias("name"), line.alias("line"))


@query(f"""WITH {FINDINGS_SQL} SELECT id, CASE WHEN trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'untitled' ELSE substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) END AS slug,
 substr(sha256(length(tool) || ':' || tool || '|' || length(title) || ':' || title), 1, 20) AS task_id FROM findings""")
def slugs_and_task_ids(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("id", T.slug(F.col("title")).alias("slug"), T.content_id(F.col("tool"), F.col("title")).alias("task_id"))


@query(f"""WITH {FINDINGS_SQL}, t AS (SELECT tool, count(*) AS n FROM findings GROUP BY tool) SELECT 'findings_total{{tool="' || tool || '"}} ' || n AS line FROM t""")
def metric_exposition(spark: SparkSession, d: str) -> DataFrame:
    return metric_lines(findings(spark, d).groupBy("tool").agg(F.count("*").alias("n")), "findings_total", F.col("n"), tool=F.col("tool"))


_TOKENS = "SELECT {0} AS {1}, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM {2}"


@query(f"""WITH x AS ({_TOKENS.format('doc_id', 'a', 'documents')}), y AS ({_TOKENS.format('item_id', 'b', 'benchmark')}),
nx AS (SELECT a, count(*) AS nx FROM x GROUP BY a), ny AS (SELECT b, count(*) AS ny FROM y GROUP BY b), c AS (SELECT a, b, count(*) AS c FROM x JOIN y USING (t) GROUP BY a, b)
SELECT a, b, c::DOUBLE / (nx + ny - c) AS overlap FROM c JOIN nx USING (a) JOIN ny USING (b) WHERE c::DOUBLE / (nx + ny - c) >= 0.25""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """All documents against all benchmark items, at a Jaccard of 0.25 or more."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("a"), D.tokens(F.col("text")).alias("x"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("b"), D.tokens(F.col("text")).alias("y"))
    return D.similar_sets(a, b, 0.25)


@query()
def token_jaccard_all(spark: SparkSession, d: str) -> DataFrame:
    """All documents against all benchmark items. No SQL: it would list every pair."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("a"), D.tokens(F.col("text")).alias("x"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("b"), D.tokens(F.col("text")).alias("y"))
    return D.similar_sets(a, b, 0.65)
