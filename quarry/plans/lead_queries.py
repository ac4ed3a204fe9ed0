"""Classification, scoring against ground truth, history and key figures of leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import ontology as O
from quarry.operators import leads as L
from quarry.operators import scoring as S
from quarry.plans.registry import query
from quarry.sources.leads import LEADS_SQL, TRUTH_SQL, leads, truth
from quarry.sources.scratch import saved


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BLOB = "lower(concat_ws(' ', nullif(title, ''), nullif(tool, ''), nullif(description, '')))"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches({_BLOB}, {_q(O.short_pattern(s))}) THEN '{k}'" if len(s) <= O.SHORT else f"WHEN contains({_BLOB}, {_q(s)}) THEN '{k}'" for s, k in O.spellings()) + " ELSE 'generic' END"
_GROUP = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{g}'" for k, g in O.COMPATIBLE.items()) + f" ELSE {c} END"
_CLASSED = f"{LEADS_SQL}, classed AS (SELECT *, {_CLASS} AS bug_class FROM leads)"


def _classed(spark: SparkSession, d: str) -> DataFrame:
    return leads(spark, d).withColumn("bug_class", O.bug_class(F.col("title"), F.col("tool"), F.col("description")))


_OF = {k: (p, w) for k, (p, w, _) in O.CLASSES.items()}


@query(f"""WITH {_CLASSED} SELECT id, bug_class, CASE bug_class {' '.join(f"WHEN '{k}' THEN '{p}'" for k, (p, _) in _OF.items())} END AS primitive, CASE bug_class {' '.join(f"WHEN '{k}' THEN '{w}'" for k, (_, w) in _OF.items())} END AS owasp FROM classed""")
def classified_leads(spark: SparkSession, d: str) -> DataFrame:
    of = lambda i: F.create_map(*(F.lit(x) for k, v in _OF.items() for x in (k, v[i])))[F.col("bug_class")]
    return _classed(spark, d).select("id", "bug_class", of(0).alias("primitive"), of(1).alias("owasp"))


_HAS = lambda c, words: "(" + " OR ".join(f"contains(lower({c}), {_q(w)})" for w in words) + ")"
_TEXT = "(title || ' ' || description || ' ' || tool)"


@query(f"""WITH {LEADS_SQL}, t AS (SELECT *, {_TEXT} AS t FROM leads),
m AS ({' UNION ALL '.join(f"SELECT '{k}' AS label, qualification, lead_depth FROM t WHERE {_HAS('t', w)}" for k, w in O.PRIORITY_NEEDLES.items())})
SELECT label, count(*)::BIGINT AS n, (count(*) FILTER (qualification = 'QUALIFIED' OR lead_depth >= 3))::BIGINT AS qualified FROM m GROUP BY label""")
def priority_class_counts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ", "title", "description", "tool")
    rows = leads(spark, d).select(F.explode(O.labels(text, O.PRIORITY_NEEDLES)).alias("label"), ((F.col("qualification") == "QUALIFIED") | (F.col("lead_depth") >= 3)).alias("q"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("q").alias("qualified"))


_FLOOR = "CASE bug_class " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in S.FLOORS.items()) + " END"
_INVENTORY = "contains(title, 'no concern')"


@query(f"""WITH {_CLASSED}, s AS (SELECT id, bug_class, cvss, CASE WHEN {_INVENTORY} THEN 'inventory' WHEN bug_class = 'denial_of_service' THEN 'deprioritized_dos' WHEN {_FLOOR} IS NOT NULL AND (cvss >= 7 OR tool = 'secret-grep') THEN 'high_severity' ELSE 'normal' END AS priority, {_FLOOR} AS floor FROM classed)
SELECT id, priority, CASE priority WHEN 'deprioritized_dos' THEN least(cvss, {S.DOS_CAP}) WHEN 'high_severity' THEN greatest(cvss, floor) ELSE cvss END AS score, CASE priority WHEN 'high_severity' THEN 0 WHEN 'deprioritized_dos' THEN 2 ELSE 1 END::INT AS band FROM s""")
def severity_bands(spark: SparkSession, d: str) -> DataFrame:
    """Inventory rows have no class; the order is band, then falling score."""
    own = _classed(spark, d)
    inventory = F.contains("title", F.lit("no concern"))
    score, priority = S.severity(F.col("cvss"), F.col("bug_class"), F.col("tool"), ["secret-grep"])
    ranked = own.select("id", F.when(inventory, "inventory").otherwise(priority).alias("priority"), F.when(inventory, F.col("cvss")).otherwise(score).alias("score"))
    return ranked.withColumn("band", F.when(F.col("priority") == "high_severity", 0).when(F.col("priority") == "deprioritized_dos", 2).otherwise(1))


_CANDIDATES = f"""{_CLASSED}, {TRUTH_SQL}, cand AS (SELECT t.repo_id, t.gt_id, c.id FROM truth t JOIN classed c ON c.repo_id = t.repo_id AND {_GROUP('c.bug_class')} = {_GROUP('t.bug_class')}
 AND regexp_extract(c.file, '([^/]*)$', 1) = regexp_extract(t.file, '([^/]*)$', 1) AND (t.line IS NULL OR t.line = 0 OR c.line = 0 OR abs(t.line - c.line) <= 25))"""
_ASSIGNED = f"""WITH RECURSIVE {_CANDIDATES},
g AS (SELECT t.repo_id, t.gt_id, row_number() OVER (PARTITION BY t.repo_id ORDER BY t.gt_id) AS k, list_sort(list(c.id) FILTER (c.id IS NOT NULL)) AS ids FROM truth t LEFT JOIN cand c ON c.gt_id = t.gt_id GROUP BY t.repo_id, t.gt_id),
r AS (SELECT repo_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS gt_id, NULL::BIGINT AS id FROM (SELECT DISTINCT repo_id FROM g)
 UNION ALL SELECT repo_id, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, gt_id, pick FROM (SELECT g.repo_id, g.k, r.used, g.gt_id, list_filter(coalesce(g.ids, []::BIGINT[]), lambda x: NOT list_contains(r.used, x))[1] AS pick FROM r JOIN g ON g.repo_id = r.repo_id AND g.k = r.k + 1))"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    t = truth(spark, d).select("repo_id", "gt_id", O.class_group(F.col("bug_class")).alias("class"), base("file").alias("name"), F.col("line").alias("gt_line"))
    c = _classed(spark, d).select("repo_id", "id", O.class_group(F.col("bug_class")).alias("class"), base("file").alias("name"), "line")
    return L.greedy_line_assignment(t, c, ["repo_id", "class", "name"], "gt_id", "id", "gt_line", "line", 25)


@query(f"{_ASSIGNED} SELECT gt_id, id FROM r WHERE id IS NOT NULL")
def truth_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each labelled bug takes the first lead that is free and fits in class, file and line."""
    return _assigned(spark, d)


@query(f"""{_ASSIGNED}, m AS (SELECT t.repo_id, t.expected_status, r.id IS NOT NULL AS hit, l.status, l.confirmed FROM truth t JOIN r USING (gt_id) LEFT JOIN leads l ON l.id = r.id),
s AS (SELECT repo_id, (count(*) FILTER (hit))::BIGINT AS tp, (count(*) FILTER (NOT hit))::BIGINT AS fn, (count(*) FILTER (hit AND confirmed))::BIGINT AS confirmed,
 (count(*) FILTER (expected_status IN ('latent', 'unproven') AND status = 'report-eligible'))::BIGINT AS over_escalated, (count(*) FILTER (expected_status = 'report-eligible' AND status IN ('latent', 'below-threshold', 'unproven')))::BIGINT AS under_escalated FROM m GROUP BY repo_id),
f AS (SELECT repo_id, count(*)::BIGINT AS fp FROM leads WHERE status = 'report-eligible' AND id NOT IN (SELECT id FROM r WHERE id IS NOT NULL) GROUP BY repo_id)
SELECT repo_id, tp, fn, coalesce(fp, 0)::BIGINT AS fp, confirmed, over_escalated, under_escalated, CASE WHEN tp + coalesce(fp, 0) > 0 THEN tp::DOUBLE / (tp + coalesce(fp, 0)) END AS precision, tp::DOUBLE / (tp + fn) AS recall FROM s LEFT JOIN f USING (repo_id)""")
def truth_scorecard(spark: SparkSession, d: str) -> DataFrame:
    found = saved(_assigned(spark, d))
    own = leads(spark, d)
    m = truth(spark, d).select("repo_id", "gt_id", "expected_status").join(found, "gt_id", "left").join(own.select("id", "status", "confirmed"), "id", "left")
    hit, note = F.col("id").isNotNull(), L.status_note(F.col("expected_status"), F.col("status"))
    s = m.groupBy("repo_id").agg(
        F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn"), F.count_if(hit & F.col("confirmed")).alias("confirmed"), F.count_if(note == "over").alias("over_escalated"), F.count_if(note == "under").alias("under_escalated")
    )
    f = own.where("status = 'report-eligible'").join(found.select("id"), "id", "left_anti").groupBy("repo_id").agg(F.count("*").alias("fp"))
    out = s.join(f, "repo_id", "left").withColumn("fp", F.coalesce("fp", F.lit(0).cast("long")))
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


_KPI = """count(*) AS total, count(*) FILTER (qualification = 'QUALIFIED') AS qualified, count(*) FILTER (qualification = 'LATENT') AS latent, count(*) FILTER (status IN ('report-eligible', 'proven')) AS validated,
 count(*) FILTER (status IN ('report-eligible', 'proven') AND (qualification = 'QUALIFIED' OR conviction >= 2)) AS sure, sum(greatest(lead_depth, 1)) AS depths, count(*) FILTER (lead_depth >= 3) AS deep,
 count(*) FILTER (status IN ('report-eligible', 'proven') AND cvss >= 9 AND conviction >= 2) AS grave"""


@query(f"""WITH {LEADS_SQL}, n AS (SELECT repo_id, {_KPI} FROM leads GROUP BY repo_id)
SELECT repo_id, total, qualified, latent, validated, grave, round_even(CASE WHEN qualified > 0 THEN sure::DOUBLE / qualified ELSE 0 END, 3) AS confirm_rate, round_even(depths::DOUBLE / total, 2) AS depth_avg, round_even(100.0::DOUBLE * deep / total, 1) AS depth_ge3_pct,
 round_even((qualified * 2 + deep * 3 + sure * 5)::DOUBLE / 90.0, 3) AS high_signal_score FROM n""")
def discovery_kpis(spark: SparkSession, d: str) -> DataFrame:
    return L.discovery_kpis(leads(spark, d), ["repo_id"], 90.0)


_BEST = "(qualification <> 'QUALIFIED')::INT, -cvss, -greatest(lead_depth, 1), id"


@query(f"WITH {LEADS_SQL} SELECT id, title, cvss, row_number() OVER (ORDER BY {_BEST})::INT AS rank FROM leads QUALIFY rank <= 250")
def ranked_leads(spark: SparkSession, d: str) -> DataFrame:
    return L.best_leads(leads(spark, d), 250).select("id", "title", "cvss", "rank")


@query(f"WITH {LEADS_SQL} SELECT id, title, cvss, row_number() OVER (ORDER BY {_BEST})::INT AS rank FROM leads QUALIFY rank <= 25")
def top_leads(spark: SparkSession, d: str) -> DataFrame:
    return L.best_leads(leads(spark, d), 25).select("id", "title", "cvss", "rank")


@query(f"""WITH {LEADS_SQL} SELECT repo_id, lower(title) AS title_key, file, line, arg_max(id, (job_id, -id)) AS id, max(job_id) AS job_id FROM leads WHERE job_id < 5 GROUP BY ALL""")
def prior_leads(spark: SparkSession, d: str) -> DataFrame:
    return L.first_seen(leads(spark, d).where("job_id < 5"), ["repo_id"], "job_id", "id").select("repo_id", "title_key", "file", "line", "id", "job_id")


@query(f"""WITH {LEADS_SQL}, old AS (SELECT repo_id, lower(title) AS title_key, file, line, list_sort(list_distinct(list(job_id))) AS jobs, min(id) AS first_id FROM leads WHERE job_id < 5 GROUP BY ALL),
now AS (SELECT repo_id, lower(title) AS title_key, file, line, id FROM leads WHERE job_id >= 5)
SELECT id, coalesce(array_to_string(jobs, ','), '') AS prior_jobs, false AS candidate FROM now LEFT JOIN old USING (repo_id, title_key, file, line)
UNION ALL SELECT first_id, array_to_string(jobs, ','), true FROM old ANTI JOIN now USING (repo_id, title_key, file, line)""")
def merged_history(spark: SparkSession, d: str) -> DataFrame:
    own = leads(spark, d)
    return L.merged_history(own.where("job_id >= 5"), own.where("job_id < 5"), ["repo_id"]).select("id", F.array_join("prior_jobs", ",").alias("prior_jobs"), "candidate")


#: What the skills declare. Ours.
SKILLS = {"spring-beans": ["spring", "java"], "container-escape": ["docker", "dockerfile", "ci"], "yaml-loading": ["pyyaml", "yaml"], "graph-apis": ["graphql", "apollo"]}
_HAY = ["spring-boot-starter-web", "ci", "ml", "apollo-server", "pyyaml", "express", "yaml-cpp"]
_FILES = ["dockerfile", "docker-notes.md", "pom.xml"]


def _hay_sql(n: int) -> str:
    return f"list_filter({_HAY!r}, lambda x, i: (repo_id + i) % {n} <> 0)"


def _hit_sql(t: str) -> str:
    exact = f"list_contains(hay, '{t}') OR list_contains(names, '{t}')"
    return f"({exact} OR len(list_filter(hay, lambda h: length(h) >= 4 AND (contains(h, '{t}') OR contains('{t}', h)))) > 0)" if len(t) >= 4 else f"({exact})"


@query(f"""WITH p AS (SELECT DISTINCT user_id % 50 AS repo_id FROM events), q AS (SELECT repo_id, {_hay_sql(3)} AS hay, list_filter({_FILES!r}, lambda x, i: (repo_id + i) % 2 = 0) AS names FROM p)
{' UNION ALL '.join(f"SELECT repo_id, '{k}' AS skill, array_to_string([x FOR x IN [{', '.join(f'CASE WHEN {_hit_sql(t)} THEN {_q(t)} END' for t in ts)}] IF x IS NOT NULL], ',') AS matched FROM q" for k, ts in SKILLS.items())}""")
def skill_matches(spark: SparkSession, d: str) -> DataFrame:
    """Which of each skill's tokens a repository's profile has; the catalogue is part of the plan."""
    p = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 50).alias("repo_id")).distinct()
    some = lambda values, n, keep: F.filter(F.array(*map(F.lit, values)), lambda x, i: keep((F.col("repo_id") + i + 1) % n))
    q = p.select("repo_id", some(_HAY, 3, lambda r: r != 0).alias("hay"), some(_FILES, 2, lambda r: r == 0).alias("names"))
    every = F.array(*(F.struct(F.lit(k).alias("skill"), F.array_join(L.matched_tokens(ts, F.col("hay"), F.col("names")), ",").alias("matched")) for k, ts in SKILLS.items()))
    return q.select("repo_id", F.explode(every).alias("s")).select("repo_id", "s.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 3 ELSE greatest(1, least(5, p_size % 11 - 2)) END::INT AS depth,
 CASE WHEN p_size / 50.0 >= 0.85 THEN 'high' WHEN p_size / 50.0 >= 0.55 THEN 'medium' WHEN p_size > 0 THEN 'low' ELSE 'unavailable' END AS label FROM part""")
def levels_and_labels(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    level = F.when(F.col("p_size") % 11 == 0, None).otherwise((F.col("p_size") % 11 - 2).cast("int"))
    return p.select("p_partkey", L.depth_level(level).alias("depth"), L.confidence_label(F.col("p_size") / 50.0).alias("label"))
