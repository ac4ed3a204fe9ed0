"""Manifests, imports, risky uses and captured sources of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dependencies as D
from quarry.plans.registry import query
from quarry.sources.projects import PROJECTS_SQL, ROOTS_SQL, projects, roots
from quarry.sources.scratch import saved

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_DECLARED_SQL = rf"""{PROJECTS_SQL}, pl AS (SELECT project, path, unnest(range(len(l))) + 1 AS line, trim(unnest(l), ' ' || chr(9) || chr(13)) AS t FROM (SELECT *, string_split(content, chr(10)) AS l FROM projects WHERE j = 0 AND content IS NOT NULL)),
py AS (SELECT project, path, line, 'python' AS ecosystem, CASE WHEN t LIKE '-%' THEN NULL WHEN regexp_matches(t, '^([a-zA-Z0-9_.-]+)\s*[=><!~]+\s*([0-9.]+)') THEN regexp_extract(t, '^([a-zA-Z0-9_.-]+)\s*[=><!~]+\s*([0-9.]+)', 1) WHEN regexp_matches(t, '^[a-zA-Z0-9_.-]+$') THEN t END AS package,
 regexp_extract(t, '^([a-zA-Z0-9_.-]+)\s*[=><!~]+\s*([0-9.]+)', 2) AS version, false AS dev FROM pl WHERE path = 'requirements.txt' AND t <> '' AND t NOT LIKE '#%'),
js AS (SELECT project, path, 0 AS line, 'node' AS ecosystem, k AS package, regexp_replace(json_extract_string(content, s || '."' || k || '"'), '^[^0-9]*', '') AS version, s = '$.devDependencies' AS dev
 FROM (SELECT *, unnest(json_keys(content, s)) AS k FROM projects, (VALUES ('$.dependencies'), ('$.devDependencies')) x(s) WHERE path = 'package.json' AND json_valid(content))),
lk AS (SELECT project, path, 0 AS line, 'node' AS ecosystem, coalesce(json_extract_string(content, '$.packages."' || k || '".name'), regexp_replace(k, '^.*node_modules/', '')) AS package, coalesce(json_extract_string(content, '$.packages."' || k || '".version'), '') AS version,
 coalesce(json_extract_string(content, '$.packages."' || k || '".dev') = 'true', false) AS dev FROM (SELECT *, unnest(json_keys(content, '$.packages')) AS k FROM projects WHERE path = 'package-lock.json') WHERE k LIKE 'node_modules/%'),
rb AS (SELECT project, path, line, 'ruby' AS ecosystem, regexp_extract(t, '^([a-zA-Z0-9_.-]+)\s*\(([0-9.]+)', 1) AS package, regexp_extract(t, '^([a-zA-Z0-9_.-]+)\s*\(([0-9.]+)', 2) AS version, false AS dev
 FROM (SELECT *, last_value(CASE WHEN t = 'specs:' THEN true WHEN t = '' THEN false END IGNORE NULLS) OVER (PARTITION BY project ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM pl WHERE path = 'Gemfile.lock') WHERE inside AND regexp_matches(t, '^([a-zA-Z0-9_.-]+)\s*\(([0-9.]+)')),
jv AS (SELECT project, path, 1 + len(before) - len(replace(before, chr(10), '')) AS line, 'java' AS ecosystem, package, version, false AS dev FROM (SELECT project, path, package, version, content[1:instr(content, '<artifactId>' || package || '<') - 1] AS before FROM (SELECT project, path, content,
 unnest(regexp_extract_all(content, '<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>', 1)) AS package, unnest(regexp_extract_all(content, '<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>', 2)) AS version FROM projects WHERE path = 'pom.xml'))),
gm AS (SELECT project, path, line, 'go' AS ecosystem, CASE WHEN t NOT LIKE 'require%' THEN regexp_extract(t, '^(\S+)', 1) END AS package, CASE WHEN t NOT LIKE 'require%' THEN regexp_extract(t, '^\S+\s+(\S+)', 1) END AS version, false AS dev FROM pl WHERE path = 'go.mod' AND (t LIKE 'github%' OR t = 'require broken')),
d AS (SELECT *, CASE WHEN package IS NULL THEN 'unresolved requirement' END AS gap FROM py UNION ALL SELECT *, NULL FROM js UNION ALL SELECT *, NULL FROM lk UNION ALL SELECT *, NULL FROM rb UNION ALL SELECT *, NULL FROM jv UNION ALL SELECT *, CASE WHEN package IS NULL THEN 'unresolved line' END FROM gm
 UNION ALL SELECT project, path, 0, 'node', NULL, NULL, false, 'malformed manifest' FROM projects WHERE path = 'package.json' AND NOT json_valid(content)),
declared AS (SELECT project, path, line::INT AS line, ecosystem, package, CASE WHEN package IS NOT NULL THEN version END AS version, dev, gap FROM d),
packages AS (SELECT project, min(package) AS package, version FROM declared WHERE package IS NOT NULL AND NOT dev GROUP BY project, lower(package), version)"""


def _declared(files: DataFrame) -> DataFrame:
    return D.declared(files.where("j = 0"), ["project"])


def _packages(files: DataFrame) -> DataFrame:
    return D.inventory(_declared(files), ["project"])


def _usages(files: DataFrame) -> DataFrame:
    return D.usages(files.where("j > 0"), _packages(files), ["project"])


@query(f"WITH {_DECLARED_SQL} SELECT * FROM declared")
def declared_packages(spark: SparkSession, d: str) -> DataFrame:
    return _declared(saved(projects(spark, d)))  # each format reads the snapshot


@query(f"WITH {_DECLARED_SQL} SELECT project, package, version FROM packages")
def manifest_inventory(spark: SparkSession, d: str) -> DataFrame:
    return _packages(saved(projects(spark, d)))


_KEY = "replace(lower(trim({})), '-', '_')"
_RISK_ROWS = ", ".join(f"({i}, {_Q(h)}, {_Q(p)})" for i, (h, p) in enumerate((h, p) for h, own in D.RISKY.items() for p in own))
_USED_SQL = rf"""{_DECLARED_SQL}, idx AS (SELECT project, norm, max(package) AS package FROM (SELECT project, {_KEY.format('package')} AS norm, package FROM packages UNION ALL SELECT project, CASE {_KEY.format('package')} {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in D.IMPORTED_AS.items())} END, package FROM packages) WHERE norm IS NOT NULL GROUP BY ALL),
risky(i, hint, pattern) AS (VALUES {_RISK_ROWS}), src AS (SELECT project, path, content, string_split(content, chr(10)) AS ls FROM projects WHERE j > 0 AND content IS NOT NULL AND NOT regexp_matches(path, '\.(java|php|rs)$')),
pats(p) AS (VALUES {", ".join(f"({_Q(p)})" for p in D.IMPORTS)}),
im AS (SELECT project, path, {_KEY.format('raw')} AS raw, min(1 + len(b) - len(replace(b, chr(10), ''))) AS line FROM (SELECT project, path, raw, pieces, found, array_to_string(list_transform(range(1, k + 1), lambda i: pieces[i] || CASE WHEN i < k THEN found[i] ELSE '' END), '') AS b
 FROM (SELECT project, path, string_split_regex(content, p) AS pieces, regexp_extract_all(content, p, 0) AS found, unnest(regexp_extract_all(content, p, 1)) AS raw, unnest(range(1, len(regexp_extract_all(content, p, 1)) + 1)) AS k FROM src, pats)) GROUP BY ALL),
ma AS (SELECT im.project, im.path, im.line, im.raw, arg_max(idx.norm, length(idx.norm)) AS norm FROM im JOIN idx ON idx.project = im.project AND (im.raw = idx.norm OR starts_with(im.raw, idx.norm || '/') OR starts_with(im.raw, idx.norm || '.')) GROUP BY ALL),
mb AS (SELECT project, path, line, norm FROM ma UNION ALL SELECT project, path, line, split_part(raw, '.', 1) FROM im WHERE split_part(raw, '.', 1) IN (SELECT hint FROM risky) AND NOT EXISTS (SELECT 1 FROM ma WHERE ma.project = im.project AND ma.path = im.path AND ma.raw = im.raw)),
mc AS (SELECT * FROM mb UNION ALL SELECT DISTINCT project, path, 0, hint FROM src s JOIN risky ON regexp_matches(content, pattern) WHERE NOT EXISTS (SELECT 1 FROM mb WHERE mb.project = s.project AND mb.path = s.path)),
md AS (SELECT m.project, m.path, m.norm, min(m.line) AS line, coalesce(any_value(idx.package), m.norm) AS package FROM mc m LEFT JOIN idx USING (project, norm) GROUP BY m.project, m.path, m.norm),
me AS (SELECT md.* EXCLUDE (line), ls, CASE WHEN line > 0 THEN line ELSE coalesce(list_position(list_transform(ls, lambda s: contains(replace(lower(s), '-', '_'), norm) OR contains(lower(s), lower(package))), true), 1) END AS line FROM md JOIN src USING (project, path)),
mf AS (SELECT *, array_to_string(ls[greatest(line - {D.BEFORE}, 1):line + {D.AFTER}], chr(10)) AS w FROM me),
mg AS (SELECT project, path, line, package, norm, regexp_matches(w, {_Q(D.TAINT)}) AS near_input, coalesce((SELECT arg_min(regexp_extract(w, pattern, 0), i) FROM risky WHERE (contains(norm, hint) OR contains({_KEY.format('package')}, hint)) AND regexp_matches(w, pattern)), '') AS risky_call FROM mf),
used AS (SELECT project, path, line::INT AS line, package, norm AS import_name, near_input, risky_call[:100] AS risky_call, CASE WHEN near_input AND risky_call <> '' THEN 'critical' WHEN near_input THEN 'high' WHEN risky_call <> '' THEN 'medium' ELSE 'low' END AS risk
 FROM mg QUALIFY row_number() OVER (PARTITION BY project, path, line, package ORDER BY norm) = 1)"""


@query(f"WITH {_USED_SQL} SELECT project, path, line, package, import_name, near_input, risky_call, risk FROM used")
def dependency_usages(spark: SparkSession, d: str) -> DataFrame:
    return _usages(saved(projects(spark, d)))


@query(f"""WITH {_USED_SQL}, r AS (SELECT *, list_position(['low', 'medium', 'high', 'critical'], risk) AS rank, count(*) OVER (PARTITION BY project, package) AS sites FROM used)
SELECT project, package, path, line, risk, risky_call, CASE risk WHEN 'critical' THEN 8.5 WHEN 'high' THEN 7.0 ELSE 5.5 END::DOUBLE AS cvss, sites::BIGINT AS sites FROM r QUALIFY row_number() OVER (PARTITION BY project, package ORDER BY rank DESC, line, path) = 1 AND risk <> 'low'""")
def reachable_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return D.reachable(_usages(saved(projects(spark, d))), ["project"])


@query(f"""WITH {_DECLARED_SQL}, {ROOTS_SQL}, r AS (SELECT project, name, count(DISTINCT root) AS n, min(root) AS root FROM roots GROUP BY ALL)
SELECT p.project, p.package, p.version, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'captured' END AS source_status, CASE WHEN n = 1 THEN root END AS root FROM packages p LEFT JOIN r ON r.project = p.project AND r.name = p.package""")
def dependency_sources(spark: SparkSession, d: str) -> DataFrame:
    return D.bound_sources(_packages(saved(projects(spark, d))), roots(spark, d), ["project"])


@query(f"""WITH {_USED_SQL}, {ROOTS_SQL}, r AS (SELECT project, name, min(root) AS root FROM roots GROUP BY ALL HAVING count(DISTINCT root) = 1),
n AS (SELECT project, package, (40 + max(CASE WHEN risky_call <> '' THEN 10 ELSE 0 END) + least(count(*), 9))::INT AS score FROM used WHERE near_input GROUP BY ALL)
SELECT n.project, n.package, r.root, n.score, (row_number() OVER (PARTITION BY n.project ORDER BY score DESC, n.package, root))::INT AS place FROM n JOIN r ON r.project = n.project AND r.name = n.package WHERE (n.project, n.package) IN (SELECT (project, package) FROM packages) QUALIFY place <= 2""")
def dependency_audit_candidates(spark: SparkSession, d: str) -> DataFrame:
    files = saved(projects(spark, d))
    packages = saved(_packages(files))  # manifests are read once, for the uses and for the sources
    bound = D.bound_sources(packages, roots(spark, d), ["project"])
    return D.audit_candidates(D.usages(files.where("j > 0"), packages, ["project"]), bound, ["project"], 2)
