"""The source detectors over the code table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import batteries as B
from quarry.functions import detectors as D
from quarry.operators import patterns as P
from quarry.plans.registry import query
from quarry.sources import text as X
from quarry.sources.code import CODE_SQL, code

CODE_LINES_SQL = f"{CODE_SQL}, lines AS (SELECT path, kind, unnest(range(len(ls))) + 1 AS line, unnest(ls) AS line_text FROM (SELECT path, kind, string_split(content, chr(10)) AS ls FROM code))"


def _quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _rules_sql(rules: dict[str, list] | list, any_case: bool = False) -> str:
    flag = "(?i)" if any_case else ""
    rows = []
    for kind, own in rules.items() if isinstance(rules, dict) else [(None, rules)]:
        for i, (p, t, c, *u) in enumerate(own):
            rows.append(f"({_quoted(kind)}, {i}, {_quoted(flag + p)}, {_quoted(t)}, {c}::DOUBLE, {_quoted(f'^(?:{flag}{u[0]})' if u else None)})")
    return f"rules(of, rule, pattern, title, cvss, unless) AS (VALUES {', '.join(rows)})"


def _content_sql(rules: dict[str, list] | list, any_case: bool = False, where: str = "true") -> str:
    """Rows of scan_content(): the breaks before each match give its line."""
    breaks = "len({0}) - len(replace({0}, chr(10), ''))"
    return f"""WITH {CODE_SQL}, {_rules_sql(rules, any_case)},
m AS (SELECT path, rule, title, cvss, unless, regexp_extract_all(content, pattern, 0) AS found, string_split_regex(content, pattern) AS pieces FROM code JOIN rules ON (of IS NULL OR of = kind) AND regexp_matches(content, pattern) WHERE {where}),
x AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM m)
SELECT path, title, cvss, (1 + list_sum(list_transform(pieces[1:k], lambda s: {breaks.format('s')})) + coalesce(list_sum(list_transform(found[1:k - 1], lambda s: {breaks.format('s')})), 0))::INT AS line
FROM x WHERE unless IS NULL OR NOT regexp_matches(pieces[k + 1], unless)"""


def _scanned(spark: SparkSession, d: str, rules: dict[str, list] | list, *, any_case: bool = False, where: str = "true") -> DataFrame:
    files = code(spark, d).where(where)
    hits = P.scan_content_by_kind(files, rules, "kind", any_case=any_case) if isinstance(rules, dict) else P.scan_content(files, rules, any_case=any_case)
    return hits.select("path", "title", "cvss", "line")


_C = "kind IN ('c/cpp', 'php')"
_SOURCE = "kind IN ('python', 'node', 'ruby/rails', 'go', 'java', 'php', 'c/cpp')"


@query(_content_sql(B.UNSAFE_C, where=_C))
def unsafe_c_calls(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, B.UNSAFE_C, where=_C)


@query(_content_sql(B.PARSERS, where=_SOURCE))
def parser_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, B.PARSERS, where=_SOURCE)


_OPENINGS = " OR ".join(f"(a.kind = '{k}' AND regexp_matches(a.line_text, {_quoted(p)}))" for k, p in B.PARSE_FUNCTION.items())


@query(rf"""WITH {CODE_LINES_SQL}, o AS (SELECT path, line, regexp_extract(line_text, '(?i)(\w*parse\w*)', 1) AS name FROM lines a WHERE {_OPENINGS})
SELECT DISTINCT o.path, o.line::INT AS line, o.name FROM o JOIN lines b ON b.path = o.path AND b.line BETWEEN o.line + 1 AND o.line + 25 AND contains(b.line_text, o.name) WHERE o.name <> ''""")
def recursive_parsers(spark: SparkSession, d: str) -> DataFrame:
    own = X.lines(code(spark, d))
    whole = None
    for kind, opening in B.PARSE_FUNCTION.items():
        part = P.recurring_names(own.where(F.col("kind") == kind), "path", opening, r"(?i)(\w*parse\w*)", 25)
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query(_content_sql(B.SQL_CONCAT))
def sql_concatenations(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, B.SQL_CONCAT)


@query(_content_sql(B.DISPATCH))
def dynamic_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, B.DISPATCH)


@query(_content_sql(B.SINGLE_PASS))
def single_pass_strips(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, B.SINGLE_PASS)


@query(_content_sql(B.ERROR_PATHS))
def error_path_residue(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, B.ERROR_PATHS)


@query(_content_sql(B.DESERIALISATION))
def deserialisation_sinks(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, B.DESERIALISATION)


@query(_content_sql(B.BOUNDARIES, any_case=True, where=_SOURCE))
def boundary_crossings(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d, B.BOUNDARIES, any_case=True, where=_SOURCE)


_CHECKS = ", ".join(f"('{k}', {i}, {_quoted(c)}, {_quoted(u)}, {_quoted(t)}, {s}::DOUBLE)" for k, own in B.CHECK_THEN_USE.items() for i, (c, u, t, s) in enumerate(own))


@query(f"""WITH {CODE_LINES_SQL}, rules(of, rule, checked, used, title, cvss) AS (VALUES {_CHECKS})
SELECT DISTINCT a.path, a.line::INT AS line, title, cvss FROM lines a JOIN rules ON of = a.kind AND regexp_matches(a.line_text, checked) JOIN lines b ON b.path = a.path AND b.line BETWEEN a.line + 1 AND a.line + 10 AND regexp_matches(b.line_text, used)""")
def check_then_use(spark: SparkSession, d: str) -> DataFrame:
    own = X.lines(code(spark, d))
    whole = None
    for kind, checks in B.CHECK_THEN_USE.items():
        part = P.check_then_use(own.where(F.col("kind") == kind), "path", checks, 10)
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query(f"""WITH {CODE_LINES_SQL}, {_rules_sql({"config": B.SETTINGS, "compose": B.COMPOSE}, True)}
SELECT path, title, cvss, min(line)::INT AS line FROM lines JOIN rules ON of = kind AND regexp_matches(line_text, pattern) GROUP BY path, title, cvss""")
def dangerous_settings(spark: SparkSession, d: str) -> DataFrame:
    own = X.lines(code(spark, d))
    hits = P.scan(own.where("kind = 'config'"), B.SETTINGS).unionByName(P.scan(own.where("kind = 'compose'"), B.COMPOSE))
    return P.first_in_file(hits, "path").select("path", "title", "cvss", "line")


_FLAGS = ", ".join(f"({_quoted(f)}, {_quoted(t)}, {c}::DOUBLE)" for f, t, c in B.HARDENING)


@query(f"""WITH {CODE_LINES_SQL}, flags(flag, title, cvss) AS (VALUES {_FLAGS}), {_rules_sql(B.UNSAFE_FLAGS)}
SELECT path, 1::INT AS line, title, cvss FROM code JOIN flags ON NOT contains(lower(content), lower(flag)) WHERE kind = 'build'
UNION ALL SELECT path, min(line)::INT, title, cvss FROM lines JOIN rules ON regexp_matches(line_text, pattern) WHERE kind = 'build' GROUP BY path, title, cvss""")
def build_flags(spark: SparkSession, d: str) -> DataFrame:
    files = code(spark, d).where("kind = 'build'")
    unsafe = P.first_in_file(P.scan(X.lines(files), B.UNSAFE_FLAGS, any_case=False), "path").select("path", "line", "title", "cvss")
    return P.missing_flags(files, "path", "content", B.HARDENING).unionByName(unsafe)


@query(f"""WITH {CODE_LINES_SQL} SELECT path, line::INT AS line, regexp_extract(line_text, '^\\s*([A-Za-z0-9_.-]+)\\s*==', 1) AS package, regexp_extract(line_text, '==\\s*([A-Za-z0-9_.-]+)', 1) AS version
FROM lines WHERE kind = 'manifest' AND regexp_matches(line_text, '^\\s*([A-Za-z0-9_.-]+)\\s*==\\s*([A-Za-z0-9_.-]+)')""")
def pinned_requirements(spark: SparkSession, d: str) -> DataFrame:
    return X.requirements(code(spark, d).where("kind = 'manifest'")).select("path", "line", "package", "version")


@query(f"WITH {CODE_LINES_SQL}, {_rules_sql(D.SECRETS, True)} SELECT path, line::INT AS line, title, cvss FROM lines JOIN rules ON regexp_matches(line_text, pattern)")
def secret_patterns(spark: SparkSession, d: str) -> DataFrame:
    return P.scan(X.lines(code(spark, d)), D.SECRETS).select("path", "line", "title", "cvss")


@query(f"WITH {CODE_LINES_SQL}, {_rules_sql(D.CONTAINERS, True)} SELECT path, line::INT AS line, title, cvss FROM lines JOIN rules ON regexp_matches(line_text, pattern) WHERE kind = 'compose'")
def container_patterns(spark: SparkSession, d: str) -> DataFrame:
    return P.scan(X.lines(code(spark, d).where("kind = 'compose'")), D.CONTAINERS).select("path", "line", "title", "cvss")


_LANGUAGES = [(k, r) for k, r in D.CRYPTO.items() if k in B.SUFFIXES]


@query(f"WITH {CODE_LINES_SQL}, {_rules_sql({k: r for k, r in _LANGUAGES}, True)} SELECT path, line::INT AS line, title, cvss FROM lines JOIN rules ON of = kind AND regexp_matches(line_text, pattern)")
def crypto_timing(spark: SparkSession, d: str) -> DataFrame:
    return P.scan_by_language(X.lines(code(spark, d)), dict(_LANGUAGES), F.col("kind")).select("path", "line", "title", "cvss")


@query(f"WITH {CODE_LINES_SQL}, {_rules_sql(D.INTEGERS)} SELECT path, line::INT AS line, title, cvss FROM lines JOIN rules ON of = kind AND regexp_matches(line_text, pattern)")
def integer_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return P.scan_by_language(X.lines(code(spark, d)), D.INTEGERS, F.col("kind"), any_case=False).select("path", "line", "title", "cvss")


TARGET, GUARD = "open|query|send", "if |catch|rescue"


@query(f"""WITH {CODE_LINES_SQL}, t AS (SELECT path, line FROM lines WHERE regexp_matches(line_text, '{TARGET}')), g AS (SELECT path, line AS gl FROM lines WHERE regexp_matches(line_text, '{GUARD}'))
SELECT t.path, t.line::INT AS line, min(abs(gl - t.line))::INT AS distance FROM t JOIN g ON g.path = t.path GROUP BY t.path, t.line HAVING min(abs(gl - t.line)) > 3""")
def unguarded_targets(spark: SparkSession, d: str) -> DataFrame:
    own = X.lines(code(spark, d))
    return P.far_from_guard(own.where(F.col("line_text").rlike(TARGET)), own.where(F.col("line_text").rlike(GUARD)), "path", 3)


@query(f"""WITH {CODE_LINES_SQL} SELECT path, line::INT AS line, upper(regexp_extract(line_text, '(?i)([.])(get|post|put|patch|delete)[(]', 2)) AS method, regexp_extract(line_text, '[(]"([^"]+)"', 1) AS route FROM lines WHERE kind = 'go' AND regexp_matches(line_text, '[.](GET|Post)[(]"')""")
def registered_routes(spark: SparkSession, d: str) -> DataFrame:
    return X.routes(code(spark, d).where("kind = 'go'")).select("path", "line", "method", "route")


@query(f"""WITH {CODE_SQL} SELECT count(*)::BIGINT AS files FROM code""")
def source_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree's hash is independent of order; here its file count."""
    own = code(spark, d).select("path", F.sha2("content", 256).alias("sha256"))
    return X.tree_hash(own, "path", "sha256").select("files")
