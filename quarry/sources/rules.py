"""Learned patterns as a table: some from the items of ``benchmark``, safe and
unsafe ones, repeated ones, and some of earlier audits of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import table

_B = "chr(92)"
#: Spark and DuckDB read this alike: the words of an item, from which its patterns are made.
_WORDS = "split(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'), ' ')"
_REGEX = f"""CASE CAST((item_id * 5 + k) % 9 AS INT) WHEN 0 THEN '.*' WHEN 1 THEN concat(a, '||', b) WHEN 2 THEN concat('(', a) WHEN 3 THEN concat(a, '|', b, ' ', a)
WHEN 4 THEN concat('(?:', a, '|xx)', {_B}, 's+', b, '?') WHEN 5 THEN concat(a0, {_B}, 's+', b0) WHEN 6 THEN concat('(a|b)+', b) WHEN 7 THEN concat({_B}, 'd{{4,}}', {_B}, 's[xyz]') ELSE concat(a, {_B}, 's+', b) END"""
#: (title, regex, language, score, from notes), of code.
CODE = [
    ("Command injection via os.system", r"os\.system\(", "python", 8.5, False), ("Command injection via os.system", r"subprocess\.(run|call)", "python", 8.0, False), ("SQL built by hand", r"execute\(", "multi", 7.5, False),
    ("Unsafe YAML", r"yaml\.load\(\w+", "multi", 7.0, True), ("Unsafe pickle", r"pickle\.loads?\(", "multi", 8.0, False), ("Unsafe pickle", r"pickle\.loads?\(", "multi", 6.5, True), ("Node only", r"require\(req", "node", 7.0, False),
    ("Ruby send", r"\.send\(params", "ruby", 7.0, True), ("Weak hash", r"hashlib\.md5", "any", 5.0, False), ("Go ignored error", r"_ = \w+\.Close", "go", 4.0, False), ("File opened", r"open\(p(?:ath)?\)", "multi", 6.0, True),
]


def _literal(s: object) -> str:
    return ("true" if s else "false") if isinstance(s, bool) else str(s) if isinstance(s, float) else "concat(" + f", {_B}, ".join("'" + x.replace("'", "''") + "'" for x in str(s).split("\\")) + ")"


def _sql(dialect: str) -> str:
    words = _WORDS if dialect == "duckdb" else _WORDS.replace(", 'g')", ")")
    at = (lambda n: f"w[{n}]") if dialect == "duckdb" else (lambda n: f"try_element_at(w, {n})")
    ks = "unnest([0, 1, 2, 3, 4, 5, 6])" if dialect == "duckdb" else "explode(array(0, 1, 2, 3, 4, 5, 6))"
    fixed = " UNION ALL ".join(f"SELECT {i - len(CODE)} AS pattern_id, {', '.join(_literal(x) for x in row)}" for i, row in enumerate(CODE))
    return f"""SELECT CAST(pattern_id AS BIGINT) AS pattern_id, title, regex, language, CAST(cvss AS DOUBLE) AS cvss, from_notes FROM (
{fixed.replace('AS pattern_id, ', 'AS pattern_id, ', 1)}
UNION ALL SELECT item_id * 7 + k, concat('item ', CAST(item_id % 20 AS {'VARCHAR' if dialect == 'duckdb' else 'STRING'})), {_REGEX}, 'multi', 7.0, k = 5 FROM (SELECT item_id, k, {at('k * 3 + 2')} AS a, {at('k * 3 + 3')} AS b, {at('2')} AS a0, {at('3')} AS b0 FROM (SELECT item_id, {words} AS w, {ks} AS k FROM benchmark) s) t WHERE length(a) > 0 AND length(b) > 0
) AS all_(pattern_id, title, regex, language, cvss, from_notes)"""


RULES_SQL = f"rules AS ({_sql('duckdb')})"


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pattern_id, title, regex, language, cvss, from_notes)``."""
    text = _sql("spark").replace("{", "{{").replace("}", "}}").replace("FROM benchmark", "FROM {benchmark}")
    return spark.sql(text, benchmark=table(spark, sf_dir, "benchmark"))
