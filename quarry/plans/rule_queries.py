"""Learned patterns over documents and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import learned as L
from quarry.plans.registry import query
from quarry.sources.code import CODE_SQL, code
from quarry.sources.rules import RULES_SQL, rules
from quarry.sources.tables import FILES_SQL, files

_LIST = lambda words: "(" + ", ".join("'{}'".format(w.replace("'", "''")) for w in words) + ")"
_ANY = lambda c, words: "(" + " OR ".join("contains({}, '{}')".format(c, w.replace("'", "''")) for w in words) + ")"
#: Of safe() patterns the SQL only knows by their making that they don't compile, repeat a group or have no literal.
_REASON_SQL = rf"""CASE WHEN length(trim(coalesce(regex, ''))) < 4 THEN 'too-short' WHEN trim(regex) IN {_LIST(L.BROAD)} THEN 'broad' WHEN regexp_matches(trim(regex), '^\||\|\||\|$') THEN 'empty-alternative'
WHEN length(regexp_replace(trim(regex), '[\\^$.*+?()\[\]{{}}|]', '', 'g')) < 3 THEN 'few-literals' WHEN regex[1] = '(' AND NOT contains(regex, ')') THEN 'broken' WHEN contains(regex, ')+') THEN 'repeated-group' WHEN contains(regex, 'd{{4') THEN 'no-literal' END"""
_SAFE_SQL = f"{RULES_SQL}, safe AS (SELECT * FROM rules WHERE {_REASON_SQL} IS NULL QUALIFY row_number() OVER (PARTITION BY trim(regex) ORDER BY from_notes, pattern_id) = 1)"


def _all_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", F.lit("text").alias("kind"), "content").unionByName(code(spark, d).select("path", "kind", "content"))


@query(f"WITH {RULES_SQL} SELECT pattern_id, regex, coalesce({_REASON_SQL}, 'runs') AS verdict FROM rules")
def pattern_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return rules(spark, d).select("pattern_id", "regex", F.coalesce(L.refusal(F.col("regex")), F.lit("runs")).alias("verdict"))


@query(f"WITH {_SAFE_SQL} SELECT pattern_id, title, regex, from_notes FROM safe")
def preferred_patterns(spark: SparkSession, d: str) -> DataFrame:
    return L.preferred(rules(spark, d).where(L.refusal(F.col("regex")).isNull())).select("pattern_id", "title", "regex", "from_notes")


@query(f"""WITH {RULES_SQL}, known AS (SELECT * FROM rules WHERE pattern_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY trim(regex) ORDER BY pattern_id) = 1),
fresh AS (SELECT *, trim(regex) AS rx FROM rules WHERE pattern_id % 3 <> 0 AND {_REASON_SQL} IS NULL QUALIFY row_number() OVER (PARTITION BY trim(regex) ORDER BY from_notes, pattern_id) = 1),
joined AS (SELECT *, false AS late FROM known UNION ALL SELECT * EXCLUDE (rx), true FROM fresh WHERE rx NOT IN (SELECT trim(regex) FROM known)),
last AS (SELECT * FROM joined ORDER BY late DESC, pattern_id DESC LIMIT 90)
SELECT pattern_id, title, regex, row_number() OVER (ORDER BY late, pattern_id)::INT AS place FROM last""")
def appended_patterns(spark: SparkSession, d: str) -> DataFrame:
    own = rules(spark, d)
    known = own.where("pattern_id % 3 = 0")
    first = known.groupBy("regex").agg(F.min("pattern_id").alias("pattern_id"))
    return L.appended(known.join(first.select("pattern_id"), "pattern_id", "left_semi"), own.where("pattern_id % 3 <> 0"), 90).select("pattern_id", "title", "regex", "place")


_W = "array_to_string(ls[greatest(line - 1, 1):line + 1], chr(10))"
_SAID = "lower(title || ' ' || regex)"
_HARMLESS = rf"""CASE WHEN {_ANY(_SAID, ["system", "popen", "subprocess", "command", "shell"])} OR regexp_matches({_SAID}, '\b(?:exec|rce)\b') THEN NOT {_ANY('w', ["os.system(", "os.popen(", "shell=true", "commands.getoutput", "`", "/bin/sh", "eval(", "exec("])}
WHEN {_ANY(_SAID, ["sql", "select", "insert", "query", "execute"])} THEN regexp_matches(w, '(execute|executemany)\s*\([^)]*[,]\s*[\(\[\{{]') OR (contains(w, ' where ') AND contains(w, '?')) OR (contains(w, '%s') AND contains(w, ',')) OR regexp_matches(w, '\?\s*[,)\]]')
 OR {_ANY('w', ["qsql_id", "quote_ident", "quote_identifier", "identifier(", "sql.identifier", "escape_string"])} OR NOT {_ANY('w', ["f'", 'f"', "%", "+", ".format("])} ELSE false END"""


@query(rf"""WITH {_SAFE_SQL}, {FILES_SQL}, {CODE_SQL}, own AS (SELECT path, 'text' AS kind, content FROM files UNION ALL SELECT path, kind, content FROM code),
m AS (SELECT path, pattern_id, title, regex, from_notes, cvss, content, regexp_extract_all(content, '(?i)' || regex, 0) AS found, string_split_regex(content, '(?i)' || regex) AS pieces
 FROM own JOIN safe ON regexp_matches(content, '(?i)' || regex) WHERE NOT (kind LIKE 'ruby%' AND language NOT IN ('multi', 'unknown', 'any', '') AND NOT contains(lower(kind), lower(language)) AND NOT contains(language, 'ruby'))),
x AS (SELECT *, string_split(content, chr(10)) AS ls, unnest(range(1, len(found) + 1)) AS k FROM m),
l AS (SELECT *, 1 + list_sum(list_transform(pieces[1:k], lambda s: len(s) - len(replace(s, chr(10), '')))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda s: len(s) - len(replace(s, chr(10), '')))), 0) AS line FROM x),
h AS (SELECT *, lower({_W}) AS w, len(list_filter(ls[greatest(line - 25, 1):line + 25], lambda s: {_ANY('s', L.SINKS)} OR {_ANY('s', L.SOURCES)})) > 0 AS near FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY path, title ORDER BY path, line, pattern_id) AS a FROM h WHERE NOT ({_HARMLESS}) AND NOT contains(regexp_extract(path, '([^/]*)$', 1), 'conftest') QUALIFY a <= 2),
g AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY path, line, pattern_id) AS b FROM f QUALIFY b <= 5)
SELECT path, line::INT AS line, pattern_id, title, CASE WHEN near THEN 'QUALIFIED' ELSE 'LATENT' END AS qualification, CASE WHEN near THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN near THEN cvss WHEN from_notes THEN least(cvss, 5.5) ELSE least(cvss, 6.0) END AS cvss FROM g""")
def learned_pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    return L.transferred(_all_files(spark, d), rules(spark, d))
