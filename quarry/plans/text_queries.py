"""Lines, patterns, proximity, JSON and retrieval over text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import detectors
from quarry.functions import json as J
from quarry.functions import text as T
from quarry.operators import patterns as P
from quarry.operators import search as Q
from quarry.plans.registry import query
from quarry.sources import text as X
from quarry.sources.scratch import saved
from quarry.sources.tables import FILES_SQL, files, spread, table

LINES_SQL = f"{FILES_SQL}, lines AS (SELECT path, doc_id, unnest(range(len(ls)) ) + 1 AS line, unnest(ls) AS line_text FROM (SELECT path, doc_id, string_split(content, chr(10)) AS ls FROM files))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return X.lines(files(spark, d))


def _rules_sql(rules: list, any_case: bool = True) -> str:
    rows = ", ".join("({}, '{}', '{}', {}::DOUBLE)".format(i, p.replace("'", "''"), t.replace("'", "''"), c) for i, (p, t, c) in enumerate(rules))
    return f"rules(rule, pattern, title, cvss) AS (VALUES {rows})"


@query(f"WITH {LINES_SQL} SELECT path, line::INT AS line, length(line_text)::INT AS width, line_text FROM lines")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("path", "line", F.length("line_text").alias("width"), "line_text")


@query(f"WITH {LINES_SQL} SELECT path, line::INT AS line, line_text FROM lines")
def all_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document."""
    return _lines(spark, d).select("path", "line", "line_text")


@query(f"""WITH {LINES_SQL} SELECT doc_id, line::INT AS line, (coalesce(sum(strlen(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, strlen(line_text)::INT AS bytes FROM lines""")
def line_offset_index(spark: SparkSession, d: str) -> DataFrame:
    return X.line_offsets(files(spark, d), "doc_id")


@query(f"WITH {FILES_SQL} SELECT path, strlen(content)::BIGINT AS bytes, sha256(content) AS sha256 FROM files")
def snapshot_index(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query(f"""WITH {FILES_SQL} SELECT CASE WHEN contains(path, '/tests/') OR contains(path, '/vendor/') THEN 'skipped-folder' WHEN path NOT LIKE '%.py' AND path NOT LIKE '%.go' THEN 'extension' WHEN strlen(content) > 10000 THEN 'too-large' ELSE 'eligible' END AS reason, count(*)::BIGINT AS n FROM files GROUP BY 1""")
def scan_ledger(spark: SparkSession, d: str) -> DataFrame:
    reason = X.omission_reason(F.col("path"), F.octet_length("content"), [".py", ".go"], 10_000)
    return files(spark, d).groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {FILES_SQL}, e AS (SELECT regexp_extract(path, '([.][^./]+)$', 1) AS suffix, count(*) AS n FROM files GROUP BY 1)
SELECT suffix, n::BIGINT AS n, n::DOUBLE / sum(n) OVER () AS share FROM e WHERE n >= 3""")
def language_shares(spark: SparkSession, d: str) -> DataFrame:
    n = files(spark, d).groupBy(X.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("all"))).where("n >= 3").select("suffix", "n", (F.col("n") / F.col("all")).alias("share"))  # all: one row


@query(f"WITH {LINES_SQL}, {_rules_sql(detectors.PROSE)} SELECT doc_id, line::INT AS line, rule, title, cvss FROM lines JOIN rules ON regexp_matches(line_text, pattern, 'i')")
def prose_patterns(spark: SparkSession, d: str) -> DataFrame:
    return P.scan(_lines(spark, d), detectors.PROSE).select("doc_id", "line", "rule", "title", "cvss")


@query(f"""WITH {LINES_SQL}, {_rules_sql(detectors.PROSE)}, h AS (SELECT path, rule, title, line FROM lines JOIN rules ON regexp_matches(line_text, pattern, 'i')),
a AS (SELECT *, row_number() OVER (PARTITION BY path, rule ORDER BY path, line) AS x FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY path, line) AS y FROM a WHERE x <= 2)
SELECT path, line::INT AS line, rule FROM b WHERE y <= 5""")
def pattern_hits_capped(spark: SparkSession, d: str) -> DataFrame:
    hits = P.scan(_lines(spark, d), detectors.PROSE)
    return P.capped(hits, [(["path", "rule"], 2), (["rule"], 5)], ["path", "line"]).select("path", "line", "rule")


@query(f"""WITH {LINES_SQL}, {_rules_sql(detectors.PROSE)} SELECT path, title, min(line)::INT AS line FROM lines JOIN rules ON regexp_matches(line_text, pattern, 'i') GROUP BY path, title""")
def first_hit_per_file(spark: SparkSession, d: str) -> DataFrame:
    return P.first_in_file(P.scan(_lines(spark, d), detectors.PROSE), "path").select("path", "title", "line")


SINK, SOURCE = "licen[sc]e|copyright|@", "[0-9]"


@query(f"""WITH {LINES_SQL}, k AS (SELECT path, line FROM lines WHERE regexp_matches(line_text, '{SINK}', 'i')), s AS (SELECT path, line AS sl FROM lines WHERE regexp_matches(line_text, '{SOURCE}'))
SELECT k.path, k.line::INT AS line, min(abs(sl - k.line))::INT AS distance FROM k JOIN s ON s.path = k.path AND sl BETWEEN k.line - 49 AND k.line + 10 GROUP BY k.path, k.line""")
def taint_proximity(spark: SparkSession, d: str) -> DataFrame:
    own = _lines(spark, d)
    sinks, sources = own.where(F.col("line_text").rlike(f"(?i){SINK}")).select("path", "line"), own.where(F.col("line_text").rlike(SOURCE))
    return P.near(sinks, sources, "path", 49, 10)


@query(f"""WITH {LINES_SQL}, o AS (SELECT path, line FROM lines WHERE regexp_matches(line_text, '(?i)licen[sc]e') AND path NOT IN (SELECT path FROM lines WHERE regexp_matches(line_text, '(?i)warranty')))
SELECT path, line::INT AS line FROM o QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 3""")
def lifecycle_gaps(spark: SparkSession, d: str) -> DataFrame:
    return P.present_without(_lines(spark, d), "path", "(?i)licen[sc]e", "(?i)warranty", 3)


@query(f"""WITH {FILES_SQL}, t(token) AS (VALUES ('the '), (' und '), (' de '), ('http')) SELECT path, token FROM files JOIN t ON NOT contains(content, token)""")
def missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return P.missing_tokens(files(spark, d), "path", F.col("content"), ["the ", " und ", " de ", "http"])


@query(f"""WITH {LINES_SQL}, u AS (SELECT path, line, substr(line_text, 1, 1) AS family, length(line_text) > 60 AS checked FROM lines WHERE line_text <> ''),
v AS (SELECT path, family FROM u GROUP BY path, family HAVING bool_or(checked))
SELECT path, family, line::INT AS line FROM u JOIN v USING (path, family) WHERE NOT checked QUALIFY row_number() OVER (PARTITION BY path, family ORDER BY line) <= 2""")
def sibling_divergence(spark: SparkSession, d: str) -> DataFrame:
    u = _lines(spark, d).where("line_text <> ''").select("path", "line", F.substring("line_text", 1, 1).alias("family"), (F.length("line_text") > 60).alias("checked"))
    return P.divergent(u, ["path", "family"], F.col("checked"), 2, "line").select("path", "family", "line")


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(html, '<title>([^<]+)</title>', 1), regexp_extract_all(html, '<h1>([^<]+)</h1>', 1)), lambda s: trim(s)), lambda s: length(s) BETWEEN 3 AND 120)))[1:8], '|') AS markers,
 coalesce(nullif(regexp_replace('/' || ltrim(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/+', '/', 'g'), '/'), '(.)/$', '\1'), ''), '/') AS route FROM pages""")
def page_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(T.body_markers(F.col("html")), "|").alias("markers"), T.route(F.regexp_replace("url", "^https?://[^/]+", "")).alias("route"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'absent' ELSE 'present' END AS k_state, 'absent' AS zz_state FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "events").select("event_id", J.document(F.col("props")).alias("doc"))
    return doc.select("event_id", J.field(F.col("doc"), "$.k", "bigint").alias("k"), J.state(F.col("doc"), "$.k").alias("k_state"), J.state(F.col("doc"), "$.zz").alias("zz_state"))


@query("SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.k') AS value FROM events")
def json_members(spark: SparkSession, d: str) -> DataFrame:
    return J.members(table(spark, d, "events"), "event_id", "props")


@query("""WITH a AS (SELECT user_id, '[1, {"a": ' || user_id || '}, "x", {"a": ' || user_id + 1 || ', "b": "t"}, {"b": "u"}]' AS doc FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, o AS ordinal, a, b FROM (SELECT user_id, 1 AS o, user_id + 1 AS a, 't' AS b FROM a UNION ALL SELECT user_id, 2, NULL, 'u' FROM a)""")
def json_array_page(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").select("user_id").distinct()
    doc = u.withColumn("doc", F.format_string('[1, {"a": %d}, "x", {"a": %d, "b": "t"}, {"b": "u"}]', "user_id", F.col("user_id") + 1))
    return J.objects(doc, "user_id", "doc", "a bigint, b string", limit=2, offset=1)


_W = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_TFIDF = f"""asked AS (SELECT item_id, word, count(*) AS asked FROM (SELECT item_id, unnest({_W.format('text')}) AS word FROM benchmark) GROUP BY ALL),
own AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM (SELECT doc_id, {_W.format('text')} AS w FROM documents)),
tf AS (SELECT doc_id, n, word, count(*) AS tf FROM own WHERE word IN (SELECT word FROM asked) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
scored AS (SELECT item_id, doc_id, sum(asked * (1 + tf::DOUBLE / n * ln((SELECT count(*) FROM documents)::DOUBLE / df))) AS score FROM tf JOIN df USING (word) JOIN asked USING (word) GROUP BY ALL)"""


def _lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    return Q.tfidf(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", "text", k)


@query(f"WITH {_TFIDF} SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM scored QUALIFY rank <= 5")
def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    return Q.top_k(_lexical(spark, d, 5), "item_id", "doc_id", 5).withColumn("score", F.round("score", 6))


_CHARS = r"(SELECT {0}, string_split(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'), '') AS c FROM {1})"
_GRAMS = "(SELECT {0}, g, count(*) AS n FROM (SELECT {0}, unnest(CASE WHEN len(c) = 0 THEN [] WHEN len(c) < 3 THEN [array_to_string(c, '')] ELSE list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) END) AS g FROM {1}) GROUP BY ALL)"
_HYBRID = f"""{_TFIDF}, cand AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 15),
near AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM cand)),
ga AS {_GRAMS.format('item_id', _CHARS.format('item_id', 'benchmark'))}, gb AS {_GRAMS.format('doc_id', _CHARS.format('doc_id', 'near'))},
na AS (SELECT item_id, sum(n * n) AS nx FROM ga GROUP BY 1), nb AS (SELECT doc_id, sum(n * n) AS ny FROM gb GROUP BY 1),
dot AS (SELECT c.item_id, c.doc_id, sum(ga.n * gb.n)::DOUBLE AS dot FROM cand c JOIN ga ON ga.item_id = c.item_id JOIN gb ON gb.doc_id = c.doc_id AND gb.g = ga.g GROUP BY ALL),
cosine AS (SELECT c.item_id, c.doc_id, coalesce(dot / sqrt(nx::DOUBLE * ny::DOUBLE), 0) AS cosine FROM cand c LEFT JOIN na USING (item_id) LEFT JOIN nb USING (doc_id) LEFT JOIN dot USING (item_id, doc_id)),
second AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 9) DESC, doc_id) AS rank FROM cosine)"""


def _gram_ranked(spark: SparkSession, d: str, candidates: DataFrame) -> DataFrame:
    return Q.gram_cosine(candidates, table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


@query(f"WITH {_HYBRID} SELECT item_id, doc_id, round(cosine, 6) AS cosine FROM cosine")
def gram_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _gram_ranked(spark, d, saved(Q.top_k(_lexical(spark, d, 15), "item_id", "doc_id", 15))).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH {_HYBRID}, f AS (SELECT item_id, doc_id, sum(p) AS score FROM (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM cand UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM second) GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 5""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    first = saved(Q.top_k(_lexical(spark, d, 15), "item_id", "doc_id", 15))  # read four times
    second = Q.top_k(_gram_ranked(spark, d, first), "item_id", "doc_id", 15, "cosine")
    return Q.top_k(Q.fuse([first, second], "item_id", "doc_id"), "item_id", "doc_id", 5).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_dot_product(qe::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS c FROM embeddings, q WHERE vec_id <> q)
SELECT q, vec_id, round(c, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5""")
def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """A stated query set against all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    scored = Q.nearest(spread(e), e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return Q.top_k(scored, "q", "vec_id", 5).withColumn("score", F.round("score", 6))
