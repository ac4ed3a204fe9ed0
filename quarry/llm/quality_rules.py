"""Quality rules with risk-controlled thresholds. DataFrame functions only.

A base rule rejects outright. Beyond it, each metric may reject documents above
a cutoff, chosen per stratum from labelled documents: the strictest cutoff for
which an exact binomial test shows that it rejects at most a stated share of good
documents. The tests of all strata, metrics and cutoffs share one error
probability (Bonferroni), and the metrics share the allowed rejections, so with
probability 1 - error no stratum loses more than ``risk`` of its good
documents to all metrics together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Metrics, and the cutoffs tried for each, from strict to lenient.
CUTOFFS = {
    "symbol_share": [0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3],
    "dup_line_share": [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeat_share": [0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.19],
    "word_length": [6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}
RISK = 0.04
ERROR = 0.05


def counts(docs: DataFrame, id_col: str, text_col: str, stratum: Column) -> DataFrame:
    """``(id, stratum, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines)``; a null text has none of anything."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(SPACE)) != "")
    read = docs.select(
        F.col(id_col).alias("id"), stratum.alias("stratum"), text.alias("text"), lines.alias("lines"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
    )
    words = read.withColumn("word", F.transform("words", lambda x: F.xxhash64(x)))
    hashed = words.withColumn(
        "h", F.slice(F.transform("word", lambda x, i: F.xxhash64(x, *(F.get("word", i + k) for k in range(1, WINDOW)))), 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    )
    # Most texts repeat no window. In the others the windows whose hash repeats are compared word by word.
    beside = lambda c, x, k, key: F.coalesce((x[key] == F.get(c, k - 1)[key]) | (x[key] == F.get(c, k + 1)[key]), x[key] == F.get(c, k - 1)[key], x[key] == F.get(c, k + 1)[key], F.lit(False))
    places = lambda c, key: F.filter(F.transform(c, lambda x, k: F.when(beside(c, x, k, key), x["i"])), lambda i: i.isNotNull())
    sorted_ = hashed.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))))
    suspect = sorted_.withColumn("w", F.sort_array(F.transform(places("s", "h"), lambda i: F.struct(F.concat_ws(" ", F.slice("words", i, WINDOW)).alias("k"), i.alias("i")))))
    placed = suspect.withColumn("at", F.sort_array(places("w", "k")))
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda n, x: n + x
    )
    return placed.select(
        "id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, by Stirling's series at x + 8: 13 digits."""
    z = x + 8
    shifted = F.ln(x * (x + 1) * (x + 2) * (x + 3)) + F.ln((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.ln(z) - z + 0.918938533204672741780329736406 + series - shifted


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of the binomial (n, p) for k <= n p: the term of k times the
    sum of the ratios below it. Terms beyond 9 standard deviations are under
    the last digit and left out, so the work grows with sqrt(n)."""
    k, n = k.cast("double"), n.cast("double")
    term = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    steps = F.least(k, 50 + 9 * F.sqrt(n * p)).cast("int")
    start = F.struct(F.lit(1.0).alias("ratio"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        ratio = acc["ratio"] * (k - i + 1) / (n - k + i) * ((1 - p) / p)
        return F.struct(ratio.alias("ratio"), (acc["sum"] + ratio).alias("sum"))

    ratios = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return term * F.aggregate(ratios, start, step)["sum"]


def _metrics() -> dict[str, Column]:
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_share": over("n_symbols", "word_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "word_length": over("word_chars", "n_words"),
    }


def cutoffs(good: DataFrame, *, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``good(stratum, metrics...)``: documents labelled good that pass the base
    rule -> ``(stratum, metric, cutoff)``, rows only where a cutoff is safe."""
    tried = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(float(c)).alias("cutoff")) for m, cs in CUTOFFS.items() for c in cs))
    n_tests = sum(map(len, CUTOFFS.values()))
    above = F.transform(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x"), F.array(*map(F.lit, map(float, cs))).alias("cs")) for m, cs in CUTOFFS.items())),
                        lambda s: F.struct(s["metric"].alias("metric"), F.size(F.filter(s["cs"], lambda c: s["x"] > c)).alias("passed")))
    # passed: how many of a metric's cutoffs the document is above; counted before the cutoffs multiply it
    tally = good.select("stratum", F.explode(above).alias("a")).groupBy("stratum", "a.metric", "a.passed").agg(F.count("*").alias("n"))
    per = tally.groupBy("stratum", "metric").agg(F.sum("n").alias("n"), F.collect_list(F.struct("passed", "n")).alias("by"))  # at most 11 entries
    strata = per.agg(F.count_distinct("stratum").alias("strata"))
    rank = F.create_map(*(x for m, cs in CUTOFFS.items() for i, c in enumerate(cs) for x in (F.struct(F.lit(m), F.lit(float(c))), F.lit(i))))
    tests = (
        per.crossJoin(F.broadcast(strata))  # one row
        .select("stratum", F.col("metric"), "n", "by", "strata", F.explode(F.filter(tried, lambda t: t["metric"] == F.col("metric"))).alias("t"))
        .select("stratum", "metric", "n", "strata", F.col("t.cutoff").alias("cutoff"),
                F.aggregate(F.filter("by", lambda b: b["passed"] > rank[F.col("t")]), F.lit(0).cast("long"), lambda s, b: s + b["n"]).alias("k"))
    )
    allowed = risk / len(CUTOFFS)
    level = error / (n_tests * F.col("strata"))
    safe = F.when(F.col("k") > F.col("n") * allowed, False).otherwise(binomial_cdf(F.col("k"), F.col("n"), allowed) <= level)
    return tests.where(safe).groupBy("stratum", "metric").agg(F.min("cutoff").alias("cutoff"))


def apply_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """One row a document: ``(id_col, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, reasons)``.

    All labelled documents are the holdout. A null text has no words and fails
    the base rule. A null stratum is a stratum of its own. A stratum with too
    few good documents for any cutoff, or without labels, rejects by the base
    rule alone. Null labels and ids teach nothing; a document labelled good by
    any of its labels is good. Repeated ids are rows of their own.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("\x00none"))
    read = written(counts(docs, id_col, text_col, stratum))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = read.withColumns({"base_failed": failed} | _metrics())
    good = labels.where(F.col(label_col) > 0).select(F.col(id_col).alias("id")).distinct()
    chosen = cutoffs(measured.where(~F.col("base_failed")).join(good, "id", "left_semi"), risk=risk, error=error)
    wide = written(chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("metric", "cutoff"))).alias("cut")))  # a row a stratum, at most 4 entries
    over = F.array_compact(F.array(*(F.when(F.col(m) > F.col("cut")[m], F.lit(m)) for m in CUTOFFS)))
    judged = measured.join(wide, "stratum", "left").withColumn("reasons", F.coalesce(over, F.array().cast("array<string>")))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons",
    )


def oracle_sql(risk: float = RISK, error: float = ERROR) -> str:
    """The same rows in DuckDB's SQL, on documents and labels."""
    ws = "[\\x20\\x09-\\x0D]+"
    tried = ", ".join(f"('{m}', {c!r}::DOUBLE)" for m, cs in CUTOFFS.items() for c in cs)
    p, n_tests = risk / len(CUTOFFS), sum(map(len, CUTOFFS.values()))
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(lang, chr(0) || 'none') AS stratum, coalesce(text, '') AS t,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'), lambda w: w <> '') AS words
  FROM documents),
wins AS (SELECT *, list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS win FROM base),
pos AS (SELECT doc_id, rid, i FROM (SELECT doc_id, rid, unnest(win) AS w, unnest(range(len(win))) AS i FROM (SELECT *, row_number() OVER () AS rid FROM wins WHERE len(list_distinct(win)) < len(win)))
        QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, nxt - i)) AS n FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + {WINDOW}) AS nxt FROM pos) GROUP BY doc_id),
m AS (
  SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM wins LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_share, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_share,
    n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share, word_chars::DOUBLE / greatest(n_words, 1) AS word_length FROM m),
long AS (UNPIVOT (SELECT doc_id, stratum, base_failed, symbol_share, dup_line_share, repeat_share, word_length FROM f) ON symbol_share, dup_line_share, repeat_share, word_length INTO NAME metric VALUE x),
tried(metric, cutoff) AS (VALUES {tried}),
good AS (SELECT * FROM long WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality > 0)),
tests AS (SELECT stratum, metric, cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS k, (SELECT count(DISTINCT stratum) FROM good) AS strata
          FROM good JOIN tried USING (metric) GROUP BY ALL),
cut AS (SELECT stratum, metric, min(cutoff) AS cutoff FROM tests
        WHERE k <= n * {p!r} AND list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r})))) <= {error!r} / ({n_tests} * strata)
        GROUP BY ALL),
over AS (SELECT DISTINCT doc_id FROM long JOIN cut USING (stratum, metric) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over) AS kept FROM f"""
