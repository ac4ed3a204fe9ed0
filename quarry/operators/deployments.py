"""What a deployment shows of itself, compared with the baseline of its source:
routes of stored audits as a static signature, identifying markers by path,
contradictions, and how far they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import bound
from quarry.functions.canonical import digest
from quarry.operators.leads import confidence_label
from quarry.sources.json_tree import route_values

#: Paths that may be asked for. Fixed values.
SAFE_PATHS = ["/", "/health", "/healthz", "/status", "/version", "/robots.txt", "/favicon.ico", "/openapi.json", "/swagger.json"]
#: Suffixes of source files, which aren't routes. Fixed values.
SOURCE_SUFFIX = r"(?i)\.(?:py|rb|go|java|kt|js|jsx|ts|tsx|php|c|cc|cpp|h|hpp|rs|ex|exs|cs|sql|md)$"
#: Markers that tell products apart begin with one of these; bytes that an equal body has at least. Fixed values.
STRONG, LEAST_BODY = ["product:", "title:"], 32


def normal_path(value: Column) -> Column:
    """A route's path in one spelling, null if it is none: not beginning with a
    slash, over 256 characters, with dots upwards, templates or marks of other
    languages in it, or a source file. Scheme and host, query and fragment go."""
    def bare(raw: Column) -> Column:
        return F.when(raw.rlike(r"^https?://"), F.coalesce(F.nullif(F.regexp_extract(raw, r"^https?://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))).otherwise(raw)

    def trimmed(own: Column) -> Column:
        path = F.regexp_replace(F.substring_index(F.substring_index(own, "?", 1), "#", 1), "/+", "/")
        return F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)

    def kept(raw: Column, own: Column, path: Column) -> Column:
        refused = (raw == "") | (F.length(raw) > 256) | ~F.startswith(own, F.lit("/")) | F.contains(path, F.lit("..")) | path.rlike(r"""[{}\[\];|&$`\\"'\n\r]""") | F.regexp_extract(path, r"([^/]*)$", 1).rlike(SOURCE_SUFFIX)
        return F.when(~refused, path)

    # each step once, however often the next one names it
    return bound(F.btrim(F.coalesce(value, F.lit("")), F.lit(" \t\n\r\x0b\x0c")), lambda raw: bound(bare(raw), lambda own: bound(trimmed(own), lambda path: kept(raw, own, path))))


def static_signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, paths, route_count, excluded, signature)`` of each stored audit
    with a route: the safe paths among its routes, how many distinct routes it has and how many
    aren't asked for, and the digest of all this. A row a document; at most as many paths as are safe are gathered."""
    own = route_values(df, key, text).select(key, normal_path(F.col("route")).alias("path")).where("path is not null").distinct()
    safe = F.col("path").isin(SAFE_PATHS)
    seen = own.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.when(safe, F.col("path")))), ",").alias("paths"), F.count("*").alias("route_count"), F.count_if(~safe).alias("excluded"))
    return seen.withColumn("signature", digest(F.to_json(F.struct("paths", "route_count", "excluded"))))


def compared(baseline: DataFrame, observed: DataFrame, key: list[str], order: str) -> DataFrame:
    """``(key..., path, method, status, markers, body_hash, body_bytes, truncated)``
    each -> a row a key of the baseline: ``(key..., anchors, contradictions,
    coverage, confidence, label, matched)``.

    Baseline answers of 200 to 299 to GET on safe paths are expected; of
    repeated paths the last by ``order`` counts on either side. An answer is an
    anchor if it is in good order, whole on both sides, and shares a product or
    a title; equal anchors count once. Markers on both sides of which none is
    shared contradict. Without an anchor confidence is 0.1 if anything answered,
    else 0; a contradiction holds it at 0.3. A key whose baseline has nothing to expect has
    confidence 0.1 if anything is expected, so 0; null markers are none.
    """
    last = lambda df: df.where(F.col("path").isin(SAFE_PATHS) & (F.col("method") == "GET")).withColumn("n_", F.row_number().over(Window.partitionBy(*key, "path").orderBy(F.desc(order)))).where("n_ = 1").drop("n_")
    good = lambda s: s.between(200, 299)
    expected = baseline.where(good(F.col("status")))
    fields = ["status", "markers", "body_hash", "truncated"]
    e = last(expected).select(*key, "path", *(F.col(c).alias(f"e_{c}") for c in fields))
    a = last(observed).select(*key, "path", *(F.col(c).alias(f"a_{c}") for c in fields))
    none = F.array().cast("array<string>")
    em, am = F.coalesce("e_markers", none), F.coalesce("a_markers", none)
    strong = F.array_sort(F.filter(F.array_intersect(em, am), lambda m: F.startswith(m, F.lit(STRONG[0])) | F.startswith(m, F.lit(STRONG[1]))))
    both = e.join(a, [*key, "path"], "left").withColumn("strong", strong)
    whole = good(F.coalesce("a_status", F.lit(0))) & ~F.coalesce("a_truncated", F.lit(False)) & ~F.coalesce("e_truncated", F.lit(False))
    anchor = F.when(whole & (F.size("strong") > 0), F.struct("strong", F.coalesce("e_body_hash", F.lit("")).alias("body")))
    against = (F.size(em) > 0) & (F.size(am) > 0) & (F.size("strong") == 0)
    answered = F.coalesce("a_status", F.lit(0)) > 0
    per = both.groupBy(*key).agg(F.count_distinct(anchor).alias("anchors"), F.count_if(against).alias("contradictions"), F.avg(answered.cast("double")).alias("coverage"))
    heard = observed.where(F.col("path").isin(SAFE_PATHS) & (F.col("method") == "GET") & (F.coalesce("status", F.lit(0)) != 0)).select(*key).distinct().withColumn("heard", F.lit(True))
    keys = baseline.select(*key).distinct().join(per, key, "left").join(heard, key, "left")
    c, n, d = F.coalesce("coverage", F.lit(0.0)), F.coalesce("anchors", F.lit(0)), F.coalesce("contradictions", F.lit(0))
    sure = F.least(F.lit(0.95), 0.35 + 0.25 * n + 0.1 * c)
    confidence = F.round(F.when(n > 0, F.when(d > 0, F.least(F.lit(0.3), sure)).otherwise(sure)).when(F.col("anchors").isNotNull() & F.col("heard"), 0.1).otherwise(0.0), 3)
    out = keys.select(*key, n.alias("anchors"), d.alias("contradictions"), F.round(c, 3).alias("coverage"), confidence.alias("confidence"))
    return out.select("*", confidence_label(F.col("confidence")).alias("label"), ((F.col("anchors") > 0) & (F.col("contradictions") == 0) & (F.col("confidence") >= 0.55)).alias("matched"))
