"""Observation identity, best-row merge, and fuzzy title matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of classes. Fixed values.
CLASS_ALIASES = {
    "command-injection": "command_injection",
    "command injection": "command_injection",
    "code-injection": "code_injection",
    "code injection": "code_injection",
    "rce": "code_injection",
    "path-traversal": "path_traversal",
    "path traversal": "path_traversal",
    "authz-bypass": "authz_bypass",
    "authorization bypass": "authz_bypass",
}


def canonical_class(declared: Column, title: Column) -> Column:
    """The declared class in its canonical spelling, else one from the title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    has = lambda *words: F.greatest(*(F.contains(t, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(t, F.lit(words[0]))
    guessed = (
        F.when(has("command injection", "os.system", "popen"), "command_injection")
        .when(has("code injection", "eval", "instance_eval", "rce"), "code_injection")
        .when(has("path traversal", "directory traversal"), "path_traversal")
        .otherwise("unknown")
    )
    raw = F.coalesce(F.nullif(declared, F.lit("")), guessed)
    slug = F.btrim(F.regexp_replace(F.btrim(F.lower(raw)), "[^a-z0-9]+", "_"), F.lit("_"))
    named = F.create_map(*(F.lit(x) for kv in CLASS_ALIASES.items() for x in kv))
    return F.coalesce(named[slug], F.nullif(slug, F.lit("")), F.lit("unknown"))


def relative_path(path: Column) -> Column:
    """Forward slashes, repeated ones once, no leading dots and slashes."""
    return F.ltrim(F.regexp_replace(F.btrim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), "/+(\\./)*", "/"), F.lit("./"))


def observation_key(file: Column, line: Column, bug_class: Column, title: Column) -> Column:
    """location|file|line|class where both are known, else unlocated|file|class|title."""
    path, at = relative_path(file), F.coalesce(line.try_cast("long"), F.lit(0).cast("long"))
    plain = F.regexp_replace(F.btrim(F.lower(F.coalesce(title, F.lit("")))), r"\s+", " ")
    return F.when((path != "") & (at > 0), F.concat_ws("|", F.lit("location"), path, at, bug_class)).otherwise(F.concat_ws("|", F.lit("unlocated"), path, bug_class, plain))


def rank(confidence: Column, cvss: Column, description: Column) -> Column:
    level = F.when(F.lower(confidence) == "high", 3).when(F.lower(confidence) == "medium", 2).when(F.lower(confidence) == "low", 1).otherwise(0)
    return F.struct(level.alias("level"), F.coalesce(cvss, F.lit(0.0)).alias("cvss"), F.length(F.coalesce(description, F.lit(""))).alias("length"))


def merge_best(observations: DataFrame, key: Column, order: str, evidence: list[str]) -> DataFrame:
    """One row a key: the best by rank, the earliest of equals; each evidence
    column the best row's, else the earliest that isn't null; ``first_seen``, ``reports`` and the
    distinct ``tools``. Aggregates only, so copies combine before the shuffle."""
    best = F.max(F.struct(rank(F.col("confidence"), F.col("cvss"), F.col("description")).alias("r"), (-F.col(order)).alias("o"), F.struct(*observations.columns).alias("row"))).alias("best")
    earliest = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"e_{c}") for c in evidence]
    merged = observations.groupBy(key.alias("key")).agg(best, F.min(order).alias("first_seen"), F.count("*").alias("reports"), F.sort_array(F.collect_set("tool")).alias("tools"), *earliest)
    filled = [F.coalesce(F.col(f"best.row.{c}"), F.col(f"e_{c}")).alias(c) if c in evidence else F.col(f"best.row.{c}").alias(c) for c in observations.columns]
    return merged.select("key", *filled, "first_seen", "reports", "tools")


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct lower-case words of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def similar_sets(left: DataFrame, right: DataFrame, least: float, salts: int = 16) -> DataFrame:
    """``left(a, x)``, ``right(b, y)`` of distinct tokens -> every ``(a, b, overlap)`` with a
    Jaccard of ``least`` (above 0) or more; null and repeated ids are rows like any other.

    Two such sets share a token among the first ``n - ceil(least * n) + 1`` of each, in any one order.
    Here tokens of over 1 % of the right sets come last, so that few sets meet at them; they
    are salted too. Their number is at most 100 times the mean size of a right set.
    """
    total = right.agg(F.count("*").alias("total"))
    counts = right.select(F.explode("y").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    often = counts.crossJoin(F.broadcast(total)).where("n * 100 > total").select(F.struct("n", "token").alias("o"))
    hot = F.broadcast(often.agg(F.transform(F.sort_array(F.collect_list("o")), lambda o: o["token"]).alias("hot")))

    def prefixes(sets: DataFrame, key: str, tokens: str, size: str) -> DataFrame:
        rare = F.sort_array(F.array_except(tokens, "hot"))
        n = F.size(tokens)
        kept = n - F.ceil(n * least - 1e-9).cast("int") + 1
        ordered = sets.where(n > 0).crossJoin(hot).select(key, n.alias(size), F.size(rare).alias("rare"), F.slice(F.concat(rare, F.array_intersect("hot", tokens)), F.lit(1), kept).alias("prefix"))
        return ordered.select(key, size, "rare", F.posexplode("prefix").alias("pos", "token")).withColumn("salts", F.when(F.col("pos") >= F.col("rare"), salts).otherwise(1)).drop("pos", "rare")

    one = prefixes(left, "a", "x", "size_a").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    other = prefixes(right, "b", "y", "size_b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    close = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * least - 1e-9
    pairs = one.join(other, ["token", "salt"]).where(close).select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()
    both = pairs.join(left, F.col("id_a").eqNullSafe(F.col("a"))).join(right, F.col("id_b").eqNullSafe(F.col("b")))
    return both.select("a", "b", jaccard(F.col("x"), F.col("y")).alias("overlap")).where(F.col("overlap") >= least)


def normal_title(title: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def titles_match(a: Column, b: Column, least: float = 0.65, min_length: int = 8) -> Column:
    """Equal, one within the other, or token sets that overlap enough."""
    x, y = normal_title(a), normal_title(b)
    long_enough = (F.length(x) >= min_length) & (F.length(y) >= min_length)
    return (x != "") & ((x == y) | (long_enough & (F.contains(x, y) | F.contains(y, x) | (jaccard(tokens(a), tokens(b)) >= least))))


def unseen(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key wasn't known before it; repeats within the batch stay."""
    return new.join(known.select(*keys).distinct(), keys, "left_anti")
