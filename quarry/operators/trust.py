"""Which routes change something without a guard: registrations of several
routers, the gates of their files, and one verdict a route with the rule that decided it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registrations by method, groups and prefixes, other routers. Fixed values.
ROUTE = r"""(?:^|[^A-Za-z])(?:(\w+)\.)?(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*["'](/[^"']*)["']"""
GROUP = r"""(\w+)\s*:?=\s*\w*\.Group\(\s*["'](/[^"']*)["']"""
PREFIX = r"""\.Route\(\s*["'](/[^"']*)["']"""
CHAINED = r"""(?i)\.route\(\s*["'](/[^"']+)["']\s*,\s*(get|post|put|patch|delete)\s*\("""
HANDLE = r"""(?:HandleFunc|Handle)\(\s*["'](/[^"']+)["']"""
#: Gates, and what opens them. Fixed values.
GATE = r"accessTokenMiddleware|unified_auth|checkAuth|GinRequestMiddleware|AuthGuard|with_auth"
OPEN = r"""if\s+token\s*==\s*""|if\s+!.*AuthConf\.Enable|auth_configured|if\s+auth_configured"""
NO_TOKEN = r"""(?m)(?:ServerAccessToken|accessToken|token)\s*[:=]\s*""\s*(?:$|[,;])"""
#: Names of files that hold the routes of a service; words of a route that only tells, and of one that changes something. Fixed values.
ROUTERS = ["router.go", "routes.go", "routes.rs", "record.go", "replay.go", "server.go"]
TELLS = ["health", "ready", "ping", "metrics", "status"]
CHANGES = ["resume", "create", "delete", "kill", "update", "upload", "pause", "stop", "insert", "sandbox", "command", "exec", "run", "proxy"]


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _pairs(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<a, b, c>> of the groups of each match on a line; "" for groups that aren't asked for."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) if g else None for n, g in zip("abc", (*groups, 0, 0), strict=False)]
    zipped = F.arrays_zip(*(p for p in parts if p is not None))
    return F.transform(zipped, lambda z: F.struct(*((z[n] if p is not None else F.lit("")).alias(n) for n, p in zip("abc", parts, strict=True))))


def registered(files: DataFrame, content: str = "content") -> DataFrame:
    """``files(path, content)`` -> ``(path, line, method, route, gate, opened)``: each
    route of a file once, where it first stands, with the prefix of its group,
    and whether the file has a gate and something that opens one.

    A route of no group gets the first prefix of its file unless it begins with
    one. Registrations without a method count as POST if their words say that they
    change something, else as ANY. Lines that are comments register nothing. It all happens within a file's row.
    """
    text = F.col(content)
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct((i + 1).alias("line"), s.alias("t")))
    code = F.filter(lines, lambda x: ~F.btrim(x["t"]).rlike(r"^(?://|#|--)"))
    bare = lambda p: F.regexp_replace(p, "/+$", "")
    groups = F.arrays_zip(F.regexp_extract_all(text, F.lit(GROUP), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(GROUP), F.lit(2)).alias("prefix"))
    own = files.where(text.isNotNull()).select(
        "path", (text.rlike(GATE)).alias("has"), (text.rlike(OPEN) | text.rlike(NO_TOKEN)).alias("opens"), groups.alias("groups"), F.transform(F.regexp_extract_all(text, F.lit(PREFIX), F.lit(1)), bare).alias("prefixes"), F.explode(code).alias("x"),
    ).select("path", F.col("has").alias("gate"), F.col("opens").alias("opened"), "groups", "prefixes", F.col("x.line").alias("line"), F.col("x.t").alias("t"))
    low = F.lower(F.col("t"))
    kinds = [("by method", _pairs(F.col("t"), ROUTE, 1, 2, 3)), ("chained", _pairs(F.col("t"), CHAINED, 1, 2)), ("handle", _pairs(F.col("t"), HANDLE, 1))]
    named = lambda k: lambda z: F.struct(F.lit(k).alias("kind"), z["a"].alias("a"), z["b"].alias("b"), z["c"].alias("c"))
    found = F.concat(*(F.transform(c, named(k)) for k, c in kinds))
    each = own.select("*", low.alias("low"), F.explode(found).alias("r"))
    kind, a, b, c = (F.col(f"r.{n}") for n in ("kind", "a", "b", "c"))
    group = F.get(F.reverse(F.filter("groups", lambda g: g["name"] == a)), F.lit(0))["prefix"]
    raw = F.when(kind == "by method", c).otherwise(a)
    shared = F.when((F.size("prefixes") > 0) & ~F.exists("prefixes", lambda p: F.startswith(raw, p)), F.get("prefixes", F.lit(0)))
    prefix = F.when(kind == "by method", F.coalesce(F.nullif(bare(group), F.lit("")), shared, F.lit(""))).otherwise("")
    full = F.when(raw == "/", F.coalesce(F.nullif(prefix, F.lit("")), F.lit("/"))).otherwise(F.concat(prefix, raw))
    said = F.concat(F.lower(a), F.lit(" "), F.lower(F.regexp_extract("t", r",\s*(?:[A-Za-z_]\w*\.)*([A-Z]\w+)\s*\)?\s*$", 1)))
    changes = ~_any(said, TELLS) & _any(said, CHANGES)
    method = F.when(kind == "handle", F.when(changes, "POST").otherwise("ANY")).otherwise(F.upper(b))
    rows = each.select("path", "line", method.alias("method"), F.regexp_replace(full, "/{2,}", "/").alias("route"), "gate", "opened")
    return rows.groupBy("path", "method", "route", "gate", "opened").agg(F.min("line").alias("line")).select("path", "line", "method", "route", "gate", "opened")


def verdicts(routes: DataFrame) -> DataFrame:
    """Routes of ``registered()`` with ``verdict`` and ``rule``, the first that applies: a
    route that only reads is harmless; one that changes something is open if
    its file opens a gate, or has none and is named like a table of routes; else it is
    guarded if its file has a gate; of others nothing is known."""
    changing = F.col("method").isin("POST", "PUT", "PATCH", "DELETE")
    ladder = [(~changing, "harmless", "reads only"), (F.col("opened"), "open", "fail-open middleware"), (~F.col("gate") & _any(F.lower("path"), ROUTERS), "open", "no auth middleware in route file"), (F.col("gate"), "guarded", "middleware in route file")]
    verdict, rule = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, v, r in ladder:
        verdict, rule = verdict.when(test, v), rule.when(test, r)
    return routes.withColumn("verdict", verdict.otherwise("unknown")).withColumn("rule", rule.otherwise("no evidence"))
