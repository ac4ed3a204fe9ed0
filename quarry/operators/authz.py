"""Missing authorisation: objects fetched without a check nearby, and methods
without the guard that others of their file have.

Only lines that say something (a fetch, a guard, a definition) are sorted, and
frames over line numbers look up and down from each; lines are never paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources import text as X

#: By language: a fetch by number; tokens of a caller's input; tokens of a check; how a request is called. Fixed values.
FETCH = {
    "python": r"(?:\.objects\.(?:get|filter)\s*\(|get_object_or_404\s*\(|\.objects\.get_or_create\s*\(|session\.query\([^)]*\)\.get\s*\()",
    "ruby/rails": r"\b[A-Z]\w+\.(?:find|find_by|find_by_id|find_by!)\s*\(|\.find\s*\(\s*params\[",
    "node": r"\.(?:findById|findOne|findByPk|findByIdAndUpdate|findByIdAndDelete)\s*\(",
}
INPUT = {
    "python": ["request.", "self.kwargs", "kwargs[", "pk=", "id=", "request.get", "request.post", "request.data", "query_params"],
    "ruby/rails": ["params[", "params.require", "params.fetch"],
    "node": ["req.params", "req.query", "req.body", "req.headers"],
}
CHECKS = {
    "python": [
        "request.user", "self.request.user", "has_perm", "has_permission", "permissionrequired", "isowner", "get_queryset", "filter(user", "filter(realm", "user=request.user", "user_id=request.user", "permissiondenied", "check_", "authorize",
        "@login_required", "user_profile", "acting_user", "can_", "access_control", "has_message_access", "access_message", "access_stream_by_id", "access_stream", "access_user_by_id", "check_stream_access", "user_has_access", "require_member",
        "get_object_or_403", "userpassestestmixin", "permissionrequiredmixin", "validate_access",
    ],
    "ruby/rails": ["current_user", "current_account", "authorize", "can?", "cannot?", "policy", "pundit", "cancan", ".where(", "current_organization", "authenticate_user", "check_", "scoped", "accessible_by"],
    "node": ["req.user", "req.session", "isowner", "ownerid", "userid ===", "authorize", "checkpermission", "haspermission", "req.auth", "verifyowner", "can(", "ability", "acl"],
}
REQUEST = {"python": "request", "ruby/rails": "params", "node": "req"}
#: Tokens of an address that can't be guessed, which is a check of its own. Fixed values.
SIGNED = ["badsignature", "signing", "signer", "hmac", "salt", "itsdangerous", "verify_signature", "signed", "message_authentication"]
#: Folders without handlers, and folders of handlers. Fixed values.
NO_HANDLERS = [
    "migrations", "migration", "test", "tests", "spec", "specs", "fixtures", "factories", "examples", "example", "node_modules", "vendor", "__pycache__", ".venv", "seeds", "seed", "db", "management", "commands", "scripts", "bin", "tools", "benchmarks",
]
HANDLERS = ["views", "controllers", "api", "handlers", "endpoints", "routes", "resources", "web", "rest"]
#: Words of which a file with handlers has one. Fixed values.
HINTS = ["request", "params", "req.", "def ", "class ", "function", "controller", "view"]
#: Lines before a fetch and after it that may hold its check, its input, its function. Fixed values.
CHECK_FRAME, INPUT_FRAME, FUNCTION_FRAME = (-25, 11), (-2, 2), (-29, 0)


def _any(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))


def unchecked_fetches(files: DataFrame, key: list[str], kind: str = "kind", content: str = "content") -> DataFrame:
    """``files(key..., path, kind, content)`` -> ``(key..., path, line, in_handler, cvss,
    confidence)``: lines that fetch an object by what a caller sent, within two
    lines, with no check from 25 lines before to 11 after.

    A fetch in a handler's folder, or whose function takes a request, weighs
    more. Files without content have no lines. No row is left out for a file's
    or the report's sake.
    """
    folders = F.transform(F.split(F.col("path"), "/"), F.lower)
    low = F.lower(content)
    own = files.where(F.col(kind).isin(list(FETCH)) & ~F.arrays_overlap(folders, F.array(*map(F.lit, NO_HANDLERS))) & _any(low, HINTS))
    t, lt = F.col("line_text"), F.col("low")
    defines = F.contains(t, F.lit("def ")) | F.contains(t, F.lit("function")) | t.rlike(r"=>\s*\{|\)\s*=>")

    def flagged(k: str) -> DataFrame:
        """Of one language: a line is lower-cased once and asked for that language's tokens only."""
        said = X.lines(own.where(F.col(kind) == k), content).withColumn("low", F.lower("line_text"))
        flags = said.select(
            *key, "path", "line", t.rlike(FETCH[k]).alias("fetch"), _any(lt, INPUT[k]).alias("input"), (_any(lt, CHECKS[k]) | _any(lt, SIGNED)).alias("check"), F.when(defines, F.contains(lt, F.lit(REQUEST[k]))).alias("asks")
        )
        return flags.where(F.col("fetch") | F.col("input") | F.col("check") | F.col("asks").isNotNull())

    flags = reduce(DataFrame.unionByName, map(flagged, FETCH))
    near = lambda frame: Window.partitionBy(*key).orderBy("line").rangeBetween(*frame)
    seen = flags.select(
        *key, "path", "line", "fetch", F.max("input").over(near(INPUT_FRAME)).alias("given"), F.max("check").over(near(CHECK_FRAME)).alias("checked"),
        F.last("asks", ignorenulls=True).over(near(FUNCTION_FRAME)).alias("asked"),
    )
    in_folder = F.arrays_overlap(F.transform(F.split(F.col("path"), "/"), F.lower), F.array(*map(F.lit, HANDLERS))) | F.contains(F.lower(F.regexp_extract("path", r"([^/]*)$", 1)), F.lit("controller"))
    hit = seen.where(F.col("fetch") & F.col("given") & ~F.col("checked")).withColumn("in_handler", in_folder | F.coalesce("asked", F.lit(False)))
    return hit.select(*key, "path", "line", "in_handler", F.when(F.col("in_handler"), 7.5).otherwise(5.5).alias("cvss"), F.when(F.col("in_handler"), "high").otherwise("low").alias("confidence"))


#: By language: a guard, a method with its name. Fixed values.
GUARD = {
    "java": (r"@(?:Authorized|PreAuthorize|Secured|RolesAllowed|RequiresPermissions)\s*\(", r"(?:public|protected)\s+\w[\w<>,\s]*\s+(\w+)\s*\("),
    "python": (r"@(?:login_required|permission_required|requires_auth|auth_required|authenticated)", r"def\s+(\w+)\s*\("),
    "ruby/rails": (r"before_action\s+:(?:authenticate|authorize|require_login|check_auth)", r"def\s+(\w+)"),
    "node": (r"(?:requireAuth|isAuthenticated|authMiddleware|verifyToken|checkPermission)", r"(?:router\.\w+|app\.\w+)\s*\(\s*['\"]([^'\"]+)['\"]"),
    "go": (r"(?:accessTokenMiddleware|Middleware\(|JWT|Bearer|RequireAuth|authorize)", r"func\s+\([^)]+\)\s+(\w+)\s*\("),
    "rust": (r"(?:unified_auth|auth_configured|from_fn_with_state|layer\(.*auth)", r"(?:async\s+)?fn\s+(\w+)\s*\("),
}
#: Folders that aren't looked at; files that hold the guards themselves; methods that need none. Fixed values.
UNSEEN = [".git", "node_modules", "vendor", "__pycache__", ".venv", "target", "build", "dist", "test", "tests", "spec", "__tests__"]
GUARD_FILES = ["decorator", "decorators", "auth", "authentication", "authorization", "permissions", "permission", "middleware", "guards", "guard", "access_control", "acl"]
NO_ENDPOINTS = ["__init__", "initialize", "setup", "teardown", "toString", "hashCode", "equals", "compareTo"]
NO_ENDPOINTS_LOWER = ["wrapper", "wrapped", "decorator", "inner", "func", "fn"]
NO_ENDPOINT = r"^(?:_|(?i:require_|check_|assert_|ensure_|validate_|authorize|authenticate|verify_|has_|guard_|format_|parse_|build_|render_|serialize_|deserialize_|truncate))|(?i:_required|_decorator|_guard)$"
GUARD_LINES = 5


def unguarded_methods(files: DataFrame, key: list[str], kind: str = "kind", content: str = "content") -> DataFrame:
    """``(key..., path, line, name, siblings)``: methods without a guard on their
    line or the five before it, in files of which other methods have one; the
    first three names of those, comma-joined."""
    folders = F.slice(F.split(F.col("path"), "/"), 1, F.greatest(F.size(F.split(F.col("path"), "/")) - 1, F.lit(0)))
    stem = F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", ""))
    own = files.where(F.col(kind).isin(list(GUARD)) & ~F.arrays_overlap(folders, F.array(*map(F.lit, UNSEEN))) & ~stem.isin(GUARD_FILES))
    t = F.col("line_text")
    of = lambda f, none: reduce(lambda c, k: c.when(F.col(kind) == k, f(*GUARD[k])), GUARD, F.when(F.lit(False), none))
    flags = X.lines(own, content).select(*key, "path", "line", of(lambda g, m: t.rlike(g), False).alias("guard"), of(lambda g, m: F.regexp_extract(t, m, 1), "").alias("name")).where(F.col("guard") | (F.col("name") != ""))
    near = Window.partitionBy(*key).orderBy("line").rangeBetween(-GUARD_LINES, 0)
    methods = flags.withColumn("guarded", F.max("guard").over(near)).where("name <> ''")
    names = methods.where("guarded").select(*key, "name").distinct().withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("name"))).where("n <= 3")
    siblings = names.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("siblings"))
    plain = F.col("name").isin(NO_ENDPOINTS) | F.lower("name").isin(NO_ENDPOINTS_LOWER) | F.col("name").rlike(NO_ENDPOINT)
    return methods.where(~F.col("guarded") & ~plain).join(siblings, key).select(*key, "path", "line", "name", "siblings")
