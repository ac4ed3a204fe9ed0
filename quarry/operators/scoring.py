"""Severity, confidence, classification and prefilter columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keywords in the order in which they are tried, and their categories. Fixed values.
KEYWORD_CATEGORY = {
    "command injection": "A03",
    "code injection": "A03",
    "SQL injection": "A03",
    "XSS": "A03",
    "path traversal": "A03",
    "template injection": "A03",
    "SSTI": "A03",
    "deserialization": "A08",
    "buffer overflow": "A03",
    "format string": "A03",
    "auth bypass": "A01",
    "access control": "A01",
    "IDOR": "A01",
    "privilege": "A01",
    "admin": "A01",
    "secret": "A02",
    "crypto": "A02",
    "hardcoded": "A02",
    "weak random": "A02",
    "debug": "A05",
    "CORS": "A05",
    "SSL": "A05",
    "config": "A05",
    "dependency": "A06",
    "vulnerable": "A06",
    "SSRF": "A10",
}
CATEGORIES = [f"A{i:02d}" for i in range(1, 11)]
DOMAIN_OF = {"A03": "injection", "A01": "access_control", "A02": "crypto_secrets", "A05": "config_infra", "A06": "config_infra"}
#: Base metric weights of CVSS 3. Fixed values.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20},
    "AC": {"L": 0.77, "H": 0.44},
    "PR_U": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_C": {"N": 0.85, "L": 0.68, "H": 0.50},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"N": 0.0, "L": 0.22, "H": 0.56},
}
DOS_CAP = 5.3
#: Lowest scores of grave classes. Fixed values.
FLOORS = {
    "command_injection": 9.0,
    "code_injection": 8.8,
    "deserialization": 8.5,
    "authz_bypass": 8.1,
    "api_surface": 8.0,
    "sql_injection": 8.0,
    "ssti": 8.5,
    "path_traversal_write": 7.5,
}
TEST_FOLDERS = ["test", "tests", "spec", "specs", "__tests__", "__mocks__", "examples", "example", "vendor", "fixtures", "testdata", "test_data", "mocks", "stubs", "doc", "docs"]
TEST_FILE = r"^(test_.*|.*_test\.go|.*_spec\.rb|.*\.test\.js|.*\.spec\.ts)$"


def blob(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))


def first_match(text: Column, rules: dict[str, str], otherwise: str | None) -> Column:
    """The value of the first rule whose keyword the (lower-case) text contains."""
    out = None
    for word, value in rules.items():
        hit = F.contains(text, F.lit(word.lower()))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def category(text: Column) -> Column:
    return first_match(text, KEYWORD_CATEGORY, "A04")


def domain(text: Column) -> Column:
    """The domain of the first keyword whose category has one."""
    return first_match(text, {k: DOMAIN_OF[v] for k, v in KEYWORD_CATEGORY.items() if v in DOMAIN_OF}, "injection")


def primitive(text: Column) -> Column:
    has = lambda *ws: F.greatest(*(F.contains(text, F.lit(w)) for w in ws)) if len(ws) > 1 else F.contains(text, F.lit(ws[0]))
    return (
        F.when(has("command", "exec", "system"), "X-1").when(has("ssti", "template"), "X-3").when(has("eval", "dynamic"), "X-4").when(has("deserializ"), "X-5")
        .when(has("write", "upload"), "W-1").when(has("travers") & has("write", "save"), "W-3").when(has("proto", "pollution"), "W-9")
        .when(has("travers", "read"), "R-3").when(has("sql"), "R-2").when(has("ssrf"), "R-4").otherwise("X-13")
    )


def confidence(tool: Column, stated: Column, cvss: Column) -> Column:
    points = (
        F.when(tool == "taint-proximity", 3).when(tool.isin("brakeman", "semgrep"), 2).when(tool.isin("config-audit", "attack-surface-map"), 1).otherwise(0)
        + F.when(stated == "high", 2).when(stated == "medium", 1).otherwise(0)
        + F.when(cvss >= 8.0, 2).when(cvss >= 6.0, 1).otherwise(0)
    )
    return F.when(points >= 5, "high").when(points >= 3, "medium").otherwise("low")


def severity(cvss: Column, bug_class: Column, tool: Column, grave_tools: list[str]) -> tuple[Column, Column]:
    """Score and priority: availability is capped, grave classes have a floor."""
    floor = F.create_map(*(F.lit(x) for kv in FLOORS.items() for x in kv))[bug_class]
    dos, high = bug_class == "denial_of_service", floor.isNotNull() & ((cvss >= 7.0) | tool.isin(grave_tools))
    score = F.when(dos, F.least(cvss, F.lit(DOS_CAP))).when(high, F.greatest(cvss, floor)).otherwise(cvss)
    return score, F.when(dos, "deprioritized_dos").when(high, "high_severity").otherwise("normal")


def band(cvss: Column) -> Column:
    return F.when(cvss >= 9, "critical").when(cvss >= 7, "high").when(cvss >= 4, "medium").otherwise("low")


def cvss3(av: Column, ac: Column, pr: Column, ui: Column, scope: Column, c: Column, i: Column, a: Column) -> Column:
    """CVSS 3 base score, null if any metric is unknown."""
    of = lambda name, x: F.create_map(*(F.lit(y) for kv in CVSS[name].items() for y in kv))[F.upper(x)]
    changed, known = F.upper(scope) == "C", F.upper(scope).isin("U", "C")
    iss = 1 - (1 - of("CIA", c)) * (1 - of("CIA", i)) * (1 - of("CIA", a))
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    ease = 8.22 * of("AV", av) * of("AC", ac) * F.when(changed, of("PR_C", pr)).otherwise(of("PR_U", pr)) * of("UI", ui)
    total = F.least(F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease), F.lit(10.0))
    return F.when(known & ease.isNotNull() & iss.isNotNull(), F.when(impact <= 0, 0.0).otherwise(F.ceil((total - 1e-10) * 10) / 10))


def prefilter_reason(findings: DataFrame, order: str) -> DataFrame:
    """``findings`` with ``reason``: why it is no lead, null if it is one.

    Test and documentation paths first, then comments, then guarded sinks, then
    repeats of (file, line, title) among what those rules passed.
    """
    path = F.lower(F.replace(F.coalesce("file", F.lit("")), F.lit("\\"), F.lit("/")))
    parts = F.split(path, "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    matched = F.filter(folders, lambda p: p.isin(TEST_FOLDERS))
    text = F.concat_ws("\n", F.lower("title"), path, F.lower("description"))
    guarded = text.rlike("safe[_-](ping|calc|whois|read)")
    early = (
        F.when(name.rlike(TEST_FILE), F.concat(F.lit("Test file: "), name)).when(F.size(matched) > 0, F.concat(F.lit("In "), F.get(matched, F.lit(0)), F.lit("/ directory")))
        .when((F.size(parts) == 1) & name.isin(TEST_FOLDERS), F.concat(F.lit("Test/docs path: "), F.col("file")))
        .when(F.lower("description").rlike("comment|string literal"), "comment_or_string").when(guarded, "disproven_guarded_sink")
    )
    marked = findings.withColumn("early_", early)
    first = F.min(F.when(F.col("early_").isNull(), F.col(order))).over(Window.partitionBy("file", "line", "title"))
    return marked.withColumn("first_", first).withColumn("reason", F.coalesce("early_", F.when(F.col(order) > F.col("first_"), "duplicate"))).drop("early_", "first_")


def grade(f1: Column) -> Column:
    return F.when(f1.isNull(), "N/A").when(f1 >= 0.9, "A").when(f1 >= 0.75, "B").when(f1 >= 0.6, "C").when(f1 >= 0.4, "D").otherwise("F")


def precision_recall(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by group; undefined ratios are null."""
    t = df.groupBy(*by).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return t.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * p * r, p + r))
