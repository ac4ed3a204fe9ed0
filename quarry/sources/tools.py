"""Reports of external scanners -> finding rows and what is wrong with a report.

Each takes ``reports(key, output)``. Rows that are whole are kept although
others are malformed; ``*_failure`` says why a report can't be called clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEMGREP_ROW = "check_id string, path string, start struct<line:int>, extra struct<message:string>"


def _is_object(text: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(text), F.lit("{")) & F.try_parse_json(text).isNotNull(), F.lit(False))


def _semgrep_rows(reports: DataFrame, key: str) -> DataFrame:
    rows = F.from_json("output", "results array<string>")["results"]
    own = reports.select(key, F.posexplode(rows).alias("ordinal", "row")).withColumn("r", F.from_json("row", _SEMGREP_ROW))
    whole = (F.coalesce("r.check_id", F.lit("")) != "") & (F.coalesce("r.path", F.lit("")) != "") & (F.coalesce("r.start.line", F.lit(0)) > 0) & F.col("r.extra").isNotNull()
    return own.withColumn("whole", whole)


def semgrep(reports: DataFrame, key: str) -> DataFrame:
    """``(key, ordinal, rule, path, line, message)`` of the rows that are whole."""
    rows = _semgrep_rows(reports, key).where("whole")
    return rows.select(key, "ordinal", F.col("r.check_id").alias("rule"), F.col("r.path").alias("path"), F.col("r.start.line").alias("line"), F.coalesce("r.extra.message", F.lit("")).alias("message"))


def semgrep_failure(reports: DataFrame, key: str, code: str) -> DataFrame:
    """``(key, kept, reason)``; reason null if the run was clean. The first of:
    exit code, no list of results, malformed rows, scan errors."""
    n = _semgrep_rows(reports, key).groupBy(F.col(key).alias("k_")).agg(F.count_if("whole").alias("kept"), F.count_if(~F.col("whole")).alias("malformed"))
    doc = F.from_json("output", "results array<string>, errors array<string>")
    errors = F.size(F.coalesce(doc["errors"], F.array().cast("array<string>")))
    bad = F.coalesce("malformed", F.lit(0))
    reason = (
        F.when(~F.col(code).isin(0, 1), F.format_string("semgrep execution failed (rc=%d)", code)).when(doc["results"].isNull(), "semgrep returned no usable JSON results list")
        .when(bad > 0, F.format_string("semgrep returned %d malformed result rows", bad)).when(errors > 0, F.format_string("semgrep recorded %d scan errors", errors))
    )
    return reports.join(n, F.col(key) == F.col("k_"), "left").select(key, F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), reason.alias("reason"))


def npm_audit_failure(output: Column) -> Column:
    doc = F.from_json(output, "vulnerabilities string, message string, error string")
    return (
        F.when(~_is_object(output), "npm audit returned a non-object JSON document")
        .when(doc["vulnerabilities"].isNull() | doc["error"].isNotNull(), "npm audit could not analyze the dependency graph")
    )


def npm_audit(reports: DataFrame, key: str) -> DataFrame:
    """``(key, package, severity, via_title)``; reports that failed give no row."""
    sound = reports.where(npm_audit_failure(F.col("output")).isNull())
    found = F.from_json("output", "vulnerabilities map<string,struct<severity:string,via:array<string>>>")["vulnerabilities"]
    rows = sound.select(key, F.explode(F.map_entries(found)).alias("v"))
    title = F.get_json_object(F.get(F.col("v.value.via"), F.lit(0)), "$.title")
    return rows.select(key, F.col("v.key").alias("package"), F.coalesce("v.value.severity", F.lit("unknown")).alias("severity"), F.coalesce(title, F.lit("")).alias("via_title"))


def dependency_check(reports: DataFrame, key: str) -> DataFrame:
    """``(key, dependency, advisory, cvss, file)``; a score of 0 is none, and none is 7."""
    score = "struct<baseScore:double,score:double>"
    schema = f"dependencies array<struct<fileName:string,vulnerabilities:array<struct<name:string,id:string,cvssv3:{score},cvssv2:{score}>>>>"
    rows = reports.select(key, F.explode(F.from_json("output", schema)["dependencies"]).alias("d")).select(key, F.coalesce("d.fileName", F.lit("unknown dependency")).alias("dependency"), F.explode("d.vulnerabilities").alias("v"))
    of = lambda c: F.coalesce(F.nullif(F.col(f"v.{c}.baseScore"), F.lit(0.0)), F.nullif(F.col(f"v.{c}.score"), F.lit(0.0)), F.lit(7.0))
    cvss = F.when(F.col("v.cvssv3").isNotNull(), of("cvssv3")).when(F.col("v.cvssv2").isNotNull(), of("cvssv2")).otherwise(7.0)
    file = F.when(F.col("dependency").rlike(r"\.(jar|war)\z"), "pom.xml").otherwise("build.gradle")
    return rows.select(key, "dependency", F.coalesce("v.name", "v.id", F.lit("unknown-advisory")).alias("advisory"), F.greatest(F.lit(0.0), F.least(F.lit(10.0), cvss)).alias("cvss"), file.alias("file"))


_TRUFFLE = "DetectorName string, DetectorType int, SourceMetadata struct<Data:struct<Filesystem:struct<file:string,line:long>>>, Raw string, RawV2 string, Redacted string, level string, msg string, logger string, error string"


def trufflehog(reports: DataFrame, key: str) -> DataFrame:
    """``(key, ordinal, kind, detector, file, line)`` of every line that isn't
    blank: detection, information, error or invalid. The secrets themselves
    are not carried on."""
    lines = reports.select(key, F.posexplode(F.split("output", "\n")).alias("ordinal", "text")).where(F.btrim("text", F.lit(" \t\r")) != "")
    r = F.from_json("text", _TRUFFLE)
    o = lines.withColumn("object", _is_object(F.col("text"))).withColumn("r", r)
    log = F.col("r.DetectorName").isNull() & F.col("r.SourceMetadata").isNull() & F.col("r.level").isNotNull() & F.col("r.msg").isNotNull() & F.col("r.logger").isNotNull()
    quiet = F.lower("r.level").rlike(r"\A(?:info|debug|trace)(?:-[0-5])?\z") & (F.coalesce("r.error", F.lit("")) == "")
    file, line = F.col("r.SourceMetadata.Data.Filesystem.file"), F.coalesce("r.SourceMetadata.Data.Filesystem.line", F.lit(0).cast("long"))
    whole = (
        (F.btrim(F.coalesce("r.DetectorName", F.lit(""))) != "") & (F.length("r.DetectorName") <= 160) & (F.coalesce("r.DetectorType", F.lit(-1)) >= 0)
        & F.coalesce("r.Raw", "r.RawV2", "r.Redacted").isNotNull() & (F.btrim(F.coalesce(file, F.lit(""))) != "") & (F.length(file) <= 4096) & line.between(0, 2147483647)
    )
    kind = F.when(~F.col("object"), "invalid").when(log & quiet, "information").when(log, "error").when(F.coalesce(whole, F.lit(False)), "detection").otherwise("invalid")
    named = o.select(key, "ordinal", kind.alias("kind"), F.col("r.DetectorName").alias("detector"), file.alias("file"), line.alias("line"))
    only = lambda c: F.when(F.col("kind") == "detection", F.col(c)).alias(c)
    return named.select(key, "ordinal", "kind", only("detector"), only("file"), only("line"))


_GO = "osv struct<id:string,summary:string,aliases:array<string>>, finding struct<osv:string,trace:array<struct<module:string,package:string,function:string,position:struct<filename:string,line:long>>>>"


def govulncheck(objects: DataFrame, key: str) -> DataFrame:
    """``objects(key, ordinal, object)`` of a stream -> ``(key, osv, reachable,
    package, function, line, summary, cvss)``: of an advisory's findings the first, or the
    first that is reachable, with the advisory's own summary."""
    r = objects.select(key, "ordinal", F.from_json("object", _GO).alias("r"))
    f = r.where("r.finding is not null").select(key, "ordinal", F.col("r.finding.osv").alias("osv"), F.col("r.finding.trace").alias("trace"))
    reach = F.exists(F.coalesce("trace", F.array().cast(f.schema["trace"].dataType)), lambda t: F.coalesce(t["function"], F.lit("")) != "")
    best = f.withColumn("reachable", reach).groupBy(key, "osv").agg(F.max_by(F.struct("reachable", F.get("trace", F.lit(0)).alias("top")), F.struct("reachable", -F.col("ordinal"))).alias("b"))
    about = r.where("r.osv is not null").groupBy(key, F.col("r.osv.id").alias("osv")).agg(F.max_by("r.osv.summary", "ordinal").alias("summary"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return best.join(about, [key, "osv"], "left").select(
        key, "osv", F.col("b.reachable").alias("reachable"), F.coalesce("b.top.package", "b.top.module", F.lit("")).alias("package"), empty("b.top.function").alias("function"),
        F.coalesce("b.top.position.line", F.lit(0).cast("long")).alias("line"), empty("summary").alias("summary"), F.when(F.col("b.reachable"), 8.0).otherwise(5.0).alias("cvss"),
    )
