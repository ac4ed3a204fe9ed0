"""Rules over lines: scans, caps, proximity, absence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import match_lines
from quarry.operators.relational import tolerance_join

Rule = tuple[str, str, float]


def scan(lines: DataFrame, rules: Sequence[Rule], *, any_case: bool = True, text: str = "line_text") -> DataFrame:
    """``lines`` x rules that match -> a row each with rule, title, cvss.

    The rules are part of the plan, not a table: one projection tries them all
    on each line and explodes those that match, so nothing is joined or shuffled.
    """
    flag = "(?i)" if any_case else ""
    tried = F.array(*(F.when(F.col(text).rlike(flag + p), F.struct(F.lit(i).alias("rule"), F.lit(t).alias("title"), F.lit(float(c)).alias("cvss"))) for i, (p, t, c) in enumerate(rules)))
    return lines.withColumn("m", F.explode(F.array_compact(tried))).select(*(c for c in lines.columns), "m.*")


def scan_by_language(lines: DataFrame, rules: dict[str, Sequence[Rule]], language: Column, *, any_case: bool = True) -> DataFrame:
    """The rules of each line's own language."""
    parts = [scan(lines.where(language == name), own, any_case=any_case).withColumn("language", F.lit(name)) for name, own in rules.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _hits(at: Column, rule: int, title: str, cvss: float) -> Column:
    return F.transform(at, lambda line: F.struct(F.lit(rule).alias("rule"), F.lit(title).alias("title"), F.lit(cvss).alias("cvss"), line.alias("line")))


def scan_content(files: DataFrame, rules: Sequence[tuple], *, any_case: bool = False, content: str = "content") -> DataFrame:
    """``files`` x matches of rules in whole texts: rule, title, cvss and the
    line on which the match begins, in place of the content. Matches may span
    lines. Like ``scan()`` one projection, with no join and no shuffle."""
    flag = "(?i)" if any_case else ""
    others = [c for c in files.columns if c != content]
    hits = []
    for i, (pattern, title, cvss, *unless) in enumerate(rules):
        at = match_lines(F.col(content), flag + pattern, *(flag + u for u in unless))
        hits.append(_hits(at, i, title, float(cvss)))
    return files.select(*others, F.explode(F.concat(*hits)).alias("m")).select(*others, "m.*")


def scan_content_by_kind(files: DataFrame, rules: dict[str, Sequence[tuple]], kind: str, *, any_case: bool = False) -> DataFrame:
    """``scan_content()`` with the rules of each file's own kind."""
    return reduce(DataFrame.unionByName, (scan_content(files.where(F.col(kind) == k), own, any_case=any_case) for k, own in rules.items()))


def check_then_use(lines: DataFrame, file: str, checks: Sequence[tuple[str, str, str, float]], within: int) -> DataFrame:
    """``(file, line, title, cvss)``: lines that match a check whose use follows
    within so many lines. Checks and uses of all rules are found in one pass;
    they meet on (file, rule, cell of lines), never all with all of a file."""
    t = F.col("line_text")
    marks = lambda at: F.array_compact(F.array(*(F.when(t.rlike(r[at]), F.lit(i)) for i, r in enumerate(checks))))
    found = lines.select(file, "line", marks(0).alias("checks"), marks(1).alias("uses"))
    check = found.select(file, "line", F.explode("checks").alias("rule"))
    use = found.select(file, F.col("line").alias("use_line"), F.explode("uses").alias("rule"))
    cell = lambda c: F.floor(c / within).cast("long")
    left = check.withColumn("cell", F.explode(F.array(cell(F.col("line")), cell(F.col("line")) + 1)))
    near_ = left.join(use.withColumn("cell", cell(F.col("use_line"))).distinct(), [file, "rule", "cell"]).where(F.col("use_line").between(F.col("line") + 1, F.col("line") + within))
    pick = lambda k: F.element_at(F.array(*(F.lit(r[k]) for r in checks)), F.col("rule") + 1)
    return near_.select(file, "line", "rule").distinct().select(file, "line", pick(2).alias("title"), pick(3).cast("double").alias("cvss"))


def recurring_names(lines: DataFrame, file: str, opening: str, name: str, within: int) -> DataFrame:
    """``(file, line, name)``: lines that match ``opening`` whose name (the first
    group of ``name``) stands again within the next lines."""
    t = F.col("line_text")
    opened = lines.where(t.rlike(opening)).select(file, "line", F.regexp_extract(t, name, 1).alias("name")).where("name <> ''")
    near_ = tolerance_join(opened, lines.select(file, F.col("line").alias("other"), "line_text"), file, "line", "other", within)
    hit = near_.where(F.col("other").between(F.col("line") + 1, F.col("line") + within) & F.contains("line_text", F.col("name")))
    return hit.select(file, "line", "name").distinct()


def missing_flags(files: DataFrame, file: str, content: str, flags: Sequence[tuple[str, str, float]]) -> DataFrame:
    """``(file, line, title, cvss)`` with line 1 for each flag that a file lacks, in any case."""
    low = F.lower(content)
    lacking = F.array_compact(F.array(*(F.when(~F.contains(low, F.lit(f.lower())), F.struct(F.lit(t).alias("title"), F.lit(float(c)).alias("cvss"))) for f, t, c in flags)))
    return files.select(file, F.lit(1).alias("line"), F.explode(lacking).alias("m")).select(file, "line", "m.*")


def capped(hits: DataFrame, per: list[tuple[list[str], int]], order: list[str]) -> DataFrame:
    """First hits in scan order, at most so many in each group, cap after cap."""
    for i, (group, most) in enumerate(per):
        n = f"n{i}_"
        hits = hits.withColumn(n, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(n) <= most).drop(n)
    return hits


def first_in_file(hits: DataFrame, file: str, *, line: str = "line") -> DataFrame:
    """One row for each (file, rule): its first line."""
    return hits.groupBy(file, "rule", "title", "cvss").agg(F.min(line).alias(line))


def near(sinks: DataFrame, sources: DataFrame, file: str, before: int, after: int) -> DataFrame:
    """Sinks with a source in the same file from ``before`` lines above to
    ``after`` below: an equi-join on cells of lines, one row a sink."""
    s = sources.select(F.col(file), F.col("line").alias("source_line")).distinct()
    pairs = tolerance_join(sinks, s, file, "line", "source_line", max(before, after))
    inside = F.col("source_line").between(F.col("line") - before, F.col("line") + after)
    return pairs.where(inside).groupBy(*sinks.columns).agg(F.min(F.abs(F.col("source_line") - F.col("line"))).alias("distance"))


def far_from_guard(targets: DataFrame, guards: DataFrame, file: str, beyond: int) -> DataFrame:
    """Targets in files that have guards, none of them within ``beyond`` lines.
    The nearest guard on either side comes from one sorted pass over both."""
    t = targets.select(file, "line", F.lit(False).alias("guard"))
    both = t.unionByName(guards.select(file, "line", F.lit(True).alias("guard")))
    at = F.when(F.col("guard"), F.col("line"))
    w = Window.partitionBy(file).orderBy("line", F.desc("guard"))
    above = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(file).orderBy(F.desc("line"), F.desc("guard"))
    below = F.last(at, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    near_ = both.withColumn("above", above).withColumn("below", below).where(~F.col("guard"))
    distance = F.least(F.col("line") - F.col("above"), F.col("below") - F.col("line"))
    return near_.withColumn("distance", distance).where(F.col("distance") > beyond).select(file, "line", "distance").distinct()


def present_without(lines: DataFrame, file: str, setup: str, teardown: str, most: int) -> DataFrame:
    """The first lines of files that match ``setup`` while no line of the
    file matches ``teardown``."""
    t = F.col("line_text")
    flagged = lines.select(file, "line", t.rlike(setup).alias("on"), t.rlike(teardown).alias("off")).where("on or off")
    closed = flagged.where("off").select(file).distinct()
    return capped(flagged.where("on").join(closed, file, "left_anti").select(file, "line"), [([file], most)], ["line"])


def missing_tokens(files: DataFrame, file: str, content: Column, tokens: list[str]) -> DataFrame:
    """``(file, token)`` for each token that a file lacks."""
    lacking = F.array_compact(F.array(*(F.when(~F.contains(content, F.lit(x)), F.lit(x)) for x in tokens)))
    return files.select(file, F.explode(lacking).alias("token"))


def divergent(units: DataFrame, group: list[str], checked: Column, most: int, order: str) -> DataFrame:
    """Unchecked units of groups of which others are checked, the first few of
    each group. The group's verdict is an aggregate joined back."""
    verdict = units.groupBy(*group).agg(F.bool_or(checked).alias("some"))
    rows = units.where(~checked).join(verdict.where("some").select(*group), group, "left_semi")
    return capped(rows, [(group, most)], [order])


def complexity(lines: DataFrame, file: str, least: float) -> DataFrame:
    """Branches per line, deepest nesting by braces and length, as one score."""
    t = F.col("line_text")
    branches = F.regexp_count(t, F.lit(r"\b(if|for|while|case|catch|elif)\b"))
    step = F.regexp_count(t, F.lit(r"\{")) - F.regexp_count(t, F.lit(r"\}"))
    depth = F.sum(step).over(Window.partitionBy(file).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    own = lines.select(file, branches.alias("b"), depth.alias("d")).groupBy(file).agg(F.sum("b").alias("branches"), F.count("*").alias("n"), F.greatest(F.max("d"), F.lit(0)).alias("nesting"))
    return own.withColumn("score", F.col("branches") / F.col("n") * 50 + 2 * F.col("nesting") + F.log1p(F.col("n").cast("double"))).where(F.col("score") >= least)
