"""Review plans: tasks out of leads, obligations matched to tasks, files owned by components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.report import plan_band


def planned_tasks(leads: DataFrame, key: list[str], threshold: float, disproved: Column) -> DataFrame:
    """One task for each key: its gravest lead, the earliest of equals, with its band. Disproved leads make none."""
    best = F.max_by(F.struct("id", "cvss"), F.struct("cvss", -F.col("id"))).alias("b")
    tasks = leads.where(~disproved).groupBy(*key).agg(best, F.count("*").alias("leads"))
    return tasks.select(*key, "b.id", "b.cvss", "leads", plan_band(F.col("b.cvss"), threshold).alias("band"))


def matched_obligations(obligations: DataFrame, tasks: DataFrame, key: list[str]) -> DataFrame:
    """``obligations(id, key...)``, ``tasks(task_id, source_ref, key...)`` -> ``(id,
    task_id, how)``. A reference decides; without one, a key that exactly one
    task has; else how is missing or ambiguous and the task null."""
    by_ref = tasks.where("source_ref is not null").groupBy(F.col("source_ref").alias("ref_")).agg(F.min("task_id").alias("by_ref"))
    by_key = tasks.groupBy(*(F.col(k).alias(f"{k}_") for k in key)).agg(F.min("task_id").alias("by_key"), F.count("*").alias("n"))
    same = [F.col(k) == F.col(f"{k}_") for k in key]
    wide = obligations.join(by_ref, F.col("id") == F.col("ref_"), "left").join(by_key, same, "left")
    how = F.when(F.col("by_ref").isNotNull(), "reference").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return wide.select("id", F.when(how == "reference", F.col("by_ref")).when(how == "unique", F.col("by_key")).alias("task_id"), how.alias("how"))


def owned_by(files: DataFrame, path: str, owners: DataFrame, owner: str) -> DataFrame:
    """``files`` with ``owner``: the longest of ``owners(owner)`` that is a folder
    above the file, null without one. Each file asks for all its folders, so this is an equi-join."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    asked = files.select(F.col(path).alias("p_"), F.explode(folders).alias(owner)).where(F.col(owner) != F.col("p_"))
    best = asked.join(owners.select(owner).distinct(), owner).groupBy("p_").agg(F.max_by(owner, F.length(owner)).alias(owner))
    return files.join(best, F.col(path) == F.col("p_"), "left").drop("p_")


def zero_filled(dimension: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``(key, n, covered, covered_pct)`` for every row of a small dimension."""
    wide = dimension.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("covered", F.col("n") > 0)
    share = wide.agg(F.bround(100.0 * F.count_if("covered") / F.greatest(F.count("*"), F.lit(1)), 1).alias("covered_pct"))
    return wide.crossJoin(F.broadcast(share))  # share: one row


def latest_with(jobs: DataFrame, group: str, order: str, sources: list[Column], out: str) -> DataFrame:
    """``(group, order, out)``: the newest job with a value, its first source that isn't empty."""
    found = F.coalesce(*(F.nullif(s, F.lit("")) for s in sources))
    return jobs.withColumn(out, found).where(F.col(out).isNotNull()).groupBy(group).agg(F.max(order).alias(order), F.max_by(out, order).alias(out))
