"""Choosing within a budget: ranked rows cut by count or by a running sum.

Rows are put in order by ranges of their score, so a group of any size is many
tasks: each range is summed first, and only ranges that the budget reaches are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(df: DataFrame, group: list[str], order: list[tuple[str, bool]], cost: Column, budget: int, *, mandatory: Column | None = None, bucket: Column, whole: bool = True) -> DataFrame:
    """Rows of each group in order until ``budget`` is spent, with ``place`` from
    1, ``spent`` up to and with the row, and ``given``: the row's share of the budget.

    ``order``: columns and whether they fall; together they tell rows apart.
    Mandatory rows come first and count, and stay whatever they cost.
    ``bucket`` is a whole number that never falls along the order of the other rows, a coarser
    form of its first column; null goes last. ``whole`` drops a row that only
    a part of the budget is left for; otherwise it stays with that part.
    Costs are whole numbers, null and negative ones 0. Rows after one that
    didn't fit are not tried.
    """
    first = F.coalesce(mandatory, F.lit(False)) if mandatory is not None else F.lit(False)
    named = df.withColumn("must_", first).withColumn("cost_", F.greatest(F.coalesce(cost.cast("long"), F.lit(0)), F.lit(0)))
    rows = named.withColumn("b_", F.when(F.col("must_"), F.lit(-(2**62))).otherwise(F.coalesce(bucket.cast("long"), F.lit(2**62))))
    sums = rows.groupBy(*group, "b_").agg(F.sum("cost_").alias("s_"), F.count("*").alias("n_"))
    up = Window.partitionBy(*group).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    reached = sums.select(*group, "b_", F.coalesce(F.sum("s_").over(up), F.lit(0)).alias("before_"), F.coalesce(F.sum("n_").over(up), F.lit(0)).alias("placed_"))
    reached = reached.where((F.col("before_") < budget) | (F.col("b_") == -(2**62)))
    keys = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    same = F.col("b_").eqNullSafe(F.col("b2_"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}2_"))
    own = rows.join(reached.withColumnsRenamed({"b_": "b2_", **{g: f"{g}2_" for g in group}}), same)
    w = Window.partitionBy(*group, "b_").orderBy(*keys)
    ran = own.withColumn("spent", (F.col("before_") + F.sum("cost_").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long")).withColumn("place", (F.col("placed_") + F.row_number().over(w)).cast("long"))
    start = F.col("spent") - F.col("cost_")
    fits = (F.col("spent") <= budget) if whole else (start < budget)
    kept = ran.where(F.col("must_") | fits)
    given = F.when(F.col("must_"), F.col("cost_")).otherwise(F.least(F.col("cost_"), F.lit(budget) - start))
    return kept.select(*df.columns, "place", "spent", given.alias("given"))


def first_in_order(df: DataFrame, group: list[str], order: list[tuple[str, bool]], most: int, *, mandatory: Column | None = None, bucket: Column) -> DataFrame:
    """The first ``most`` rows of each group, mandatory ones before all others:
    a budget of rows. ``place`` from 1."""
    return within_budget(df, group, order, F.lit(1), most, mandatory=mandatory, bucket=bucket).where(F.col("place") <= most).drop("spent", "given")
