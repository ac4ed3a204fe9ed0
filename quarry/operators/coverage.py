"""Coverage matrices, ledgers and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(hits: DataFrame, row: str, column: str, values: list[str], yes: str = "covered", no: str = "not_tested") -> DataFrame:
    """``row`` by the fixed ``values`` of ``column``: covered or not. One
    aggregate; no pivot over unknown values."""
    return hits.groupBy(row).agg(*(F.when(F.bool_or(F.coalesce(F.col(column) == v, F.lit(False))), yes).otherwise(no).alias(v) for v in values))


def capped_percent(done: Column, total: Column) -> Column:
    """One decimal; 100 only if all are done, 99.9 at most otherwise."""
    p = F.bround(100.0 * done / F.greatest(total, F.lit(1)), 1)
    return F.when(done >= total, p).otherwise(F.least(p, F.lit(99.9)))


def summary(nodes: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Counts by status, percent covered and whether the gate is open."""
    n = lambda s: F.count_if(F.col(status) == s)
    out = nodes.groupBy(*by).agg(F.count("*").alias("total"), n("covered").alias("covered"), n("pending").alias("pending"), n("running").alias("running"), n("blocked").alias("blocked"))
    return out.withColumn("percent", capped_percent(F.col("covered"), F.col("total"))).withColumn("complete", F.col("covered") == F.col("total"))


def tool_ledger(results: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Applicable tools and the share of them that completed; at least one in
    the denominator."""
    off = F.col(status).isin("skipped", "not-installed")
    out = results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(off).alias("not_applicable"), F.count_if(F.col(status) == "completed").alias("completed"))
    return out.withColumn("percent", F.bround(100.0 * F.col("completed") / F.greatest(F.col("total") - F.col("not_applicable"), F.lit(1)), 1))


def gates(surfaces: DataFrame, tools: str, required: dict[str, list[str]]) -> DataFrame:
    """A boolean for each gate: did any of its tools run on the surface; and all_gates."""
    out = surfaces.withColumns({g: F.arrays_overlap(F.col(tools), F.array(*map(F.lit, ts))) for g, ts in required.items()})
    every = F.lit(True)
    for g in required:
        every = every & F.col(g)
    return out.withColumn("all_gates", every)
