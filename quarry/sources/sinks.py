"""Sinks: snapshots, metric lines, and compare-and-set projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, *parts: str) -> None:
    """Compact JSON, partitioned by ``parts``; the committer makes it atomic."""
    df.write.mode("overwrite").partitionBy(*parts).json(path)


def metric_lines(df: DataFrame, name: str, value: Column, **labels: Column) -> DataFrame:
    """``(line)`` in the text exposition format: name{label="v"} value."""
    escaped = lambda c: F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    inner = F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), escaped(c), F.lit('"')) for k, c in labels.items()))
    return df.select(F.concat(F.lit(f"{name}{{"), inner, F.lit("} "), value.cast("string")).alias("line"))


def changed_only(new: DataFrame, stored: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of ``new`` whose generation is later than the stored one's."""
    old = stored.select(F.col(key).alias("k_"), F.col(generation).alias("g_"))
    return new.join(old, new[key] == F.col("k_"), "left").where(F.col("g_").isNull() | (F.col("g_") < F.col(generation))).drop("k_", "g_")
