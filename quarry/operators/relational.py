"""Latest per group, paging, diffs, scoping, tolerance and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_group(df: DataFrame, group: str, *order: str) -> DataFrame:
    """The row of each group with the largest ``order`` columns. An
    aggregate, so it combines on the map side and a hot group is one row a task."""
    best = F.max(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.struct(*df.columns).alias("row"))).alias("best")
    return df.groupBy(group).agg(best).select("best.row.*")


def ranked_per_group(df: DataFrame, group: list[str], order: list[Column], keep: int, rank: str = "rank") -> DataFrame:
    """The first ``keep`` rows of each group, ranked from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= keep)


def zero_filled_counts(df: DataFrame, column: str, values: list[str], out: str = "n") -> DataFrame:
    """Counts for every one of a fixed list of values, 0 where there is none."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counted = df.groupBy(column).agg(F.count("*").alias(out))
    return wanted.join(counted, column, "left").select(column, F.coalesce(out, F.lit(0).cast("long")).alias(out))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page; the limit is clamped to 1..most, a limit of 0 gives no row."""
    if limit == 0:
        return df.limit(0)
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def keyset_page(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next rows by key: a range filter that reaches the scan."""
    return df.where(F.col(key) > after).orderBy(key).limit(limit)


def key_diff(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """``(key, state)``: new, resolved or persistent."""
    c, p = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((current, "c_"), (previous, "p_")))
    state = F.when(F.col("p_").isNull(), "new").when(F.col("c_").isNull(), "resolved").otherwise("persistent")
    return c.join(p, key, "full_outer").select(key, state.alias("state"))


def current_scope(findings: DataFrame, latest: DataFrame, grace_seconds: float = 1.0) -> DataFrame:
    """Findings of their repository's latest job.

    ``latest(repo_id, job_id, started_at)``. A finding without a job counts if
    it isn't older than the job by more than the grace; one with a job only if that is
    the latest. Without a latest job only findings without a job count.
    """
    job = latest.select(F.col("repo_id").alias("r_"), F.col("job_id").alias("j_"), F.col("started_at").alias("s_"))
    late = F.unix_micros(F.col("s_").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")) <= int(grace_seconds * 1_000_000)
    mine = F.when(F.col("scan_job_id").isNull(), F.col("s_").isNull() | late).otherwise(F.coalesce(F.col("scan_job_id") == F.col("j_"), F.lit(False)))
    return findings.join(job, findings["repo_id"] == F.col("r_"), "left").where(mine).drop("r_", "j_", "s_")


def tolerance_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, within: int) -> DataFrame:
    """Pairs with equal keys and positions at most ``within`` apart.

    Positions are cut into cells of the tolerance's width; each left row looks
    in its own cell and the two beside it, so the join is an equi-join on
    (key, cell) however many rows share a key. ``left`` and ``right`` have no
    other names in common.
    """
    cell = lambda c: F.floor(F.col(c) / (within + 1)).cast("long")
    a = left.withColumn("cell_", F.explode(F.array(*(cell(left_at) + d for d in (-1, 0, 1)))))
    b = right.withColumn("cell_", cell(right_at))
    return a.join(b, [key, "cell_"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= within).drop("cell_")


def nearest_before(df: DataFrame, keys: list[str], at: list[str], is_anchor: Column, value: Column, out: str) -> DataFrame:
    """``df`` with the value of the last anchor row at or before each row, in
    one sorted pass; no pairs are made."""
    upto = Window.partitionBy(*keys).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(is_anchor, value), ignorenulls=True).over(upto))


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2 and so on within equal keys, in ``order``.

    ``bucket`` grows with the order, as a coarser form of its first column. Rows
    are numbered within (keys, bucket), and each bucket begins where the counts
    of those before it end, so a key with a third of all rows is many groups.
    """
    rows = df.withColumn("bucket_", bucket)
    counts = rows.groupBy(*keys, "bucket_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("bucket_").alias("of_"), F.coalesce(before, F.lit(0)).alias("before_"))
    own = rows.withColumn("own_", F.row_number().over(Window.partitionBy(*keys, "bucket_").orderBy(*order)))
    same = F.col("bucket_").eqNullSafe(F.col("of_"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return own.join(starts, same).select(*df.columns, (F.col("before_") + F.col("own_")).alias(out))


def batches(df: DataFrame, order: list[str], size: int, group: str) -> DataFrame:
    """``df`` with ``batch``: consecutive runs of ``size`` rows within a group. Rows
    are dealt by their first two columns of order, the second a number cut into
    cells, so neither a group nor a value of the first column is one task."""
    coarse = F.struct(F.col(order[0]), F.floor(F.col(order[1]) / 16)) if len(order) > 1 else F.col(order[0])
    rows = numbered(df, [group], order, coarse, "place_")
    return rows.withColumn("batch", F.floor((F.col("place_") - 1) / size)).drop("place_")


def first_of_union(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Union by name, missing columns null; of equal keys the first part's row
    with the smallest ``order`` stays."""
    whole = None
    for i, p in enumerate(parts):
        p = p.withColumn("part_", F.lit(i))
        whole = p if whole is None else whole.unionByName(p, allowMissingColumns=True)
    first = F.min_by(F.struct(*[c for c in whole.columns if c != "part_"]), F.struct("part_", order)).alias("row")
    return whole.groupBy(*(F.col(k).alias(f"k_{k}") for k in keys)).agg(first).select("row.*")
