"""Leads: one-to-one assignment, history, key figures, ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.scratch import dropped, saved


def greedy_assignment(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs(left, right)``: whom each left row may take -> ``(left, right)``, what
    it takes when the left rows, in their order, each take the first right row that is still free.

    Found in rounds rather than row by row: every left row asks for its first
    right row, each right row keeps the first that asks, and the others strike
    it off their lists. When nobody is turned away this is the sequential result,
    because all right rows prefer earlier left rows. A round is two aggregates and an anti-join;
    no group is gathered.
    """
    left_over = saved(pairs.select(left, right).distinct())
    while True:
        asked = saved(left_over.groupBy(left).agg(F.min(right).alias(right)))
        kept = asked.groupBy(right).agg(F.min(left).alias(left))
        refused = saved(asked.join(kept, [left, right], "left_anti"))
        if refused.isEmpty():
            dropped(left_over, refused)
            return asked
        rest = saved(left_over.join(refused, [left, right], "left_anti"))
        dropped(left_over, asked, refused)
        left_over = rest


class _Free:
    """The free rights of a block, in order of line and id: the first of each line
    is at hand, and so is, by a heap whose stale entries are dropped when met, the first of all."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], within: int) -> None:
        lines, self.ids = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 2
        self.lines, self.at = np.unique(lines, return_index=True)
        self.past = np.append(self.at[1:], len(self.ids))
        self.first = self.ids[self.at]
        self.heap = list(zip(self.first.tolist(), range(len(self.first)), strict=True))
        heapify(self.heap)
        self.taken: set[int] = set()
        self.within, self.none = within, np.iinfo(np.int64).max

    def _next(self, k: int) -> None:
        self.at[k] += 1
        self.first[k] = self.ids[self.at[k]] if self.at[k] < self.past[k] else self.none
        if self.at[k] < self.past[k]:
            heappush(self.heap, (int(self.first[k]), k))

    def _near(self, line: int) -> int | None:
        a, z, zero = np.searchsorted(self.lines, [line - self.within, line + self.within + 1, 0]).tolist()
        places = [int(np.argmin(self.first[a:z])) + a] if z > a else []
        if zero < len(self.lines) and self.lines[zero] == 0:
            places.append(zero)
        k = min(places, key=lambda k: self.first[k], default=None)
        return None if k is None or self.at[k] >= self.past[k] else k

    def _any(self) -> int | None:
        while self.heap and (self.at[self.heap[0][1]] >= self.past[self.heap[0][1]] or self.first[self.heap[0][1]] != self.heap[0][0]):
            heappop(self.heap)
        return self.heap[0][1] if self.heap else None

    def take(self, line: int) -> int | None:
        while (k := self._near(line) if line else self._any()) is not None:
            own = int(self.first[k])
            self._next(k)
            if own not in self.taken:  # an id may stand on several lines
                self.taken.add(own)
                return own
        return None


def greedy_line_assignment(lefts: DataFrame, rights: DataFrame, block: list[str], left: str, right: str, left_line: str, right_line: str, within: int) -> DataFrame:
    """As ``greedy_assignment`` of all pairs of a block whose lines are at most
    ``within`` apart or one of whose lines is 0 or null, without making the pairs,
    whose number grows with the square of a block: ``(left, right)``, ids as long.

    Blocks with a null match nothing. A left id is in one row, a right id in one block. Rows
    are sorted by block, rights before lefts; a task streams them and holds line and id, 16 bytes, of
    each right of one block. Within a block each choice depends on those before, so a block is one task's.
    """
    none = reduce(Column.__or__, (F.col(c).isNull() for c in block))  # not a filter: it would compute the columns twice
    own = lambda df, kind, id_, line: df.dropna(subset=[id_]).select(
        F.when(none, "").otherwise(F.to_json(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(block))))).alias("block"), F.lit(kind).alias("kind"), F.coalesce(F.col(line).cast("bigint"), F.lit(0)).alias("line"), F.col(id_).cast("bigint").alias("id")
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, free = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column("block")
            kind, line, ids = (batch.column(c).to_numpy() for c in ("kind", "line", "id"))
            changed = pc.not_equal(blocks.slice(1), blocks.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            found = []
            for a, z in zip(cuts, cuts[1:], strict=False):
                if (here := blocks[a].as_py()) != block:
                    block, parts, free = here, [], None
                if not here:
                    continue
                m = a + int(np.count_nonzero(kind[a:z] == 0))
                if m > a:
                    parts.append((line[a:m].copy(), ids[a:m].copy()))
                if m < z:
                    if free is None:
                        free, parts = _Free(parts, within), []
                    found += [(i, r) for i, x in zip(ids[m:z].tolist(), line[m:z].tolist(), strict=True) if (r := free.take(x)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=pa.int64()) for k in (0, 1)], names=["l", "r"])

    rows = own(rights, 0, right, right_line).unionByName(own(lefts, 1, left, left_line))
    placed = rows.repartition(F.when(F.col("block") == "", F.col("id").cast("string")).otherwise(F.col("block"))).sortWithinPartitions("block", "kind", F.when(F.col("kind") == 0, F.col("line")), "id")
    return placed.mapInArrow(assign, "l bigint, r bigint").select(F.col("l").alias(left), F.col("r").alias(right))


def status_note(expected: Column, got: Column) -> Column:
    """over or under if a status claims too much or too little, null if it is fine."""
    latent = ["latent", "below-threshold", "unproven"]
    return F.when(expected.isin(latent) & (got == "report-eligible"), "over").when((expected == "report-eligible") & got.isin(latent), "under")


def first_seen(leads: DataFrame, group: list[str], newest: str, order: str) -> DataFrame:
    """One row for each (group, title in any case, file, line): that of the newest
    job, the first of it. An aggregate, so copies combine before the shuffle."""
    key = [*group, "title_key", "file", "line"]
    rest = [c for c in leads.columns if c not in key]
    rows = leads.withColumn("title_key", F.lower("title"))
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(newest), -F.col(order))).alias("row"))
    return best.select(*key, "row.*")


def merged_history(current: DataFrame, prior: DataFrame, group: list[str]) -> DataFrame:
    """``current`` with ``prior_jobs``, the jobs that reported the same (title in any case, file,
    line) before, and the prior leads that it lacks, as candidates."""
    key = [*group, "title_key", "file", "line"]
    old = prior.withColumn("title_key", F.lower("title")).groupBy(*key).agg(F.array_sort(F.collect_set("job_id")).alias("prior_jobs"), F.min("id").alias("first_id"))
    own = current.withColumn("title_key", F.lower("title")).select(*key, "id")
    both = own.join(old, key, "left").select(*key, "id", F.coalesce("prior_jobs", F.array().cast("array<bigint>")).alias("prior_jobs"), F.lit(False).alias("candidate"))
    new = old.join(own, key, "left_anti").select(*key, F.col("first_id").alias("id"), "prior_jobs", F.lit(True).alias("candidate"))
    return both.unionByName(new)


def discovery_kpis(leads: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """Key figures of a discovery run; a missing denominator counts as 1."""
    qualified, depth = F.col("qualification") == "QUALIFIED", F.when(F.coalesce("lead_depth", F.lit(0)) == 0, 1).otherwise(F.col("lead_depth"))
    validated = F.col("status").isin("report-eligible", "proven")
    sure = validated & (qualified | (F.col("conviction") >= 2))
    n = leads.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(qualified).alias("qualified"), F.count_if(F.col("qualification") == "LATENT").alias("latent"), F.count_if(validated).alias("validated"), F.count_if(sure).alias("sure"),
        F.sum(depth).alias("depths"), F.count_if(depth >= 3).alias("deep"), F.count_if(validated & (F.col("cvss") >= 9) & (F.col("conviction") >= 2)).alias("grave"),
    )
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return n.select(
        *by, "total", "qualified", "latent", "validated", "grave", F.bround(F.when(F.col("qualified") > 0, F.col("sure") / one("qualified")).otherwise(0.0), 3).alias("confirm_rate"),
        F.bround(F.col("depths") / one("total"), 2).alias("depth_avg"), F.bround(100.0 * F.col("deep") / one("total"), 1).alias("depth_ge3_pct"),
        F.bround((F.col("qualified") * 2 + F.col("deep") * 3 + F.col("sure") * 5) / max(seconds, 0.1), 3).alias("high_signal_score"),
    )


def best_leads(leads: DataFrame, most: int) -> DataFrame:
    """The ``most`` best: qualified first, then by score, depth and id."""
    order = [(F.col("qualification") != "QUALIFIED").cast("int"), -F.col("cvss"), -F.greatest("lead_depth", F.lit(1)), F.col("id")]
    top = leads.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of ``most`` rows


def matched_tokens(declared: list[str], haystack: Column, files: Column, universal: tuple[str, ...] = ()) -> Column:
    """Which declared tokens a profile has: exactly, or from four characters on by one containing the other; file names only exactly."""
    long = F.filter(haystack, lambda h: F.length(h) >= 4)

    def hit(t: str) -> Column:
        exact = F.array_contains(haystack, t) | F.array_contains(files, t)
        return exact | F.exists(long, lambda h: F.contains(h, F.lit(t)) | F.contains(F.lit(t), h)) if len(t) >= 4 else exact

    return F.array_compact(F.array(*(F.when(hit(t.lower()), F.lit(t)) for t in declared if t and t.lower() not in universal)))


def depth_level(level: Column) -> Column:
    """1 to 5; 3 for what is missing or no whole number."""
    return F.when(level.isNull(), 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), level)))


def confidence_label(x: Column) -> Column:
    return F.when(x >= 0.85, "high").when(x >= 0.55, "medium").when(x > 0, "low").otherwise("unavailable")
