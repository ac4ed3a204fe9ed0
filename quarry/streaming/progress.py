"""Event streams: windows, exact-occurrence dedup, and a ledger of task states."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.operators.relational import numbered

TERMINAL = ["completed", "failed", "skipped"]
LEDGER = "task string, state string, started_at timestamp, ended_at timestamp, events bigint"


def read_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream, in the schema that it has now. A table of
    one file is read through its folder, since streams read folders."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def run_to_table(stream: DataFrame, folder: str, *, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote.

    append goes to a file sink with exactly-once commits. update and complete have no
    file sink: each batch is written under its number, so a batch that is run
    again replaces itself; complete reads the last batch, update all.
    """
    spark = stream.sparkSession
    out = f"{folder}/quarry-stream-{uuid.uuid4().hex}"
    schema = stream.schema
    writer = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{out}/data").outputMode("append").start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{out}/data")

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_", F.lit(n)).write.mode("overwrite").parquet(f"{out}/data/batch={n:09d}")

    writer.foreachBatch(put).outputMode(mode).start().awaitTermination()
    got = spark.read.schema(StructType([*schema.fields, StructField("batch_", IntegerType())])).parquet(f"{out}/data/batch=*")
    if mode == "complete":
        got = got.join(got.agg(F.max("batch_").alias("batch_")), "batch_", "left_semi")  # one row
    return got.select(*schema.names)


def tumbling(events: DataFrame, at: str, width: str, by: list[str], aggs: dict[str, Column], *, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Aggregates by window of event time and ``by``; batch or stream."""
    own = events.withWatermark(at, lateness) if lateness else events
    out = own.groupBy(F.window(at, width, slide).alias("w"), *by).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("w.start").alias("start"), *by, *aggs)


def task_ledger(events: DataFrame, key: str = "task", state: str = "state", at: str = "at") -> DataFrame:
    """One row a task for each batch that touches it: its state so far.

    The clock starts at the first running event. A terminal state ends it, and
    no later event but another terminal one of a later time changes it. Repeats change nothing
    but the event count. State is one small row a task, in the checkpoint.
    """

    def update(task: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, start, end, n = held.get if held.exists else ("", None, None, 0)
        for pdf in batches:
            for r in pdf.sort_values(["at", "state"]).itertuples():
                n += 1
                if end is not None and r.state not in TERMINAL:
                    continue
                if r.state == "running" and start is None:
                    start = r.at.to_pydatetime()
                if r.state in TERMINAL:
                    if end is not None and r.at.to_pydatetime() <= end:
                        continue
                    end = r.at.to_pydatetime()
                now = r.state
        held.update((now, start, end, n))
        yield pd.DataFrame({"task": [task[0]], "state": [now], "started_at": [start], "ended_at": [end], "events": [n]})

    named = events.select(F.col(key).cast("string").alias("task"), F.col(state).alias("state"), F.col(at).cast("timestamp").alias("at"))
    return named.groupBy("task").applyInPandasWithState(
        update, LEDGER, "state string, started_at timestamp, ended_at timestamp, events bigint", "update", GroupStateTimeout.NoTimeout
    )


ENDED = ["ok", "failed", "skipped"]
_REGISTRY = "state string, queued_at timestamp, started_at timestamp, updated_at timestamp, ended_at timestamp, ignored bigint, updates bigint"


def activities(events: DataFrame) -> DataFrame:
    """``events(ident, state, at, id)`` -> a row an activity for each batch that
    touches it: ``(ident, state, terminal_status, queued_at, started_at,
    updated_at, ended_at, ignored, updates)``.

    States are queued, running, ok, failed and skipped. Running after the end
    is ignored; the first time of queueing stays; the clock starts when a
    queued activity runs, or else with its first event. Events of a batch are
    taken in order of (at, id), batches as they come. State is one small row an activity.
    """

    def update(ident: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, queued, started, updated, ended, ignored, n = held.get if held.exists else ("", None, None, None, None, 0, 0)
        for r in pd.concat(list(batches)).sort_values(["at", "id"]).itertuples():
            n, at = n + 1, r.at.to_pydatetime()
            if state in ENDED and r.state == "running":
                ignored += 1
                continue
            started = at if started is None or (state == "queued" and r.state == "running") else started
            queued = at if queued is None and r.state == "queued" else queued
            state, updated, ended = r.state, at, None if r.state in ("running", "queued") else at
        held.update((state, queued, started, updated, ended, ignored, n))
        told = {"ok": "completed", "queued": "running"}.get(state, state)
        yield pd.DataFrame({"ident": [ident[0]], "state": [state], "terminal_status": [told], "queued_at": [queued], "started_at": [started], "updated_at": [updated], "ended_at": [ended], "ignored": [ignored], "updates": [n]})

    return events.groupBy("ident").applyInPandasWithState(update, f"ident string, {_REGISTRY.replace('state string,', 'state string, terminal_status string,')}", _REGISTRY, "update", GroupStateTimeout.NoTimeout)


def lease_claims(claims: DataFrame, seconds: float) -> DataFrame:
    """``claims(holder, claim, at)`` -> ``(holder, claim, taken, attempt,
    expires_at)``, a row a claim. A claim is refused while a lease lives; else
    it takes the lease for ``seconds``, one attempt later. Claims of a batch are
    decided in order of (at, claim), batches as they come; state is a lease's end and its attempts."""

    def decide(holder: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        expires, attempt = held.get if held.exists else (None, 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values(["at", "claim"]).itertuples():
            at = r.at.to_pydatetime()
            taken = expires is None or expires <= at
            if taken:
                expires, attempt = at + pd.Timedelta(seconds=seconds).to_pytimedelta(), attempt + 1
            rows.append((holder[0], r.claim, taken, attempt, expires))
        held.update((expires, attempt))
        yield pd.DataFrame(rows, columns=["holder", "claim", "taken", "attempt", "expires_at"])

    return claims.groupBy("holder").applyInPandasWithState(decide, "holder string, claim bigint, taken boolean, attempt int, expires_at timestamp", "expires_at timestamp, attempt int", "append", GroupStateTimeout.NoTimeout)


def occurrences(messages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``messages`` with ``occurrence``: the k-th of identical messages, in the
    order of a whole number. A replay and a live tail joined on (keys, occurrence) give each once."""
    return numbered(messages, keys, [order], F.floor(F.col(order) / 100_000), "occurrence").withColumn("occurrence", F.col("occurrence").cast("int"))


def replay_and_tail(history: DataFrame, live: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``history`` and what ``live`` adds: of identical messages the k-th is the same one in both."""
    old, new = occurrences(history, keys, order), occurrences(live, keys, order)
    return old.unionByName(new.join(old.select(*keys, "occurrence"), [*keys, "occurrence"], "left_anti"))


def expired_leases(leases: DataFrame, holder: str, heartbeat: str, seconds: float, now: DataFrame) -> DataFrame:
    """``(holder, heartbeat, age)`` of leases whose last heartbeat is older than
    ``seconds`` at ``now(now)``, a table of one row."""
    last = leases.groupBy(holder).agg(F.max(heartbeat).alias("heartbeat"))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("heartbeat").cast("timestamp"))) / 1_000_000
    return last.crossJoin(F.broadcast(now)).withColumn("age", age).where(F.col("age") > seconds).select(holder, "heartbeat", "age")


def closed_with_job(tasks: DataFrame, jobs: DataFrame, job: str) -> DataFrame:
    """``tasks(job, task, state, ...)``: tasks that are still open when their job
    has ended get the job's end as their state, others keep theirs."""
    ended = jobs.where(F.col("state").isin("completed", "failed", "cancelled")).select(job, F.col("state").alias("ended_"))
    closing = F.when(F.col("ended_") == "completed", "completed").when(F.col("ended_") == "failed", "failed").otherwise("cancelled")
    still = F.col("state").isin("queued", "running") & F.col("ended_").isNotNull()
    return tasks.join(ended, job, "left").withColumn("swept", still).withColumn("state", F.when(still, closing).otherwise(F.col("state"))).drop("ended_")
