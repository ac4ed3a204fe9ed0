"""Call-graph search, event windows and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators.relational import latest_per_group
from quarry.plans.registry import query
from quarry.sources.scratch import folder
from quarry.sources.tables import table
from quarry.streaming import progress as S

EDGES_SQL = """n AS (SELECT count(*) AS n FROM supplier), edges AS (SELECT DISTINCT s_suppkey AS caller, s_suppkey * 7 % n + 1 AS callee FROM supplier, n UNION SELECT s_suppkey, s_suppkey * 13 % n + 1 FROM supplier, n)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    wide = s.crossJoin(s.agg(F.count("*").alias("n")))  # n: one row
    callee = F.explode(F.array(*(F.col("s_suppkey") * k % F.col("n") + 1 for k in (7, 13))))
    return wide.select(F.col("s_suppkey").alias("caller"), callee.alias("callee")).distinct()


_REACH = f"""{EDGES_SQL}, r AS (SELECT s_suppkey AS sink, s_suppkey AS node, 0 AS hops FROM supplier WHERE s_nationkey = 5
 UNION SELECT r.sink, e.caller, hops + 1 FROM r JOIN edges e ON e.callee = r.node WHERE hops < 4), reach AS (SELECT sink, node, min(hops)::INT AS hops FROM r GROUP BY sink, node)"""


def _reached(spark: SparkSession, d: str) -> DataFrame:
    return G.backward_reach(_edges(spark, d), table(spark, d, "supplier").where("s_nationkey = 5").select(F.col("s_suppkey").alias("node")), 4)


@query(f"WITH RECURSIVE {_REACH} SELECT sink, node, hops FROM reach")
def backward_reach(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d)


@query(f"WITH RECURSIVE {_REACH} SELECT sink, arg_min(node, (hops, node)) AS source, min(hops)::INT AS hops FROM reach WHERE node IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY sink")
def nearest_sources(spark: SparkSession, d: str) -> DataFrame:
    return G.nearest_sources(_reached(spark, d), table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node")))


_MODULES_SQL = f"""{EDGES_SQL}, modules AS (SELECT caller, caller % 6 AS caller_module, callee, callee % 6 AS callee_module FROM edges), allowed AS (SELECT caller, callee FROM modules WHERE caller_module = callee_module OR caller_module = 0 OR (caller_module + callee_module) % 3 <> 0)"""


@query(f"""WITH RECURSIVE {_MODULES_SQL}, r AS (SELECT s_suppkey AS sink, s_suppkey AS node, 0 AS hops, [s_suppkey] AS back FROM supplier WHERE s_nationkey % 5 = 0
 UNION ALL SELECT r.sink, a.caller, hops + 1, list_append(back, a.caller) FROM r JOIN allowed a ON a.callee = r.node WHERE hops < 5 AND NOT list_contains(back, a.caller))
SELECT node AS source, sink, min(hops)::INT AS hops, list_reverse(arg_min(back, (hops, back))) AS path FROM r WHERE node IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) GROUP BY node, sink""")
def taint_chains(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    edges = _edges(spark, d).withColumn("caller_module", F.col("caller") % 6).withColumn("callee_module", F.col("callee") % 6)
    m = spark.range(6)
    imports = m.where("id <> 0").select(F.col("id").alias("module"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("imported")).where("(module + imported) % 3 <> 0")
    return G.taint_chains(edges, s.where("s_acctbal < 2000").select(F.col("s_suppkey").alias("node")), s.where("s_nationkey % 5 = 0").select(F.col("s_suppkey").alias("node")), 5, imports)


@query("""WITH f AS (SELECT s_suppkey AS full_name, 'f' || s_suppkey % 10 AS name, 'file' || s_nationkey AS file FROM supplier), c AS (SELECT full_name AS caller, file AS caller_file, 'f' || (full_name * 3 % 10) AS name FROM f),
j AS (SELECT caller, c.name, full_name AS callee, file = caller_file AS same FROM c JOIN f ON f.name = c.name AND full_name <> caller), k AS (SELECT *, bool_or(same) OVER (PARTITION BY caller, name) AS loc FROM j)
SELECT DISTINCT caller, callee FROM k WHERE same = loc""")
def resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("full_name"), F.concat(F.lit("f"), F.col("s_suppkey") % 10).alias("name"), F.concat(F.lit("file"), F.col("s_nationkey")).alias("file"))
    calls = f.select(F.col("full_name").alias("caller"), F.col("file").alias("caller_file"), F.concat(F.lit("f"), F.col("full_name") * 3 % 10).alias("name"))
    return G.resolve_calls(calls, f)


@query("""WITH e AS (SELECT s_suppkey AS caller, s_nationkey AS cm, (s_suppkey * 7) % 100 + 1 AS callee, s_nationkey * 3 % 25 AS em FROM supplier)
SELECT caller, callee FROM e WHERE cm = em OR cm % 4 = 0 OR em = cm * 3 % 25 AND em % 2 = 0""")
def import_scoped_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("caller"), F.col("s_nationkey").alias("caller_module"), (F.col("s_suppkey") * 7 % 100 + 1).alias("callee"), (F.col("s_nationkey") * 3 % 25).alias("callee_module"))
    modules = table(spark, d, "nation").select(F.col("n_nationkey").alias("module")).where("module % 4 <> 0")
    target = F.col("module") * 3 % 25
    imports = modules.select("module", F.when(target % 2 == 0, target).otherwise(-1).alias("imported"))
    return G.allowed_edges(e, imports).select("caller", "callee")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.tumbling(table(spark, d, "events"), "ts", "6 hours", ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})


@query("""SELECT time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * k AS start, event_type, count(*)::BIGINT AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return S.tumbling(table(spark, d, "events"), "ts", "12 hours", ["event_type"], {"n": F.count("*")}, slide="6 hours")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS at FROM events GROUP BY user_id")
def last_state_per_task(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return latest_per_group(e, "user_id", "ts", "event_id").select("user_id", F.col("event_type").alias("state"), F.col("ts").alias("at"))


@query("""WITH d AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::DOUBLE / 1000000 AS s FROM events)
SELECT user_id, avg(s) AS mean_s, median(s) AS median_s, count(*) FILTER (s > 300)::BIGINT AS slow FROM d GROUP BY user_id""")
def task_durations(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("s", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 1_000_000)
    return e.groupBy("user_id").agg(F.avg("s").alias("mean_s"), F.median("s").alias("median_s"), F.count_if(F.col("s") > 300).alias("slow"))


@query("""WITH l AS (SELECT event_id, user_id, ts, CASE WHEN value > 75 THEN 'critical' WHEN value > 50 THEN 'warn' ELSE 'ok' END AS level FROM events),
c AS (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM l) SELECT event_id, level FROM c WHERE prev IS NULL OR prev <> level""")
def resource_level_changes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    own = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(v > 75, "critical").when(v > 50, "warn").otherwise("ok").alias("level"))
    before = F.lag("level").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return own.withColumn("before", before).where("before IS NULL OR before <> level").select("event_id", "level")


@query("SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INT AS occurrence FROM events")
def message_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return S.occurrences(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "occurrence")


_H, _T = "event_id % 10 < 7", "event_id % 10 > 3"


@query(f"""WITH h AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INT AS occurrence FROM events WHERE {_H}),
t AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INT AS occurrence FROM events WHERE {_T})
SELECT * FROM h UNION ALL SELECT * FROM t ANTI JOIN h USING (user_id, event_type, occurrence)""")
def replayed_messages(spark: SparkSession, d: str) -> DataFrame:
    """A replayed history and a live tail that overlap, each occurrence once."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return S.replay_and_tail(e.where(_H), e.where(_T), ["user_id", "event_type"], "event_id")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS heartbeat FROM events GROUP BY user_id)
SELECT user_id, heartbeat, (epoch_us(now) - epoch_us(heartbeat))::DOUBLE / 1000000 AS age FROM l, n WHERE epoch_us(now) - epoch_us(heartbeat) > 86400000000""")
def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return S.expired_leases(e, "user_id", "ts", 86_400, e.agg(F.max("ts").alias("now")))


_TASK = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'queued' ELSE 'running' END"
_JOBSTATE = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END"


@query(f"""WITH t AS (SELECT event_id, event_id % 1000 + 1 AS job_id, {_TASK} AS state FROM events), j AS (SELECT o_orderkey AS job_id, {_JOBSTATE} AS js FROM orders)
SELECT event_id, CASE WHEN state IN ('queued', 'running') AND js IN ('completed', 'failed') THEN js ELSE state END AS state, coalesce(state IN ('queued', 'running') AND js IN ('completed', 'failed'), false) AS swept FROM t LEFT JOIN j USING (job_id)""")
def terminal_sweep(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "events").select("event_id", (F.col("event_id") % 1000 + 1).alias("job_id"), F.expr(_TASK).alias("state"))
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.expr(_JOBSTATE).alias("state"))
    return S.closed_with_job(tasks, jobs, "job_id").select("event_id", "state", "swept")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def streamed_windows(spark: SparkSession, d: str) -> DataFrame:
    events = S.read_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = S.tumbling(events, "ts", "1 day", ["event_type"], {"n": F.count("*")}, lateness="2 days")
    return S.run_to_table(counted, folder(spark), mode="complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


_STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


@query(f"""WITH e AS (SELECT user_id::VARCHAR AS task, ts, event_id, {_STATE} AS state FROM events)
SELECT task, count(*)::BIGINT AS events, arg_max(state, (ts, state)) FILTER (state IN ('completed', 'failed')) AS state, max(ts) FILTER (state IN ('completed', 'failed')) AS ended_at FROM e GROUP BY task""")
def streamed_task_ledger(spark: SparkSession, d: str) -> DataFrame:
    events = S.read_stream(spark, f"{d}/events.parquet").select("user_id", F.expr(_STATE).alias("state"), "ts")
    ledger = S.run_to_table(S.task_ledger(events, "user_id", "state", "ts"), folder(spark), mode="update")
    last = latest_per_group(ledger, "task", "events")
    return last.select("task", "events", "state", F.col("ended_at").cast("timestamp_ntz").alias("ended_at"))


_ACT = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'ok' ELSE 'failed' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS ident, ts, {_ACT} AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT ident, n, state, CASE WHEN state = 'queued' THEN ts END AS queued_at, ts AS started_at, ts AS updated_at, CASE WHEN state NOT IN ('running', 'queued') THEN ts END AS ended_at, 0 AS ignored FROM e WHERE n = 1
 UNION ALL SELECT e.ident, e.n, CASE WHEN late THEN r.state ELSE e.state END, coalesce(r.queued_at, CASE WHEN e.state = 'queued' THEN ts END), CASE WHEN r.state = 'queued' AND e.state = 'running' THEN ts ELSE r.started_at END,
  CASE WHEN late THEN r.updated_at ELSE ts END, CASE WHEN late THEN r.ended_at WHEN e.state NOT IN ('running', 'queued') THEN ts END, r.ignored + late::INT
 FROM (SELECT r.*, e.state AS s2, r.state IN ('ok', 'failed', 'skipped') AND e.state = 'running' AS late FROM r JOIN e ON e.ident = r.ident AND e.n = r.n + 1) r JOIN e ON e.ident = r.ident AND e.n = r.n + 1)
SELECT ident, state, CASE state WHEN 'ok' THEN 'completed' WHEN 'queued' THEN 'running' ELSE state END AS terminal_status, queued_at, started_at, updated_at, ended_at, ignored::BIGINT AS ignored FROM r QUALIFY row_number() OVER (PARTITION BY ident ORDER BY n DESC) = 1""")
def streamed_activities(spark: SparkSession, d: str) -> DataFrame:
    events = S.read_stream(spark, f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("ident"), F.expr(_ACT).alias("state"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))
    rows = S.run_to_table(S.activities(events), folder(spark), mode="update")
    last = latest_per_group(rows, "ident", "updates")
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return last.select("ident", "state", "terminal_status", *map(naive, ("queued_at", "started_at", "updated_at", "ended_at")), "ignored")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS holder, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT holder, n, event_id, ts, true AS taken, 1 AS attempt, ts + INTERVAL '2 days' AS expires_at FROM e WHERE n = 1
 UNION ALL SELECT e.holder, e.n, e.event_id, e.ts, r.expires_at <= e.ts, r.attempt + (r.expires_at <= e.ts)::INT, CASE WHEN r.expires_at <= e.ts THEN e.ts + INTERVAL '2 days' ELSE r.expires_at END FROM r JOIN e ON e.holder = r.holder AND e.n = r.n + 1)
SELECT holder, event_id AS claim, taken, attempt::INT AS attempt, expires_at FROM r""")
def streamed_lease_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = S.read_stream(spark, f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("holder"), F.col("event_id").alias("claim"), F.col("ts").cast("timestamp").alias("at"))
    rows = S.run_to_table(S.lease_claims(claims, 2 * 86_400), folder(spark), mode="append")
    return rows.select("holder", "claim", "taken", "attempt", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))
