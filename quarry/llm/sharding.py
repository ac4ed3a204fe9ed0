"""Balanced label propagation: linked documents move to their neighbours' shard
while it has room."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, ranked, written

_ARRIVALS = 64  # buckets of arrivals; a shard admits whole buckets


def admitted(asked: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many may move between each two shards: as many as change places, and
    beyond that what the room allows, where a departure makes room too."""
    out = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    changed = True
    while changed:
        changed = False
        for (s, t), n in sorted(asked.items()):
            more = min(n - out[s, t], room[t])
            if more > 0:
                out[s, t] += more
                room[t] -= more
                room[s] += more
                changed = True
    return out


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, capacity: int, *, rounds: int = 10) -> DataFrame:
    """``nodes(node)``, ``edges(a, b)`` both ways -> ``(node, shard)``.

    Nodes start in pseudo-random shards. In each round a node that has more
    neighbours in another shard than in its own asks to move there; a random
    half may, so that neighbours don't swap places for ever. Between any two
    shards as many move one way as the other, and more while a shard has fewer than
    ``capacity``; who moves is decided by whole buckets of a random order. Only
    counts by shard, shard and bucket reach the driver (at most 64 * shards^2).
    It ends when no node asks, none is admitted twice running, or after ``rounds``.
    """
    state = written(nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")))
    idle = 0
    for t in range(rounds):
        near = edges.join(state.withColumnRenamed("node", "b"), "b").groupBy("a", "shard").agg(F.count("*").alias("n"))
        best = near.groupBy("a").agg(
            F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by_shard")
        )
        asks = written(
            state.join(best.withColumnRenamed("a", "node"), "node")
            .select("node", "shard", (-F.col("best.s")).alias("to"), (F.col("best.n") - F.coalesce(F.col("by_shard")[F.col("shard")], F.lit(0))).alias("gain"))
            .where("to <> shard and gain > 0")
            .withColumn("turn", F.pmod(F.xxhash64("node", F.lit(t)), F.lit(2)) == 0)
            .withColumn("bucket", F.pmod(F.xxhash64(F.lit(t), "node"), F.lit(_ARRIVALS)).cast("int"))
        )
        if asks.isEmpty():
            break
        load = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
        flows = asks.where("turn").groupBy("shard", "to", "bucket").count().orderBy("bucket").collect()
        asked: dict[tuple[int, int], int] = {}
        for r in flows:
            asked[r["shard"], r["to"]] = asked.get((r["shard"], r["to"]), 0) + r["count"]
        left = admitted(asked, {s: capacity - load.get(s, 0) for s in range(shards)})
        gate = [0] * (shards * shards)
        closed: set[tuple[int, int]] = set()
        for r in flows:
            way = r["shard"], r["to"]
            if way not in closed and r["count"] <= left[way]:
                left[way] -= r["count"]
                gate[r["shard"] * shards + r["to"]] = r["bucket"] + 1
            else:
                closed.add(way)
        limit = F.element_at(F.from_json(F.lit(str(gate)), "array<int>"), F.col("shard") * shards + F.col("to") + 1)
        moves = asks.where("turn").where(F.col("bucket") < limit).select("node", "to")
        after = written(state.join(moves, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")))
        idle = idle + 1 if not any(gate) else 0
        discard(state)
        state = after
        if idle == 2:
            break
    return state


def _chosen(values: list[int], of: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), of + 1)


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 10) -> DataFrame:
    """Every row of ``docs`` gets a shard; counts differ by one at most.

    Equal texts are linked, each to the first row of its group. Returns
    ``(id_col, size, text_crc32, shard, slot)``: UTF-8 bytes plus one,
    crc32 of the text, and a gapless place in the shard. A null text has size
    1 and the crc32 of an empty one, and is linked to nothing. Repeated ids are rows of
    their own. An empty table gives no rows.

    Unlinked rows, and the linked ones beyond a shard's quota, fill the gaps
    that propagation leaves.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.sha2(F.col(text_col), 256).alias("key"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    total = rows.count()
    quota, more = divmod(total, shards)
    target = [quota + (s < more) for s in range(shards)]
    groups = written(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").select("key", "hub"))
    linked = written(rows.select("node", "key").join(groups, "key").select("node", "hub"))
    spokes = linked.where("node <> hub")
    edges = written(spokes.select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(spokes.select(F.col("hub").alias("a"), F.col("node").alias("b"))))
    state = propagate(linked.select("node"), edges, shards, quota, rounds=rounds)
    placed = written(ranked(state, "shard", ["node"], "rank", total))
    fits = F.col("rank") < _chosen(target, F.col("shard"))
    load = {r["shard"]: r["count"] for r in placed.where(fits).groupBy("shard").count().collect()}
    have = [load.get(s, 0) for s in range(shards)]
    begins = [sum(target[:s]) - sum(have[:s]) for s in range(shards + 1)]
    sure = placed.where(fits).select("node", "shard", F.col("rank").alias("slot"))
    rest = rows.select("node").join(sure.select("node"), "node", "left_anti").withColumn("all", F.lit(0))
    rest = ranked(rest, "all", ["node"], "rank", total)
    shard = sum((F.when(F.col("rank") >= begins[s], 1).otherwise(0) for s in range(1, shards)), F.lit(0)).cast("int")
    rest = rest.withColumn("shard", shard).select("node", "shard", (F.col("rank") - _chosen(begins[:shards], F.col("shard")) + _chosen(have, F.col("shard"))).alias("slot"))
    return rows.join(sure.unionByName(rest), "node").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot")
    )
