"""One small case for each finding of round 3."""

import random
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph, leads, learned, search
from quarry.sources import scratch, tables


def test_durations_take_the_tenth_nearest_to_ten_times_the_number(spark):
    df = spark.createDataFrame([(14800.949999999999,), (59.949999999999996,), (0.25,), (None,)], "s double")
    assert [r["d"] for r in df.select(T.duration(F.col("s")).alias("d")).collect()] == ["4h 6m 41s", "1m 0.0s", "0.3s", None]


def test_literals_of_a_pattern_that_has_them_in_a_group_only(spark):
    samples = ["cb", "xx b", "xx  ", "ci ", "ab(c", "abd", "x9", "aab", "bc9", "zcc"]
    want = {
        r"(?:ci|xx)\s+n?": [["ci"], ["xx"]], r"(ab|cd?)\s*\(": [["ab"], ["c"]], r"(?:ab|x?)\d": None, r"(?:ab|cd)?\d{4}": None, r"(?!ab)\d{4}": None, r"(?:a(?:b|c))\s": None,
        r"\d(?:x1|\d)\s(?:ab|cd)": [["ab"], ["cd"]], r"(?:ab)?\s(?:a|b)": [["a"], ["b"]], r"(ab|cd){0,2}\d": None,
    }
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r["p"]: r["w"] for r in df.select("p", learned.literals(F.col("p")).alias("w")).collect()} == want
    rules = spark.createDataFrame([(4, "item", r"(?:ci|xx)\s+n?", "multi", 7.0, False), (5, "item", r"(?:ci|xx)\s+n? ", "multi", 7.0, True), (6, "item", r"\d{4,}\s[xyz]", "multi", 7.0, False)], "pattern_id long, title string, regex string, language string, cvss double, from_notes boolean")
    assert [(r["pattern_id"], r["why"]) for r in rules.select("pattern_id", learned.refusal(F.col("regex")).alias("why")).orderBy("pattern_id").collect()] == [(4, None), (5, None), (6, "no-literal")]
    assert [r["pattern_id"] for r in learned.preferred(rules.where(learned.refusal(F.col("regex")).isNull())).collect()] == [4]
    files = spark.createDataFrame([(f"f{i}", "text", t) for i, t in enumerate(samples)], "path string, kind string, content string")
    assert {r["path"] for r in learned.matches(files, rules.where("pattern_id = 4")).collect()} == {"f1", "f2", "f3"}


def test_hits_don_t_depend_on_the_stretches_of_files(spark):
    own = "pattern_id long, title string, regex string, language string, cvss double, from_notes boolean"
    rules = spark.createDataFrame([(k, f"t{k % 3}", rf"word{k}\s+next", "multi", 7.0, k % 2 == 0) for k in range(6)] + [(9, None, "word1", "any", 5.0, False), (8, "rare", "once here", "any", 5.0, False)], own)
    texts = [f"a\nword{i % 6} next\nword{(i * 5) % 6}\n next" + ("\nonce here" if i == 38 else "") for i in range(40)] + [None, ""]
    rows = [(f"d{i % 37:02}/conftest.py" if i % 11 == 0 else f"d{i % 37:02}", "text", t) for i, t in enumerate(texts)]
    files = spark.createDataFrame(rows, "path string, kind string, content string")
    whole = {tuple(r) for r in learned.transferred(files, rules, stretches=()).collect()}
    assert len(whole) == 21 and {r[3] for r in whole} == {"t0", "t1", "t2", "rare", None}
    for sizes in [(1, 2), (5, 5, 5), (100,), (42,)]:
        assert {tuple(r) for r in learned.transferred(files, rules, stretches=sizes).collect()} == whole
    tried = []
    known, learned.matches = learned.matches, lambda f, r, **how: tried.append((f.count(), r.count())) or known(f, r, **how)
    try:
        learned.transferred(files, rules, stretches=(10,)).collect()
    finally:
        learned.matches = known
    assert len(tried) == 2 and tried[1][1] < tried[0][1], tried


def test_assignment_by_lines_equals_that_of_all_pairs(spark):
    rng = random.Random(5)
    line = lambda: rng.choice([None, 0, *range(1, 30)])
    lefts = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2]), line()) for i in range(150)]
    rights = [(1000 + i, rng.choice(["a", "b", None]), rng.choice([1, 2]), line()) for i in range(160)]
    near = lambda x, y: not x or not y or abs(x - y) <= 3
    pairs = [(i, j) for i, a, b, x in lefts for j, c, d, y in rights if a is not None and (a, b) == (c, d) and near(x, y)]
    taken, want = set(), {}
    for i, _, _, _ in lefts:
        j = min((j for k, j in pairs if k == i and j not in taken), default=None)
        if j is not None:
            want[i] = j
            taken.add(j)
    left = spark.createDataFrame(rng.sample(lefts, len(lefts)), "l long, b string, c int, x long")
    right = spark.createDataFrame(rng.sample(rights, len(rights)), "r long, b string, c int, y long")
    found = leads.greedy_line_assignment(left, right, ["b", "c"], "l", "r", "x", "y", 3)
    assert {r["l"]: r["r"] for r in found.collect()} == want and 60 < len(want) < 150
    assert "Join" not in found._jdf.queryExecution().toString()  # no pairs
    assert leads.greedy_line_assignment(left, right.limit(0), ["b", "c"], "l", "r", "x", "y", 3).count() == 0


def test_calls_are_resolved_as_by_all_pairs(spark):
    rng = random.Random(3)
    defs = [(f"g{i}", f"n{rng.randrange(4)}", rng.choice(["a", "b", "c", None])) for i in range(60)]
    asked = [(f"g{i}", defs[i][2], f"n{rng.randrange(5)}") for i in range(60) for _ in range(2)]
    for more in [[], [("g1", "n0", "a"), ("g1", "n1", "b"), ("g2", "n2", "c")]]:  # a callee of several names and files
        own = set(defs + more)
        want, far = set(), set()
        for caller, at, name in asked:
            met = {(callee, f) for callee, n, f in own if n == name and callee != caller}
            local = {m for m in met if at is not None and m[1] == at}
            found = local or {m for m in met if at is not None and m[1] is not None and m[1] != at}
            want |= {(caller, callee) for callee, _ in found}
            far |= {(caller, callee) for callee, _ in found - local}
        calls = spark.createDataFrame(asked * 2, "caller string, caller_file string, name string")
        functions = spark.createDataFrame(sorted(own, key=str) * 2, "full_name string, name string, file string")
        one, other = graph.resolve_calls(calls, functions), graph.resolve_calls(calls, functions, across=True)
        assert Counter(map(tuple, one.collect())) == Counter(want) and Counter(map(tuple, other.collect())) == Counter(far)
    plain = graph.resolve_calls(calls, functions.where("full_name NOT IN ('g1', 'g2')"))
    assert "Aggregate [caller" not in plain._jdf.queryExecution().optimizedPlan().toString()  # pairs aren't sorted for repeats


def test_a_small_file_is_spread_over_the_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    own = tables.spread(tables.table(spark, str(tmp_path), "t"))
    assert own.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and own.count() == 1000
    assert tables.spread(own) is own


def test_large_rows_are_in_small_groups(spark):
    rows = spark.range(0, 80, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.hash(i, "id")).alias("x"))
    held = scratch.saved(rows, large_rows=True)
    (path,) = (f.removeprefix("file:") for f in held.inputFiles())
    read = pq.ParquetFile(path).metadata
    groups = [read.row_group(i) for i in range(read.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 80 and max(g.total_byte_size for g in groups) < 32 << 20, [(g.num_rows, g.total_byte_size) for g in groups]
    assert held.agg(F.sum(F.size("x"))).head()[0] == 80 * 200_000


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(9)
    vec = lambda: rng.choice([None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], *[[rng.uniform(-1, 1) for _ in range(3)] for _ in range(6)], *[[1.0, 2.0, 3.0]] * 2])
    rows = spark.createDataFrame([(i, vec()) for i in range(300)] + [(None, [1.0, 2.0, 3.0])], "vec_id long, e array<float>").repartition(3)
    q = rows.where("vec_id % 10 = 0")
    pairs = rows.join(q.select(F.col("vec_id").alias("q"), F.col("e").alias("qe")), F.col("vec_id") != F.col("q")).select("q", "vec_id", search.dense_cosine(F.col("qe"), F.col("e")).alias("score"))
    want = {tuple(r) for r in search.top_k(pairs, "q", "vec_id", 5).collect()}
    assert {tuple(r) for r in search.top_k(search.nearest(rows, q, "vec_id", "e", 5), "q", "vec_id", 5).collect()} == want and len(want) == 150
