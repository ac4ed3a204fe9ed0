"""Running folds, whole-text rules, numbering, assignment, reports and calls on rows made by hand."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import arrays, ontology
from quarry.operators import calls, leads, patterns, relational
from quarry.sources import text as X
from quarry.sources import tools
from quarry.streaming import progress


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running(spark, n):
    rng = random.Random(n)
    values = [rng.randint(-9, 9) for _ in range(n)]
    df = spark.createDataFrame([(values,), (None,)], "v array<int>")
    got = [tuple(r) for r in df.select(arrays.running(F.col("v"), lambda a, x: a + x, F.lit(0)), arrays.running(F.col("v"), F.greatest, F.lit(-99))).collect()]
    sums, most = [], []
    for v in values:
        sums.append((sums[-1] if sums else 0) + v)
        most.append(max(most[-1] if most else -99, v))
    assert got[0] == (sums, most)


def test_match_lines(spark):
    texts = ["", "a\nfoo(\n)x foo(y)\n\nfoo()", "foo(\n\n) if\nfoo(1) else", None, "none"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["all"], r["some"]) for r in df.select("i", arrays.match_lines(F.col("t"), r"foo\([^)]*\)").alias("all"), arrays.match_lines(F.col("t"), r"foo\([^)]*\)", r"\s*if").alias("some")).collect()}
    for i, t in enumerate(texts):
        found = [(t.count("\n", 0, m.start()) + 1, bool(re.match(r"\s*if", t[m.end():]))) for m in re.finditer(r"foo\([^)]*\)", t)] if t is not None else []
        assert [*(got[i][0] or [])] == [a for a, _ in found] and [*(got[i][1] or [])] == [a for a, skip in found if not skip]


def test_long_file_offsets(spark):
    text = "\n".join("x" * (i % 7) for i in range(2000))
    rows = X.line_offsets(spark.createDataFrame([("p", text)], "path string, content string"), "path").orderBy("line").collect()
    at = 0
    for r, line in zip(rows, text.split("\n"), strict=True):
        assert (r["start"], r["bytes"]) == (at, len(line))
        at += len(line) + 1


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, *range(40)]), i) for i in range(300)]
    got = relational.numbered(spark.createDataFrame(rows, "k string, o long, i long"), ["k"], ["o", "i"], F.floor(F.col("o") / 7), "place").collect()
    want = Counter()
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want.update((*r, n) for n, r in enumerate(own, 1))
    assert Counter(map(tuple, got)) == want


def test_greedy_assignment(spark):
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(25), rng.randrange(20)) for _ in range(120)})
    used, want = set(), {}
    for a in sorted({a for a, _ in pairs}):
        free = [b for x, b in pairs if x == a and b not in used]
        if free:
            want[a] = min(free)
            used.add(min(free))
    got = {r["a"]: r["b"] for r in leads.greedy_assignment(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == want
    assert leads.greedy_assignment(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_longest_spelling_wins(spark):
    rows = [("stack overflow recursion in parser",), ("rce",), ("source of force",), ("sql-no-priv-needed",), ("",), (None,), ("OOB_read",), ("IDOR!",), ("idorx",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(ontology.bug_class(F.col("t"))).collect()]

    def brute(t):
        blob = (t or "").lower()
        for s, key in ontology.spellings():
            if re.search(rf"(?<![a-z]){re.escape(s)}(?![a-z])", blob) if len(s) <= 4 else s in blob:
                return key
        return "generic"

    assert got == [brute(t) for (t,) in rows] and got[0] == "denial_of_service" and got[2] == "generic"


def test_reports_of_every_kind(spark):
    good = {"check_id": "r", "path": "p", "start": {"line": 2}, "extra": {"message": "m"}}
    outputs = [json.dumps({"results": [good, {}, None, 3, {**good, "start": {"line": "x"}}], "errors": []}), "", None, "[]", "{}", '{"results": null}', json.dumps({"results": []})]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(outputs)], "k int, output string, code int")
    assert [tuple(r) for r in tools.semgrep(df, "k").collect()] == [(0, 0, "r", "p", 2, "m")]
    why = {r["k"]: (r["kept"], r["reason"]) for r in tools.semgrep_failure(df, "k", "code").collect()}
    assert why[0] == (1, "semgrep returned 4 malformed result rows") and why[6] == (0, None) and all(why[i][1] == "semgrep returned no usable JSON results list" for i in range(1, 6))
    assert tools.npm_audit(df, "k").count() == tools.dependency_check(df, "k").count() == 0
    assert [r["kind"] for r in tools.trufflehog(df.where("k = 3"), "k").collect()] == ["invalid"]
    assert tools.trufflehog(df.where("k in (1, 2)"), "k").count() == 0


def test_split_objects():
    assert X.split_objects('x {"a": "}\\"{"} {"b": {"c": [1]}} {"open": 1') == ['{"a": "}\\"{"}', '{"b": {"c": [1]}}']
    assert X.split_objects(None) == X.split_objects("") == X.split_objects('"{}" no') [1:] == []


def test_rules_near_each_other(spark):
    code = ["if os.path.exists(p):", *["x"] * 9, "open(p)", "if os.path.exists(q):", *["y"] * 10, "open(q)"]
    own = X.lines(spark.createDataFrame([("a.py", "\n".join(code)), ("b.py", "open(p)\nos.path.exists(p)")], "path string, content string"))
    rules = [(r"os\.path\.exists\s*\(", r"open\s*\(", "race", 6.0)]
    assert [(r["path"], r["line"]) for r in patterns.check_then_use(own, "path", rules, 10).collect()] == [("a.py", 1)]
    files = spark.createDataFrame([("m", "CFLAGS += -FPIE"), ("n", "")], "path string, content string")
    assert Counter(r["path"] for r in patterns.missing_flags(files, "path", "content", [("-fPIE", "pie", 5.0), ("-O2", "o", 1.0)]).collect()) == {"m": 1, "n": 2}


def test_functions_and_calls(spark):
    code = "import os\nopen(x)\ndef read(a, b):\n    v = request.args['q']\n    helper(v)\n    return (v)\ndef helper(v):\n    os.system(v)"
    files = spark.createDataFrame([("a.py", "python", code), ("b.py", "python", "def helper(v):\n    eval(v)"), ("c.txt", "text", "def no():")], "path string, kind string, content string")
    own = calls.owned_lines(X.lines(files), "path", "kind")
    found = {(r["path"], r["function"]): (r["line"], r["has_source"], r["has_sink"]) for r in calls.extracted_functions(own, "path", "kind").collect()}
    assert found == {("a.py", "read"): (3, True, False), ("a.py", "helper"): (7, False, True), ("b.py", "helper"): (1, False, True)}
    assert {(r["function"], r["line"], r["name"]) for r in calls.extracted_calls(own, "path", "kind").where("path = 'a.py'").collect()} == {("read", 5, "helper"), ("helper", 8, "os.system")}
    functions, asked = calls.extracted_functions(own, "path", "kind"), calls.extracted_calls(own, "path", "kind")
    assert calls.cross_file_taint(functions, asked, "path").count() == 0  # its own file's helper shadows the other


def test_history_and_sweeps(spark):
    rows = [(1, 1, 5, "T", "f", 1), (2, 1, 3, "t", "f", 1), (3, 1, 4, "T", "f", 1), (4, 1, 2, "U", None, 1)]
    df = spark.createDataFrame(rows, "id long, repo_id long, job_id long, title string, file string, line long")
    assert {(r["title_key"], r["id"]) for r in leads.first_seen(df, ["repo_id"], "job_id", "id").collect()} == {("t", 1), ("u", 4)}
    tasks = spark.createDataFrame([(1, 9, "running"), (2, 9, "completed"), (3, 8, "queued"), (4, None, "queued")], "task long, job long, state string")
    jobs = spark.createDataFrame([(9, "failed"), (8, "running")], "job long, state string")
    assert {r["task"]: (r["state"], r["swept"]) for r in progress.closed_with_job(tasks, jobs, "job").collect()} == {1: ("failed", True), 2: ("completed", False), 3: ("queued", False), 4: ("queued", False)}
    messages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "m string, n long")
    tail = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("c", 5)], "m string, n long")
    assert Counter(r["m"] for r in progress.replay_and_tail(messages, tail, ["m"], "n").collect()) == {"a": 3, "b": 1, "c": 1}
