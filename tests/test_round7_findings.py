"""One small case for each finding of round 4's list."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, handlers, learned
from quarry.plans import catalog, service_queries


def _routed(spark, path, content):
    files = spark.createDataFrame([(path, content)], "path string, content string")
    routes = spark.createDataFrame([(path, 1, "GET", "/x", "s.Run")], "path string, line int, method string, route string, handler string")
    return handlers.traced(routes, files).head()


@pytest.mark.parametrize("lines", [250, 9000])
def test_sinks_behind_the_beginning_of_a_text_are_found(spark, lines):
    pad = "\n".join(["    x := 1 // nothing"] * lines)  # 9,000 of them are 180,000 characters
    own = _routed(spark, "svc/web/a.go", f"package web\n\nfunc (s *S) Run(w W) {{\n{pad}\n    b := os.ReadFile(p)\n}}\n\nfunc other() {{\n    exec.Command(c)\n}}")
    assert (own["handler_line"], own["sinks"], own["primary_sink"]) == (3, f"file_read@svc/web/a.go:{lines + 4}", "file_read")  # the body to its end, not the next one
    whole = _routed(spark, "svc/handlers/a.go", f"package web\n\nfunc (s *S) Run(w W) {{\n    return\n    return\n}}\n\nfunc other() {{\n{pad}\n    exec.Command(c)\n}}")
    assert whole["sinks"] == f"rce@svc/handlers/a.go:{lines + 9}" and whole["cvss"] == 9.0 and whole["high"]


def test_a_body_of_c_ends_where_the_next_function_opens(spark):
    text = "int run(char *s) {\n" + "  s++;\n" * 300 + "  open_url(s);\n}\nint other(char *s) {\n  avio_open(s);\n}"
    files = spark.createDataFrame([("a.c", text), ("b.rs", "async fn run(a: A) {\n1\n2\n3\n4\n}\nasync fn other() {\n}")], "path string, content string")
    found = {(r["file"], r["name"]): (r["line"], r["body"].count("\n") + 1) for r in handlers.functions(files).collect()}
    assert found == {("a.c", "run"): (1, 303), ("a.c", "other"): (304, 3), ("b.rs", "run"): (1, 6), ("b.rs", "other"): (7, 2)}


def test_handler_sinks_equals_its_sql_on_long_files(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    pad = "'\n' || repeat('    x := 1 // nothing\n', 5000) || "
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
    sql = catalog.ORACLE_SQL["handler_sinks"]
    at = "services AS (SELECT shaped.* FROM shaped JOIN"
    assert at in sql
    want = con.execute(sql.replace(at, f"services AS (SELECT shaped.* REPLACE ('package a' || {pad}content AS content) FROM shaped JOIN", 1)).fetchall()
    real = service_queries.services
    monkeypatch.setattr(service_queries, "services", lambda s, p: real(s, p).withColumn("content", F.expr("concat('package a', '\n', repeat('    x := 1 // nothing\n', 5000), content)")))
    got = [tuple(r) for r in service_queries.handler_sinks(spark, d).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum("/handlers/" in (r[5] or "") and bool(r[7]) for r in got) > 0


def test_equal_texts_are_searched_once_and_each_title_where_it_can_match(spark, monkeypatch):
    own = "pattern_id long, title string, regex string, language string, cvss double, from_notes boolean"
    rules = spark.createDataFrame([(1, "one", r"word1\s+next", "multi", 7.0, False), (2, "two", r"word2\s+next", "multi", 7.0, False), (3, None, r"word3\s+next", "multi", 7.0, False)], own)
    text = {"one": "a\nword1 next\nword1  next\nword1 next", "two": "word2\n next", None: "x\n\nword3 next"}
    rows = [(f"a/{i:04}.py" if i % 3 else f"a/{i // 2:04}/conftest.py", "python", text["one"] + "\n" * (i % 2)) for i in range(400)]
    rows += [(f"m/{i:04}.py", "python", text["two"]) for i in range(40)] + [(f"z/{i}.py", kind, text[None]) for i in range(4) for kind in ("python", "go")]
    rows += [(None, "python", text["two"]), ("a/0", "python", None), ("m/0000.py", "python", text["two"] + " word2 next")]
    files = spark.createDataFrame(rows, "path string, kind string, content string").repartition(5)
    want = [(r[0], 2 + k, "one") for r in sorted(rows[:400]) if "conftest" not in r[0] for k in (0, 1)][:5]
    want += [("m/0000.py", 1, "two")] * 2 + [(f"m/{i:04}.py", 1, "two") for i in (1, 2, 3)] + [(f"z/{i // 2}.py", 3, None) for i in range(5)]
    tried, real = [], learned.matches
    monkeypatch.setattr(learned, "matches", lambda f, r, **how: tried.append(f.count()) or real(f, r, **how))
    for stretches, searched in ((), [6]), ((1,), [5, 1]), ((50,), [6, 0]):
        tried.clear()
        found = learned.transferred(files, rules, stretches=stretches)
        assert sorted(((r["path"], r["line"], r["title"]) for r in found.collect()), key=repr) == sorted(want, key=repr)
        assert tried == searched  # of 451 files; with those of the same smallest path


def test_literals_are_looked_for_once_a_text(spark):
    files = spark.createDataFrame([("a", "python", "word1 next")], "path string, kind string, content string")
    rules = spark.createDataFrame([(1, "one", r"word1\s+next", "multi", 7.0, False)], "pattern_id long, title string, regex string, language string, cvss double, from_notes boolean")
    found = learned.matches(files, rules)
    assert found.count() == 1 and found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_pairs_of_a_name_that_many_call_and_define_are_small_in_a_file(spark, tmp_path):
    calls = spark.range(0, 600).selectExpr("concat('src/core/', id, '.py#read#1') AS caller", "concat('src/core/', id, '.py') AS caller_file", "'helper' AS name")
    functions = spark.range(300, 4300).selectExpr("concat('src/core/', id, '.py#helper#7') AS full_name", "'helper' AS name", "concat('src/core/', id, '.py') AS file")
    graph.resolve_calls(calls, functions, across=True).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    want = 300 * 4000  # the others are answered in their own file
    assert found.count() == found.distinct().count() == want and found.select("caller").distinct().count() == 300 and found.select("callee").distinct().count() == 4000
    assert sum(f.stat().st_size for f in os.scandir(f"{tmp_path}/pairs")) < 0.6 * want
    assert graph.resolve_calls(calls, functions).count() == want + 300
