"""JSON trees, routes to bodies, authorisation, learned patterns and dependencies against brute force and on awkward input."""

import json
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.functions import batteries as B
from quarry.functions import report as R
from quarry.operators import authz, dependencies, handlers, learned
from quarry.operators import patterns as P
from quarry.sources import json_tree


def _flat(value, path=()):
    """Leaves and containers of json.loads(object_pairs_hook=tuple-lists), as the tree has them."""
    if isinstance(value, tuple):
        yield path, "object", None
        for k, v in value[0]:
            yield from _flat(v, (*path, f".{k}"))
    elif isinstance(value, list):
        yield path, "array", None
        for i, v in enumerate(value):
            yield from _flat(v, (*path, f"#{i}"))
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
        yield path, kind, value if kind == "string" else json.dumps(value) if kind == "boolean" else None


def _document(rng, depth=0):
    kind = rng.choice("aonsbz" if depth < 4 else "nsbz")
    if kind == "a":
        return "[" + rng.choice(["", " "]) + ",".join(_document(rng, depth + 1) for _ in range(rng.randint(0, 3))) + "]"
    if kind == "o":
        return "{" + ", ".join(f'{json.dumps(rng.choice(["a", "b", "a.b", "é", "url"]))} : {_document(rng, depth + 1)}' for _ in range(rng.randint(0, 4))) + "}\n"
    return rng.choice({"n": ["0", "-1.5e3", "12"], "s": ['"x"', '"\\u00e9\\n"', '""', '"\\\\"'], "b": ["true", "false"], "z": ["null"]}[kind])


def test_the_tree_is_that_of_the_json_module():
    rng = random.Random(1)
    for _ in range(2000):
        text = _document(rng)
        want = [(p, k, a) for p, k, a in _flat(json.loads(text, object_pairs_hook=lambda pairs: (pairs,)))]
        got = [(tuple(n["path"]), n["kind"], None if n["kind"] == "number" else n["atom"]) for n in json_tree.parse(text)]
        assert got == want
        cut = text[: rng.randint(0, len(text))] + rng.choice(["", ",", "]", "}", '"', ":", "x"])
        try:
            json.loads(cut)
            fine = True
        except ValueError:
            fine = False
        assert (json_tree.parse(cut) is not None) == fine, cut


def test_deep_documents_end():
    deep = json_tree.parse("[" * 200_000 + "]" * 200_000)
    assert len(deep) == 200_000 and len(deep[1000]["path"]) == 1000 and deep[1001]["path"] is None
    assert json_tree.parse("[" * 200_000) is None


def test_stored_documents_of_every_kind(spark):
    texts = [None, "", "{", '{"a": {"b": 1, "b": 2}}', '{"a": [], "x": 1}', '{"a": "s"}', '{"a": {"b": null}}', '"\\ud800"', "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, doc string")
    got = {(r["k"], r["selected"]): r["state"] for r in json_tree.guards(df, "k", "doc", [["a", "b"], ["x"]]).collect()}
    assert [got[k, "a.b"] for k in range(9)] == ["not_recorded", "not_recorded", "malformed", "duplicate", "absent", "misplaced", "null", "malformed", "absent"]
    assert json_tree.nodes(df.limit(0), "k", "doc").count() == 0


def _affinity(file, route_file, route):
    low, p = file.lower(), route.lower()
    score = 120 * (file == route_file) + 50 * (file.rpartition("/")[0] == route_file.rpartition("/")[0]) + 8 * sum(a == b for a, b in zip(file.split("/"), route_file.split("/"), strict=False))
    score += -90 * any(w in low for w in handlers.AWAY) + 30 * any(w in low for w in handlers.HOME) + 45 * ("isolated" in p and "isolated" in low)
    return score + 45 * ("/files/" in p and "isolated" not in p and "filesystem" in low and "isolated" not in low) + 20 * ("upload" in p and "upload" in low)


def test_a_name_with_100_000_bodies(spark):
    folders = ["a/handlers", "a/web", "b/sdk", "a/b/c", "x/isolated", "y/filesystem", "a"]
    file = F.concat(F.element_at(F.array(*map(F.lit, folders)), (F.col("id") % 7 + 1).cast("int")), F.lit("/f"), (F.col("id") % 9000).cast("string"), F.lit(".go"))
    bodies = spark.range(100_000).select(F.lit("Handle").alias("name"), file.alias("file"), F.col("id").cast("int").alias("line"))
    asked = [(f"{f}/f{n}.go", r, "Handle") for f in (*folders, "q/r") for n in (3, 8999, 10_000) for r in ("/files/upload", "/isolated/x", "/")] + [("a/web/f1.go", "/", "None")]
    routes = spark.createDataFrame(asked * 20, "route_file string, route string, handler string")
    near = handlers.nearest_bodies(routes, bodies)
    got = {}
    for r in near.collect():
        got.setdefault((r["route_file"], r["route"]), []).append((r["rank"], r["affinity"], r["file"], r["line"]))
    everything = [(f"{folders[i % 7]}/f{i % 9000}.go", i) for i in range(100_000)]
    assert len(got) == len(asked) - 1
    for route_file, route, _ in asked[:-1:11]:
        best = sorted((-_affinity(f, route_file, route), f, i) for f, i in everything)[:4]
        assert sorted(got[route_file, route]) == [(k, -s, f, i) for k, (s, f, i) in enumerate(best, 1)]


def _app(gap_before, gap_after):
    lines = ["def get(request):", "    validate_access(x)", *["    y = 1"] * gap_before, "    Item.objects.get(pk=request.GET['n'])", *["    y = 1"] * gap_after, "    check_owner(x)"]
    return "\n".join(lines)


def test_edges_of_the_authorisation_frames(spark):
    cases = {1: (24, 20), 2: (25, 20), 3: (25, 10), 4: (25, 11), 5: (40, 40)}
    rows = [(k, "shop/util/a.py", "python", _app(*c)) for k, c in cases.items()] + [(6, "shop/tests/a.py", "python", _app(40, 40)), (7, "shop/a.py", "python", None), (8, "shop/a.py", "python", ""), (9, "shop/a.py", None, _app(40, 40))]
    files = spark.createDataFrame(rows, "file_id long, path string, kind string, content string")
    got = {r["file_id"]: (r["in_handler"], r["cvss"]) for r in authz.unchecked_fetches(files, ["file_id"]).collect()}
    assert got == {2: (True, 7.5), 4: (True, 7.5), 5: (False, 5.5)}


def test_ten_thousand_patterns_without_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(3000)]
    rules = [(i, f"rule {i}", rf"{words[i % 3000]}\s+{words[(i * 7) % 3000]}", "multi", 7.0, False) for i in range(10_000)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(200)] + [None, ""] + [f"x\n{words[k]} \n {words[(k * 7) % 3000].upper()}" for k in range(0, 100, 9)]
    files = spark.createDataFrame([(f"f{i}", "text", t) for i, t in enumerate(texts)], "path string, kind string, content string")
    table = spark.createDataFrame(rules, "pattern_id long, title string, regex string, language string, cvss double, from_notes boolean")
    found = learned.matches(files, table, block=4_000)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = Counter()
    for i, t in enumerate(texts):
        own = {r[0] for r in rules if t and words[r[0] % 3000] in t.lower()}
        for k in own:
            for m in re.finditer(rules[k][2], t, re.I):
                want[f"f{i}", k, t.count("\n", 0, m.start()) + 1] += 1
    assert sum(want.values()) > 10 and Counter((r["path"], r["pattern_id"], r["line"]) for r in found.collect()) == want


def test_every_match_holds_a_literal(spark):
    patterns = [r"foo+bar", r"(?:ab|cd)xyz?", r"one|two three", r"a\.b\x41cde", r"[abc]def{2}g", r"x(y(z)w)?v1_", r"\bword\b\s*=\s*\d+", r"\d{4}", r"colou?r", r"(?i)Secret"]
    samples = ["fooobar", "abxy", "cdxyz", "one", "two three", "a.bAcde", "adeffg", "xv1_", "xyzwv1_", "word = 12", "1234", "color", "colour", "secret"]
    df = spark.createDataFrame([(p,) for p in patterns], "p string").select("p", learned.literals(F.col("p")).alias("words"))
    for r in df.collect():
        hits = [s for s in samples if re.fullmatch(r["p"], s)]
        assert hits and (r["words"] is None or all(any(all(w in h.lower() for w in own) for own in r["words"]) for h in hits)), r
    why = {r["p"]: r["why"] for r in spark.createDataFrame([("(",), ("ab(c",), ("(a|b)+cde",), ("ab||cd",), (".*",), (None,), (r"\d{4,}\s",), (r"fine\(x",), (r"a{3}",)], "p string").select("p", learned.refusal(F.col("p")).alias("why")).collect()}
    assert why == {"(": "too-short", "ab(c": "broken", "(a|b)+cde": "repeated-group", "ab||cd": "empty-alternative", ".*": "too-short", None: "too-short", r"\d{4,}\s": "no-literal", r"fine\(x": None, r"a{3}": "few-literals"}


def test_imports_belong_to_the_longest_package(spark):
    files = spark.createDataFrame([(1, "a.js", "require('@a/parser/lib')\nrequire('@b/parser')\nrequire('lodashx')"), (1, "b.go", 'import "github.com/x/y/v2/z"'), (1, "n.js", None), (2, "a.js", "require('@a/parser')")], "project long, path string, content string")
    packages = spark.createDataFrame([(1, "@a/parser"), (1, "lodash"), (1, "github.com/x/y"), (1, "github.com/x/y/v2")], "project long, package string")
    got = {(r["project"], r["path"], r["package"]) for r in dependencies.usages(files, packages, ["project"]).collect()}
    assert got == {(1, "a.js", "@a/parser"), (1, "b.go", "github.com/x/y/v2")}
    broken = spark.createDataFrame([(1, "package.json", "{"), (1, "requirements.txt", None), (2, "package-lock.json", "[]"), (2, "pom.xml", ""), (3, "go.mod", "")], "project long, path string, content string")
    assert Counter(r["gap"] for r in dependencies.declared(broken, ["project"]).collect()) == {"malformed manifest": 2, "no content": 1}


def test_long_calls_and_hosts_dont_end_the_matcher(spark):
    files = spark.createDataFrame([("a.c", "x = malloc(" + "a" * 1_000_000 + ");\n"), ("b.c", "free(" + "(b)" * 300_000 + ");\n p = NULL"), ("c.c", "calloc((a(b)));")], "path string, content string")
    assert {(r["path"], r["title"]) for r in P.scan_content(files, B.UNSAFE_C).collect()} == {("a.c", "malloc() without NULL check")}
    hosts = [("a." * 200_000 + "com", "a." * 200_000 + "com"), ("https://A.b-c.Org.", "a.b-c.org"), ("a..com", None), ("-a.com", None), ("com", None), ("a.c0", None)]
    df = spark.createDataFrame(hosts, "h string, w string")
    assert df.where(~R.domain(F.col("h")).eqNullSafe(F.col("w"))).count() == 0
