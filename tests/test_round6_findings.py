"""F16, F17: what a text can't match isn't run on it, and the rows are those of the plain patterns."""

from pyspark.sql import functions as F

from quarry.functions.arrays import match_lines
from quarry.operators import dependencies as D

IMPORTS = ["import a", "x\n  from\n b import c", "from import d", "const e = require( 'f/g' )", "import h from \"i\"", "gem 'j'", "require_relative \"k\"", 'import (\n\t"l/m"\n)', 'import n "o.p"', "import", "\"q\" r", "From s", "REQUIRE('t')", "", None, "from 'u'\r\nimport v\r\n\"w\"\r\n"]
INPUTS = ["sys.argv", "process.argv", "ARGV", "ENV['a']", "os.environ", *(f"request.{x}" for x in "args form json data files GET POST params query".split()), "params[:a]", "flask.request", "express.request", "ctx.query", "ctx.body", "ctx.params", "input (", "gets", "readline"]


def test_import_patterns_run_where_they_can_match(spark):
    df = spark.createDataFrame([(t,) for t in IMPORTS], "t string")
    plain = F.concat(*(F.arrays_zip(F.regexp_extract_all("t", F.lit(p), F.lit(1)).alias("raw"), match_lines(F.col("t"), p).alias("line")) for p in D.IMPORTS))
    rows = df.where("t is not null").select(plain.alias("a"), D._imports(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(map(len, (r["b"] for r in rows))) > 12
    for p, signs in zip(D.IMPORTS, D.IMPORT_SIGNS, strict=True):
        assert not df.where(F.col("t").rlike(p) & ~D._any_of(F.col("t"), signs)).count()


def test_every_input_has_a_sign(spark):
    df = spark.createDataFrame([(t,) for t in INPUTS], "t string")
    assert df.where(F.col("t").rlike(D.TAINT)).count() == df.where(D._any_of(F.col("t"), D.TAINT_SIGNS)).count() == len(INPUTS)


def test_first_risky_call_by_order_of_the_hints(spark):
    rows = [("yaml\0pyyaml", "YAML.load x; yaml.load(y)", "yaml.load("), ("a\0lodash", "_.merge (x)", "_.merge ("), ("a\0b", "yaml.load(y)", ""), ("yaml\0yaml", "nothing", ""), ("open_uri\0open-uri", "URI.open", "URI.open"), ("x\0urllib", "urllib.request.urlopen(" + "z" * 200, "urllib.request.urlopen(")]
    found = spark.createDataFrame(rows, "names string, w string, want string").select("want", D._risky(F.col("names"), F.col("w")).alias("got"))
    assert all(r["want"] == r["got"] for r in found.collect())
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()  # compiled, not entry by entry
