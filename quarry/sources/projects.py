"""Projects made from ``customer``: a manifest of one of seven kinds and two
source files each, with imports near and far from input and risky calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.services import _pick
from quarry.sources.tables import spread, table

_K = "c_custkey"
_V = f"CAST({_K} % 9 AS STRING)"
_NL = "chr(10)"


def _lines(*parts: str) -> str:
    return f"concat_ws({_NL}, {', '.join(parts)})"


_PY, _JS, _RB = ["pyyaml", "Jinja2", "requests", "beautifulsoup4", "my-lib"], ["lodash", "@a/parser", "@b/parser", "marked", "left-pad"], ["nokogiri", "rexml", "open-uri", "puma"]
_MANIFEST = [
    ("requirements.txt", _lines("'# pinned'", f"concat({_pick(_PY, _K)}, '==1.', {_V})", "'-r other.txt'", f"concat('  ', {_pick(_PY, f'{_K} + 2')}, ' >= 2.0')", f"{_pick(_PY, f'{_K} * 3 + 1')}", "'git+https://x/y'", "''")),
    ("package.json", f"concat('{{\"name\": \"p\", \"dependencies\": {{\"', {_pick(_JS, _K)}, '\": \"^1.', {_V}, '.0\", \"', {_pick(_JS, f'{_K} + 1')}, '\": \"~2.1\"}}, \"devDependencies\": {{\"', {_pick(_JS, f'{_K} + 3')}, '\": \"3.0.0\"}}}}')"),
    ("Gemfile.lock", _lines("'GEM'", "'  remote: https://gems/'", "'  specs:'", f"concat('    ', {_pick(_RB, _K)}, ' (7.0.', {_V}, ')')", "'      nokogiri (>= 1.8)'", f"concat('    ', {_pick(_RB, f'{_K} + 1')}, ' (1.2.3-java)')", "''", "'PLATFORMS'", "'  ruby (3.1)'")),
    ("pom.xml", _lines("'<project><dependency>'", "'<artifactId>core-lib</artifactId>'", f"concat('  <version>1.', {_V}, '</version></dependency>')", "'<artifactId>plain</artifactId>'", "'<artifactId>web</artifactId><version>2</version>'")),
    ("go.mod", _lines("'module example.com/p'", "'require ('", f"concat('    github.com/acme/parser v1.', {_V}, '.0')", "'    github.com/acme/parser/v2 v2.0.1 // indirect'", "')'", "'replace github.com/acme/parser => ./vendor/parser'", "'require broken'")),
    ("package.json", "'{\"dependencies\": '"),
    ("package-lock.json", f"concat('{{\"packages\": {{\"\": {{\"version\": \"0\"}}, \"node_modules/lodash\": {{\"version\": \"4.', {_V}, '\"}}, \"node_modules/x/node_modules/@a/parser\": {{\"version\": \"1\", \"dev\": true}}, \"node_modules/marked\": {{\"name\": \"marked-fork\"}}}}}}')"),
]
_SOURCE = [
    (".py", ["import yaml", "from jinja2.sandbox import E", "  import requests as r", "import bs4", "from my_lib import x", "import os"], ["yaml.load(v)", "jinja2.Template (v)", "requests.get(u)", "print(v)"], ["v = sys.argv[1]", "v = 1", "v = request.args['n']", "v = 2"]),
    (".js", ["const t = require('lodash/template')", "import p from '@a/parser'", "const q = require('@b/parser/lib/x')", "const m = require('marked')", "import z from './local'", "const c = require('child_process')"], ["_.template(x)", "marked(x)", "child_process.exec(x)", "f(x)"], ["const v = process.argv", "let v = 1", "v = req.x", "v = ctx.query"]),
    (".rb", ["require 'nokogiri'", "require 'rexml/document'", "gem 'puma'", "require_relative 'x'", "require 'open-uri'", "# none"], ["Nokogiri::XML(x)", "REXML::Document.new(x)", "URI.open(x)", "puts 1"], ["x = params[:n]", "x = 1", "x = ARGV", "x = 2"]),
    (".java", ["import core.Lib;", "import web.App;"], ["f(x);", "g(x);"], ["int x = 1;", "int y = 2;"]),
    (".go", ["import \"github.com/acme/parser/ast\"", "    \"github.com/acme/parser/v2/ast\"", "import p \"github.com/acme/parserx\"", "    \"fmt\"", "import \"example.com/p/a\""], ["f(x)", "g(x)", "h(x)"], ["x := 1", "y := 2", "z := 3"]),
    (".js", ["import q from \"left-pad\"", "const n = 1"], ["yaml.load(x)", "f(x)", "DOMParser"], ["const v = process.argv", "let v = 1"]),
    (".ts", ["import q from 'marked-fork/lib'", "const t = require('lodash')", "import y from '@a/parser'"], ["_.merge(a, b)", "f(x)"], ["v = process.argv", "let v = 1"]),
]


def _file(i: int) -> str:
    suffix, imports, sinks, inputs = _SOURCE[i]
    gap = lambda n: f"repeat(concat('    pass', {_NL}), CAST({n} AS INT))"
    return f"concat({_pick(imports, f'{_K} + j')}, {_NL}, {_pick(imports, f'{_K} * 5 + j * 2')}, {_NL}, {gap(f'({_K} * 3 + j) % 23')}, {_pick(inputs, f'{_K} * 7 + j')}, {_NL}, {gap(f'({_K} + j) % 50')}, {_pick(sinks, f'{_K} + j * 3')}, {_NL})"


_CASE = lambda make: f"CASE CAST({_K} % {len(_MANIFEST)} AS INT) " + " ".join(f"WHEN {i} THEN {make(i)}" for i in range(len(_MANIFEST))) + " END"
#: Columns of a file; j is 0 for the manifest. One source file in 19 has no content.
PROJECT = {
    "project": _K, "j": "j",
    "path": "CASE WHEN j = 0 THEN " + _CASE(lambda i: f"'{_MANIFEST[i][0]}'") + " ELSE concat('src/f', CAST(j AS STRING), " + _CASE(lambda i: f"'{_SOURCE[i][0]}'") + ") END",
    "content": "CASE WHEN j = 0 THEN " + _CASE(lambda i: _MANIFEST[i][1]) + f" WHEN ({_K} + j) % 19 = 0 THEN NULL ELSE " + _CASE(_file) + " END",
}
_SHAPE = ", ".join(f"{e} AS {c}" for c, e in PROJECT.items())
PROJECTS_SQL = f"projects AS (SELECT {_SHAPE} FROM (SELECT *, unnest([0, 1, 2]) AS j FROM customer))"


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(project, j, path, content)``."""
    return spread(table(spark, sf_dir, "customer")).selectExpr("*", "explode(array(0, 1, 2)) AS j").selectExpr(*(f"{e} AS {c}" for c, e in PROJECT.items()))


#: Roots of captured packages, as a snapshot has them: none, one or two for a name. Spark and DuckDB read this alike.
ROOT = {
    "project": _K, "name": _pick([*_JS, "github.com/acme/parser", "pyyaml", "nokogiri"], f"{_K} * 3 + r"), "version": f"concat('1.', {_V})", "root": f"concat('vendor/r', CAST(r % {2} AS STRING), '/', CAST(r AS STRING))",
}
ROOTS_SQL = f"roots AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ROOT.items())} FROM (SELECT *, unnest([0, 1, 2, 8, 16]) AS r FROM customer))"


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(project, name, version, root)``."""
    return spread(table(spark, sf_dir, "customer")).selectExpr("*", "explode(array(0, 1, 2, 8, 16)) AS r").selectExpr(*(f"{e} AS {c}" for c, e in ROOT.items()))
