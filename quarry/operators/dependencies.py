"""From manifests to used packages: declarations of five formats and their
gaps, imports matched to the longest declared package, what stands near them,
and the captured sources of what is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import match_lines
from quarry.sources import text as X
from quarry.sources.scratch import saved

#: Distributions that are imported by another name. Fixed values.
IMPORTED_AS = {"pyyaml": "yaml", "beautifulsoup4": "bs4", "pillow": "pil", "pyjwt": "jwt"}
#: What imports look like, in any file. Fixed values.
IMPORTS = [
    r"(?m)^\s*(?:from|import)\s+([a-zA-Z0-9_]+)", r"(?m)^\s*import\s+([a-zA-Z0-9_]+)", r"""require\(\s*['"]([a-zA-Z0-9_@/.-]+)['"]\s*\)""", r"""from\s+['"]([a-zA-Z0-9_@/.-]+)['"]""",
    r"""(?:require|require_relative|gem)\s+['"]([a-zA-Z0-9_/-]+)['"]""", r"""(?m)^\s*"([a-zA-Z0-9._/-]+)"\s*$""", r"""(?m)^\s*import\s+(?:\w+\s+)?"([a-zA-Z0-9._/-]+)\"""",
]
#: Of each, what a text must have one of to match: plain searches are a small part of a regex's time.
IMPORT_SIGNS = [["from", "import"], ["import"], ["require"], ["from"], ["require", "gem"], ['"'], ["import"]]
#: Risky calls of packages, in this order. Fixed values.
RISKY = {
    "yaml": [r"yaml\.(load|unsafe_load)\s*\(", r"YAML\.load\b", r"Psych\.load\b"], "pyyaml": [r"yaml\.(load|unsafe_load)\s*\("], "pickle": [r"pickle\.loads?\s*\("], "marshal": [r"marshal\.loads?\s*\("],
    "serialize": [r"Marshal\.load\b", r"JSON\.parse\b"], "nokogiri": [r"Nokogiri::XML\(", r"Nokogiri::HTML\("], "rexml": [r"REXML::Document"], "subprocess": [r"subprocess\.(call|run|Popen|check_output)\s*\("],
    "child_process": [r"child_process\.(exec|execSync|spawn)\s*\("], "shelljs": [r"shell\.(exec|rm)\s*\("], "lodash": [r"_\.template\s*\(", r"_\.merge\s*\("], "handlebars": [r"Handlebars\.compile\s*\("],
    "jinja2": [r"jinja2\.Template\s*\(", r"Environment\s*\("], "ermarkdown": [r"markdown\.(markdown|Markdown)\s*\("], "marked": [r"marked\s*\("], "xmldom": [r"DOMParser", r"parseFromString"],
    "xml": [r"etree\.parse\s*\(", r"XMLParser\s*\("], "lxml": [r"etree\.(parse|fromstring|XML)\s*\("], "requests": [r"requests\.(get|post|request)\s*\("], "urllib": [r"urllib\.request\.urlopen\s*\("], "open-uri": [r"URI\.open\b", r"open\s*\(.*https?:"],
}
#: What a caller's input looks like. Fixed values.
TAINT = (
    r"\bsys\.argv\b|\bprocess\.argv\b|\bARGV\b|\bENV\[|\bos\.environ\b|\brequest\.(args|form|json|data|files|GET|POST|params|query)\b|\bparams\[|\bflask\.request\b|\bexpress\.request\b|\bctx\.(query|body|params)\b|\binput\s*\(|\bgets\b|\breadline\b"
)
#: What a text must have one of to match it.
TAINT_SIGNS = ["argv", "ARGV", "ENV[", "os.environ", "request", "params[", "ctx.", "input", "gets", "readline"]
#: Lines before and after an import that are looked at; suffixes whose imports can't be read; scores by risk. Fixed values.
BEFORE, AFTER = 24, 40
UNREAD = [".java", ".php", ".rs"]
RISKS = {"critical": 8.5, "high": 7.0, "medium": 5.5, "low": 3.0}


def package_key(name: Column) -> Column:
    return F.translate(F.lower(F.btrim(name)), "-", "_")


def _rows(df: DataFrame, key: list[str], ecosystem: str, line: Column, package: Column, version: Column, gap: Column, dev: Column | None = None) -> DataFrame:
    return df.select(*key, "path", line.cast("int").alias("line"), F.lit(ecosystem).alias("ecosystem"), package.alias("package"), version.alias("version"), (F.lit(False) if dev is None else dev).alias("dev"), gap.alias("gap"))


def declared(files: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """Manifests among ``files(key..., path, content)`` -> ``(key..., path, line,
    ecosystem, package, version, dev, gap)``: a row a declared package; one
    with ``gap`` in place of a package where a manifest or a line can't be read.

    requirements.txt, package.json, package-lock.json (each package where it is
    installed), Gemfile.lock (the blocks after "specs:", up to an empty line),
    pom.xml (an artifact with its version beside it) and go.mod (by ``go_mod()``).
    JSON has no lines: 0. Null contents are a gap.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    none = F.lit(None).cast("string")
    of = lambda *names: files.where(name.isin(*names))
    empty = _rows(of("requirements.txt", "package.json", "package-lock.json", "Gemfile.lock", "pom.xml", "go.mod").where(F.col(content).isNull()), key, "unknown", F.lit(0), none, none, F.lit("no content"))

    t = F.btrim("line_text", F.lit(" \t\r"))
    plain = X.lines(of("requirements.txt"), content).where((t != "") & ~t.startswith("#"))
    pinned, bare = r"^([a-zA-Z0-9_.-]+)\s*[=><!~]+\s*([0-9.]+)", r"^[a-zA-Z0-9_.-]+$"
    found = F.when(t.startswith("-"), none).when(t.rlike(pinned), F.regexp_extract(t, pinned, 1)).when(t.rlike(bare), t)
    python = _rows(plain, key, "python", F.col("line"), found, F.when(found.isNotNull(), F.regexp_extract(t, pinned, 2)), F.when(found.isNull(), "unresolved requirement"))

    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    node = of("package.json").where(F.col(content).isNotNull()).withColumn("doc", F.when(F.try_parse_json(content).isNotNull(), F.from_json(content, schema)))
    listed = lambda m, dev: F.transform(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(e["key"].alias("p"), F.regexp_replace(e["value"], r"^[^0-9]*", "").alias("v"), F.lit(dev).alias("d")))
    npm = _rows(node.withColumn("e", F.explode(F.concat(listed(F.col("doc.dependencies"), False), listed(F.col("doc.devDependencies"), True)))), key, "node", F.lit(0), F.col("e.p"), F.col("e.v"), none, F.col("e.d"))
    broken = _rows(node.where("doc is null"), key, "node", F.lit(0), none, none, F.lit("malformed manifest"))

    lock = of("package-lock.json").where(F.col(content).isNotNull()).withColumn("doc", F.when(F.try_parse_json(content).isNotNull(), F.from_json(content, "packages map<string,struct<name:string,version:string,dev:boolean,link:boolean>>")))
    entry = lock.withColumn("e", F.explode(F.map_entries("doc.packages"))).where(F.startswith("e.key", F.lit("node_modules/")))
    locked = _rows(entry, key, "node", F.lit(0), F.coalesce("e.value.name", F.regexp_extract("e.key", r"(?:.*node_modules/)(.*)$", 1)), F.coalesce("e.value.version", F.lit("")), none, F.coalesce("e.value.dev", F.lit(False)))
    unlocked = _rows(lock.where("doc.packages is null"), key, "node", F.lit(0), none, none, F.lit("malformed manifest"))

    gem = X.lines(of("Gemfile.lock"), content)
    mark = F.when(t == "specs:", True).when(t == "", False)
    inside = F.last(mark, ignorenulls=True).over(Window.partitionBy(*key, "path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    spec = r"^([a-zA-Z0-9_.-]+)\s*\(([0-9.]+)"
    ruby = _rows(gem.withColumn("inside", inside).where(F.col("inside") & mark.isNull() & ~t.startswith("GEM") & ~t.startswith("PLATFORMS") & t.rlike(spec)), key, "ruby", F.col("line"), F.regexp_extract(t, spec, 1), F.regexp_extract(t, spec, 2), none)

    artifact = r"<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>"
    all_ = lambda i: F.regexp_extract_all(content, F.lit(artifact), F.lit(i))
    pom = of("pom.xml").withColumn("e", F.explode(F.arrays_zip(all_(1).alias("p"), all_(2).alias("v"), match_lines(F.col(content), artifact).alias("l"))))
    java = _rows(pom, key, "java", F.col("e.l"), F.col("e.p"), F.col("e.v"), none)

    owner = F.to_json(F.struct(*key, "path"))  # go_mod() knows a file by its path
    mods = X.go_mod(of("go.mod").where(F.col(content).isNotNull()).select(owner.alias("path"), F.col(content).alias("content")))
    back = files.select(*key, "path").schema.simpleString()
    own = mods.where(F.col("kind").isin("require", "gap")).withColumn("o", F.from_json("path", back)).select("line", "kind", "package", "version", *(F.col(f"o.{c}").alias(c) for c in key), F.col("o.path").alias("path"))
    gap = F.col("kind") == "gap"
    go = _rows(own, key, "go", F.col("line"), F.when(~gap, F.col("package")), F.when(~gap, F.col("version")), F.when(gap, "unresolved line"))
    return reduce(DataFrame.unionByName, (empty, python, npm, broken, locked, unlocked, ruby, java, go))


def inventory(declarations: DataFrame, key: list[str], include_dev: bool = False) -> DataFrame:
    """``(key..., package, version)``, each once whatever its letters' case: the first spelling."""
    own = declarations.where(F.col("package").isNotNull() & (F.lit(include_dev) | ~F.col("dev")))
    return own.groupBy(*key, F.lower("package").alias("low"), F.coalesce("version", F.lit("")).alias("version")).agg(F.min("package").alias("package")).select(*key, "package", "version")


def _prefixes(name: Column) -> Column:
    """A key and what it has before each of its slashes and dots."""
    ends = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)).isin("/", "."))
    return F.concat(F.array(name), F.transform(ends, lambda i: F.substring(name, F.lit(1), i - 1)))


def _any_of(text: Column, signs: list[str]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in signs))


def _imports(content: Column) -> Column:
    """An array of (raw, line): what each pattern matches, in order of the patterns. What a text can't match isn't run on it."""
    none = F.array().cast("array<struct<raw:string,line:int>>")
    sites = lambda p: F.arrays_zip(F.regexp_extract_all(content, F.lit(p), F.lit(1)).alias("raw"), match_lines(content, p).alias("line"))
    return F.concat(*(F.when(_any_of(content, signs) & content.rlike(p), sites(p)).otherwise(none) for p, signs in zip(IMPORTS, IMPORT_SIGNS, strict=True)))


def _risky(names: Column, window: Column) -> Column:
    """The text of the first risky call of a package that has the hint in its names, '' if none.
    The first of an ordinary chain, not of an array: Spark's functions on arrays compute it entry by entry without compiling it."""
    calls = (F.when(F.contains(names, F.lit(hint)), F.nullif(F.regexp_extract(window, f"({p})", 1), F.lit(""))) for hint, patterns in RISKY.items() for p in patterns)
    return F.substring(F.coalesce(*calls, F.lit("")), 1, 100)


def usages(files: DataFrame, packages: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """``files(key..., path, content)`` x ``packages(key..., package)`` -> ``(key...,
    path, line, package, import_name, near_input, risky_call, risk)``: where each
    file first imports each package, and what stands from 24 lines before to 40 after.

    An import belongs to the longest declared package of which it is the name or
    a part below, found by joining on its prefixes; one that belongs to none
    counts if it is known for risky calls. A file that imports nothing of
    either kind counts for the packages whose risky calls it has, at line 1.
    Two packages of one key are one: the later spelling by name.
    """
    norm = package_key(F.col("package"))
    other = reduce(lambda c, kv: c.when(norm == kv[0], kv[1]), IMPORTED_AS.items(), F.when(F.lit(False), ""))
    both = packages.select(*key, "package", F.explode(F.array_compact(F.array(norm, other))).alias("norm"))
    index = saved(both.groupBy(*key, "norm").agg(F.max("package").alias("package")))  # read twice, and what it is made of is long
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    own = files.where(F.col(content).isNotNull() & ~suffix.isin(UNREAD)).withColumn("ls", F.split(content, "\n"))
    found = own.select(*key, "path", F.explode(F.array_distinct(_imports(F.col(content)))).alias("s")).select(*key, "path", package_key(F.col("s.raw")).alias("raw"), F.col("s.line").alias("line"))
    first = saved(found.groupBy(*key, "path", "raw").agg(F.min("line").alias("line")))
    tried = first.select("*", F.explode(F.array_distinct(_prefixes(F.col("raw")))).alias("norm"))
    best = saved(tried.join(index, [*key, "norm"]).groupBy(*key, "path", "raw", "line").agg(F.max_by(F.struct("norm", "package"), F.length("norm")).alias("m")))
    head = F.substring_index("raw", ".", 1)
    loose = first.join(best.select(*key, "path", "raw"), [*key, "path", "raw"], "left_anti").where(head.isin(list(RISKY))).select(*key, "path", "line", head.alias("norm"))
    matched = best.select(*key, "path", "line", F.col("m.norm").alias("norm")).unionByName(loose)
    hints = F.array_compact(F.array(*(F.when(reduce(Column.__or__, (F.col(content).rlike(p) for p in patterns)), F.lit(h)) for h, patterns in RISKY.items())))
    silent = own.join(matched.select(*key, "path").distinct(), [*key, "path"], "left_anti").select(*key, "path", F.lit(0).alias("line"), F.explode(hints).alias("norm"))
    names = F.concat_ws("\0", "norm", package_key(F.col("package")))  # hints have no such character
    named_ = matched.unionByName(silent).groupBy(*key, "path", "norm").agg(F.min("line").alias("line")).join(index, [*key, "norm"], "left").withColumn("package", F.coalesce("package", "norm")).withColumn("names", names)
    low = lambda s: F.translate(F.lower(s), "-", "_")
    there = F.array_position(F.transform("ls", lambda s: F.contains(low(s), F.col("norm")) | F.contains(F.lower(s), F.lower("package"))), True)
    placed = own.join(named_, [*key, "path"]).withColumn("line", F.when(F.col("line") > 0, F.col("line")).otherwise(F.greatest(there, F.lit(1))).cast("int"))
    start = F.greatest(F.col("line") - BEFORE, F.lit(1))
    window = F.array_join(F.slice("ls", start, F.col("line") + AFTER + 1 - start), "\n")
    seen = placed.select(*key, "path", "line", "package", F.col("norm").alias("import_name"), "names", window.alias("w"))
    said = seen.select(*key, "path", "line", "package", "import_name", (_any_of(F.col("w"), TAINT_SIGNS) & F.col("w").rlike(TAINT)).alias("near_input"), _risky(F.col("names"), F.col("w")).alias("risky_call"))
    risk = F.when(F.col("near_input") & (F.col("risky_call") != ""), "critical").when(F.col("near_input"), "high").when(F.col("risky_call") != "", "medium").otherwise("low")
    # one row a package, file and line: the first import name
    return said.withColumn("risk", risk).groupBy(*key, "path", "line", "package").agg(F.min_by(F.struct("import_name", "near_input", "risky_call", "risk"), "import_name").alias("u")).select(*key, "path", "line", "package", "u.*")


def reachable(used: DataFrame, key: list[str]) -> DataFrame:
    """``(key..., package, path, line, risk, risky_call, cvss, sites)``: of each
    package the riskiest use, the first of equal ones; packages that are only imported have none."""
    rank = reduce(lambda c, kv: c.when(F.col("risk") == kv[1], kv[0]), enumerate(("low", "medium", "high", "critical")), F.when(F.lit(False), 0))
    best = used.groupBy(*key, "package").agg(F.min_by(F.struct("path", "line", "risk", "risky_call"), F.struct(-rank, "line", "path")).alias("b"), F.count("*").alias("sites")).where("b.risk <> 'low'")
    return best.select(*key, "package", "b.*", F.element_at(F.create_map(*(F.lit(x) for kv in RISKS.items() for x in kv)), F.col("b.risk")).alias("cvss"), "sites")


def bound_sources(packages: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """``packages(key..., package, version)`` with ``source_status`` (captured,
    missing, or ambiguous where several roots claim the name: none is chosen) and
    ``root``. Roots are counted before they are joined."""
    named = roots.groupBy(*key, F.col("name").alias("package")).agg(F.count_distinct("root").alias("n"), F.min("root").alias("root"))
    both = packages.join(named, [*key, "package"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("captured")
    return both.select(*packages.columns, status.alias("source_status"), F.when(status == "captured", F.col("root")).alias("root"))


def audit_candidates(used: DataFrame, bound: DataFrame, key: list[str], most: int) -> DataFrame:
    """``(key..., package, root, score, place)``: captured packages that are used
    beside input, the ``most`` of highest score of each key; ties by name."""
    near = used.where("near_input").groupBy(*key, "package").agg((F.lit(40) + F.max(F.when(F.col("risky_call") != "", 10).otherwise(0)) + F.least(F.count("*"), F.lit(9))).cast("int").alias("score"))
    own = bound.where("source_status = 'captured'").select(*key, "package", "root").distinct().join(near, [*key, "package"])
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "package", "root"))
    return own.withColumn("place", place).where(F.col("place") <= most)
