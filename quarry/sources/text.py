"""Files as lines and as an index; manifests as dependencies; JSON documents."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import running

#: Folders whose files are no targets. Fixed values.
SKIPPED_FOLDERS = [".git", "node_modules", "vendor", "__pycache__", ".venv", "venv", "target", "build", "dist", "test", "tests", "spec", "fixtures", "examples"]


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256, content)`` of every file below ``path``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))


def suffix(path: Column) -> Column:
    """The last extension with its dot, '' without one."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row a line, numbered from 1, in place of the content. No shuffle."""
    others = [c for c in files.columns if c != content]
    return files.select(*others, F.posexplode(F.split(content, "\n")).alias("pos", "line_text")).select(*others, (F.col("pos") + 1).alias("line"), "line_text")


def line_offsets(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``(key, line, start, bytes)``: where each line begins, in bytes.

    Offsets are a running sum within the row's own array, so no shuffle and no
    window is needed.
    """
    sizes = F.transform(F.split(content, "\n"), lambda s: F.octet_length(s).cast("long"))
    ends = running(F.transform(sizes, lambda n: n + 1), lambda a, x: a + x, F.lit(0).cast("long"))
    starts = F.zip_with(ends, sizes, lambda e, n: e - n - 1)
    return files.select(key, F.posexplode(F.zip_with(starts, sizes, lambda a, n: F.struct(a.alias("start"), n.cast("int").alias("bytes")))).alias("pos", "x")).select(
        key, (F.col("pos") + 1).alias("line"), F.col("x.start").alias("start"), F.col("x.bytes").alias("bytes")
    )


def omission_reason(path: Column, size: Column, suffixes: list[str], max_bytes: int = 1_000_000) -> Column:
    """Why a file isn't scanned, null if it is."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))), "skipped-folder")
        .when(~suffix(path).isin(suffixes), "extension")
        .when(size > max_bytes, "too-large")
    )


def tree_hash(files: DataFrame, path: str, sha: str) -> DataFrame:
    """One hash of the whole tree: the sum of hashes of (path, hash) of its
    files, in two halves. Independent of order, so it is a plain aggregate
    that combines on the map side and gathers nothing."""
    h = lambda *seed: F.xxhash64(*seed, path, sha).cast("decimal(20,0)")
    return files.agg(F.count("*").alias("files"), F.sum(h()).alias("hash_low"), F.sum(h(F.lit(1))).alias("hash_high"))


def requirements(files: DataFrame, content: str = "content") -> DataFrame:
    """Lines ``name==version`` of requirements files -> ``(path, line, package, version)``."""
    found = lines(files, content).withColumn("m", F.regexp_extract_all("line_text", F.lit(r"^\s*([A-Za-z0-9_.-]+)\s*==\s*([A-Za-z0-9_.-]+)"), F.lit(1)))
    version = F.regexp_extract("line_text", r"==\s*([A-Za-z0-9_.-]+)", 1)
    return found.where(F.size("m") > 0).select("path", "line", F.col("m")[0].alias("package"), version.alias("version"))


def package_json(files: DataFrame, content: str = "content", include_dev: bool = False) -> DataFrame:
    """``dependencies`` of package.json -> ``(path, package, version)``;
    malformed documents give no row."""
    schema = "dependencies map<string,string>, devDependencies map<string,string>"
    doc = files.select("path", F.from_json(content, schema).alias("d"))
    maps = [F.coalesce("d.dependencies", F.create_map().cast("map<string,string>"))]
    if include_dev:
        maps.append(F.coalesce("d.devDependencies", F.create_map().cast("map<string,string>")))
    return doc.select("path", F.explode(F.concat(*(F.map_entries(m) for m in maps))).alias("e")).select("path", F.col("e.key").alias("package"), F.col("e.value").alias("version"))


def go_mod(files: DataFrame, content: str = "content") -> DataFrame:
    """``require`` and ``replace`` of go.mod files -> ``(path, line, kind,
    package, version)``; a line that can't be read is a row of kind gap.

    A block keyword rules the lines up to the closing parenthesis: the last
    keyword line at or before a line decides, found by a window over the file's own lines.
    """
    own = lines(files, content).withColumn("t", F.btrim(F.regexp_replace("line_text", r"//.*$", ""), F.lit(" \t\r")))
    opening = F.regexp_extract("t", r"^(require|replace|exclude|retract)\s*\($", 1)
    mark = F.when(opening != "", opening).when(F.col("t") == ")", "none")
    block = F.last(mark, ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    kind = F.coalesce(F.nullif(F.regexp_extract("t", r"^(module|go|toolchain|require|replace|exclude|retract)\s", 1), F.lit("")), F.when(block != "none", block), F.lit("gap"))
    read = own.withColumn("kind", kind).withColumn("rest", F.btrim(F.regexp_replace("t", r"^(module|go|toolchain|require|replace|exclude|retract)\s+", ""), F.lit(" \t\r")))
    items = read.where((F.col("t") != "") & mark.isNull())
    package, version = F.regexp_extract("rest", r"^(\S+)", 1), F.nullif(F.regexp_extract("rest", r"^\S+\s+(.+)$", 1), F.lit(""))
    return items.select("path", "line", F.when((F.col("kind") == "require") & version.isNull(), "gap").otherwise(F.col("kind")).alias("kind"), package.alias("package"), version.alias("version"))


#: What a scan for top-level objects has to look at: strings and braces.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)


def split_objects(text: str | None) -> list[str]:
    """Top-level JSON objects of concatenated or line-wise JSON. Quotes count
    within objects only; what stands between objects is skipped."""
    out, depth, start, at = [], 0, 0, 0
    text = text or ""
    while True:
        if not depth:
            start = at = text.find("{", at)
            if start < 0:
                return out
            depth, at = 1, at + 1
        m = _MARKS.search(text, at)
        if m is None:
            return out
        at = m.end()
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            out.append(text[start:at])


def concatenated_json(files: DataFrame, content: str = "content") -> DataFrame:
    """``(path, ordinal, object)``: each top-level object as text."""

    @F.arrow_udf("array<string>")
    def objects(texts: pa.Array) -> pa.Array:
        return pa.array([split_objects(t.as_py()) for t in texts], type=pa.list_(pa.string()))

    return files.select("path", F.posexplode(objects(F.col(content))).alias("ordinal", "object"))


def routes(files: DataFrame, content: str = "content") -> DataFrame:
    """HTTP routes registered as ``x.GET("/path", handler)`` -> ``(path, line,
    method, route, handler, mutating)``."""
    pattern = r"""\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_][A-Za-z0-9_.]*)"""
    hit = lines(files, content).where(F.col("line_text").rlike(pattern))
    part = lambda i: F.regexp_extract("line_text", pattern, i)
    return hit.select("path", "line", F.upper(part(1)).alias("method"), part(2).alias("route"), part(3).alias("handler"), F.upper(part(1)).isin("POST", "PUT", "PATCH", "DELETE").alias("mutating"))
