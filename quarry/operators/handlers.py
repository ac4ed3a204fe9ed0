"""Routes traced to the bodies of their handlers and what those reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import line_breaks
from quarry.sources.scratch import saved

#: (kind, score, pattern); of a body the first kind is its primary one. Fixed values.
SINKS = [
    ("rce", 9.0, r'exec\.Command|syscall\.Exec|/bin/(?:ba)?sh|Language:\s*"command"|RunCommand\(|RunCode\(|RunInSession\(|os\.StartProcess|Command::new|std::process::Command'),
    ("ssrf", 8.6, r"ReverseProxy|NewSingleHostReverseProxy|httputil\.ReverseProxy|proxy\.Director|http\.Get\(|http\.Post\(|reqwest::"),
    ("file_write", 8.1, r"os\.WriteFile|os\.OpenFile|os\.Create\(|CreateFileF|WriteFileF|InsertMock\(|io\.Copy\(|tokio::fs::write|std::fs::write"),
    ("path_join", 8.1, r"filepath\.Join\s*\("),
    ("deser", 7.5, r"gob\.NewDecoder|proto\.Unmarshal|json\.Unmarshal\s*\(|yaml\.Unmarshal|serde_json::from_|bincode::deserialize"),
    ("file_read", 7.5, r"os\.ReadFile|os\.Open\(|ExpandPath\(|DownloadFile\("),
    ("nested_io", 7.5, r"nested_io_open|avio_open2?\(|ffurl_open|open_url\s*\("),
    ("queue_admin", 7.5, r"NewInspector|DeleteAll|ArchiveAll|\.Enqueue\("),
    ("proxy_start", 8.6, r"StartIncomingProxy|StartOutgoing"),
    ("mutate_api", 8.6, r"create_sandbox\(|kill_sandbox\(|delete_sandbox\(|resumer\.Resume|\.Resume\(ctx"),
]
#: Kinds that make a route worth a look first. Fixed values.
HIGH = ["rce", "ssrf", "file_write", "nested_io", "deser", "queue_admin", "path_join", "proxy_start", "mutate_api"]
#: suffix: a line that opens a function, with its name. Fixed values but for the last, which reads C in one pass.
OPENING = {
    ".go": r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", ".rs": r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[<(]",
    **dict.fromkeys((".c", ".cc", ".cpp", ".h"), r"^[\w*][\w*\s]*\s(\w+)\s*\([^;{]*\)\s*\{"),
}
#: Words that such a line opens no function with; what begins the next function; bodies of a handler. Fixed values.
NO_NAME = ["if", "for", "switch", "return", "var", "type"]
STOP = r"^(?:func |pub async fn |pub fn |fn [^(])"
MOST_BODIES = 4
#: (score, folder or name in the body's path) and (score, in the route, in the body's path, not in either). Fixed values.
AWAY, HOME = ["/sdk", "/sdks/", "client", "/cmd/", "testdata"], ["controller", "/handlers/", "/web/", "/routes/"]


def sinks_in(text: Column) -> Column:
    """array<struct<kind, cvss, at>> of the kinds that a text reaches, in their
    order, with the line of each kind's first match, from 0."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(c).alias("cvss"), line_breaks(F.split(text, p, 2)[0]).alias("at"))) for k, c, p in SINKS)))


def functions(files: DataFrame, content: str = "content") -> DataFrame:
    """``files(path, content)`` -> ``(file, line, name, body)``. A body ends
    before the first line from the fifth on that begins a function, or with its
    file. What begins one is ``STOP``, and but in Go an opening line too: no
    other line tells where a function of C ends."""
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    opening = reduce(lambda c, kv: c.when(suffix == kv[0], F.lit(kv[1])), OPENING.items(), F.when(F.lit(False), ""))
    own = files.select(F.col("path").alias("file"), F.split(content, "\n").alias("ls"), opening.alias("p")).where("p is not null and ls is not null")
    opens = lambda name: (name != "") & ~name.isin(NO_NAME)
    named = own.withColumn("names", F.transform("ls", lambda s: F.call_function("regexp_extract", s, F.col("p"), F.lit(1))))
    stops = F.zip_with("ls", "names", lambda s, name: s.rlike(STOP) | (~F.endswith(F.col("file"), F.lit(".go")) & opens(name)))
    marked = named.withColumn("stops", F.filter(F.transform(stops, lambda b, i: F.when(b, i)), lambda i: i.isNotNull()))
    each = marked.select("file", "ls", "stops", F.posexplode("names").alias("i", "name")).where(opens(F.col("name")))
    end = F.coalesce(F.array_min(F.filter("stops", lambda s: s >= F.col("i") + 4)), F.size("ls"))
    body = F.array_join(F.slice("ls", F.col("i") + 1, end - F.col("i")), "\n")
    return each.select("file", (F.col("i") + 1).alias("line"), "name", body.alias("body"))


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def affinity(file: Column, route_file: Column, route: Column) -> Column:
    """How near a body's file is to a route: the same file, folder, folders at
    equal depth, and words that route and path share."""
    low, asked = F.lower(file), F.lower(route)
    has = lambda c, words: reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))
    folder = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    alike = F.aggregate(F.zip_with(_parts(file), _parts(route_file), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda n, x: n + x)
    points = lambda score, when: F.when(when, score).otherwise(0)
    isolated = F.contains(asked, F.lit("isolated"))
    return (
        points(120, (file == route_file) & (route_file != "")) + points(50, folder(file) == folder(route_file)) + 8 * alike - points(90, has(low, AWAY)) + points(30, has(low, HOME))
        + points(45, isolated & F.contains(low, F.lit("isolated")))
        + points(45, F.contains(asked, F.lit("/files/")) & ~isolated & F.contains(low, F.lit("filesystem")) & ~F.contains(low, F.lit("isolated")))
        + points(20, F.contains(asked, F.lit("upload")) & F.contains(low, F.lit("upload")))
    )


def nearest_bodies(routes: DataFrame, bodies: DataFrame, most: int = MOST_BODIES) -> DataFrame:
    """``routes(route_file, route, handler)`` x ``bodies(name, file, line, ...)``
    -> distinct routes with the ``most`` bodies of their handler's name that are
    nearest, ``rank`` from 1, ties by file and line.

    All of a name's bodies never meet all its routes. Bodies of a name in one
    folder differ for a route only in their own file's name: if it doesn't
    stand in the route's file's path at the same depth, the first few of those
    whose names hold the same words stand for all; those whose name stands there
    are found by joining on it. Both steps keep ``most`` bodies a group before
    anything is shuffled.
    """
    base, folder, depth = F.regexp_extract("file", r"([^/]*)$", 1), F.regexp_replace("file", r"/?[^/]*$", ""), F.size(_parts(F.col("file"))) - 1
    words = F.array(*(F.contains(F.lower("file"), F.lit(w)) for w in [*AWAY, *HOME, "isolated", "filesystem", "upload"]))
    b = bodies.withColumn("base_", base).withColumn("folder_", folder).withColumn("depth_", depth).withColumn("words_", words)
    first = lambda df, *group: df.withColumn("n_", F.row_number().over(Window.partitionBy(*group).orderBy("file", "line"))).where(F.col("n_") <= most).drop("n_")
    asked = routes.select("route_file", "route", "handler").distinct()
    any_ = asked.join(first(b, "name", "folder_", "words_"), F.col("handler") == F.col("name"))
    placed = asked.select("*", F.posexplode(_parts(F.col("route_file"))).alias("depth_", "base_"))
    same = placed.withColumnRenamed("handler", "name").join(first(b, "name", "folder_", "base_"), ["name", "depth_", "base_"]).withColumn("handler", F.col("name"))
    columns = ["route_file", "route", "handler", *bodies.columns]
    both = any_.select(*columns).unionByName(same.select(*columns)).dropDuplicates(["route_file", "route", "handler", "file", "line"])
    scored = both.withColumn("affinity", affinity(F.col("file"), F.col("route_file"), F.col("route")))
    place = F.row_number().over(Window.partitionBy("route_file", "route", "handler").orderBy(F.desc("affinity"), "file", "line"))
    return scored.withColumn("rank", place).where(F.col("rank") <= most)


def traced(routes: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """``routes(path, line, method, route, handler)`` x ``files(path, content)``
    -> a row a route with ``handler_file, handler_line``, ``sinks`` ("kind@file:line",
    comma-joined, each kind where it is first reached), ``primary_sink``,
    ``cvss`` (0 without sinks) and ``high``. A handler ``a.b`` is b. Files of
    controllers and handlers count as a whole beside the body, since they
    split their work. Handlers without a body have null for a file."""
    path = F.lower("path")
    whole = (F.contains(path, F.lit("controller")) | F.contains(path, F.lit("/handlers/"))) & ~F.contains(path, F.lit("/routes/"))
    of_file = files.where(whole).select(F.col("path").alias("file"), sinks_in(F.col(content)).alias("file_sinks")).where(F.size("file_sinks") > 0)
    bodies = functions(files, content).select("name", "file", "line", sinks_in(F.col("body")).alias("sinks"))
    asked = routes.withColumnsRenamed({"path": "route_file", "line": "route_line"}).withColumn("handler", F.regexp_extract("handler", r"([^.]*)$", 1))
    near = saved(nearest_bodies(asked, bodies).join(of_file, "file", "left"))  # read for the sinks, and for the nearest
    at = lambda s, kind, start: F.transform(F.coalesce(s, F.array().cast("array<struct<kind:string,cvss:double,at:int>>")), lambda x, i: F.struct(F.col("rank"), F.lit(kind).alias("of"), i.alias("i"), x["kind"].alias("kind"), x["cvss"].alias("cvss"), F.concat_ws(":", "file", start + x["at"]).alias("at")))
    key = ["route_file", "route", "handler"]
    found = near.select(*key, F.explode(F.concat(at(F.col("sinks"), 0, F.col("line")), at(F.col("file_sinks"), 1, F.lit(1)))).alias("s")).select(*key, "s.*")
    firsts = found.groupBy(*key, "kind").agg(F.min(F.struct("rank", "of", "i", "at", "cvss")).alias("s"))  # a row a kind
    lists = firsts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("s.rank", "s.of", "s.i", "kind", "s.at", "s.cvss"))).alias("s"))
    best = near.where("rank = 1").select(*key, F.col("file").alias("handler_file"), F.col("line").alias("handler_line"))
    out = asked.join(best, key, "left").join(lists, key, "left")
    s = F.coalesce("s", F.array().cast("array<struct<rank:int,of:int,i:int,kind:string,at:string,cvss:double>>"))
    return out.select(
        "route_file", "route_line", "method", "route", "handler", "handler_file", "handler_line", F.array_join(F.transform(s, lambda x: F.concat(x["kind"], F.lit("@"), x["at"])), ",").alias("sinks"),
        F.coalesce(F.get(s, F.lit(0))["kind"], F.lit("")).alias("primary_sink"), F.coalesce(F.get(s, F.lit(0))["cvss"], F.lit(0.0)).alias("cvss"), F.exists(s, lambda x: x["kind"].isin(HIGH)).alias("high"),
    )
