"""Learned patterns as data: which of them may run, which of equal ones stays,
and where they match.

Files meet patterns by literals. Of every pattern the strings are known that
each match holds; files are searched for all of them at once, and only
patterns whose strings are there are tried. So patterns aren't shuffled, files
only once, to spread those that hold any, and no file is paired with patterns that can't match it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import bound, match_lines, running
from quarry.operators.patterns import capped
from quarry.sources.scratch import saved
from quarry.sources.tables import spread

#: Patterns that say nothing. Fixed values.
BROAD = [".*", ".+", "\\w+", "error", "http", "true", "false", "return", "import"]
LEAST, LEAST_LITERAL = 4, 3
#: Patterns in one pass over the files: what a broadcast and a worker's index hold at most.
BLOCK = 50_000
#: Texts of each stretch in which a title is looked for, before the rest.
STRETCHES = (16, 256, 4096)
#: Lines between a match and the sink or source that corroborates it; matches of a title in a file, of a title. Fixed values.
NEAR, PER_FILE, PER_TITLE = 25, 2, 5
#: What a sink or a source of Python looks like. Fixed values.
SINKS = [
    "os.system", "subprocess", "eval(", "exec(", "pickle.loads", "pickle.load", "cloudpickle.loads", "dill.loads", "joblib.load", "torch.load", "yaml.load", "render_template_string", "open(", ".execute(", "requests.get", "requests.post",
    "urllib.request", "httpx.get", "httpx.post", "socket.connect", "fsspec.open", "exec_command", "shell.exec", "code.execute", "bash.exec", "run_exec",
]
SOURCES = [
    "request.args", "request.form", "request.json", "request.values", "request.data", "request.headers", "request.files", "request.query_params", "sys.argv", "os.environ", "input(", "argparse", "spec", "body", "task", "runtime", "function", "artifact",
    "key_path", "stop_condition", "params",
]
_X = "\x01"  # stands for whatever isn't a literal


def _bare(regex: Column) -> Column:
    """The pattern without escapes and classes."""
    escapes = r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[pP]\{[^}]*\}|k<[^>]*>|[0-9]+|.)"
    return F.regexp_replace(F.regexp_replace(regex, escapes, _X), r"\[\^?\]?[^\]]*\]", _X)


def literals(regex: Column) -> Column:
    """Lists of strings of a-z, 0-9 and _: every match, in small letters, holds all
    of at least one list. They are the runs of each alternative outside of groups,
    classes and what may be left out. If a pattern has but one alternative and all its
    runs are in groups, they are those of the alternatives of the first group that must
    be there and has some in each. Null if there are none."""
    out = _bare(regex)
    optional = r".(?:[*?]|\{[^}]*\})"
    listed = lambda x: F.transform(F.split(x, r"\|", -1), lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9_]+"), F.lit(0))))
    full = lambda runs: F.forall(runs, lambda x: F.size(x) > 0)
    flat = ~F.regexp_replace(out, r"\([^()]*\)", "").rlike("[()|]")  # no group within a group
    groups = F.regexp_extract_all(out, F.lit(r"\((?:\?:)?([^()?][^()]*)\)(?![*?{])"), F.lit(1))
    inner = F.when(flat, F.get(F.filter(F.transform(groups, lambda g: listed(F.regexp_replace(g, optional, _X))), full), F.lit(0)))
    for _ in range(6):  # groups within groups
        out = F.regexp_replace(out, r"\((?:\?[^()]*?[:=!>])?[^()]*\)(?:[*+?]|\{[^}]*\})?", _X)
    out = F.regexp_replace(out, optional, _X)
    runs = listed(out)
    known = ~F.contains(regex, F.lit("\\Q")) & ~F.contains(regex, F.lit("(?x")) & ~out.rlike("[()]")
    return F.when(known, F.array_distinct(F.when(full(runs), runs).otherwise(inner)))


def refusal(regex: Column) -> Column:
    """Why a pattern isn't run, null if it is: too-short, broad, empty-alternative,
    few-literals, broken (it doesn't compile), repeated-group (Java's matcher
    calls itself once a repetition, which a long text doesn't survive), no-literal
    (nothing tells which files it could match)."""
    rx = F.btrim(F.coalesce(regex, F.lit("")))
    kept = F.length(F.regexp_replace(rx, r"[\\^$.*+?()\[\]{}|]", ""))
    return (
        F.when(F.length(rx) < LEAST, "too-short").when(rx.isin(BROAD), "broad").when(rx.rlike(r"^\||\|\||\|$"), "empty-alternative").when(kept < LEAST_LITERAL, "few-literals")
        .when(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), rx).isNull(), "broken").when(_bare(rx).rlike(r"\)(?:[*+]|\{[0-9]+,)"), "repeated-group").when(literals(rx).isNull(), "no-literal")
    )


def preferred(rules: DataFrame) -> DataFrame:
    """One rule for each pattern: one that isn't from notes before one that is, then the smallest number."""
    rx = F.btrim(F.col("regex"))
    return rules.groupBy(rx.alias("regex_")).agg(F.min_by(F.struct(*rules.columns), F.struct("from_notes", "pattern_id")).alias("r")).select("r.*").withColumn("regex", F.btrim("regex"))


def appended(known: DataFrame, learned: DataFrame, most: int = 500) -> DataFrame:
    """``known`` with what was learned since: patterns that may run and aren't
    there, after the others in order of their numbers; the last ``most`` stay.
    Columns as in ``known``, with ``place`` from 1."""
    own = preferred(learned.where(refusal(F.col("regex")).isNull())).withColumn("late", F.lit(True))
    both = known.withColumn("regex", F.btrim("regex")).withColumn("late", F.lit(False)).unionByName(own.select(*known.columns, "late"))
    one = both.groupBy("regex").agg(F.min_by(F.struct(*(c for c in both.columns)), F.struct("late", "pattern_id")).alias("r")).select("r.*")
    last = one.orderBy(F.desc("late"), F.desc("pattern_id")).limit(most)
    n = last.count()  # at most ``most``
    ordered = last.groupBy().agg(F.sort_array(F.collect_list(F.struct("late", "pattern_id", *(c for c in known.columns if c != "pattern_id")))).alias("rows"))
    return ordered.select(F.posexplode("rows").alias("i", "r")).select(*(F.col(f"r.{c}").alias(c) for c in known.columns), (F.col("i") + 1).alias("place")) if n else last.select(*known.columns, F.lit(1).alias("place"))


def _any(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))


def harmless(window: Column, title: Column, regex: Column) -> Column:
    """Is the match one of the safe ways to run a command or a query? ``window``:
    the line and its neighbours."""
    w, said = F.lower(window), F.lower(F.concat(title, F.lit(" "), regex))
    command = _any(said, ["system", "popen", "subprocess", "command", "shell"]) | said.rlike(r"\b(?:exec|rce)\b")
    shell = _any(w, ["os.system(", "os.popen(", "shell=true", "commands.getoutput", "`", "/bin/sh", "eval(", "exec("])
    query = _any(said, ["sql", "select", "insert", "query", "execute"])
    has = lambda s: F.contains(w, F.lit(s))
    bound_ = w.rlike(r"(execute|executemany)\s*\([^)]*[,]\s*[\(\[\{]") | (has(" where ") & has("?")) | (has("%s") & has(",")) | w.rlike(r"\?\s*[,)\]]")
    quoted = _any(w, ["qsql_id", "quote_ident", "quote_identifier", "identifier(", "sql.identifier", "escape_string"])
    spliced = _any(w, ["f'", 'f"', "%", "+", ".format("])
    return F.when(command, ~shell).when(query, bound_ | quoted | ~spliced).otherwise(False)


def candidates(files: DataFrame, rules: list[tuple[int, str, list[list[str]]]], content: str) -> Column:
    """array<struct<pattern_id, regex>> of the rules of which a text holds all literals of an
    alternative. A text is read once, whatever the number of rules."""
    held = files.sparkSession.sparkContext.broadcast(rules)
    kind = pa.list_(pa.struct([("pattern_id", pa.int64()), ("regex", pa.string())]))

    @F.arrow_udf("array<struct<pattern_id:bigint,regex:string>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        of: dict[str, list[tuple[int, frozenset[str]]]] = {}
        regexes = {}
        for number, regex, alternatives in held.value:
            regexes[number] = regex
            for words in alternatives:
                for w in words:
                    of.setdefault(w, [])
                of[max(words, key=len)].append((number, frozenset(words)))  # looked at where its longest word is
        index = ahocorasick.Automaton()
        for w in of:
            index.add_word(w, w)
        index.make_automaton()
        for texts in batches:
            out = []
            for t in texts:
                seen = {w for _, w in index.iter(t.as_py().casefold())} if of and t.is_valid else set()
                hit = sorted({n for w in seen for n, words in of[w] if words <= seen})
                out.append([{"pattern_id": n, "regex": regexes[n]} for n in hit])
            yield pa.array(out, type=kind)

    return found.asNondeterministic()(F.col(content))  # else it runs once for a filter on it, and once more


def _blocks(rules: DataFrame, most: int) -> Iterator[list]:
    block = []
    for r in rules.select("pattern_id", "regex", "title", "language", "cvss", "from_notes", literals(F.col("regex")).alias("words")).toLocalIterator():
        block.append(r)
        if len(block) >= most:
            yield block
            block = []
    yield block


def matches(files: DataFrame, rules: DataFrame, *, content: str = "content", block: int = BLOCK) -> DataFrame:
    """``files(path, kind, content)`` x ``rules`` -> ``(path, pattern_id, title,
    from_notes, base, line, near, window)``, a row a match, any case.

    ``rules`` have been let through by ``refusal()``. They come in blocks of
    ``block``, each in one pass over the files. Null contents match nothing.
    """
    spark: SparkSession = files.sparkSession
    out = None
    for own in _blocks(rules, block):
        table = spark.createDataFrame([tuple(r)[:6] for r in own], "pattern_id bigint, regex string, title string, language string, base double, from_notes boolean")
        tried = files.select("path", "kind", F.col(content).alias("text"), candidates(files, [(r["pattern_id"], r["regex"], r["words"]) for r in own], content).alias("tried"))
        # the costly step; a table in one file is one task otherwise
        tried = tried.where(F.size("tried") > 0).repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.rand(1))
        # rules are tried within the row: only those that match get a copy of it
        tried = tried.withColumn("rules", F.transform(F.filter("tried", lambda r: F.rlike(F.col("text"), F.concat(F.lit("(?iu)"), r["regex"]))), lambda r: r["pattern_id"])).where(F.size("rules") > 0).drop("tried")
        lines = F.split("text", "\n")
        marks = F.transform(lines, lambda s: (_any(s, SINKS) | _any(s, SOURCES)).cast("int"))
        seen = tried.select("path", "kind", "text", "rules", lines.alias("ls"), running(marks, lambda a, x: a + x, F.lit(0)).alias("upto"))
        each = seen.select("path", "kind", "text", "ls", "upto", F.explode("rules").alias("pattern_id")).join(F.broadcast(table), "pattern_id")  # a block's rules
        named = F.lower("language")
        apart = ~named.isin("multi", "unknown", "any", "") & ~F.contains(F.lower("kind"), named) & F.startswith("kind", F.lit("ruby")) & ~F.contains(named, F.lit("ruby"))
        hit = each.where(~apart).withColumn("line", F.explode(match_lines(F.col("text"), F.concat(F.lit("(?iu)"), F.col("regex")))))
        count = lambda at: F.when(at < 1, 0).otherwise(F.element_at("upto", F.least(at, F.size("upto"))))
        near = count(F.col("line") + NEAR) - count(F.col("line") - NEAR - 1) > 0
        first = F.greatest(F.col("line") - 1, F.lit(1))
        window = F.array_join(F.slice("ls", first, F.col("line") + 2 - first), "\n")
        got = hit.select("path", "pattern_id", "title", "regex", "from_notes", "base", "line", near.alias("near"), window.alias("window"))
        out = got if out is None else out.unionByName(got)
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``a`` joined with ``b`` by keys of which null equals null; columns as in ``a``."""
    other = b.select(*(F.col(k).alias(f"{k}_") for k in keys))
    return a.join(other, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys)), how)


def distinct_texts(files: DataFrame, content: str = "content") -> DataFrame:
    """``files(path, kind, content)`` -> ``(text_id, path, kind, content, first)``: of the files of one
    kind and content, told apart by SHA-256, the ``PER_TITLE`` of smallest path; ``first`` is the
    smallest, which alone has the content. More of them give no title another match. Null paths and contents match nothing."""
    own = files.where(F.col("path").isNotNull() & F.col(content).isNotNull()).select(F.sha2(F.concat_ws("\0", F.coalesce("kind", F.lit("\1")), content), 256).alias("text_id"), "path", "kind", content)
    n = F.row_number().over(Window.partitionBy("text_id").orderBy("path"))
    return own.withColumn("n_", n).where(F.col("n_") <= PER_TITLE).select("text_id", "path", "kind", F.when(F.col("n_") == 1, F.col(content)).alias(content), (F.col("n_") == 1).alias("first"))


def held_titles(texts: DataFrame, rules: DataFrame, *, content: str = "content", block: int = BLOCK) -> DataFrame:
    """``(text_id, path, title)``: the texts that hold all literals of an alternative of one of a
    title's rules, which are all that the title's rules can match. One pass over the texts for each ``block`` rules."""
    out = None
    for own in _blocks(rules, block):
        number = {t: i for i, t in enumerate(dict.fromkeys(r["title"] for r in own))}
        held = candidates(texts, [(number[r["title"]], r["title"], r["words"]) for r in own], content)
        got = texts.select("text_id", "path", held.alias("held")).select("text_id", "path", F.explode("held").alias("t")).select("text_id", "path", F.col("t.regex").alias("title"))
        out = got if out is None else out.unionByName(got).distinct()
    return out


def transferred(files: DataFrame, rules: DataFrame, *, content: str = "content", stretches: tuple[int, ...] = STRETCHES, **how: object) -> DataFrame:
    """``(path, line, pattern_id, title, qualification, confidence, cvss)``: the
    first matches of each title, two a file and five in all, in order of path,
    line and rule. A match beside a sink or source is qualified; another is latent and
    weighs less, the more so if its pattern is from notes. Harmless ways and
    the files of test runners are left out before counting.

    Files of one content are searched once. One pass over the texts tells which of them each title
    can match. Of those its rules are tried on stretches in order of the smallest path, the last all
    the rest; a title whose matches all lie before what is left can get none from it, so its rules aren't tried there.
    """
    left = saved(preferred(rules.where(refusal(F.col("regex")).isNull())))
    caps, order = [(["path", "title"], PER_FILE), (["title"], PER_TITLE)], ["path", "line", "pattern_id"]
    texts = saved(distinct_texts(files.where(~F.contains(F.regexp_extract("path", r"([^/]*)$", 1), F.lit("conftest"))), content))
    one = spread(texts.where("first"))
    open_ = saved(held_titles(one, left, content=content, **how))
    seen = None
    for n in (*stretches, None):
        now = open_ if n is None else saved(open_.withColumn("n_", F.rank().over(Window.partitionBy("title").orderBy("path"))).where(F.col("n_") <= n).drop("n_"))
        some = one.join(now.select("text_id").distinct(), "text_id", "left_semi").select(F.col("text_id").alias("path"), "kind", content)
        found = matches(some, left, content=content, **how).withColumnRenamed("path", "text_id")
        found = _same(found.where(~harmless(F.col("window"), F.col("title"), F.col("regex"))).drop("window", "regex"), now, ["text_id", "title"], "left_semi")
        of_text = capped(found, [(["text_id", "title"], PER_FILE)], ["line", "pattern_id"])  # the first of each file with this text
        own = saved(capped(of_text.join(texts.select("text_id", "path"), "text_id").drop("text_id"), caps, order))
        seen = own if seen is None else seen.unionByName(own)
        if n is None:
            break
        upto = now.groupBy(F.col("title").alias("of_")).agg(F.max("path").alias("upto"))
        before = capped(seen, caps, order).join(upto, F.col("title").eqNullSafe(F.col("of_"))).where(F.col("path") <= F.col("upto"))
        done = saved(before.groupBy("title").agg(F.count("*").alias("n")).where(F.col("n") >= PER_TITLE))
        left = saved(_same(left, done, ["title"], "left_anti"))
        if left.isEmpty():
            break
        open_ = saved(_same(_same(open_, done, ["title"], "left_anti"), now, ["text_id", "title"], "left_anti"))
    first = capped(seen, caps, order)
    latent = ~F.col("near")
    cvss = F.when(latent & F.col("from_notes"), F.least("base", F.lit(5.5))).when(latent, F.least("base", F.lit(6.0))).otherwise(F.col("base"))
    return first.select("path", "line", "pattern_id", "title", F.when(latent, "LATENT").otherwise("QUALIFIED").alias("qualification"), F.when(latent, "low").otherwise("medium").alias("confidence"), cvss.alias("cvss"))
