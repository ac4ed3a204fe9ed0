"""Line deduplication over levelled sorted runs of line hashes.

Main path: DataFrame functions only. Line keys are hashed to 128 bits. A batch
of documents becomes a sorted run of (key, documents). Runs of a level are
merged into one of the next level when there are ``fanout`` of them. Keys that
reach the limit move to the settled run, and later batches are anti-joined
with it: their rows of settled keys need no more counting.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, ascii_lower, discard, fresh, written

KEY = ["h1", "h2"]
KEY_SCHEMA = "h1 long, h2 long"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


class LineRuns:
    """Counts of documents per line key, in levels of sorted runs.

    With ``folder``, a path that all executors see, the runs stay there when
    the application ends, and ``LineRuns(spark, folder=...)`` of a later one goes on from them: each
    ``add()`` writes a new manifest, a small table of the runs that count, before the runs that it replaces are deleted.
    The newest whole manifest is the state, so a driver that dies within ``add()`` loses that batch only.
    Without a folder the runs are tables of ``written()``.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3, folder: str | None = None):
        self.spark, self.min_docs, self.fanout, self.folder = spark, min_docs, fanout, folder
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: DataFrame | None = None
        self.version = -1
        self._old: list[DataFrame] = []
        if folder:
            self._open()

    def _open(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        versions = [int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found]
        if not versions:
            return
        self.version = max(versions)
        for r in self.spark.read.parquet(f"{self.folder}/manifest-{self.version}").orderBy("level", "run").collect():  # a row a run
            run = self._table(r["run"], KEY_SCHEMA + ("" if r["level"] < 0 else ", docs long"))
            if r["level"] < 0:
                self.settled = run
            else:
                while len(self.levels) <= r["level"]:
                    self.levels.append([])
                self.levels[r["level"]].append(run)

    def _table(self, name: str, schema: str) -> DataFrame:
        run = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        run._saved_at, run._run = f"{self.folder}/{name}", name
        return run

    def _written(self, df: DataFrame) -> DataFrame:
        if not self.folder:
            return written(df, sort=KEY)
        name = f"run-{uuid.uuid4().hex}"
        df.sortWithinPartitions(*KEY).write.parquet(f"{self.folder}/{name}")
        return self._table(name, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))

    def _commit(self) -> None:
        if self.folder:
            runs = [(level, run._run) for level, own in enumerate(self.levels) for run in own] + ([(-1, self.settled._run)] if self.settled is not None else [])
            self.version += 1
            self.spark.createDataFrame(runs, "level int, run string").coalesce(1).write.parquet(f"{self.folder}/manifest-{self.version}")
        for run in self._old:
            discard(run)
        self._old = []

    def _unsettled(self, run: DataFrame) -> DataFrame:
        return run if self.settled is None else run.join(self.settled, KEY, "left_anti")

    def add(self, keys: DataFrame) -> None:
        """``keys(h1, h2)``: a row for each document of the batch and key in it."""
        run = keys.groupBy(*KEY).agg(F.count("*").alias("docs"))
        self.levels[0].append(self._written(self._unsettled(run)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._compact(self.levels[level]))
            self.levels[level] = []
            level += 1
        self._commit()

    def _sum(self, runs: list[DataFrame]) -> DataFrame:
        return self._unsettled(reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("docs").alias("docs")))

    def _compact(self, runs: list[DataFrame]) -> DataFrame:
        whole = self._written(self._sum(runs))
        new = whole.where(F.col("docs") >= self.min_docs).select(*KEY)
        old, self.settled = self.settled, self._written(new if self.settled is None else self.settled.unionByName(new))
        rest = self._written(whole.where(F.col("docs") < self.min_docs))
        self._old += [*runs, whole, *([old] if old is not None else [])]
        return rest

    def frequent(self) -> DataFrame:
        """Keys in at least ``min_docs`` documents of all batches."""
        runs = [run for level in self.levels for run in level]
        found = [self._sum(runs).where(F.col("docs") >= self.min_docs).select(*KEY)] if runs else []
        found += [self.settled] if self.settled is not None else []
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], KEY_SCHEMA)


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """``(id, text_hash, drop)``: for each document with lines to drop, their
    positions, sorted. Identical rows have one entry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = F.transform(
        F.split(text, "\n"), lambda s, i: F.struct(F.length(line_key(s)).alias("n"), F.xxhash64(line_key(s)).alias("h1"), F.xxhash64(F.lit(1), line_key(s)).alias("h2"), i.alias("at"))
    )
    long_enough = F.sort_array(F.transform(F.filter(line, lambda x: x["n"] >= min_chars), lambda x: F.struct(x["h1"], x["h2"], x["at"])))
    of_doc = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), long_enough.alias("lines"))
    same = lambda x, y: (x["h1"] == y["h1"]) & (x["h2"] == y["h2"])
    marked = F.transform("lines", lambda x, k: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["at"].alias("at"), (~F.coalesce(same(x, F.get("lines", k - 1)), F.lit(False))).alias("first")))
    lines = written(of_doc.select("id", "text_hash", F.explode(marked).alias("x")).select("id", "text_hash", "x.*"))
    runs = LineRuns(docs.sparkSession, min_docs)
    firsts = lines.where("first").withColumn("batch", F.pmod(F.xxhash64("id", "text_hash"), F.lit(batches)))
    for k in range(batches):
        runs.add(firsts.where(F.col("batch") == k).select(*KEY))
    hit = lines.join(written(runs.frequent(), sort=KEY), KEY).select("id", "text_hash", "at")
    return hit.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("drop"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4, report: bool = False) -> DataFrame:
    """``docs`` without the lines whose key is in ``min_docs`` documents or more.

    A key is the line stripped of white space, A-Z lower-cased; keys shorter
    than ``min_chars`` code points are never counted. All lines of a frequent
    key go, in every document; the rest are joined by a line feed. A null or
    empty text is one empty line; a document left without lines has an empty
    text. Rows that repeat an id count as documents of their own. ``report``
    adds n_lines, before dropping, and n_dropped (under these names, or with
    underscores if ``docs`` has them); a null text then comes back as ''.
    """
    drops = dropped_lines(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars, batches=batches)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d, h, ln = (fresh(docs, x) for x in ("drop_", "hash_", "lines_"))
    named = drops.select(F.col("id").alias(f"{d}id"), F.col("text_hash").alias(f"{d}hash"), F.col("drop").alias(d))
    wide = docs.withColumn(h, F.xxhash64(text))
    wide = wide.join(named, wide[id_col].eqNullSafe(F.col(f"{d}id")) & (F.col(h) == F.col(f"{d}hash")), "left")
    wide = wide.withColumn(ln, F.split(text, "\n"))
    between = F.transform(
        F.sequence(F.lit(0), F.size(d)),
        lambda k: F.slice(
            F.col(ln),
            F.coalesce(F.get(d, k - 1), F.lit(-1)) + 2,
            F.coalesce(F.get(d, k), F.size(ln)) - F.coalesce(F.get(d, k - 1), F.lit(-1)) - 1,
        ),
    )
    kept = F.when(F.col(d).isNull(), text if report else F.col(text_col)).otherwise(F.array_join(F.flatten(between), "\n"))
    more = [F.size(ln).cast("long").alias(fresh(docs, "n_lines")), F.coalesce(F.size(d), F.lit(0)).cast("long").alias(fresh(docs, "n_dropped"))]
    return wide.select(*(kept.alias(c) if c == text_col else F.col(c) for c in docs.columns), *(more if report else []))


def oracle_sql(min_docs: int = 10, min_chars: int = 1) -> str:
    """The rows of the registered query in DuckDB's SQL."""
    key = "translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT rid, doc_id, line, pos, {key} AS k FROM (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs)),
often AS (SELECT k FROM lines WHERE length(k) >= {min_chars} GROUP BY k HAVING count(DISTINCT rid) >= {min_docs}),
marked AS (SELECT l.*, o.k IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.k = o.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id"""
