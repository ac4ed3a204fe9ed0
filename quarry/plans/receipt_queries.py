"""Canonical digests, signed index entries, receipts, and choices within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import canonical as C
from quarry.operators import selection as S
from quarry.plans.registry import query
from quarry.sources.scratch import saved
from quarry.sources.tables import FILES_SQL, FINDINGS_SQL, files, findings, table

#: A key for the queries' own signatures; a deployment gives its own.
KEY, DOMAIN = b"an example key, not a secret", b"source-index-v1"


def _hmac_sql(text: str) -> str:
    block = KEY.ljust(64, b"\0")
    inner, outer = ("'" + "".join(f"\\x{b ^ pad:02X}" for b in block) + "'::BLOB" for pad in (0x36, 0x5C))
    return f"sha256({outer} || unhex(sha256({inner} || encode({text}))))"


_PROPS = "concat('{{\"u\": ', CAST(user_id AS {0}), ', \"p\": ', props, ', \"b\": [{{\"z\": null, \"a\": \"', event_type, '\"}}, true], \"A\": \"', CASE WHEN event_id % 3 = 0 THEN 'é' ELSE 'e' END, '\"}}')"


@query(f"""SELECT event_id, sha256('{{"A":"' || CASE WHEN event_id % 3 = 0 THEN chr(92) || 'u00e9' ELSE 'e' END || '","b":[{{"a":"' || event_type || '","z":null}},true],"p":' || replace(props, ' ', '') || ',"u":' || user_id || '}}') AS digest FROM events""")
def canonical_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id", f"{_PROPS.format('STRING')} AS doc").select("event_id", C.digest(F.col("doc")).alias("digest"))


_ENTRY = """'{"bytes":' || strlen(content) || ',"path":"' || path || '","sha256":"' || sha256(content) || '"}'"""


@query(f"""WITH {FILES_SQL}, e AS (SELECT path, {_ENTRY} AS payload FROM files), s AS (SELECT path, '{{"payload":' || payload || ',"signature":"' || {_hmac_sql("'" + DOMAIN.decode() + "' || chr(0) || payload")} || '"}}' AS document FROM e)
SELECT path, document, 'valid' AS verdict, 'forged' AS other FROM s""")
def signed_index(spark: SparkSession, d: str) -> DataFrame:
    """An index entry a file, signed, and what is said of it and of one with another size."""
    entry = F.struct("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    own = C.signed(files(spark, d), entry, KEY, DOMAIN, 1 << 20)
    other = F.regexp_replace("document", '"bytes":', '"bytes":1')
    return own.select("path", "document", C.verdict_of_signed(F.col("document"), KEY, DOMAIN).alias("verdict"), C.verdict_of_signed(other, KEY, DOMAIN).alias("other"))


_PRINT_SQL = """sha256('{"class":"' || tool || '","file":"' || file || '","line":' || line || ',"title":"' || title || '"}')"""
_RECEIPT = """'{"audit_id":"a' || repo_id || '","finding_fingerprint":"' || fp || '"}'"""


@query(f"""WITH {FINDINGS_SQL}, p AS (SELECT *, {_PRINT_SQL} AS fp FROM findings), r AS (SELECT *, {_RECEIPT} AS body FROM p), s AS (SELECT *, '{{"audit_id":"a' || repo_id || '","finding_fingerprint":"' || fp || '","signature":"' || {_hmac_sql("'" + DOMAIN.decode() + "' || chr(0) || body")} || '"}}' AS receipt FROM r)
SELECT id, fp AS fingerprint, CASE id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'malformed' WHEN 2 THEN 'not-canonical' WHEN 3 THEN 'hash' WHEN 4 THEN 'unbound' WHEN 5 THEN 'fingerprint' WHEN 6 THEN 'row-changed' WHEN 7 THEN 'audit' WHEN 8 THEN 'signature' ELSE 'valid' END AS verdict FROM s""")
def receipt_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of all findings, nine in ten of them tampered with in one way each."""
    own = findings(spark, d).withColumn("fp", C.finding_fingerprint(F.col("title"), F.col("file"), F.col("line"), F.col("tool")))
    audit = F.concat(F.lit("a"), "repo_id")
    body = C.canonical(F.to_json(F.struct(audit.alias("audit_id"), F.col("fp").alias("finding_fingerprint"))))
    n = F.col("id") % 10
    mark = F.when(n == 8, F.lit("0" * 64)).otherwise(C.signature(KEY, DOMAIN, F.col("body")))
    # each step is written: a plan of all would compute the inner forms again for each use
    marked = saved(saved(own.withColumn("body", body)).withColumn("mark", mark))
    made = saved(marked.withColumn("receipt", C.canonical(F.to_json(F.struct(audit.alias("audit_id"), F.col("fp").alias("finding_fingerprint"), F.col("mark").alias("signature"))))))
    stored = made.withColumn("receipt", F.when(n == 0, "").when(n == 1, F.concat("receipt", F.lit("x"))).when(n == 2, F.concat(F.lit(" "), "receipt")).otherwise(F.col("receipt")))
    hash_ = F.when(n == 3, F.lit("0" * 64)).otherwise(F.sha2("receipt", 256))
    bound = F.when(n == 4, "").when(n == 5, F.sha2("fp", 256)).otherwise(F.col("fp"))
    title = F.when(n == 6, F.concat("title", F.lit("!"))).otherwise(F.col("title"))
    row = C.finding_fingerprint(title, F.col("file"), F.col("line"), F.col("tool"))
    field = lambda r, name: F.get_json_object(r, f"$.{name}")
    holds = lambda r: C.signature(KEY, DOMAIN, F.to_json(F.struct(field(r, "audit_id").alias("audit_id"), field(r, "finding_fingerprint").alias("finding_fingerprint")))) == field(r, "signature")
    verdict = C.receipt_verdict(F.col("receipt"), hash_, bound, row, F.when(n == 7, "other").otherwise(audit), holds)
    return stored.select("id", F.col("fp").alias("fingerprint"), verdict.alias("verdict"))


_SKILL = "SELECT doc_id, source, coalesce(length(text), 0) AS chars, (doc_id * 37 % 101) / 4.0 AS score, doc_id % 97 = 0 AS pinned FROM documents"


@query(f"""WITH k AS ({_SKILL}), r AS (SELECT *, row_number() OVER w AS place, sum(chars) OVER (w ROWS UNBOUNDED PRECEDING) AS spent FROM k WINDOW w AS (PARTITION BY source ORDER BY pinned DESC, CASE WHEN NOT pinned THEN score END DESC, doc_id))
SELECT source, doc_id, place::BIGINT AS place, spent::BIGINT AS spent, (CASE WHEN pinned THEN chars ELSE least(chars, 12000 - spent + chars) END)::BIGINT AS given FROM r WHERE pinned OR spent - chars < 12000""")
def context_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each source by score until 12,000 characters are spent, the last one cut; pinned ones first."""
    skills = table(spark, d, "documents").selectExpr("doc_id", "source", "coalesce(length(text), 0) AS chars", "CAST(doc_id * 37 % 101 AS DOUBLE) / 4 AS score", "doc_id % 97 = 0 AS pinned").withColumn("by", F.when(~F.col("pinned"), F.col("score")))
    got = S.within_budget(skills, ["source"], [("by", True), ("doc_id", False)], F.col("chars"), 12_000, mandatory=F.col("pinned"), bucket=-F.floor(F.col("score") * 4), whole=False)
    return got.select("source", "doc_id", "place", "spent", "given")


@query(f"""WITH k AS ({_SKILL}) SELECT doc_id, row_number() OVER (ORDER BY pinned DESC, CASE WHEN NOT pinned THEN score END DESC, doc_id)::BIGINT AS place FROM k QUALIFY place <= 50""")
def selected_skills(spark: SparkSession, d: str) -> DataFrame:
    """The fifty first of all texts by score, pinned ones before."""
    skills = table(spark, d, "documents").selectExpr("doc_id", "CAST(doc_id * 37 % 101 AS DOUBLE) / 4 AS score", "doc_id % 97 = 0 AS pinned", "1 AS one").withColumn("by", F.when(~F.col("pinned"), F.col("score")))
    return S.first_in_order(skills, ["one"], [("by", True), ("doc_id", False)], 50, mandatory=F.col("pinned"), bucket=-F.floor(F.col("score") * 4)).select("doc_id", "place")
