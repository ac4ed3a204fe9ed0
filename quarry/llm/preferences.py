"""Preference formatting: one prompt and two masked completions a pair.

Turns come as rows, ``(pair, turn, role, text, in_chosen, in_rejected)``: a
turn that both conversations have is stored once. Conversations are aligned by
turn number. Their longest common prefix ends before the first number at which
the turns of the two differ, and is rendered once. What follows is rendered for
each side, and a flag says what a model is trained on: the assistant's words.

No conversation is gathered: hashes of turns are summed with opposite signs by
(pair, turn), the smallest number with a sum other than zero is found for each
pair, and joined back. Only ``assembled()`` builds whole examples, one a row:
the prompt once, and the two completions with the spans that are trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.arrays import running

BEGIN, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _plain(c: Column) -> Column:
    """Text that can't spell a marker."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def header(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), _plain(role), F.lit("\n"))


def body(text: Column) -> Column:
    return F.concat(_plain(text), F.lit(f"{END}\n"))


def first_difference(turns: DataFrame) -> DataFrame:
    """``(pair, first)``: the first turn number at which the sides of a pair
    don't have the same turns; pairs that are equal throughout have no row.

    A number that occurs twice counts as a set of turns with repeats. A null
    number comes before all others.
    """
    sign = F.col("in_chosen").cast("int") - F.col("in_rejected").cast("int")
    h = lambda *seed: (F.xxhash64(*seed, "role", F.isnull("role"), "text", F.isnull("text")).cast("decimal(20,0)") * sign)
    sums = turns.where(sign != 0).groupBy("pair", "turn").agg(F.sum(h()).alias("x"), F.sum(h(F.lit(1))).alias("y"))
    differ = sums.where("x <> 0 or y <> 0")
    return differ.groupBy("pair").agg(F.min("turn").alias("first"), F.max(F.isnull("turn")).alias("at_null"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """``turns(pair, turn, role, text, in_chosen, in_rejected)`` -> rendered
    turns ``(pair, part, turn, role, header, body, trained)``.

    part is prompt, chosen or rejected; header + body is the rendered turn.
    trained is true for the body of an assistant's turn in a completion; headers
    and the prompt are masked. Pairs that are equal throughout are all prompt.
    A null role or text is rendered as an empty one; markers within texts are
    broken by a space. Rows of the same pair and turn are all kept, as are
    those of a null pair. Rows on neither side are on no side's rendering.
    """
    first = first_difference(turns)
    mine = turns.join(first.withColumnRenamed("pair", "pair_"), F.col("pair").eqNullSafe(F.col("pair_")), "left")
    after = F.when(F.col("at_null"), True).when(F.col("turn").isNull(), False).otherwise(F.coalesce(F.col("turn") >= F.col("first"), F.lit(False)))
    parts = F.when(after, F.array_compact(F.array(F.when(F.col("in_chosen"), "chosen"), F.when(F.col("in_rejected"), "rejected")))).when(
        F.col("in_chosen"), F.array(F.lit("prompt"))
    )
    rows = mine.select("pair", "turn", "role", "text", F.explode(parts).alias("part"))
    return rows.select(
        "pair", "part", "turn", "role", header(F.col("role")).alias("header"), body(F.col("text")).alias("body"),
        ((F.col("part") != "prompt") & F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))).alias("trained"),
    )


def assembled(rendered: DataFrame) -> DataFrame:
    """``format_pairs()`` -> one row a pair: prompt, chosen, rejected, and for
    each completion the trained spans as ``start:end`` in code points, end
    exclusive, comma-joined. Rows of one turn number are in the order of their
    roles and texts. An example is one row and as long as its conversation;
    whoever has conversations beyond a row's size keeps to ``format_pairs()``."""
    of = lambda part: F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "role", "body", "header", "trained"))))
    text = lambda c: F.array_join(F.transform(c, lambda t: F.concat(t["header"], t["body"])), "")

    def spans(c: str) -> Column:
        ends = running(F.transform(c, lambda t: F.length(t["header"]) + F.length(t["body"])), lambda a, x: a + x, F.lit(0))
        marked = F.zip_with(c, ends, lambda t, e: F.when(t["trained"], F.concat_ws(":", e - F.length(t["body"]), e)))
        return F.array_join(F.array_compact(marked), ",")

    whole = rendered.groupBy("pair").agg(*(of(p).alias(f"{p}_turns") for p in ("prompt", "chosen", "rejected")))
    return whole.select("pair", *(text(f"{p}_turns").alias(p) for p in ("prompt", "chosen", "rejected")), *(spans(f"{p}_turns").alias(f"{p}_spans") for p in ("chosen", "rejected")))


def examples(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``stale_reply_pairs()`` formatted and assembled: ``(conv_col, prompt,
    chosen, rejected, chosen_spans, rejected_spans)``.

    Turns without a conversation can't be told to belong together: each is a
    prompt of its own, with empty completions. Repeated turns are all kept. An
    empty table gives no rows.
    """
    known = conversations.where(F.col(conv_col).isNotNull())
    pairs = assembled(format_pairs(stale_reply_pairs(known, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)))
    no = [F.lit("").alias(c) for c in pairs.columns[2:]]
    lone = conversations.where(F.col(conv_col).isNull()).select(F.col(conv_col), F.concat(header(F.col(role_col)), body(F.col(text_col))).alias("prompt"), *no)
    return pairs.withColumnRenamed("pair", conv_col).unionByName(lone)


def stale_reply_pairs(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Preference pairs from plain conversations, for ``format_pairs()``.

    Chosen is the conversation. Rejected answers its last assistant turn
    with a stale reply: the first assistant turn's text or, if that is the
    last one too, the text of the opening turn. A conversation without an assistant turn
    has nothing to prefer and is the same on both sides.
    """
    rows = conversations.select(F.col(conv_col).alias("pair"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    said = F.when(F.col("role") == TRAINED_ROLE, F.col("turn"))
    ends = rows.groupBy("pair").agg(F.min("turn").alias("opening"), F.min(said).alias("first"), F.max(said).alias("last"))
    ends = ends.select(F.col("pair").alias("pair_"), "opening", "last", F.when(F.col("first") < F.col("last"), F.col("first")).otherwise(F.col("opening")).alias("stale"))
    known = rows.join(ends, F.col("pair").eqNullSafe(F.col("pair_")), "left")
    replaced = F.coalesce((F.col("turn") == F.col("last")) & (F.col("role") == TRAINED_ROLE), F.lit(False))
    # the reply that is repeated: of its turn number, only assistant's rows if there are two replies
    repeated = F.coalesce((F.col("turn") == F.col("stale")) & ((F.col("stale") == F.col("opening")) | (F.col("role") == TRAINED_ROLE)), F.lit(False)) & F.col("last").isNotNull()
    own = F.struct("turn", "role", F.lit(True).alias("in_chosen"), (~replaced).alias("in_rejected"))
    again = F.struct(F.col("last").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), F.lit(False).alias("in_chosen"), F.lit(True).alias("in_rejected"))
    sides = known.select("pair", "text", F.explode(F.array_compact(F.array(own, F.when(repeated, again)))).alias("s"))
    return sides.select("pair", "s.turn", "s.role", "text", "s.in_chosen", "s.in_rejected")


def oracle_sql() -> str:
    """The rows of ``examples()`` on conversations, in DuckDB's SQL."""
    plain = lambda c: f"replace(coalesce({c}, ''), '<|', '< |')"
    order = "turn NULLS FIRST, role NULLS FIRST, body, header"
    text = lambda part: f"coalesce(string_agg(header || body, '' ORDER BY {order}) FILTER (part = '{part}'), '') AS {part}"
    spans = lambda part: f"coalesce(string_agg((ends - length(body)) || ':' || ends, ',' ORDER BY ends) FILTER (part = '{part}' AND trained), '') AS {part}_spans"
    rendered = f"'{BEGIN}' || {plain('role')} || chr(10) AS header, {plain('text')} || '{END}' || chr(10) AS body"
    return f"""
WITH ends AS (
  SELECT conv_id, min(turn) AS opening, min(turn) FILTER (role = 'assistant') AS first_said, max(turn) FILTER (role = 'assistant') AS last_said
  FROM conversations GROUP BY conv_id),
known AS (SELECT c.conv_id, c.turn, c.role, c.text, e.last_said, e.opening, CASE WHEN first_said < last_said THEN first_said ELSE opening END AS stale
          FROM conversations c JOIN ends e ON c.conv_id = e.conv_id),
chosen AS (SELECT conv_id, turn, role, text FROM known),
rejected AS (
  SELECT conv_id, turn, role, text FROM known WHERE NOT coalesce(turn = last_said AND role = 'assistant', false)
  UNION ALL SELECT conv_id, last_said, 'assistant', text FROM known WHERE last_said IS NOT NULL AND turn = stale AND (stale = opening OR role = 'assistant')),
differ AS (
  SELECT conv_id, turn FROM (SELECT conv_id, turn, role, text FROM chosen EXCEPT ALL SELECT conv_id, turn, role, text FROM rejected)
  UNION ALL SELECT conv_id, turn FROM (SELECT conv_id, turn, role, text FROM rejected EXCEPT ALL SELECT conv_id, turn, role, text FROM chosen)),
lcp AS (SELECT conv_id, min(turn) AS first_turn FROM differ GROUP BY conv_id),
parts AS (
  SELECT CASE WHEN turn >= first_turn THEN 'chosen' ELSE 'prompt' END AS part, c.* FROM chosen c LEFT JOIN lcp USING (conv_id)
  UNION ALL SELECT 'rejected', r.* FROM rejected r JOIN lcp USING (conv_id) WHERE turn >= first_turn),
turns AS (SELECT conv_id, part, turn, role, part <> 'prompt' AND coalesce(role = 'assistant', false) AS trained, {rendered} FROM parts),
placed AS (SELECT *, sum(length(header) + length(body)) OVER (PARTITION BY conv_id, part ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS ends FROM turns)
SELECT conv_id, {text('prompt')}, {text('chosen')}, {text('rejected')}, {spans('chosen')}, {spans('rejected')} FROM placed GROUP BY conv_id
UNION ALL SELECT conv_id, header || body, '', '', '', '' FROM (SELECT conv_id, {rendered} FROM conversations WHERE conv_id IS NULL)"""
