"""Preference formatting of chat conversations, in DataFrame operations only.

`preferences` takes the turns of pairs of conversations: pair_id, side ('chosen' or
'rejected'), turn, role, text. The turns of both sides are joined on their place; the
longest common prefix ends before the first place where role or text differs or one side
has no turn. That prefix is rendered once, as prompt; what follows on either side is its
completion. A completion's mask lists the [start, end) code points in it that a loss
counts: the assistant's texts with their closing mark, not the other roles' turns.

Turns are grouped by pair, so a task holds one conversation at a time, never a group of copies.

Defined results: turns are ordered by turn, then role and text, and take places 0, 1, …,
so gaps and repeated turn numbers do no harm; a null text is rendered empty, a null role
as 'unknown', and null equals null; equal sides give empty completions and `tie` true;
a side without turns gives an empty prompt; no pairs give no rows; repeated rows are turns of their own; texts of any length are
rendered whole; marks within a text or role are parted by a space, so that none forges a turn; other columns are left out, whatever
their names. `swapped_answers` drops turns without a conv_id, as they belong to no pair; of several last answers on one
turn the greatest text counts, and all equal to it are swapped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What the marks begin with, and what texts hold instead.
MARK, PARTED = "<|im_", "< |im_"


def preferences(turns: DataFrame) -> DataFrame:
    """pair_id, prompt, n_prompt_turns, chosen, chosen_mask, rejected, rejected_mask, tie."""
    place = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    lined = turns.select(
        "pair_id", "side", (F.row_number().over(place) - 1).alias("place"),
        F.replace(F.coalesce("role", F.lit("unknown")), F.lit(MARK), F.lit(PARTED)).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(PARTED)).alias("text"),
    )
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"))
    shown = lined.select("*", F.concat(head, F.col("text"), F.lit(CLOSE)).alias("shown"), F.length(head).alias("head"))
    upto = F.sum(F.length("shown")).over(Window.partitionBy("pair_id", "side").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    lined = shown.withColumn("upto", upto)
    turn = F.struct("place", "shown", "head", "upto", (F.col("role") == "assistant").alias("counts"))
    wide = lined.groupBy("pair_id", "place").agg(
        F.max(F.when(F.col("side") == "chosen", turn)).alias("chosen"),
        F.max(F.when(F.col("side") == "rejected", turn)).alias("rejected"),
    )
    same = F.col("chosen.shown").eqNullSafe(F.col("rejected.shown"))
    pairs = wide.groupBy("pair_id").agg(
        F.min(F.when(~same, F.col("place"))).alias("split"),
        F.sort_array(F.collect_list("chosen")).alias("chosen"),
        F.sort_array(F.collect_list("rejected")).alias("rejected"),
    )

    def after(side: str):
        return F.filter(side, lambda t: F.col("split").isNotNull() & (t["place"] >= F.col("split")))

    def mask(side: str):
        """Places in the completion: code points up to a turn, less those of the prompt, which are the same on both sides."""
        base = F.coalesce(F.element_at(F.transform("shared", lambda t: t["upto"]), -1), F.lit(0))
        spans = F.transform(F.filter(after(side), lambda t: t["counts"]), lambda t: F.struct((t["upto"] - F.length(t["shown"]) + t["head"] - base).alias("start"), (t["upto"] - base).alias("end")))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")

    shared = F.filter("chosen", lambda t: F.col("split").isNull() | (t["place"] < F.col("split")))
    return pairs.withColumn("shared", shared).select(
        "pair_id",
        F.array_join(F.transform("shared", lambda t: t["shown"]), "").alias("prompt"),
        F.size("shared").cast("long").alias("n_prompt_turns"),
        F.array_join(F.transform(after("chosen"), lambda t: t["shown"]), "").alias("chosen"),
        mask("chosen").alias("chosen_mask"),
        F.array_join(F.transform(after("rejected"), lambda t: t["shown"]), "").alias("rejected"),
        mask("rejected").alias("rejected_mask"),
        F.col("split").isNull().alias("tie"),
    )


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs, one pair a conversation.

    Chosen is the conversation itself; rejected is the same with its last assistant turn
    answered by the last assistant turn of its neighbour, the conversation whose id
    differs in the lowest bit (itself, if there is none: a tie).
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    last = turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    answer = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"), F.lit(True).alias("has"))
    known = turns.join(last.select("conv_id", "last"), "conv_id", "left").join(answer, "conv_id", "left")
    is_last = F.coalesce((F.col("role") == "assistant") & F.struct("turn", "text").eqNullSafe(F.col("last")) & F.col("has"), F.lit(False))
    sides = F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
        F.struct(F.lit("rejected").alias("side"), F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text")),
    ))
    return known.select(F.col("conv_id").alias("pair_id"), "turn", "role", sides.alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")


def op10_preference_pairs(spark, sf_dir: str) -> DataFrame:
    return preferences(swapped_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = r"""
WITH a AS (SELECT conv_id, arg_max(text, (turn, text)) AS last, max(turn) AS at FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, replace(text, '<|im_', '< |im_') AS text FROM conversations
  UNION ALL
  SELECT c.conv_id, 'rejected', c.turn, c.role, replace(CASE WHEN c.role = 'assistant' AND c.turn = a.at AND b.conv_id IS NOT NULL THEN b.last ELSE c.text END, '<|im_', '< |im_')
  FROM conversations c LEFT JOIN a ON a.conv_id = c.conv_id LEFT JOIN a b ON b.conv_id = xor(c.conv_id, 1)),
p AS (SELECT pair_id, side, role, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) - 1 AS place,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown, len('<|im_start|>' || role || chr(10)) AS head FROM sides),
j AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.place, r.place) AS place, c.shown IS NOT DISTINCT FROM r.shown AS same
  FROM (SELECT * FROM p WHERE side = 'chosen') c FULL JOIN (SELECT * FROM p WHERE side = 'rejected') r ON c.pair_id = r.pair_id AND c.place = r.place),
s AS (SELECT pair_id, min(CASE WHEN NOT same THEN place END) AS split FROM j GROUP BY pair_id),
k AS (SELECT p.*, split, sum(len(shown)) FILTER (split IS NOT NULL AND place >= split) OVER (PARTITION BY pair_id, side ORDER BY place) AS upto FROM p JOIN s USING (pair_id)),
m AS (SELECT pair_id, side, any_value(split) AS split,
  string_agg(shown, '' ORDER BY place) FILTER (split IS NULL OR place < split) AS before, count(*) FILTER (split IS NULL OR place < split) AS n,
  string_agg(shown, '' ORDER BY place) FILTER (place >= split) AS rest,
  string_agg((upto - len(shown) + head)::BIGINT::VARCHAR || '-' || upto::BIGINT::VARCHAR, ',' ORDER BY place) FILTER (place >= split AND role = 'assistant') AS mask
  FROM k GROUP BY pair_id, side)
SELECT c.pair_id, coalesce(c.before, '') AS prompt, c.n AS n_prompt_turns, coalesce(c.rest, '') AS chosen, coalesce(c.mask, '') AS chosen_mask,
  coalesce(r.rest, '') AS rejected, coalesce(r.mask, '') AS rejected_mask, c.split IS NULL AS tie
FROM (SELECT * FROM m WHERE side = 'chosen') c JOIN (SELECT * FROM m WHERE side = 'rejected') r USING (pair_id)
"""
