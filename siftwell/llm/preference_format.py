"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The turns of each pair are gathered once, in one shuffle, to its training example (``format_preferences``): the longest common turn
prefix is rendered as the prompt, and what follows on either side as its completion, with the spans that a loss should see.
``preference_turns`` gives the same as a row for each rendered turn, without gathering a conversation anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>"


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the public ChatML form; its markers within a text are broken by a blank, so that no text can forge a turn."""
    safe = F.replace(text, F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(TURN_OPEN), role, F.lit("\n"), safe, F.lit(TURN_CLOSE + "\n"))


def preference_turns(turns: DataFrame) -> DataFrame:
    """Rows (pair_id, segment, turn, role, rendered, trained, paired) from turns (pair_id, chosen, turn, role, text).

    segment is 'prompt' for the turns before the first that differs (rendered once for both sides), else 'chosen' or
    'rejected'. trained is true on assistant turns of the completions, the only ones a loss should see. Of rows that repeat a
    (pair, side, turn), the least (role, text) counts. Null roles and texts count as empty. Rows whose pair, side or turn is
    null have no place in a conversation and give none. Where one side is missing, paired is false and all is completion; where
    both are equal, all is prompt. An empty table gives no rows; other columns are ignored.
    """
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = turns.where("pair_id IS NOT NULL AND chosen IS NOT NULL AND turn IS NOT NULL")
    by_turn = placed.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("chosen"), said)).alias("c"), F.min(F.when(~F.col("chosen"), said)).alias("r"))
    differs = F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))
    pairs = by_turn.groupBy("pair_id").agg(
        F.min(differs).alias("first_diff"), (F.max(F.col("c").isNotNull()) & F.max(F.col("r").isNotNull())).alias("paired")
    )
    sides = F.array(F.struct(F.lit("chosen").alias("segment"), F.col("c").alias("said")), F.struct(F.lit("rejected").alias("segment"), F.col("r").alias("said")))
    prompt = F.array(F.struct(F.lit("prompt").alias("segment"), F.col("c").alias("said")))
    in_prompt = F.col("first_diff").isNull() | (F.col("turn") < F.col("first_diff"))
    rows = (
        by_turn.join(pairs, "pair_id")
        .select("pair_id", "turn", "paired", F.explode(F.when(in_prompt, prompt).otherwise(sides)).alias("s"))
        .where("s.said IS NOT NULL")
    )
    return rows.select(
        "pair_id",
        "s.segment",
        "turn",
        "s.said.role",
        render_turn(F.col("s.said.role"), F.col("s.said.text")).alias("rendered"),
        ((F.col("s.segment") != "prompt") & (F.col("s.said.role") == "assistant")).alias("trained"),
        "paired",
    )


def _in_turn(said: str) -> Column:
    """Sorted turns (turn, role, text) without those that repeat a turn's number: the least (role, text) of each."""
    return F.filter(said, lambda x, i: (i == 0) | (x["turn"] != F.get(said, F.greatest(i - 1, F.lit(0)))["turn"]))


def _said() -> Column:
    return F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def render_pairs(pairs: DataFrame) -> DataFrame:
    """The result of format_preferences from pairs (pair_id, c, r) of sorted turns (turn, role, text)."""
    same = F.least(F.size("c"), F.size("r"))
    apart = F.filter(F.sequence(F.lit(0), same), lambda i: (i == same) | ~F.get("c", i).eqNullSafe(F.get("r", i)))
    cut = pairs.withColumn("n", F.array_min(apart)).select(
        "pair_id",
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("paired"),
        F.slice("c", 1, F.col("n")).alias("prompt"),
        F.slice("c", F.col("n") + 1, F.size("c")).alias("chosen"),
        F.slice("r", F.col("n") + 1, F.size("r")).alias("rejected"),
    )

    def rendered(name: str) -> Column:
        head = F.length(F.lit(TURN_OPEN)) + 1
        return F.transform(name, lambda t: F.struct(render_turn(t["role"], t["text"]).alias("said"), F.when(t["role"] == "assistant", head + F.length(t["role"])).alias("head")))

    def mask(name: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

        def add(a: Column, t: Column) -> Column:
            end = a["at"] + F.length(t["said"])
            span = F.concat(F.when(a["spans"] == "", "").otherwise(F.lit(",")), (a["at"] + t["head"]).cast("string"), F.lit(":"), (end - 1).cast("string"))
            return F.struct(end.alias("at"), F.concat(a["spans"], F.coalesce(span, F.lit(""))).alias("spans"))

        return F.aggregate(name, start, add, lambda a: a["spans"]).alias(f"{name}_mask")

    names = ("prompt", "chosen", "rejected")
    told = cut.select("pair_id", "paired", *[rendered(name).alias(name) for name in names])
    whole = [F.array_join(F.transform(name, lambda t: t["said"]), "").alias(name) for name in names]
    return told.select("pair_id", "paired", *whole, mask("chosen"), mask("rejected"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, paired, prompt, chosen, rejected, chosen_mask, rejected_mask), one row for each pair of turns (pair_id, chosen, turn,
    role, text).

    A mask lists what a loss should see of its completion, the assistant's words and their end marks, as start:end in code points,
    comma-joined; a side without any, or without turns, has an empty one. Nulls, repeats and missing sides are treated as in
    preference_turns; an empty table gives no rows. A conversation is one row, as it is for whoever trains on it.
    """
    placed = turns.where("pair_id IS NOT NULL AND chosen IS NOT NULL AND turn IS NOT NULL")
    sides = [F.sort_array(F.collect_list(F.when(side, _said()))).alias(name) for name, side in (("c", F.col("chosen")), ("r", ~F.col("chosen")))]
    return render_pairs(placed.groupBy("pair_id").agg(*sides).select("pair_id", _in_turn("c").alias("c"), _in_turn("r").alias("r")))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs (pair_id, c, r) for want of stated preferences: the chosen side of pair k is conversation k, the rejected one the same
    with its last assistant turn taken from conversation k xor 1.

    Of rows that repeat a (conversation, turn) the least (role, text) counts. Where either has no assistant turn, pair k has a chosen
    side alone. Rows without a conversation or turn give none.
    """
    placed = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    whole = placed.groupBy(F.col("conv_id").cast("long").alias("pair_id")).agg(F.sort_array(F.collect_list(_said())).alias("said")).select("pair_id", _in_turn("said").alias("c"))
    last = F.array_max(F.transform("c", lambda x, i: F.when(x["role"] == "assistant", i)))
    whole = whole.withColumn("last", last)
    donors = whole.where("last IS NOT NULL").select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.get("c", F.col("last"))["text"].alias("donated"))
    swapped = F.transform("c", lambda x, i: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), F.when(i == F.col("last"), F.col("donated")).otherwise(x["text"]).alias("text")))
    able = F.col("last").isNotNull() & F.col("donated").isNotNull()
    return whole.join(donors, "pair_id", "left").select("pair_id", "c", F.when(able, swapped).otherwise(F.slice("c", 1, 0)).alias("r"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id AS pair_id, turn, min(row(coalesce(role, ''), coalesce(text, ''))) AS c
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
last AS (SELECT pair_id, max(turn) AS turn, max_by(c[2], turn) AS answer FROM t WHERE c[1] = 'assistant' GROUP BY pair_id),
swap AS (SELECT a.pair_id, a.turn, b.answer FROM last a JOIN last b ON xor(a.pair_id, 1) = b.pair_id),
d AS (
  SELECT t.pair_id, t.turn, c, CASE WHEN swap.pair_id IS NULL THEN NULL WHEN t.turn = swap.turn THEN row(c[1], answer) ELSE c END AS r
  FROM t LEFT JOIN swap USING (pair_id)),
p AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS first_diff, bool_or(r IS NOT NULL) AS paired FROM d GROUP BY pair_id),
s AS (
  SELECT pair_id, turn, 'prompt' AS segment, c AS said FROM d JOIN p USING (pair_id) WHERE first_diff IS NULL OR turn < first_diff
  UNION ALL SELECT pair_id, turn, 'chosen', c FROM d JOIN p USING (pair_id) WHERE turn >= first_diff
  UNION ALL SELECT pair_id, turn, 'rejected', r FROM d JOIN p USING (pair_id) WHERE turn >= first_diff AND r IS NOT NULL),
o AS (SELECT *, '<|im_start|>' || said[1] || chr(10) || replace(said[2], '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS x FROM s),
e AS (SELECT *, CAST(sum(length(x)) OVER (PARTITION BY pair_id, segment ORDER BY turn) AS BIGINT) AS ends FROM o)
SELECT pair_id, any_value(paired) AS paired,
  coalesce(string_agg(x, '' ORDER BY turn) FILTER (segment = 'prompt'), '') AS prompt,
  coalesce(string_agg(x, '' ORDER BY turn) FILTER (segment = 'chosen'), '') AS chosen,
  coalesce(string_agg(x, '' ORDER BY turn) FILTER (segment = 'rejected'), '') AS rejected,
  coalesce(string_agg((ends - length(x) + 13 + length(said[1])) || ':' || (ends - 1), ',' ORDER BY turn) FILTER (segment = 'chosen' AND said[1] = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((ends - length(x) + 13 + length(said[1])) || ':' || (ends - 1), ',' ORDER BY turn) FILTER (segment = 'rejected' AND said[1] = 'assistant'), '') AS rejected_mask
FROM e JOIN p USING (pair_id) GROUP BY pair_id
"""
