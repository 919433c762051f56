"""Preference formatting of conversations; DataFrame functions only.

A pair has a chosen and a rejected conversation.  Their longest common prefix of turns (role and text equal) is rendered
once as prompt; the rest of each is its completion, with the spans that a loss may count: the text and end mark of
assistant turns.  Spans count code points of the completion, ends exclusive.

A pair is one row, since its texts are; its size is that of its conversations.  One shuffle brings the turns of a pair together; everything else happens within its row.  Defined results: a null role
or text is an empty one; turns are ordered by turn, role and text, so ties are stable and repeated rows are repeated
turns; rows without a conversation belong to none and are left out; a missing side is a conversation without turns;
marks of the format inside a role or text lose their bars where they are written, and can't open a turn (turns are
compared before that); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _rendered(turns: str) -> str:
    """SQL: the turns as one text."""
    return f"array_join(transform({turns}, t -> t.shown), '')"


def _spans(turns: str) -> str:
    """SQL: the trained spans of the rendered turns."""
    head = f"{len(START) + 1} + length(t.written)"
    return f"""aggregate({turns}, named_struct('at', 0, 'spans', cast(array() AS array<struct<start: int, end: int>>)),
        (a, t) -> named_struct('at', a.at + length(t.shown),
            'spans', if(t.role = '{TRAINED}', concat(a.spans, array(named_struct('start', a.at + {head}, 'end', a.at + length(t.shown) - 1))), a.spans)),
        a -> a.spans)"""


def _turn(turn_col: str, role_col: str, text_col: str) -> Column:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.struct(F.col(turn_col).alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"))


def formatted(pairs: DataFrame) -> DataFrame:
    """A row per pair: pair_id, n_prefix_turns, prompt, chosen, rejected, and their spans as arrays of (start, end).

    ``pairs`` has pair_id and the turns of both sides, ``a`` and ``b``, as arrays of (turn, role, text).  Turns are
    compared as they are, and written without the format's marks inside them."""
    safe = lambda c: f"replace(replace({c}, '{START}', '<im_start>'), '{END}', '<im_end>')"
    differs = "array_position(zip_with(a, b, (x, y) -> coalesce(x.role = y.role AND x.text = y.text, false)), false)"
    shown = f"x -> named_struct('role', x.role, 'written', {safe('x.role')}, 'shown', concat('{START}', {safe('x.role')}, '\\n', {safe('x.text')}, '{END}\\n'))"
    both = pairs.withColumn("n", F.expr(f"cast(if({differs} = 0, greatest(size(a), size(b)), {differs} - 1) AS int)"))
    both = both.select("pair_id", "n", F.expr(f"transform(a, {shown})").alias("a"), F.expr(f"transform(b, {shown})").alias("b"))
    both = both.select("pair_id", F.col("n").cast("long").alias("n_prefix_turns"), F.expr("slice(a, 1, n)").alias("p"), F.expr("slice(a, n + 1, size(a))").alias("a"), F.expr("slice(b, n + 1, size(b))").alias("b"))
    return both.select(
        "pair_id", "n_prefix_turns", F.expr(_rendered("p")).alias("prompt"), F.expr(_rendered("a")).alias("chosen"), F.expr(_rendered("b")).alias("rejected"), F.expr(_spans("a")).alias("chosen_spans"), F.expr(_spans("b")).alias("rejected_spans")
    )


def _sides(turns: DataFrame, pair: Column, chosen: Column, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.where(F.col(conv_col).isNotNull()).select(pair.alias("pair_id"), chosen.alias("__c"), _turn(turn_col, role_col, text_col).alias("t"))
    side = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("t"))))
    return rows.groupBy("pair_id").agg(side(F.col("__c")).alias("a"), side(~F.col("__c")).alias("b"))


def format_pairs(turns: DataFrame, pair: Column, chosen: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``formatted`` for a table of turns: ``pair`` is the pair of a turn's conversation, ``chosen`` whether that is the
    chosen one."""
    return formatted(_sides(turns, pair, chosen, conv_col, turn_col, role_col, text_col))


def answered_otherwise(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation that has turns, with its number: chosen is the conversation; rejected are the same
    turns, but the last answer's text is that of the neighbour's (conversations 2k and 2k+1; empty if it has none).
    A conversation without an answer is rejected as it is.  Spans are text ``start:end,...``."""
    both = _sides(conversations, F.floor(F.col("conv_id") / 2).cast("long"), F.pmod("conv_id", F.lit(2)) == 0, "conv_id", "turn", "role", "text")
    answers = lambda c: f"filter({c}, t -> t.role = '{TRAINED}')"
    last = lambda c: f"coalesce(try_element_at({answers(c)}, -1).text, '')"
    at = lambda c: f"array_max(transform({c}, (t, i) -> if(t.role = '{TRAINED}', i, -1)))"
    swapped = lambda c, o: f"zip_with({c}, transform({c}, (t, i) -> i = {o}_at), (t, hit) -> if(hit, named_struct('turn', t.turn, 'role', t.role, 'text', {o}_text), t))"
    both = both.withColumns({"x_at": F.expr(at("a")), "y_at": F.expr(at("b")), "x_text": F.expr(last("b")), "y_text": F.expr(last("a"))})
    pair = lambda n, c, o: f"named_struct('pair_id', 2 * pair_id + {n}, 'a', {c}, 'b', {swapped(c, o)})"
    pairs = both.select(F.inline(F.expr(f"filter(array({pair(0, 'a', 'x')}, {pair(1, 'b', 'y')}), p -> size(p.a) > 0)")))
    rows = formatted(pairs)
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.withColumns({c: written(c) for c in ("chosen_spans", "rejected_spans")})
