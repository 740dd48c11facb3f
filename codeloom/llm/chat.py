"""Chat formatting: from reply trees to conversations of one text each, with a loss mask.

The template writes an assistant's turn as ``<s>TEXT</s>`` and any other as ``<s>[INST]ROLE\\nTEXT[/INST]``. Control strings
inside texts and roles get a backslash behind their bracket (``<\\/s>``), and those that look so already one more, so that the
template's own control strings are the only ones left and the reading back is exact. The loss mask is a list of
(first, length) in code points that covers each assistant's text, and nothing else.

Nulls: a null text or role is empty, a null score counts 0. A message whose parent is null or not in the table is a root.
Messages on a cycle of parents are under no root and in no conversation. Ties of score go to the smaller leaf id. Message
ids must be unique and not null (``linear`` makes such ids, also for repeated rows). An empty table gives no rows. Extra
columns are ignored. One conversation is one string, as the feature asks for.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialize, written


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\[\\(\\*)(/?INST\])", "[$1$2")
    return F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2")


def escape_role(role: Column) -> Column:
    """Roles end at a line break, so they may hold none: ``\\`` becomes ``\\s`` and a line break ``\\n``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def ancestors(tree: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Self-joins that double the distance each time. tree: id, parent, score.

    Returns (id, root, total, parent) for every message under a root, total being the scores from it up to its root, and the
    jumps: (id, up) with the ancestor 1, 2, 4, ... steps above.
    """
    here = tree.select("id")
    linked = tree.join(here.withColumnRenamed("id", "parent").withColumn("found", F.lit(True)), "parent", "left").select(
        "id", F.when(F.col("found"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.col("id").alias("far"))
    # far: the highest ancestor counted into total; up: the one above it
    count_open = {"open": F.sum(F.col("up").isNotNull().cast("long"))}
    state, seen = materialize(linked, **count_open)
    parents = state.select("id", F.col("up").alias("parent"))
    done, jumps, steps = [], [], math.ceil(math.log2(max(seen["rows"], 2))) + 1
    while seen.get("open") and len(jumps) < steps:
        # only messages that have not reached their root go on; what they meet may have
        going = state.where("up is not null")
        done.append(state.where("up is null"))
        jumps.append(going.select("id", "up"))
        above = reduce(DataFrame.unionByName, [going, *done]).select(
            F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("far").alias("further"))
        state, seen = materialize(going.join(above, "up").select(
            "id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), F.col("further").alias("far")),
            **count_open)
    reached = reduce(DataFrame.unionByName, [*done, state.where("up is null")])
    return reached.select("id", F.col("far").alias("root"), "total").join(parents, "id"), jumps


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of every tree, by the sum of scores: root, branch (rank from 1), leaf, and the
    turns in order as an array of (role, text).

    messages: id, parent, role, text, score.
    """
    tree = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    reached, jumps = ancestors(tree)
    leaves = reached.join(reached.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    best = Window.partitionBy("root").orderBy(F.desc("total"), "id")
    chosen = written(leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= top)
                     .select("root", "branch", F.col("id").alias("leaf")), "chat-chosen")
    # after k jumps all messages less than 2 ** k above a leaf are there; the next jump adds as many again, where there are any
    on_path = chosen.select("leaf", F.col("leaf").alias("id"), F.lit(0).alias("above"))
    for k, jump in enumerate(jumps):
        further = written(on_path.join(jump, "id").select(
            "leaf", F.col("up").alias("id"), (F.col("above") + 2 ** k).alias("above")), "chat-path")
        on_path = on_path.unionByName(further)
    told = messages.select("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("place"), "role", "text")))
    whole = on_path.join(told, "id").groupBy("leaf").agg(
        F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    return chosen.join(whole, "leaf")


def formatted(chosen: DataFrame) -> DataFrame:
    """``chosen`` with text (the formatted conversation) and loss_mask in place of turns."""
    def piece(turn: Column) -> Column:
        return F.when(turn["role"] == "assistant", F.concat(F.lit("<s>"), escape(turn["text"]), F.lit("</s>"))).otherwise(
            F.concat(F.lit("<s>[INST]"), escape_role(turn["role"]), F.lit("\n"), escape(turn["text"]), F.lit("[/INST]")))

    pieces = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("said"), piece(t).alias("text")))
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).cast("long").alias("at"),
                           F.array().cast("array<struct<first:bigint,length:bigint>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["text"])).alias("at"),
            F.when(p["said"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + 3).alias("first"), (F.length(p["text"]) - 7).cast("long").alias("length")))))
            .otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    kept = [c for c in chosen.columns if c != "turns"]
    return (chosen.withColumn("pieces", pieces)
            .select(*kept, F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"), spans.alias("loss_mask")))


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation, read back: an array of (role, text)."""
    def turn(piece: Column) -> Column:
        said = ~piece.startswith("[INST]")
        body = piece.substr(F.lit(7), F.length(piece) - 13)
        line = F.instr(body, "\n")
        return F.when(said, F.struct(F.lit("assistant").alias("role"),
                                     unescape(piece.substr(F.lit(1), F.length(piece) - 4)).alias("text"))).otherwise(
            F.struct(unescape_role(body.substr(F.lit(1), line - 1)).alias("role"),
                     unescape(body.substr(line + 1, F.length(body))).alias("text")))

    pieces = F.split(text, "<s>")
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def masked_text(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, joined without anything between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(text, s["first"].cast("int") + 1, s["length"].cast("int")))), "")


def linear(rows: DataFrame) -> DataFrame:
    """Messages of conversations without branches (conv_id, turn, role, text): each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return (rows.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
            .select("conv_id", F.concat_ws(":", name, F.lpad(F.col("place").cast("string"), 10, "0")).alias("id"),
                    F.when(F.col("place") > 1, F.concat_ws(":", name, F.lpad((F.col("place") - 1).cast("string"), 10, "0"))).alias("parent"),
                    "role", "text", F.lit(0.0).alias("score")))


SQL = r"""
with c as (select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n,
    coalesce(role, '') as role, coalesce(text, '') as text from c),
e as (select *, len(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) as long
  from m)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum(case when role = 'assistant' then 7 + long else 17 + len(role) + long end)::bigint as formatted_chars
from e group by conv_id
"""
