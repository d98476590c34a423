"""Preference pairs rendered as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "<|{role}|>\n{text}<|end|>\n"


def conversations_as_arrays(turns: DataFrame) -> DataFrame:
    """One row per conv_id with its turns in order: array<struct<turn,role,text>>.

    Rows without conv_id are no conversation and are left out.  A null role reads
    as 'user', a null text as ''; repeated turn numbers are ordered by role and text.
    """
    clean = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(clean)).alias("turns"))


def mismatched_reply_pairs(turns: DataFrame) -> DataFrame:
    """Chosen and rejected conversations built from a table of conversations.

    Chosen is a conversation up to its last assistant turn.  Rejected has the same
    turns before that one, followed by the last assistant turn of the neighbour
    (conv_id with its lowest bit flipped); without such a neighbour it stops before
    the reply.  Conversations without an assistant turn give no pair.
    """
    whole = conversations_as_arrays(turns)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)))
    ended = whole.withColumn("_last", last).where("_last IS NOT NULL")
    ended = ended.select("conv_id", F.slice("turns", 1, F.col("_last") + 1).alias("chosen"), F.get("turns", F.col("_last")).alias("reply"))
    other = ended.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("_other"))
    joined = ended.join(other, "conv_id", "left")
    head = F.slice("chosen", 1, F.size("chosen") - 1)
    rejected = F.when(F.col("_other").isNull(), head).otherwise(F.concat(head, F.array("_other")))
    return joined.select(F.col("conv_id").alias("pair_id"), "chosen", rejected.alias("rejected"))


def _same(a: Column, b: Column) -> Column:
    return (a["role"] == b["role"]) & (a["text"] == b["text"])


def _render(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def _completion(turns: Column, start: Column) -> Column:
    """Struct of text and spans; a span is (start, end, train) in code points.

    Only what an assistant says and the mark that ends it are trained on; headers
    and other speakers are masked.
    """
    tail = F.slice(turns, start + 1, F.size(turns))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,train:boolean>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        header = F.length(t["role"]) + 5
        end = s["at"] + F.length(_render(t))
        head = F.struct(s["at"].alias("start"), (s["at"] + header).alias("end"), F.lit(False).alias("train"))
        body = F.struct((s["at"] + header).alias("start"), end.alias("end"), (t["role"] == "assistant").alias("train"))
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(head, body)).alias("spans"))

    text = F.array_join(F.transform(tail, _render), "")
    return F.struct(text.alias("text"), F.aggregate(tail, zero, add)["spans"].alias("spans"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, differs) for each pair.

    `pairs` has pair_id, chosen and rejected as array<struct<role,text,...>>; turns
    are equal when role and text are.  The longest common prefix of turns is
    rendered once as `prompt`; each side's other turns become a completion with the
    spans to train on.  Equal conversations give empty completions and differs =
    false; a null or empty side has no turns.  Columns beyond these are dropped.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    plain = lambda c: F.coalesce(F.transform(F.col(c), lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))), empty)
    sides = pairs.select("pair_id", plain("chosen").alias("c"), plain("rejected").alias("r"))
    shared = F.least(F.size("c"), F.size("r"))
    first_difference = F.array_position(F.zip_with(F.slice("c", 1, shared), F.slice("r", 1, shared), _same), False)
    n = F.when(first_difference > 0, first_difference - 1).otherwise(shared).cast("int")
    cut = sides.withColumn("n_prompt_turns", n)
    return cut.select(
        "pair_id",
        "n_prompt_turns",
        F.array_join(F.transform(F.slice("c", 1, F.col("n_prompt_turns")), _render), "").alias("prompt"),
        _completion(F.col("c"), F.col("n_prompt_turns")).alias("chosen"),
        _completion(F.col("r"), F.col("n_prompt_turns")).alias("rejected"),
        ((F.size("c") > F.col("n_prompt_turns")) | (F.size("r") > F.col("n_prompt_turns"))).alias("differs"),
    )
