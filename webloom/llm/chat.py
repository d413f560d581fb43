"""Preference formatting of conversations.

Two tables of turns, chosen and rejected, share a key.  The longest common prefix of turns
(same role and same text) of each pair is rendered once as the prompt, and what follows on
either side as a completion.  A completion comes as segments with a loss mask: the text of
assistant turns and their end mark are trained on, all other characters aren't.

    prompt               <|user|>\\nHello<|end|>\\n
    chosen_segments      [("<|assistant|>\\n", false), ("Hi!<|end|>\\n", true)]

``spans`` gives the same mask as character offsets (start, end) of the trained text.

Everything is native expressions over one shuffle by key per table.

Nulls, ties and odd rows: turns with a null key are left out; a null
role renders as "unknown", a null text as empty; turns are ordered by (turn, role,
text) so rendered, a null turn first, so repeated turn numbers have one order and repeated rows stay.  A conversation becomes
one row, whatever its length; very long texts are rendered whole.  A key that only one table holds is left out,
and so is a pair without any assistant text after the prefix on either side (identical
conversations, or one that is a prefix of the other and adds no reply).  A side that ends within
the prefix has an empty completion.  Extra columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEGMENTS = "array<struct<text:string,train:boolean>>"
END = "<|end|>\n"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _turns(rows: DataFrame, key: str, name: str) -> DataFrame:
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(one)).alias("__t"))
    return listed.select("key", F.transform("__t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(END))), "")


def _segments(turns: Column) -> Column:
    def of(t: Column) -> Column:
        head, body = F.struct(_head(t["role"]).alias("text"), F.lit(False).alias("train")), F.struct(F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == "assistant").alias("train"))
        return F.array(head, body)

    return F.flatten(F.transform(turns, of)).cast(_SEGMENTS)


def _trained(turns: Column) -> Column:
    return F.exists(turns, lambda t: (t["role"] == "assistant") & (t["text"] != ""))


def spans(segments: Column) -> Column:
    """(start, end) of the trained characters, one span for each trained segment."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["train"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(segments, zero, step, lambda acc: acc["out"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, prefix_turns, prompt, chosen, rejected, chosen_segments, rejected_segments)."""
    both = _turns(chosen, key, "c").join(_turns(rejected, key, "r"), "key")
    least = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.arrays_zip(F.slice("c", 1, least), F.slice("r", 1, least)), lambda z: z["0"] == z["1"])
    differ = F.array_position(same, F.lit(False))
    cut = both.withColumn("n", F.when(differ > 0, differ - 1).otherwise(least.cast("long")).cast("int"))
    rest = cut.withColumns({"p": F.slice("c", 1, F.col("n")), "c": F.slice("c", F.col("n") + 1, F.size("c")), "r": F.slice("r", F.col("n") + 1, F.size("r"))})
    rest = rest.where(_trained(F.col("c")) | _trained(F.col("r")))
    return rest.select(
        F.col("key").alias(key),
        F.col("n").alias("prefix_turns"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _segments(F.col("c")).alias("chosen_segments"),
        _segments(F.col("r")).alias("rejected_segments"),
    )


def echo_rejections(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from plain conversations: the last reply against an echo of the turn before it.

    Both sides end with the last assistant turn that has a turn before it; the rejected one
    repeats that earlier turn's text.  Conversations without such a reply give no pair.
    """
    order = [F.col("turn"), F.col("role"), F.col("text")]
    w = Window.partitionBy("conv_id").orderBy(*order)
    back = Window.partitionBy("conv_id").orderBy(*[c.desc() for c in order])
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id is not null")
    marked = rows.withColumns({"prev": F.lag(F.coalesce("text", F.lit(""))).over(w), "at": F.row_number().over(w)})
    last = marked.withColumn("last", F.max(F.when((F.col("role") == "assistant") & F.col("prev").isNotNull(), F.col("at"))).over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = last.where(F.col("at") <= F.col("last"))
    chosen = kept.select("conv_id", "turn", "role", "text")
    rejected = kept.select("conv_id", "turn", "role", F.when(F.col("at") == F.col("last"), F.col("prev")).otherwise(F.col("text")).alias("text"))
    return chosen, rejected


def early_rejections(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from plain conversations that part at any reply, with all turns after it.

    Of the n assistant turns that have a turn before them, the rejected side's number 1 + conv_id mod n repeats that earlier
    turn's text; where conv_id is even, the turn behind it is missing too.  All other turns are on both sides.
    Conversations without such a reply give no pair; a conv_id that is no number counts as 0.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    placed = rows.withColumns({"at": F.row_number().over(order), "prev": F.lag("text").over(order)})
    reply = F.when((F.col("role") == "assistant") & (F.col("at") > 1), 1)
    counted = placed.withColumns({"n": F.count(reply).over(whole), "k": F.when(reply == 1, F.count(reply).over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))})
    number = F.coalesce(F.col("conv_id").try_cast("long"), F.lit(0))
    parted = counted.withColumn("here", F.max(F.when(F.col("k") == 1 + F.pmod(number, F.nullif(F.col("n"), F.lit(0))), F.col("at"))).over(whole)).where("here is not null")
    chosen = parted.select("conv_id", F.col("at").alias("turn"), "role", "text")
    text = F.when(F.col("at") == F.col("here"), F.col("prev")).otherwise(F.col("text")).alias("text")
    rejected = parted.where(~((F.col("at") == F.col("here") + 1) & (F.pmod(number, F.lit(2)) == 0))).select("conv_id", F.col("at").alias("turn"), "role", text)
    return chosen, rejected
