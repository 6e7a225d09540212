"""Chat formatting by perspective rotation: each participant's view of a dialogue, in DataFrame functions only.

Method. For every participant the whole dialogue is rendered with that speaker as ``assistant`` and all others as named
users; system turns stay. Only the assistant's contents, with their end marks, are to be learnt: they are given as spans. A
rendering comes in chunks of ``chunk`` turns, a row each, whose texts in order are the whole; spans are [start, end) code
points within their chunk.

Scale. A conversation may hold a third of all rows. Turns get their places by a distributed count: rows are sorted by
(conversation, turn, hash) over ranges, which split a long conversation; each range's rows of a conversation are counted, and
the counts before a range are its offset. Then only groups of at most ``chunk`` turns are put together. Output has a row for each
participant and chunk, as the renderings do.

Defined cases: a null text is empty; a null role is the speaker ``unknown``; a null conversation id is a conversation. Turns with
equal numbers are ordered by their text's hash, role and text; null turns come first; repeated rows are repeated turns.
A conversation of system turns only has no participant and no row. Special marks in texts or names are broken up. An empty
table gives an empty result. Other columns aren't carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazeframe.llm.common import materialize

#: The template's marks.
START, END = "<|im_start|>", "<|im_end|>"


def _plain(c: Column) -> Column:
    """A text that can't be mistaken for a mark."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system: str = "system",
    chunk: int = 64,
) -> DataFrame:
    """(conv_id, participant, chunk, n_turns, n_chars, n_learnt, text, spans) rows."""
    speaker = F.coalesce(F.col(role), F.lit("unknown"))
    body = F.coalesce(F.col(text), F.lit(""))
    turns = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), speaker.alias("speaker"), body.alias("body"))
    turns = turns.withColumn("h", F.md5(F.col("body").cast("binary")))
    key = ["conv", "turn", "h", "speaker"]
    ranged = turns.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*key, "salt").sortWithinPartitions(*key)
    ranged = materialize(ranged.drop("salt").withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))
    counts = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("conv", "part").orderBy("seq")
    placed = ranged.withColumn("k", F.row_number().over(own) - 1).join(offsets.hint("shuffle_merge"), (F.col("part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")))
    placed = placed.withColumn("place", F.col("k") + F.col("offset")).withColumn("chunk", F.floor(F.col("place") / chunk))

    groups = placed.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "speaker", "body"))).alias("turns"))
    people = turns.where(F.col("speaker") != system).select(F.col("conv").alias("c"), F.col("speaker").alias("participant")).distinct()
    views = groups.join(people.hint("shuffle_merge"), F.col("conv").eqNullSafe(F.col("c")))

    def rendered(t: Column) -> Column:
        me = t["speaker"] == F.col("participant")
        name = _plain(F.regexp_replace(t["speaker"], r"\s", "_"))
        head = F.when(t["speaker"] == system, F.lit(f"{START}system\n")).when(me, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))
        content = F.concat(_plain(t["body"]), F.lit(END))
        return F.struct(head.alias("head"), content.alias("content"), (me & (t["speaker"] != system)).alias("me"))

    none = "cast(array() as array<struct<start:int,end:int>>)"
    start = F.struct(F.lit(0).alias("at"), F.expr(none).alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["content"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(s["me"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    segments = views.withColumn("s", F.transform("turns", rendered))
    out = segments.withColumn("text", F.array_join(F.transform("s", lambda s: F.concat(s["head"], s["content"], F.lit("\n"))), ""))
    out = out.withColumn("spans", F.aggregate("s", start, step, lambda a: a["spans"]))
    learnt = F.aggregate("spans", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return out.select(
        F.col("conv").alias("conv_id"), "participant", F.col("chunk").cast("long").alias("chunk"), F.size("turns").cast("long").alias("n_turns"), F.length("text").cast("long").alias("n_chars"), learnt.cast("long").alias("n_learnt"), "text", "spans"
    )
