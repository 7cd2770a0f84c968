"""Chat formatting by rotating the perspective: each participant in turn is the assistant.

For every conversation and every participant of it, the whole dialogue is
rendered with that participant's turns as the assistant's, the other
participants as named users, and a mask that covers the assistant's contents.
System turns belong to nobody: they are rendered in each perspective and are
never masked in.

A conversation can hold a large share of all rows, so no step needs its rows in
one task. Rows are dealt out by ranges of (conversation, turn, role, text), each
range counts its own characters, and the few range totals of a conversation
give every turn its place in the rendered dialogue. The dialogue comes in pages
of about ``page_chars`` characters (a turn belongs to the page of its first
character), so that one output row stays bounded; almost every conversation is
one page.

Defined cases: a null text is an empty one; a null or empty role is the
participant ``unknown``; rows without conv_id form one conversation; turns are
ordered by turn (null first), then role, then text, so ties and repeated rows
have a fixed place and are all rendered; a conversation of system turns only has
no participant and no output; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from neardup.session import cut_lineage

SYSTEM = "system"
UNKNOWN = "unknown"
PAGE_CHARS = 32_768


def _heading(target: str, speaker: Column, is_target: Column) -> Column:
    return (F.when(speaker == SYSTEM, F.lit("<|system|>\n"))
            .when(is_target, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user|> "), speaker, F.lit("\n"))))


END = "\n<|end|>\n"


def rendered_turns(conversations: DataFrame) -> DataFrame:
    """A row for each turn and perspective: conv_id, perspective, seq, piece, start, mask_start, mask_end.

    ``start`` is the code point of the dialogue at which ``piece`` begins; the mask
    is [mask_start, mask_end) in the dialogue, null where the turn isn't the
    perspective's own.
    """
    parts = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    role = F.when(F.coalesce(F.col("role"), F.lit("")) == "", F.lit(UNKNOWN)).otherwise(F.col("role"))
    turns = conversations.select("conv_id", "turn", role.alias("speaker"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "speaker", "text"]
    # equal rows are alike, so the salt may part them as it likes
    dealt = (turns.withColumn("salt", F.monotonically_increasing_id())
             .repartitionByRange(parts, *order, "salt").withColumn("chunk", F.spark_partition_id()))
    dealt = cut_lineage(dealt.drop("salt"))

    # the participants of a conversation, wanted once for each of its chunks
    seen = cut_lineage(dealt.groupBy("conv_id", "chunk", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")))
    targets = (seen.where(F.col("speaker") != SYSTEM).groupBy("conv_id", "speaker").agg(F.lit(1).alias("one"))
               .select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")))
    # what each chunk adds to the dialogue of each perspective
    of = seen.join(targets, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("speaker") == F.col("perspective")
    adds = F.col("chars") + F.col("n") * (F.length(_heading("perspective", F.col("speaker"), own)) + len(END))
    before = (Window.partitionBy("conv_id", "perspective").orderBy("chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    chunks = (of.groupBy("conv_id", "perspective", "chunk").agg(F.sum(adds).alias("adds"), F.sum("n").alias("n"))
              .select(F.col("conv_id").alias("c"), "perspective", F.col("chunk").alias("k"),
                      F.coalesce(F.sum("adds").over(before), F.lit(0)).alias("chars_before"),
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before")))
    chunks = cut_lineage(chunks)

    rows = dealt.join(chunks, (F.col("chunk") == F.col("k")) & F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("speaker") == F.col("perspective")
    heading = _heading("perspective", F.col("speaker"), own)
    rows = rows.withColumns({"heading": heading, "own": own & (F.col("speaker") != SYSTEM)})
    rows = rows.withColumn("piece", F.concat("heading", "text", F.lit(END)))
    within = Window.partitionBy("conv_id", "perspective", "chunk").orderBy("turn", "speaker", "text")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "seq": F.col("turns_before") + F.row_number().over(within) - 1,
        "start": F.col("chars_before") + F.coalesce(F.sum(F.length("piece")).over(upto), F.lit(0))})
    mask = F.col("start") + F.length("heading")
    return rows.select("conv_id", "perspective", "seq", "piece", "start",
                       F.when(F.col("own"), mask).alias("mask_start"),
                       F.when(F.col("own"), mask + F.length("text")).alias("mask_end"))


def rotate_perspectives(conversations: DataFrame, page_chars: int = PAGE_CHARS) -> DataFrame:
    """A row for each conversation, perspective and page.

    conv_id, perspective, page (from 0), start (the page's first code point in the
    dialogue), n_turns, text (the page) and masks (pairs of code points of the
    dialogue, end exclusive, as ``start:end`` joined by commas).
    """
    turns = rendered_turns(conversations).withColumn("page", F.floor(F.col("start") / page_chars))
    span = F.when(F.col("mask_start").isNotNull(), F.concat_ws(":", "mask_start", "mask_end"))
    pages = turns.groupBy("conv_id", "perspective", "page").agg(
        F.min("start").alias("start"), F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("seq", "piece", span.alias("span")))).alias("_turns"))
    return pages.select("conv_id", "perspective", "page", "start", "n_turns",
                        F.array_join(F.transform("_turns", lambda x: x["piece"]), "").alias("text"),
                        F.array_join(F.transform("_turns", lambda x: x["span"]), ",").alias("masks"))
