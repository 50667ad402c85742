"""Conversation-history hygiene on a table of turns (conv_id, turn, role, text)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.spread import prefix_sum, salted_lookup
from vigilake.functions.text import truthy
from vigilake.functions.written import written

USER = ("user", "human")
ASSISTANT = ("assistant", "model")

# Turns of one task in ordered work on one conversation.
BLOCK_TURNS = 65_536


def redaction_pairs(redactions: DataFrame) -> DataFrame:
    """Lookup hash -> original from (redacted, original, seq); of equal texts the last one counts."""
    usable = redactions.where(truthy(F.col("redacted")).isNotNull() & truthy(F.col("original")).isNotNull())
    return usable.groupBy(F.sha2("redacted", 256).alias("text_hash")).agg(F.max_by("original", "seq").alias("original"))


def block_hashes(messages: DataFrame, text: str = "text") -> DataFrame:
    """Hashes of the block messages that were put into conversations, of both phases."""
    return messages.where(F.col(text) != "").select(F.sha2(text, 256).alias("text_hash")).distinct()


def recorded(evaluated: DataFrame, at: Column) -> DataFrame:
    """(kind, text_hash, original, at): what evaluated exchanges leave for later requests.

    A blocked phase put its block message into the conversation (``block``); a redacted
    response put its redacted text there (``swap``), whose original is kept.
    """
    message = F.when(F.col("verdict") == "blocked", truthy(F.col("block_message")))
    redacted = F.coalesce(F.col("response_eval.final_verdict") == "redacted", F.lit(False)) & truthy(F.col("response")).isNotNull()
    said = F.when(redacted, truthy(F.col("final_response")))
    none = F.lit(None).cast("string")

    def row(kind, text, original):
        return F.struct(F.lit(kind).alias("kind"), F.sha2(text, 256).alias("text_hash"), original.alias("original"))

    rows = F.array(row("block", message, none), row("swap", said, F.col("response")))
    made = evaluated.select(at.alias("at"), F.inline(F.filter(rows, lambda r: r["text_hash"].isNotNull())))
    return made.select("kind", "text_hash", "original", "at")


def _with_row(turns: DataFrame) -> DataFrame:
    """Hash of assistant texts, and a row key to split hot hashes by."""
    said = F.col("role").isin(*ASSISTANT) & (F.col("text") != "")
    return turns.withColumns(
        {
            "text_hash": F.when(said, F.sha2("text", 256)),
            "__row": F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
        }
    )


def swap_back(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Put the original text back into assistant turns that hold a known redaction.

    Adds ``swapped``. The same redacted text may fill very many turns; such hot
    hashes are split over tasks.
    """
    found = salted_lookup(_with_row(turns), pairs, "text_hash", "left", "__row")
    swapped = F.coalesce(F.col("original") != F.col("text"), F.lit(False))
    return found.withColumns(
        {"swapped": swapped, "text": F.when(swapped, F.col("original")).otherwise(F.col("text"))}
    ).drop("original", "text_hash", "__row")


def with_blocks(turns: DataFrame, hashes: DataFrame) -> DataFrame:
    """Add ``is_block``: assistant turns whose text is a known block message."""
    known = hashes.select("text_hash", F.lit(True).alias("__known"))
    found = salted_lookup(_with_row(turns), known, "text_hash", "left", "__row")
    return found.withColumn("is_block", F.coalesce("__known", F.lit(False))).drop("__known", "text_hash", "__row")


def strip_blocks(turns: DataFrame, is_block: str = "is_block") -> DataFrame:
    """Drop block turns and, for each, the user turn kept just before it.

    Consecutive blocks take further user turns, so this is bracket matching: user
    turns open, blocks close, any other turn is a wall. Between two walls the open
    depth is a running sum with a floor of zero, and a user turn is taken when the
    depth later falls below the one it reached. Walls are counted per conversation
    in bucketed order, so one long conversation is many tasks. Marked turns are written
    once, since numbering and folding read them several times.
    """
    turns = written(turns, "marked-turns")
    user = F.col("role").isin(*USER) & ~F.col(is_block)
    step = F.when(user, 1).when(F.col(is_block), -1).otherwise(0)
    wall = F.when(step == 0, 1).otherwise(0)
    bucket = F.floor(F.col("turn") / BLOCK_TURNS)
    walled = prefix_sum(turns, ["conv_id"], bucket, ["turn"], "__wall", wall)
    part = Window.partitionBy("conv_id", "__wall").orderBy("turn")
    until = part.rowsBetween(Window.unboundedPreceding, 0)
    # The turns after this one, as a running frame of the opposite order: linear, where a frame to the end is not.
    after = Window.partitionBy("conv_id", "__wall").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    summed = walled.withColumn("__sum", F.sum(step).over(until))
    deep = summed.withColumn("__depth", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(until)))
    taken = user & F.coalesce(F.min("__depth").over(after) < F.col("__depth"), F.lit(False))
    return deep.withColumn("__taken", taken).where(~F.col("__taken") & ~F.col(is_block)).drop(
        "__wall", "__sum", "__depth", "__taken"
    )


def stripped_counts(turns: DataFrame, is_block: str = "is_block") -> DataFrame:
    """Exchanges dropped per conversation by strip_blocks(): one per block turn."""
    return turns.where(F.col(is_block)).groupBy("conv_id").agg(F.count("*").alias("dropped"))


def strip_blocks_in_row(turns: Column) -> Column:
    """strip_blocks() on one row's array of struct(role, text, is_block), in order.

    The same fold inside the row, for request bodies that carry their history.
    """

    def step(kept, turn):
        before = F.try_element_at(kept, F.lit(-1))
        by_user = F.coalesce(before["role"].isin(*USER), F.lit(False))
        shorter = F.slice(kept, 1, F.size(kept) - 1)
        return F.when(turn["is_block"], F.when(by_user, shorter).otherwise(kept)).otherwise(
            F.concat(kept, F.array(turn))
        )

    return F.aggregate(turns, F.slice(turns, 1, 0), step)


def purge_marked(turns: DataFrame, is_block: str = "is_block") -> DataFrame:
    """Drop turns marked as block responses and user turns directly followed by one.

    Turns are numbered without gaps first; the next turn is then an equal join on
    (conversation, number), which has no hot key, instead of a window. Marked turns and then
    numbered ones are written once.
    """
    turns = written(turns, "marked-turns")
    numbered = written(prefix_sum(turns, ["conv_id"], F.floor(F.col("turn") / BLOCK_TURNS), ["turn"], "__n"), "numbered-turns")
    marked = numbered.where(F.col(is_block)).select("conv_id", (F.col("__n") - 1).alias("__n"), F.lit(True).alias("__next"))
    joined = numbered.join(marked, ["conv_id", "__n"], "left")
    followed = F.col("role").isin(*USER) & F.coalesce("__next", F.lit(False))
    return joined.where(~followed & ~F.col(is_block)).drop("__n", "__next")
