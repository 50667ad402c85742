"""Conversation history inside logged request bodies: known block messages out, originals back in.

A body carries its whole history, so its turns are looked up as rows and the body is rewritten in
its own row, as a VARIANT. Bodies without a known turn keep their text unchanged.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import variant as V
from vigilake.functions.once import with_once
from vigilake.functions.spread import as_of_lookup, salted_lookup
from vigilake.operators import traffic
from vigilake.operators.traffic import ASSISTANT_ROLES, CHATGPT_WEB, CLAUDE_WEB, GEMINI, JOINT, USER_ROLES

MARK = "struct<pos:int,original:string>"


def _by_user(message: Column, surface: str) -> Column:
    if surface != CLAUDE_WEB:
        return F.coalesce(traffic._role(message, surface) == "user", F.lit(False))
    named = F.when(F.map_contains_key(V.fields_of(message), "role"), V.string_at(message, "$.role")).otherwise(V.string_at(message, "$.sender"))
    return F.coalesce(named.isin(*USER_ROLES), F.lit(False))


def _said(body: Column, surface: str) -> Column:
    """Assistant turns with text: position, text to look blocks up by and text to look redactions up by."""

    def one(message, i):
        text = F.array_join(traffic._message_texts(message, surface), JOINT)
        blocked = text
        if surface == CHATGPT_WEB:  # empty parts count where blocks are looked for
            parts = F.transform(V.list_at(message, "$.content.parts"), lambda p: V.string_at(p, "$"))
            blocked = F.array_join(F.filter(parts, lambda p: p.isNotNull()), JOINT)
        ours = F.coalesce(traffic._role(message, surface).isin(*ASSISTANT_ROLES[surface]), F.lit(False))
        return F.struct(i.alias("pos"), F.when(ours, blocked).alias("blocked"), F.when(ours, text).alias("text"))

    listed = F.transform(traffic._messages(body, surface), one)
    return F.filter(listed, lambda t: (F.coalesce(t["text"], F.lit("")) != "") | (F.coalesce(t["blocked"], F.lit("")) != ""))


def said_in_bodies(requests: DataFrame, keys: list[str], more: list[str] | None = None) -> DataFrame:
    """Assistant turns of request bodies as rows: keys, pos, block_hash, text_hash."""
    bodies = with_once(requests, {"__request": V.parse_strict(F.col("request_body"))})
    listed = with_once(bodies, {"__said": traffic.per_surface(lambda s: _said(F.col("__request"), s))})
    rows = listed.select(*keys, *(more or []), F.inline("__said"))
    hashed = lambda c: F.when(F.col(c) != "", F.sha2(c, 256))
    return rows.select(*keys, *(more or []), "pos", hashed("blocked").alias("block_hash"), hashed("text").alias("text_hash"))


def marked(requests: DataFrame, keys: list[str], blocks: DataFrame, swaps: DataFrame) -> DataFrame:
    """Add ``blocks`` (positions) and ``swaps`` (position to original) from rows of keys, pos (, original).

    A body has as many marks as turns at most, so a list is no longer than its body.
    """
    both = blocks.select(*keys, "pos", F.lit(None).cast("string").alias("original")).union(swaps.select(*keys, "pos", "original"))
    lists = both.groupBy(*keys).agg(F.collect_list(F.struct("pos", "original").cast(MARK)).alias("__marks"))
    joined = requests.join(lists, keys, "left")
    own = F.filter("__marks", lambda m: m["original"].isNull())
    other = F.filter("__marks", lambda m: m["original"].isNotNull())
    return joined.withColumns({"blocks": F.transform(own, lambda m: m["pos"]), "swaps": F.map_from_entries(other)}).drop("__marks")


def dropped_positions(body: Column, surface: str, blocks: Column) -> Column:
    """Positions of block messages and of the user turns that each of them takes along.

    A fold in order: user turns open, a block message takes the last open one, any other turn
    closes all. Only open user turns are carried from one message to the next.
    """
    turns = F.transform(
        traffic._messages(body, surface),
        lambda m, i: F.struct(i.alias("pos"), F.array_contains(blocks, i).alias("block"), _by_user(m, surface).alias("user")),
    )
    none = F.array().cast("array<int>")

    def step(state, turn):
        last = F.slice(state["open"], -1, 1)
        shorter = F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        has = F.size(state["open"]) > 0
        open_ = F.when(turn["block"], F.when(has, shorter).otherwise(state["open"]))
        open_ = open_.when(turn["user"], F.concat(state["open"], F.array(turn["pos"]))).otherwise(none)
        taken = F.when(turn["block"] & has, F.concat(state["taken"], last)).otherwise(state["taken"])
        return F.struct(open_.alias("open"), taken.alias("taken"))

    start = F.struct(none.alias("open"), none.alias("taken"))
    return F.concat(blocks, F.aggregate(turns, start, step, lambda state: state["taken"]))


def _rewritten(body: Column, surface: str, blocks: Column, swaps: Column, dropped: Column) -> Column:
    def swap(message, i):
        return F.when(F.map_contains_key(swaps, i), traffic.rewrite_turn(message, surface, F.element_at(swaps, i))).otherwise(message)

    placed = F.transform(traffic._messages(body, surface), lambda m, i: F.struct(i.alias("pos"), swap(m, i).alias("item")))
    kept = F.filter(placed, lambda p: ~F.array_contains(dropped, p["pos"]))
    items = F.to_variant_object(F.transform(kept, lambda p: p["item"]))
    return traffic._set(body, "contents" if surface == GEMINI else "messages", items)


def rewrite_bodies(requests: DataFrame) -> DataFrame:
    """Bodies with ``blocks`` and ``swaps`` applied: adds history_body, stripped and swapped.

    ``stripped`` counts block messages, each with the user turn before it; ``swapped`` counts
    the originals put back into turns that stay. A body without either is handed on as it came.
    """
    empty = F.array().cast("array<int>")
    none = F.create_map().cast("map<int,string>")
    any_ = (F.size(F.coalesce("blocks", empty)) > 0) | (F.size(F.coalesce("swaps", none)) > 0)
    bodies = with_once(
        requests,
        {"__request": F.when(any_, V.parse_strict(F.col("request_body"))), "__blocks": F.coalesce("blocks", empty), "__swaps": F.coalesce("swaps", none)},
    )
    body, blocks, swaps = F.col("__request"), F.col("__blocks"), F.col("__swaps")
    found = with_once(bodies, {"__dropped": F.when(any_, traffic.per_surface(lambda s: dropped_positions(body, s, blocks)))})
    dropped = F.coalesce(F.col("__dropped"), empty)
    made = with_once(found, {"__made": F.when(any_, F.to_json(traffic.per_surface(lambda s: _rewritten(body, s, blocks, swaps, dropped))))})
    swapped = F.size(F.filter(F.map_keys(swaps), lambda p: ~F.array_contains(dropped, p)))
    return made.withColumns(
        {"history_body": F.coalesce("__made", "request_body"), "stripped": F.size(blocks), "swapped": swapped}
    ).drop("__request", "__blocks", "__swaps", "__dropped", "__made", "blocks", "swaps")


def strip_blocks_in_body(requests: DataFrame, keys: list[str], hashes: DataFrame) -> DataFrame:
    """Request bodies without the turns that are known block messages, nor the user turns that led to them."""
    said = said_in_bodies(requests, keys).where(F.col("block_hash").isNotNull()).withColumn("__row", F.xxhash64(*keys, "pos"))
    blocks = salted_lookup(said.select(*keys, "pos", "__row", F.col("block_hash").alias("text_hash")), hashes.select("text_hash"), "text_hash", "inner", "__row")
    none = said.where("false").select(*keys, "pos", F.lit("").alias("original"))
    return rewrite_bodies(marked(requests, keys, blocks, none)).drop("swapped")


def swap_back_in_body(requests: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """Request bodies with the original text in assistant turns that hold a known redaction."""
    said = said_in_bodies(requests, keys).where(F.col("text_hash").isNotNull()).withColumn("__row", F.xxhash64(*keys, "pos"))
    found = salted_lookup(said.drop("block_hash"), pairs.select("text_hash", "original"), "text_hash", "inner", "__row")
    swaps = found.where(F.sha2("original", 256) != F.col("text_hash")).select(*keys, "pos", "original")
    return rewrite_bodies(marked(requests, keys, said.where("false").select(*keys, "pos"), swaps)).drop("stripped")


def clean_history(requests: DataFrame, keys: list[str], at: str, records: DataFrame, bucket) -> DataFrame:
    """Request bodies as they are forwarded: first block messages out, then originals back in.

    ``records`` come from history.recorded(): a block message or a redaction counts for a request only
    if it was recorded before the request's time ``at``; of several originals
    the last one recorded before it. ``bucket`` maps a time to one that never decreases with it and
    bounds how many requests and records of one text are ordered in one task.
    """
    said = said_in_bodies(requests, keys, [at]).withColumn("__row", F.xxhash64(*keys, "pos"))
    since = records.where("kind = 'block'").groupBy("text_hash").agg(F.min("at").alias("__since"))
    told = said.where(F.col("block_hash").isNotNull()).select(*keys, at, "pos", "__row", F.col("block_hash").alias("text_hash"))
    blocks = salted_lookup(told, since, "text_hash", "inner", "__row").where(F.col(at) > F.col("__since"))
    swaps = records.where("kind = 'swap'").select("text_hash", "at", "original")
    held = said.where(F.col("text_hash").isNotNull()).select(*keys, F.col(at).alias("at"), "pos", "text_hash")
    found = as_of_lookup(held, swaps, "text_hash", "at", bucket, "original")
    originals = found.where(F.sha2("original", 256) != F.col("text_hash")).select(*keys, "pos", "original")
    return rewrite_bodies(marked(requests, keys, blocks, originals))
