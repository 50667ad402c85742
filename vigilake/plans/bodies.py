"""Queries on the history inside request bodies: what evaluations recorded, taken out or put back."""

from pyspark.sql import functions as F

from vigilake.functions import variant as V
from vigilake.functions.once import with_once
from vigilake.operators import bodies, history, traffic
from vigilake.plans.base import TALK_SQL, Catalog, table
from vigilake.plans.evaluation import talk

CATALOG = Catalog()

# Requests of one text whose times differ by less are ordered in one task.
_BUCKET = 65_536


def _at():
    """Time of an exchange: all conversations proceed together, a turn after the other."""
    return F.struct("turn", "conv_id")


def _bucket(at):
    return F.struct(at["turn"].alias("turn"), F.floor(at["conv_id"] / _BUCKET).alias("part"))


def records(spark, sf_dir):
    return history.recorded(talk(spark, sf_dir), _at())


_RECORDS_SQL = f"""{TALK_SQL},
records AS (
    SELECT 'block' AS kind, sha256(block_message) AS text_hash, NULL AS original, turn, conv_id FROM talk WHERE verdict = 'blocked' AND block_message <> ''
    UNION ALL SELECT 'swap', sha256(final_response), response, turn, conv_id FROM talk WHERE response_verdict = 'redacted' AND response <> '' AND final_response <> '')"""


@CATALOG.query(
    "recorded_history",
    f"WITH {_RECORDS_SQL} SELECT conv_id, turn, kind, text_hash, sha256(original) AS original_sha FROM records",
)
def recorded_history(spark, sf_dir):
    """What every evaluated exchange leaves for later requests: block messages and redactions."""
    return records(spark, sf_dir).select("at.conv_id", "at.turn", "kind", "text_hash", F.sha2("original", 256).alias("original_sha"))


def shown_turns(spark, sf_dir):
    """Conversations as the client keeps them: block messages and redacted texts where the answers were.

    Some turns take the role of their neighbour, so that there are runs of user turns and of block messages.
    """
    done = talk(spark, sf_dir).select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), "block_message",
        F.when(F.col("response_eval.final_verdict") == "redacted", F.col("final_response")).alias("redacted"),
    )
    turns = table(spark, sf_dir, "conversations").join(done, ["conv_id", "turn", "role"], "left")
    text = F.coalesce("block_message", "redacted", "text")
    flip = F.when((F.col("turn") == 4) & (F.col("role") == "user"), "assistant").when((F.col("turn") % 5 == 3) & (F.col("role") == "assistant"), "user")
    return turns.select("conv_id", "turn", F.coalesce(flip, F.col("role")).alias("role"), text.alias("text"))


_SHOWN_SQL = """shown AS (
    SELECT c.conv_id, c.turn, CASE WHEN c.turn = 4 AND c.role = 'user' THEN 'assistant' WHEN c.turn % 5 = 3 AND c.role = 'assistant' THEN 'user' ELSE c.role END AS role,
      CASE WHEN t.block_message IS NOT NULL THEN t.block_message WHEN t.response_verdict = 'redacted' THEN t.final_response ELSE c.text END AS text
    FROM conversations c LEFT JOIN talk t ON t.conv_id = c.conv_id AND t.turn = c.turn - 1 AND c.role = 'assistant')"""


def requests(spark, sf_dir):
    """The last request of every conversation in all five shapes, its history as shown; ``at`` is that of the conversation before."""
    turns = shown_turns(spark, sf_dir)
    # One request holds its conversation's turns, so this list is one row's content.
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    lit, s = F.lit, lambda **fields: F.struct(*[c.alias(n) for n, c in fields.items()])
    meta = s(a=F.array(lit(1), lit(None), lit(3)), f=lit(0.5), n=F.col("conv_id"), s=lit("é"))
    ours = lambda t, name: F.when(t["role"] == "assistant", lit(name)).otherwise(t["role"])
    shapes = {
        traffic.GEMINI: s(meta=meta, contents=F.transform("turns", lambda t: s(role=ours(t, "model"), parts=F.array(s(text=t["text"]))))),
        traffic.ANTHROPIC: s(meta=meta, messages=F.transform("turns", lambda t: s(role=t["role"], content=F.array(s(type=lit("text"), text=t["text"]))))),
        traffic.CHATGPT: s(meta=meta, messages=F.transform("turns", lambda t: s(role=t["role"], content=t["text"]))),
        traffic.CHATGPT_WEB: s(meta=meta, messages=F.transform("turns", lambda t: s(author=s(role=t["role"]), content=s(content_type=lit("text"), parts=F.array(t["text"]))))),
        traffic.CLAUDE_WEB: s(meta=meta, messages=F.transform("turns", lambda t: s(sender=t["role"], text=t["text"]))),
    }
    made = F.array(*[s(surface=lit(n), request_body=F.to_json(shapes[n], {"ignoreNullFields": "false"})) for n in traffic.SURFACES])
    last = F.array_max(F.transform(F.filter("turns", lambda t: t["role"] == "user"), lambda t: t["turn"]))
    before = F.struct(F.coalesce(last, lit(0)).cast("bigint").alias("turn"), (F.col("conv_id") - 1).alias("conv_id"))
    return listed.select("conv_id", before.alias("at"), made.alias("made")).select("conv_id", "at", F.inline("made"))


def _read_back(done, *counts):
    """The rewritten bodies as texts of their turns, and their other members."""
    bodies_ = with_once(done, {"__body": V.parse_strict(F.col("history_body"))})
    turns = traffic.per_surface(lambda n: traffic.turn_array(F.col("__body"), n))
    said = with_once(bodies_, {"__turns": turns})
    joint = F.array_join(F.transform("__turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit(":"), t["text"])), "|")
    return said.select("conv_id", "surface", *counts, F.sha2(joint, 256).alias("turns_sha"), F.to_json(V.at(F.col("__body"), "$.meta")).alias("meta"))


# One fold in order per conversation, with all kept turns: a block takes the user turn that was kept last.
_FOLD_SQL = """convs AS (SELECT conv_id, list({'r': role, 'x': coalesce(original, text), 'b': b, 'w': original IS NOT NULL, 'kept': []::STRUCT(r VARCHAR, x VARCHAR, w BOOLEAN)[]}
      ORDER BY turn) AS ts, count(*) FILTER (WHERE b) AS stripped FROM marked GROUP BY conv_id),
  folded AS (SELECT conv_id, stripped, list_reduce(list_prepend({'r': '', 'x': '', 'b': false, 'w': false, 'kept': []::STRUCT(r VARCHAR, x VARCHAR, w BOOLEAN)[]}, ts),
      lambda a, x: {'r': '', 'x': '', 'b': false, 'w': false, 'kept':
        CASE WHEN NOT x.b THEN list_append(a.kept, {'r': x.r, 'x': x.x, 'w': x.w})
             WHEN len(a.kept) > 0 AND a.kept[-1].r = 'user' THEN a.kept[1:-2] ELSE a.kept END}).kept AS kept FROM convs),
  done AS (SELECT conv_id, stripped, len(list_filter(kept, lambda k: k.w)) AS swapped, sha256(array_to_string(list_transform(kept, lambda k: k.r || ':' || k.x), '|')) AS turns_sha,
      '{"a":[1,null,3],"f":0.5,"n":' || conv_id || ',"s":"é"}' AS meta FROM folded)"""
_SURFACES_SQL = "unnest(['gemini', 'anthropic', 'chatgpt', 'chatgpt_web', 'claude_web']) AS surface"


@CATALOG.query(
    "strip_blocks_in_body",
    f"""WITH {_RECORDS_SQL}, {_SHOWN_SQL}, marked AS (SELECT *, role = 'assistant' AND sha256(text) IN (SELECT text_hash FROM records WHERE kind = 'block') AS b,
          NULL::VARCHAR AS original FROM shown), {_FOLD_SQL}
        SELECT conv_id, {_SURFACES_SQL}, stripped::INT AS stripped, turns_sha, meta FROM done""",
)
def strip_blocks_in_body(spark, sf_dir):
    """Request bodies without the block messages of evaluated exchanges."""
    hashes = records(spark, sf_dir).where("kind = 'block'").select("text_hash").distinct()
    return _read_back(bodies.strip_blocks_in_body(requests(spark, sf_dir).drop("at"), ["conv_id", "surface"], hashes), "stripped")


_LAST_SQL = "SELECT text_hash, first(original ORDER BY turn DESC, conv_id DESC) AS original FROM records WHERE kind = 'swap' GROUP BY text_hash"


@CATALOG.query(
    "swap_back_in_body",
    f"""WITH {_RECORDS_SQL}, {_SHOWN_SQL}, pairs AS ({_LAST_SQL}),
        marked AS (SELECT s.*, false AS b, CASE WHEN p.original <> s.text THEN p.original END AS original FROM shown s LEFT JOIN pairs p
          ON s.role = 'assistant' AND s.text <> '' AND p.text_hash = sha256(s.text)), {_FOLD_SQL}
        SELECT conv_id, {_SURFACES_SQL}, swapped::INT AS swapped, turns_sha, meta FROM done""",
)
def swap_back_in_body(spark, sf_dir):
    """Request bodies with the originals of redacted answers put back."""
    pairs = records(spark, sf_dir).where("kind = 'swap'").groupBy("text_hash").agg(F.max_by("original", "at").alias("original"))
    return _read_back(bodies.swap_back_in_body(requests(spark, sf_dir).drop("at"), ["conv_id", "surface"], pairs), "swapped")


@CATALOG.query(
    "history_as_recorded",
    f"""WITH {_RECORDS_SQL}, {_SHOWN_SQL},
        times AS (SELECT conv_id, coalesce(max(turn) FILTER (WHERE role = 'user'), 0) AS t, conv_id - 1 AS c FROM shown GROUP BY conv_id),
        asked AS (SELECT s.*, t, c, CASE WHEN role = 'assistant' AND text <> '' THEN sha256(text) END AS h FROM shown s JOIN times USING (conv_id)),
        first_block AS (SELECT text_hash, min((turn, conv_id)) AS since FROM records WHERE kind = 'block' GROUP BY text_hash),
        found AS (SELECT a.conv_id, a.turn, first(r.original ORDER BY r.turn DESC, r.conv_id DESC) AS original FROM asked a JOIN records r
          ON r.kind = 'swap' AND r.text_hash = a.h AND (r.turn < a.t OR (r.turn = a.t AND r.conv_id < a.c)) GROUP BY a.conv_id, a.turn),
        marked AS (SELECT a.conv_id, a.turn, a.role, a.text, coalesce(b.since < (a.t, a.c), false) AS b, CASE WHEN f.original <> a.text THEN f.original END AS original
          FROM asked a LEFT JOIN first_block b ON b.text_hash = a.h LEFT JOIN found f ON f.conv_id = a.conv_id AND f.turn = a.turn), {_FOLD_SQL}
        SELECT conv_id, {_SURFACES_SQL}, stripped::INT AS stripped, swapped::INT AS swapped, turns_sha, meta FROM done""",
)
def history_as_recorded(spark, sf_dir):
    """Requests made before some of their texts were recorded: only what was known by then counts."""
    done = bodies.clean_history(requests(spark, sf_dir), ["conv_id", "surface"], "at", records(spark, sf_dir), _bucket)
    return _read_back(done, "stripped", "swapped")
