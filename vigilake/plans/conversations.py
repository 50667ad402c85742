"""API-traffic and conversation-history queries."""

from pyspark.sql import functions as F

from vigilake.functions import variant as V
from vigilake.functions.once import with_once
from vigilake.operators import history, traffic
from vigilake.plans.base import EXCHANGES_SQL, NOW, TALK_SQL, Catalog, exchanges, table
from vigilake.plans.evaluation import documents, talk

CATALOG = Catalog()

# --- traffic: every exchange logged once per surface -------------------------

_SYSTEM = "Be brief."
_EARLIER = "earlier question"


def api_traffic(spark, sf_dir):
    """Request and response bodies in all five shapes, built from exchanges; a call without an answer has no response body."""
    pairs = exchanges(spark, sf_dir)
    ask, answer = F.col("prompt"), F.col("response")
    lit = F.lit

    def s(**fields):
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    old_answer = F.concat(lit("old answer "), F.col("exchange_id").cast("string"))
    text = s(type=lit("text"), text=ask)
    requests = {
        traffic.GEMINI: s(
            systemInstruction=s(parts=F.array(s(text=lit(_SYSTEM)))),
            contents=F.array(
                s(role=lit("user"), parts=F.array(s(text=lit(_EARLIER)))),
                s(role=lit("model"), parts=F.array(s(text=old_answer))),
                s(role=lit("user"), parts=F.array(s(text=ask))),
            ),
        ),
        traffic.ANTHROPIC: s(
            system=F.array(s(type=lit("text"), text=lit(_SYSTEM))),
            messages=F.array(
                s(role=lit("user"), content=F.array(s(type=lit("text"), text=lit(_EARLIER)))),
                s(role=lit("assistant"), content=F.array(s(type=lit("text"), text=old_answer))),
                s(role=lit("user"), content=F.array(text)),
            ),
        ),
        traffic.CHATGPT: s(
            messages=F.array(
                s(role=lit("system"), content=lit(_SYSTEM)),
                s(role=lit("user"), content=lit(_EARLIER)),
                s(role=lit("assistant"), content=old_answer),
                s(role=lit("user"), content=ask),
            )
        ),
        traffic.CHATGPT_WEB: s(
            messages=F.array(
                *[
                    s(author=s(role=lit(r)), content=s(content_type=lit("text"), parts=F.array(t)))
                    for r, t in (("system", lit(_SYSTEM)), ("user", lit(_EARLIER)), ("assistant", old_answer), ("user", ask))
                ]
            )
        ),
        traffic.CLAUDE_WEB: s(
            messages=F.array(
                s(sender=lit("human"), text=lit(_EARLIER)), s(sender=lit("assistant"), text=old_answer),
                s(sender=lit("human"), text=ask),
            )
        ),
    }
    more = lit("And so on.")
    responses = {
        traffic.GEMINI: s(
            candidates=F.array(s(content=s(role=lit("model"), parts=F.array(s(text=answer), s(text=more))), index=lit(0)))
        ),
        traffic.ANTHROPIC: s(
            content=F.array(
                s(type=lit("tool_use"), text=lit(None).cast("string"), id=lit("t1")),
                s(type=lit("text"), text=answer, id=lit(None).cast("string")),
                s(type=lit("text"), text=more, id=lit(None).cast("string")),
            ),
            model=lit("m"),
        ),
        traffic.CHATGPT: s(choices=F.array(s(message=s(role=lit("assistant"), content=answer), index=lit(0)),
                                           s(message=s(role=lit("assistant"), content=more), index=lit(1)))),
        traffic.CHATGPT_WEB: s(message=s(id=lit("m1"), content=s(parts=F.array(answer, more)))),
        traffic.CLAUDE_WEB: s(completion=F.concat(answer, lit("\n\n"), more)),
    }
    bodies = F.array(
        *[
            s(surface=lit(n), request_body=F.to_json(requests[n]), response_body=F.when(answer.isNotNull(), F.to_json(responses[n])))
            for n in traffic.SURFACES
        ]
    )
    return pairs.select("exchange_id", F.inline(bodies))


_SURFACES_SQL = "unnest(['gemini', 'anthropic', 'chatgpt', 'chatgpt_web', 'claude_web']) AS surface"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@CATALOG.query(
    "traffic_texts",
    f"""WITH {EXCHANGES_SQL} SELECT exchange_id, surface, sha256(regexp_replace(
          CASE WHEN surface = 'claude_web' THEN '' ELSE '{_SYSTEM}' || chr(10) || chr(10) END || prompt, '^\\s+|\\s+$', '', 'g')) AS prompt_sha,
          sha256(coalesce(response || chr(10) || chr(10) || 'And so on.', '')) AS response_sha
        FROM (SELECT *, {_SURFACES_SQL} FROM exchanges)""",
)
def traffic_texts(spark, sf_dir):
    done = traffic.normalise(api_traffic(spark, sf_dir))
    return done.select(
        "exchange_id", "surface", F.sha2("prompt", 256).alias("prompt_sha"), F.sha2("response", 256).alias("response_sha")
    )


@CATALOG.query(
    "traffic_rewritten",
    f"""WITH {EXCHANGES_SQL}, bodies AS (SELECT exchange_id, surface, CASE WHEN response IS NOT NULL THEN '"#' || exchange_id || '"' END AS t
            FROM (SELECT *, {_SURFACES_SQL} FROM exchanges))
       SELECT exchange_id, surface, CASE surface
         WHEN 'gemini' THEN '{{"candidates":[{{"content":{{"parts":[{{"text":' || t || '}}],"role":"model"}},"index":0}}]}}'
         WHEN 'anthropic' THEN '{{"content":[{{"id":"t1","type":"tool_use"}},{{"text":' || t || ',"type":"text"}}],"model":"m"}}'
         WHEN 'chatgpt' THEN '{{"choices":[{{"index":0,"message":{{"content":' || t || ',"role":"assistant"}}}},{{"index":1,"message":{{"content":"And so on.","role":"assistant"}}}}]}}'
         WHEN 'chatgpt_web' THEN '{{"message":{{"content":{{"parts":[' || t || ']}},"id":"m1"}}}}'
         ELSE '{{"completion":' || t || '}}' END AS rewritten FROM bodies""",
)
def traffic_rewritten(spark, sf_dir):
    named = api_traffic(spark, sf_dir).withColumn("fresh", F.concat(F.lit("#"), F.col("exchange_id").cast("string")))
    return traffic.redacted_responses(named, "fresh").select("exchange_id", "surface", "rewritten")


@CATALOG.query(
    "traffic_assistant_turns",
    f"""WITH {EXCHANGES_SQL} SELECT exchange_id, surface, CASE WHEN surface LIKE 'chatgpt%' THEN 2 ELSE 1 END AS pos,
          'old answer ' || exchange_id AS text FROM (SELECT *, {_SURFACES_SQL} FROM exchanges)""",
)
def traffic_assistant_turns(spark, sf_dir):
    return traffic.assistant_turns(api_traffic(spark, sf_dir), ["exchange_id", "surface"])


@CATALOG.query(
    "traffic_turn_rewritten",
    f"""WITH {EXCHANGES_SQL} SELECT exchange_id, surface, CASE surface
         WHEN 'gemini' THEN '{{"parts":[{{"text":"new"}}],"role":"model"}}'
         WHEN 'anthropic' THEN '{{"content":[{{"text":"new","type":"text"}}],"role":"assistant"}}'
         WHEN 'chatgpt' THEN '{{"content":"new","role":"assistant"}}'
         WHEN 'chatgpt_web' THEN '{{"author":{{"role":"assistant"}},"content":{{"content_type":"text","parts":["new"]}}}}'
         ELSE '{{"sender":"assistant","text":"new"}}' END AS turn
        FROM (SELECT *, {_SURFACES_SQL} FROM exchanges)""",
)
def traffic_turn_rewritten(spark, sf_dir):
    bodies = traffic.parsed(api_traffic(spark, sf_dir))
    path = {n: ("$.contents[1]" if n == traffic.GEMINI else f"$.messages[{2 if n.startswith('chatgpt') else 1}]") for n in traffic.SURFACES}
    made = traffic.per_surface(lambda n: traffic.rewrite_turn(V.at(F.col("request"), path[n]), n, F.lit("new")))
    return with_once(bodies, {"made": made}).select("exchange_id", "surface", F.to_json("made").alias("turn"))


@CATALOG.query(
    "traffic_block_payloads",
    f"""WITH {EXCHANGES_SQL} SELECT exchange_id, surface, 'No: ' || exchange_id AS message
        FROM (SELECT *, {_SURFACES_SQL} FROM exchanges)""",
)
def traffic_block_payloads(spark, sf_dir):
    """Block payloads read back as responses give the block message."""
    rows = api_traffic(spark, sf_dir).select("exchange_id", "surface", "request_body")
    told = F.concat(F.lit("No: "), F.col("exchange_id").cast("string"))
    payload = traffic.per_surface(lambda n: traffic.block_payload(n, F.lit("m"), told, F.lit(NOW)))
    back = traffic.normalise(with_once(rows, {"response_body": payload}))
    return back.select("exchange_id", "surface", F.col("response").alias("message"))


@CATALOG.query(
    "traffic_generic_prompts",
    f"""WITH {EXCHANGES_SQL} SELECT exchange_id, surface, CASE WHEN surface NOT IN ('gemini', 'chatgpt_web') THEN sha256(prompt) END AS prompt_sha
        FROM (SELECT *, {_SURFACES_SQL} FROM exchanges)""",
)
def traffic_generic_prompts(spark, sf_dir):
    """Bodies of unknown shape: two of the five keep their text where the generic search does not look."""
    bodies = traffic.parsed(api_traffic(spark, sf_dir))
    found = with_once(bodies, {"found": traffic.generic_prompt(F.col("request"))})
    return found.select("exchange_id", "surface", F.sha2("found", 256).alias("prompt_sha"))


_LETTERS = "regexp_replace({}, '[^A-Za-z ]', 'x', 'g')"


def nested_bodies(spark, sf_dir):
    """Form bodies with the prompt two JSON layers deep, among ids and addresses."""
    plain = F.regexp_replace("prompt", "[^A-Za-z ]", "x")
    said = F.concat(F.lit("Say "), plain)
    inner = F.to_json(F.array(F.lit("at_1"), F.lit("http://x.example"), F.lit("abc123"), said))
    tree = F.concat(F.lit("[null,"), F.to_json(F.array(inner, F.lit("other"))), F.lit("]"))
    body = F.concat(F.lit("f.req="), F.url_encode(tree), F.lit("&at=1"))
    return exchanges(spark, sf_dir).select("exchange_id", body.alias("body"), said.alias("said"))


@CATALOG.query(
    "nested_prompts",
    f"""WITH {EXCHANGES_SQL} SELECT exchange_id, sha256(trim('Say ' || {_LETTERS.format('prompt')})) AS prompt_sha FROM exchanges""",
)
def nested_prompts(spark, sf_dir):
    found = nested_bodies(spark, sf_dir).withColumn("found", traffic.nested_prompt("body"))
    return found.select("exchange_id", F.sha2("found", 256).alias("prompt_sha"))


@CATALOG.query(
    "nested_replacements",
    f"""WITH {EXCHANGES_SQL} SELECT exchange_id, 'Hidden ' || exchange_id AS found FROM exchanges""",
)
def nested_replacements(spark, sf_dir):
    """The found prompt replaced in flat nested arrays and read back."""
    plain = F.concat(F.lit("Say "), F.regexp_replace("prompt", "[^A-Za-z ]", "x"))
    tree = F.concat(F.lit('[null,["at_1",['), F.to_json(F.array(plain, F.lit("other"))), F.lit("]]]"))
    bodies = exchanges(spark, sf_dir).select(
        "exchange_id", F.concat(F.lit("f.req="), F.url_encode(tree)).alias("body"),
        F.concat(F.lit("Hidden "), F.col("exchange_id").cast("string")).alias("fresh"),
    )
    found = bodies.withColumn("said", traffic.nested_prompt("body"))
    changed = found.withColumn("body", traffic.nested_replace("body", "said", "fresh"))
    return changed.select("exchange_id", traffic.nested_prompt("body").alias("found"))


def event_chunks(spark, sf_dir, size: int = 500):
    """Documents as the server-sent events of two vendors: deltas for one, cumulative texts for the other."""
    docs = documents(spark, sf_dir)
    pieces = F.ceil(F.char_length("text") / size).cast("int")
    cut = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), pieces)).alias("seq"))
    even = F.col("doc_id") % 2 == 0
    delta = F.struct(
        F.lit("content_block_delta").alias("type"),
        F.struct(F.substring("text", F.col("seq") * size + 1, F.lit(size)).alias("text")).alias("delta"),
    )
    reached = F.struct(
        F.struct(F.struct(F.array(F.substring("text", F.lit(1), (F.col("seq") + 1) * size)).alias("parts")).alias("content")).alias("message")
    )
    last = F.col("seq") * size >= F.char_length("text")
    frame = F.when(last, F.lit("[DONE]")).when(even, F.to_json(delta)).otherwise(F.to_json(reached))
    return cut.select(
        F.col("doc_id").alias("stream_id"), F.col("seq").cast("bigint").alias("seq"),
        F.when(even, "claude").otherwise("chatgpt").alias("vendor"),
        F.concat(F.lit("event: x\ndata: "), frame, F.lit("\n\ndata: {broken\n")).alias("data"), last.alias("last"),
    )


@CATALOG.query(
    "sse_assembly",
    """SELECT doc_id AS stream_id, CASE WHEN doc_id % 2 = 0 THEN 'claude' ELSE 'chatgpt' END AS vendor, sha256(text) AS text_sha
       FROM documents WHERE text <> ''""",
)
def sse_assembly(spark, sf_dir):
    done = traffic.assemble(event_chunks(spark, sf_dir))
    return done.select("stream_id", "vendor", F.sha2("text", 256).alias("text_sha"))


# --- history -----------------------------------------------------------------

_MASKED = "replace(text, 'en', '[x]')"


def masked_history(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    masked = F.replace(F.col("text"), F.lit("en"), F.lit("[x]"))
    return turns.withColumn("text", F.when(F.col("role") == "assistant", masked).otherwise(F.col("text")))


def known_redactions(spark, sf_dir):
    """What was redacted late in conversations is known; the rest is not."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant' and turn >= 3")
    return said.select(
        F.replace(F.col("text"), F.lit("en"), F.lit("[x]")).alias("redacted"),
        F.col("text").alias("original"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )


_PAIRS_SQL = f"""pairs AS (SELECT sha256({_MASKED}) AS h, arg_max(text, conv_id * 1000 + turn) AS original FROM conversations
    WHERE role = 'assistant' AND turn >= 3 GROUP BY 1)"""


@CATALOG.query(
    "redaction_pairs",
    f"""WITH {TALK_SQL} SELECT sha256(final_response) AS text_hash, sha256(first(response ORDER BY turn DESC, conv_id DESC)) AS original_sha
        FROM talk WHERE response_verdict = 'redacted' AND response <> '' AND final_response <> '' GROUP BY 1""",
)
def redaction_pairs(spark, sf_dir):
    """Redacted answers of evaluated exchanges with their originals."""
    done = talk(spark, sf_dir).where("response_eval.final_verdict = 'redacted'")
    redactions = done.select(F.col("final_response").alias("redacted"), F.col("response").alias("original"), F.struct("turn", "conv_id").alias("seq"))
    pairs = history.redaction_pairs(redactions)
    return pairs.select("text_hash", F.sha2("original", 256).alias("original_sha"))


@CATALOG.query(
    "swap_back",
    f"""WITH {_PAIRS_SQL}, shown AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN {_MASKED} ELSE text END AS text
            FROM conversations)
       SELECT conv_id, turn, coalesce(role = 'assistant' AND original <> text, false) AS swapped,
              sha256(CASE WHEN role = 'assistant' AND original <> text THEN original ELSE text END) AS text_sha
       FROM shown LEFT JOIN pairs ON role = 'assistant' AND h = sha256(text)""",
)
def swap_back(spark, sf_dir):
    done = history.swap_back(masked_history(spark, sf_dir), history.redaction_pairs(known_redactions(spark, sf_dir)))
    return done.select("conv_id", "turn", "swapped", F.sha2("text", 256).alias("text_sha"))


# Assistant turns below this length are taken as block messages of a policy.
_SHORT = 900


def block_messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where((F.col("role") == "assistant") & (F.char_length("text") < _SHORT))


@CATALOG.query("block_hashes", f"WITH {TALK_SQL} SELECT DISTINCT sha256(block_message) AS text_hash FROM talk WHERE verdict = 'blocked' AND block_message <> ''")
def block_hashes(spark, sf_dir):
    """Block messages of evaluated exchanges, of both phases."""
    return history.block_hashes(talk(spark, sf_dir).where("verdict = 'blocked'"), "block_message")


def rough_history(spark, sf_dir):
    """Turns with runs of user turns and of block messages: some turns take the role of their neighbour."""
    turns = table(spark, sf_dir, "conversations")
    role = F.when((F.col("turn") % 5 == 3) & (F.col("role") == "assistant"), "user").otherwise(F.col("role"))
    return turns.withColumn("role", F.when((F.col("turn") == 4) & (F.col("role") == "user"), "assistant").otherwise(role))


_ROUGH_SQL = f"""rough AS (SELECT conv_id, turn, text, CASE WHEN turn = 4 AND role = 'user' THEN 'assistant'
      WHEN turn % 5 = 3 AND role = 'assistant' THEN 'user' ELSE role END AS role FROM conversations),
  known AS (SELECT DISTINCT text FROM conversations WHERE role = 'assistant' AND length(text) < {_SHORT} AND text <> ''),
  marked AS (SELECT *, role = 'assistant' AND text IN (SELECT text FROM known) AS b FROM rough)"""


@CATALOG.query(
    "strip_blocks",
    f"""WITH {_ROUGH_SQL}, convs AS (SELECT conv_id, list({{'t': turn, 'u': role = 'user', 'b': b, 'kept': []::STRUCT(t BIGINT, u BOOLEAN)[]}}
              ORDER BY turn) AS ts FROM marked GROUP BY conv_id),
       folded AS (SELECT conv_id, list_reduce(list_prepend({{'t': 0::BIGINT, 'u': false, 'b': false, 'kept': []::STRUCT(t BIGINT, u BOOLEAN)[]}}, ts),
           lambda a, x: {{'t': 0::BIGINT, 'u': false, 'b': false, 'kept':
             CASE WHEN NOT x.b THEN list_append(a.kept, {{'t': x.t, 'u': x.u}})
                  WHEN len(a.kept) > 0 AND a.kept[-1].u THEN a.kept[1:-2] ELSE a.kept END}}).kept AS kept FROM convs)
       SELECT conv_id, k.t AS turn FROM (SELECT conv_id, unnest(kept) AS k FROM folded)""",
)
def strip_blocks(spark, sf_dir):
    marked = history.with_blocks(rough_history(spark, sf_dir), history.block_hashes(block_messages(spark, sf_dir)))
    return history.strip_blocks(marked).select("conv_id", "turn")


@CATALOG.query("stripped_counts", f"WITH {_ROUGH_SQL} SELECT conv_id, count(*) AS dropped FROM marked WHERE b GROUP BY conv_id")
def stripped_counts(spark, sf_dir):
    marked = history.with_blocks(rough_history(spark, sf_dir), history.block_hashes(block_messages(spark, sf_dir)))
    return history.stripped_counts(marked)


@CATALOG.query(
    "purge_marked",
    f"""WITH {_ROUGH_SQL} SELECT conv_id, turn FROM (
         SELECT *, coalesce(lead(b) OVER (PARTITION BY conv_id ORDER BY turn), false) AS nb FROM marked)
       WHERE NOT b AND NOT (role = 'user' AND nb)""",
)
def purge_marked(spark, sf_dir):
    known = F.sha2("text", 256)
    rough = rough_history(spark, sf_dir)
    marked = history.with_blocks(rough, block_messages(spark, sf_dir).select(known.alias("text_hash")).where("text_hash is not null").distinct())
    return history.purge_marked(marked).select("conv_id", "turn")
