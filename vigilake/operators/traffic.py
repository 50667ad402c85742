"""Logged API bodies of five vendor surfaces, normalised to prompt and response text.

Each body is parsed once into a VARIANT; a surface is a set of column
expressions over it, chosen by the ``surface`` column inside one narrow stage.
"""

import json
from urllib.parse import parse_qsl, quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigilake.functions import variant as V
from vigilake.functions.once import with_once
from vigilake.functions.text import strip

GEMINI, ANTHROPIC, CHATGPT, CHATGPT_WEB, CLAUDE_WEB = SURFACES = (
    "gemini", "anthropic", "chatgpt", "chatgpt_web", "claude_web",
)

# How texts are joined, and the names the bodies use for roles.
JOINT = "\n\n"
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = {
    GEMINI: ("model",),
    ANTHROPIC: ("assistant",),
    CHATGPT: ("assistant",),
    CHATGPT_WEB: ("assistant",),
    CLAUDE_WEB: ("assistant", "model"),
}
TURN = "struct<pos:int,role:string,text:string>"

# Segments of a stream are joined first per this many chunks, then per stream.
SEGMENT_CHUNKS = 1024


def _known(texts: Column) -> Column:
    return F.filter(texts, lambda t: t.isNotNull())


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda t: F.coalesce(t != "", F.lit(False)))


def _is_text_block(block: Column) -> Column:
    return F.coalesce(V.string_at(block, "$.type") == "text", F.lit(False))


def _block_texts(items: Column, plain: bool = False) -> Column:
    """Texts of the blocks of type text; with ``plain`` also bare strings."""

    def one(block):
        text = F.when(_is_text_block(block), V.string_at(block, "$.text"))
        text = F.when(text != "", text)
        return F.coalesce(text, V.string_at(block, "$")) if plain else text

    return _known(F.transform(items, one))


def _part_texts(holder: Column, path: str = "$.parts") -> Column:
    return _filled(F.transform(V.list_at(holder, path), lambda p: V.string_at(p, "$.text")))


def _string_parts(holder: Column, path: str) -> Column:
    return _filled(F.transform(V.list_at(holder, path), lambda p: V.string_at(p, "$")))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _messages(body: Column, surface: str) -> Column:
    return V.list_at(body, "$.contents" if surface == GEMINI else "$.messages")


def _role(message: Column, surface: str) -> Column:
    if surface == CHATGPT_WEB:
        return V.string_at(message, "$.author.role")
    role = V.string_at(message, "$.role")
    return F.coalesce(F.nullif(role, F.lit("")), V.string_at(message, "$.sender")) if surface == CLAUDE_WEB else role


def _content_or_text(message: Column) -> Column:
    """``content`` unless it is missing or empty, then ``text``."""
    content = V.at(message, "$.content")
    empty = V.kind(content).isin("VOID") | F.coalesce(V.string_at(content, "$") == "", F.lit(False))
    empty = empty | (V.is_array(content) & (F.size(V.list_at(content, "$")) == 0))
    return F.when(content.isNull() | empty, V.at(message, "$.text")).otherwise(content)


def _message_texts(message: Column, surface: str, plain: bool = False) -> Column:
    if surface == GEMINI:
        return _part_texts(message)
    if surface == CHATGPT_WEB:
        return _string_parts(message, "$.content.parts")
    content = _content_or_text(message) if surface == CLAUDE_WEB else V.at(message, "$.content")
    single = _known(F.array(V.string_at(content, "$")))
    if surface == CHATGPT:
        return single
    return F.when(V.is_array(content), _block_texts(V.list_at(content, "$"), plain)).otherwise(single)


def prompt_text(body: Column, surface: str) -> Column:
    """System text and the last user message, joined by a blank line."""
    messages = _messages(body, surface)

    def by_user(m):
        mine = F.coalesce(_role(m, surface).isin(*(USER_ROLES if surface == CLAUDE_WEB else ("user",))), F.lit(False))
        if surface == CHATGPT:
            # Only a user message of plain text ends the search.
            return mine & V.string_at(m, "$.content").isNotNull()
        if surface == CHATGPT_WEB:
            content = V.at(m, "$.content")
            return mine & (content.isNull() | V.is_object(content))
        return mine

    user = _message_texts(_last(F.filter(messages, by_user)), surface, plain=True)
    none = F.array().cast("array<string>")
    if surface == GEMINI:
        first = V.at(body, "$.systemInstruction")
        chosen = F.when(F.size(V.fields_of(first)) > 0, first).otherwise(V.at(body, "$.system_instruction"))
        system = _part_texts(chosen)
    elif surface == ANTHROPIC:
        system = F.when(V.is_array(V.at(body, "$.system")), _block_texts(V.list_at(body, "$.system"))).otherwise(
            _known(F.array(V.string_at(body, "$.system")))
        )
    elif surface in (CHATGPT, CHATGPT_WEB):
        spoken = F.filter(messages, lambda m: F.coalesce(_role(m, surface) == "system", F.lit(False)))
        system = F.flatten(F.transform(spoken, lambda m: _message_texts(m, surface)))
    else:
        top = none
        for key in ("content", "text", "prompt"):
            text = strip(V.string_at(body, f"$.{key}"))
            here = F.when(text != "", F.array(text)).otherwise(_block_texts(V.list_at(body, f"$.{key}"), plain=True))
            top = F.when(F.size(here) > 0, here).otherwise(top)
        return strip(F.array_join(F.when(F.size(top) > 0, top).otherwise(F.coalesce(user, none)), JOINT))
    return strip(F.array_join(F.concat(system, F.coalesce(user, none)), JOINT))


def response_text(payload: Column, surface: str) -> Column:
    """All text parts of the answer, joined by a blank line."""
    if surface == GEMINI:
        texts = F.flatten(F.transform(V.list_at(payload, "$.candidates"), lambda c: _part_texts(c, "$.content.parts")))
    elif surface == ANTHROPIC:
        texts = _block_texts(V.list_at(payload, "$.content"))
    elif surface == CHATGPT:
        texts = _filled(F.transform(V.list_at(payload, "$.choices"), lambda c: V.string_at(c, "$.message.content")))
    elif surface == CHATGPT_WEB:
        texts = _string_parts(payload, "$.message.content.parts")
    else:
        blocks = F.array_join(_block_texts(V.list_at(payload, "$.content")), JOINT)
        return F.coalesce(V.string_at(payload, "$.completion"), V.string_at(payload, "$.content"), blocks)
    return F.array_join(texts, JOINT)


def _text_block(text: Column) -> Column:
    return V.obj(type=F.lit("text"), text=text)


def _array(items: Column) -> Column:
    return F.to_variant_object(items)


def _first_text_replaced(items: Column, is_text, fresh: Column) -> Column:
    """Items with the first text one replaced, other text ones dropped and the rest kept."""
    flags = F.transform(items, is_text)
    first = F.array_position(flags, F.lit(True)) - 1
    placed = F.transform(
        items,
        lambda p, i: F.struct((~is_text(p) | (i == first)).alias("keep"), F.when(i == first, fresh).otherwise(p).alias("item")),
    )
    kept = F.transform(F.filter(placed, lambda s: s["keep"]), lambda s: s["item"])
    return F.when(first < 0, F.concat(F.array(fresh), items)).otherwise(kept)


def _has_text(part: Column) -> Column:
    return V.is_object(part) & V.at(part, "$.text").isNotNull()


def _set(holder: Column, key: str, value: Column, path: str = "$") -> Column:
    """The object at ``path`` with ``key`` set, as a VARIANT."""
    return F.to_variant_object(V.with_field(V.fields_of(holder, path), key, value))


def _with_parts(holder: Column, text: Column, path: str = "$") -> Column:
    parts = V.list_at(holder, f"{path}.parts")
    return _set(holder, "parts", _array(_first_text_replaced(parts, _has_text, V.obj(text=text))), path)


def _with_blocks(holder: Column, text: Column) -> Column:
    blocks = V.list_at(holder, "$.content")
    return _set(holder, "content", _array(_first_text_replaced(blocks, _is_text_block, _text_block(text))))


def _replace_head(items: Column, head: Column) -> Column:
    return F.concat(F.array(head), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))))


def rewrite_response(payload: Column, surface: str, text: Column) -> Column:
    """The answer with its text replaced, as a VARIANT; parts that are not text stay."""
    if surface == GEMINI:
        all_ = V.list_at(payload, "$.candidates")
        fresh = V.obj(
            content=V.obj(role=F.lit("model"), parts=F.array(V.obj(text=text))), finishReason=F.lit("STOP"), index=F.lit(0)
        )
        first = F.get(all_, F.lit(0))
        head = _set(first, "content", _with_parts(first, text, "$.content"))
        return _set(payload, "candidates", _array(F.when(F.size(all_) == 0, F.array(fresh)).otherwise(_replace_head(all_, head))))
    if surface == ANTHROPIC:
        return _with_blocks(payload, text)
    if surface == CHATGPT:
        all_ = V.list_at(payload, "$.choices")
        fresh = V.obj(
            message=V.obj(role=F.lit("assistant"), content=text), finish_reason=F.lit("stop"), index=F.lit(0)
        )
        first = F.get(all_, F.lit(0))
        head = _set(first, "message", _set(first, "content", V.scalar(text), "$.message"))
        return _set(payload, "choices", _array(F.when(F.size(all_) == 0, F.array(fresh)).otherwise(_replace_head(all_, head))))
    if surface == CHATGPT_WEB:
        content = _set(payload, "parts", _array(F.array(text)), "$.message.content")
        return _set(payload, "message", _set(payload, "content", content, "$.message"))
    return (
        F.when(F.map_contains_key(V.fields_of(payload), "completion"), _set(payload, "completion", V.scalar(text)))
        .when(V.is_array(V.at(payload, "$.content")), _with_blocks(payload, text))
        .otherwise(_set(payload, "content", V.scalar(text)))
    )


def rewrite_turn(message: Column, surface: str, text: Column) -> Column:
    """An assistant turn of a request body with its text replaced, as a VARIANT."""
    if surface == GEMINI:
        return _with_parts(message, text)
    if surface == CHATGPT:
        return _set(message, "content", V.scalar(text))
    if surface == CHATGPT_WEB:
        return _set(message, "content", _set(message, "parts", _array(F.array(text)), "$.content"))
    plain = _set(message, "content", V.scalar(text))
    replaced = F.when(V.is_array(V.at(message, "$.content")), _with_blocks(message, text)).otherwise(plain)
    if surface == ANTHROPIC:
        return replaced
    return F.when(F.map_contains_key(V.fields_of(message), "content"), replaced).otherwise(
        _set(message, "text", V.scalar(text))
    )


def turn_array(body: Column, surface: str) -> Column:
    """All turns of a request body: position, role (user / assistant / as written) and text."""

    def one(message, i):
        role = _role(message, surface)
        said = (
            F.when(role.isin(*ASSISTANT_ROLES[surface]), F.lit("assistant")).when(role.isin(*USER_ROLES), F.lit("user")).otherwise(role)
        )
        return F.struct(
            i.alias("pos"), said.alias("role"), F.array_join(_message_texts(message, surface), JOINT).alias("text")
        ).cast(TURN)

    return F.transform(_messages(body, surface), one)


def block_payload(surface: str, model: Column, message: Column, now: Column, marker: str = "policy-block") -> Column:
    """A block message in the vendor's response shape, as JSON text."""
    millis = F.unix_millis(now).cast("string")
    if surface == GEMINI:
        shape = F.struct(
            F.array(
                F.struct(
                    F.struct(F.lit("model").alias("role"), F.array(F.struct(message.alias("text"))).alias("parts")).alias("content"),
                    F.lit("OTHER").alias("finishReason"),
                    F.lit(0).alias("index"),
                    F.array().cast("array<string>").alias("safetyRatings"),
                )
            ).alias("candidates"),
            model.alias("modelVersion"),
        )
    elif surface in (ANTHROPIC, CLAUDE_WEB):
        shape = F.struct(
            F.concat(F.lit(f"msg_{marker.replace('-', '_')}_"), millis).alias("id"),
            F.lit("message").alias("type"),
            F.lit("assistant").alias("role"),
            model.alias("model"),
            F.array(F.struct(F.lit("text").alias("type"), message.alias("text"))).alias("content"),
            F.lit("end_turn").alias("stop_reason"),
            F.lit(None).cast("string").alias("stop_sequence"),
            F.struct(F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens")).alias("usage"),
        )
    elif surface == CHATGPT:
        answer = F.struct(F.lit("assistant").alias("role"), message.alias("content"))
        shape = F.struct(
            F.concat(F.lit(f"chatcmpl-{marker}-"), millis).alias("id"),
            F.lit("chat.completion").alias("object"),
            F.unix_timestamp(now).alias("created"),
            model.alias("model"),
            F.array(
                F.struct(F.lit(0).alias("index"), answer.alias("message"), F.lit("content_filter").alias("finish_reason"))
            ).alias("choices"),
            F.struct(*[F.lit(0).alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")]).alias("usage"),
        )
    else:
        shape = F.struct(
            F.struct(
                F.lit(f"msg-{marker}").alias("id"),
                F.struct(F.lit("assistant").alias("role")).alias("author"),
                F.struct(F.lit("text").alias("content_type"), F.array(message).alias("parts")).alias("content"),
                F.lit("finished").alias("status"),
            ).alias("message")
        )
    return F.to_json(shape, {"ignoreNullFields": "false"})


def per_surface(make, surfaces: tuple[str, ...] = SURFACES, column: str = "surface") -> Column:
    """``make(surface)`` for the row's surface; NULL for an unknown one."""
    chosen = None
    for name in surfaces:
        here = F.col(column) == name
        chosen = F.when(here, make(name)) if chosen is None else chosen.when(here, make(name))
    return chosen


def parsed(traffic: DataFrame) -> DataFrame:
    """Add the bodies as VARIANT columns ``request`` and ``response``; NULL where unreadable."""
    return with_once(
        traffic,
        {"request": V.parse_strict(F.col("request_body")), "response": V.parse_strict(F.col("response_body"))},
    )


def normalise(traffic: DataFrame) -> DataFrame:
    """Logged bodies to exchanges: adds ``prompt`` and ``response`` texts.

    A call without an answer, or with an unreadable one, stays and has an empty response.
    """
    bodies = parsed(traffic)
    request, answer = F.col("request"), F.col("response")
    return with_once(
        bodies.withColumnRenamed("response", "__response"),
        {
            "prompt": per_surface(lambda s: prompt_text(request, s)),
            "response": per_surface(lambda s: response_text(F.col("__response"), s)),
        },
    ).drop("request", "__response")


def assistant_turns(traffic: DataFrame, keys: list[str]) -> DataFrame:
    """Assistant turns of request bodies as rows (keys, pos, text)."""
    turns = per_surface(lambda s: turn_array(F.col("request"), s))
    listed = with_once(parsed(traffic), {"__turns": turns})
    rows = listed.select(*keys, F.inline("__turns"))
    return rows.where(F.col("role") == "assistant").select(*keys, "pos", "text")


def redacted_responses(traffic: DataFrame, text: str) -> DataFrame:
    """Add ``rewritten``: the response body with its text replaced by the column ``text``; NULL without an answer."""
    new = F.col(text)
    bodies = parsed(traffic)
    answered = F.col("response").isNotNull()
    made = with_once(bodies, {"__new": F.when(answered, per_surface(lambda s: rewrite_response(F.col("response"), s, new)))})
    return made.withColumn("rewritten", F.to_json("__new")).drop("__new", "request", "response")


def generic_prompt(body: Column) -> Column:
    """Prompt of a body of unknown shape: a top-level text, else the last user message with text."""
    top = F.coalesce(*[V.string_at(body, f"$.{k}") for k in ("prompt", "text", "content")])

    def role(m):
        named = [V.string_at(m, p) for p in ("$.role", "$.author.role", "$.sender")]
        return F.coalesce(*[F.nullif(n, F.lit("")) for n in named])

    def text(m):
        content = _content_or_text(m)
        blocks = F.array_join(_block_texts(V.list_at(content, "$"), plain=True), JOINT)
        return F.coalesce(V.string_at(content, "$"), F.when(V.is_array(content), blocks))

    mine = F.filter(V.list_at(body, "$.messages"), lambda m: F.coalesce(role(m).isin(*USER_ROLES), F.lit(False)))
    return F.coalesce(top, _last(_known(F.transform(mine, text))))


# Which strings inside a nested request are no prompt.
_ID_CHARS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-")
_FORM_FIELD = "f.req"


def _is_prompt(text: str) -> bool:
    units = len(text.encode("utf-16-le", "surrogatepass")) // 2
    short_id = units <= 10 and bool(text) and set(text) <= _ID_CHARS
    return units > 3 and not text.startswith("at_") and "http" not in text and not short_id


def _find_prompt(tree):
    """First prompt-like string, depth first; JSON inside strings is opened."""
    pending = [tree]
    while pending:
        item = pending.pop()
        if isinstance(item, list):
            pending.extend(reversed(item))
        elif isinstance(item, str):
            text = item.strip()
            if text[:1] in ("[", "{"):
                try:
                    pending.append(json.loads(text))
                except (ValueError, RecursionError):
                    continue
            elif _is_prompt(text):
                return text
    return None


def _replace_first(tree, old: str, new: str) -> bool:
    """Replace the first string equal to ``old`` in nested arrays; strings are not opened."""
    pending = [(tree, i) for i in reversed(range(len(tree)))] if isinstance(tree, list) else []
    while pending:
        holder, i = pending.pop()
        item = holder[i]
        if isinstance(item, str) and item.strip() == old:
            holder[i] = new
            return True
        if isinstance(item, list):
            pending.extend((item, j) for j in reversed(range(len(item))))
    return False


def _form_tree(body):
    pairs = parse_qsl(body, keep_blank_values=True) if body else []
    for i, (name, value) in enumerate(pairs):
        if name == _FORM_FIELD:
            try:
                return pairs, i, json.loads(value)
            except (ValueError, RecursionError):
                return pairs, i, None
    return pairs, -1, None


@F.pandas_udf(StringType())
def nested_prompt(bodies: pd.Series) -> pd.Series:
    """Prompt of a form-encoded body whose field holds nested arrays of unbounded depth."""
    return bodies.map(lambda body: _find_prompt(_form_tree(body)[2]))


@F.pandas_udf(StringType())
def nested_replace(bodies: pd.Series, prompts: pd.Series, texts: pd.Series) -> pd.Series:
    """The same body with the found prompt replaced."""

    def one(body, prompt, text):
        pairs, i, tree = _form_tree(body)
        if tree is None or prompt is None or text is None:
            return body
        _replace_first(tree, prompt, text)
        pairs[i] = (_FORM_FIELD, json.dumps(tree, separators=(",", ":"), ensure_ascii=False))
        written = (f"{quote_plus(k, safe='*')}={quote_plus(v, safe='*')}" for k, v in pairs)
        return "&".join(written).replace("~", "%7E")

    return pd.Series([one(*row) for row in zip(bodies, prompts, texts)])


def frame_text(data: Column, vendor: Column) -> Column:
    """Text a chunk of server-sent events adds (claude) or has reached (chatgpt)."""
    lines = F.transform(F.split(data, "\n", -1), strip)
    marked = F.filter(lines, lambda line: line.startswith("data: "))
    bodies = F.transform(marked, lambda line: strip(F.substring(line, 7, F.length(line))))
    frames = F.transform(F.filter(bodies, lambda b: b != "[DONE]"), V.parse_strict)

    def reached(frame):
        return F.array_join(F.transform(V.list_at(frame, "$.message.content.parts"), lambda p: V.text_at(p, "$")), "")

    def delta(frame):
        ours = V.string_at(frame, "$.type") == "content_block_delta"
        return F.when(ours, V.string_at(frame, "$.delta.text"))

    # The longest text of a chunk counts; of equally long ones the first.
    longest = F.aggregate(
        F.transform(frames, reached),
        F.lit(""),
        lambda best, text: F.when(F.length(text) > F.length(best), text).otherwise(best),
    )
    return F.when(vendor == "chatgpt", longest).otherwise(F.array_join(_known(F.transform(frames, delta)), ""))


def assemble(chunks: DataFrame) -> DataFrame:
    """Whole text of every stream from its chunks (stream_id, seq, vendor, data).

    Cumulative streams: the last chunk with text. Delta streams: all texts in
    order, joined per segment of chunks first, so no task sorts a whole long stream.
    """
    texts = with_once(chunks, {"__text": frame_text(F.col("data"), F.col("vendor"))}).where("__text <> ''")
    segment = F.floor(F.col("seq") / SEGMENT_CHUNKS).alias("segment")
    cumulative = F.col("vendor") == "chatgpt"
    appended = F.when(~cumulative, F.struct("seq", F.col("__text").alias("text")))
    segments = texts.groupBy("stream_id", "vendor", segment).agg(
        F.max_by(F.when(cumulative, F.col("__text")), "seq").alias("last"),
        F.array_join(F.array_sort(F.collect_list(appended))["text"], "").alias("joined"),
    )
    parts = F.array_sort(F.collect_list(F.struct("segment", "joined")))
    return segments.groupBy("stream_id", "vendor").agg(
        F.when(F.col("vendor") == "chatgpt", F.max_by("last", "segment"))
        .otherwise(F.array_join(parts["joined"], ""))
        .alias("text")
    )
