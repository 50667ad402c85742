"""Language identification by a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over a
fixed-length window and classified by a softmax. The network is trained in numpy
on a bounded sample of labelled rows; prediction runs over every window of every
whole text inside the tasks, and a document takes the byte-weighted mean of its
windows' log-probabilities.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import crc_bucket, staged, table

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED = 8
FILTERS = 16
UNKNOWN = "und"
# Bound of the training sample: texts per language.
SAMPLE_PER_LANGUAGE = 1500
# Windows of one forward pass in a task: bounds its memory whatever the text's length.
BATCH_WINDOWS = 1024


@dataclass
class ByteCnn:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: dict[int, np.ndarray]  # width -> (width * EMBED) x FILTERS
    bias: np.ndarray  # over all filters
    dense: np.ndarray  # all filters x languages
    offset: np.ndarray

    def tables(self) -> list[tuple[int, list[np.ndarray]]]:
        """Per width the filter response to each byte at each offset, pairs of offsets merged.

        A filter over embedded bytes is a sum of one looked-up row per offset; rows
        of two offsets are added up beforehand, so four bytes cost two look-ups.
        """
        made = []
        for width in WIDTHS:
            rows = [self.embed @ self.filters[width][j * EMBED : (j + 1) * EMBED] for j in range(width)]
            merged = [(rows[j][:, None, :] + rows[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, width - 1, 2)]
            made.append((width, [t.astype(np.float32) for t in merged + ([rows[-1]] if width % 2 else [])]))
        return made


def _pooled(windows: np.ndarray, tables: list) -> np.ndarray:
    """Max-pooled filter responses of byte windows (n x WINDOW, zero padded)."""
    n = len(windows)
    pairs = (windows[:, :-1].astype(np.intp) << 8) | windows[:, 1:]
    out = []
    for width, parts in tables:
        places = WINDOW - width + 1
        total = np.zeros((n, places, FILTERS), np.float32)
        for j, part in enumerate(parts):
            index = pairs[:, 2 * j : 2 * j + places] if len(part) == 65536 else windows[:, 2 * j : 2 * j + places].astype(np.intp)
            total += part[index]
        out.append(total.max(axis=1))
    return np.concatenate(out, axis=1)


def log_probabilities(model: ByteCnn, windows: np.ndarray, tables: list) -> np.ndarray:
    hidden = np.maximum(_pooled(windows, tables) + model.bias, 0)
    logits = hidden @ model.dense + model.offset
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def windows_of(data: bytes) -> np.ndarray:
    """All fixed-length windows of a text's bytes, the last one padded with zeros."""
    n = -(-len(data) // WINDOW)
    flat = np.zeros(n * WINDOW, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return flat.reshape(n, WINDOW)


def train(samples: list[tuple[bytes, str]], seed: int = 7, epochs: int = 8) -> ByteCnn | None:
    """Fit the network; None without samples. Windows are also cut short, so that short texts are learnt too."""
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in samples})
    code = {lang: i for i, lang in enumerate(languages)}
    rows, target = [], []
    for data, lang in samples:
        for row in windows_of(data)[:2]:
            rows.append(row)
            target.append(code[lang])
    x, y = np.array(rows), np.array(target)
    size = FILTERS * len(WIDTHS)
    params = {"embed": rng.normal(0, 0.3, (256, EMBED)), "bias": np.zeros(size), "dense": rng.normal(0, 0.2, (size, len(languages))), "offset": np.zeros(len(languages))}
    params |= {w: rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS}
    params = {k: v.astype(np.float32) for k, v in params.items()}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    weight = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            batch = x[pick].copy()
            cut = np.where(rng.random(len(pick)) < 0.4, rng.integers(12, WINDOW, len(pick)), WINDOW)
            batch[np.arange(WINDOW)[None, :] >= cut[:, None]] = 0
            grads = _gradients(params, batch, y[pick], weight)
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= 0.004 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(languages, params["embed"], {w: params[w] for w in WIDTHS}, params["bias"], params["dense"], params["offset"])


def _gradients(params: dict, batch: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    n = len(batch)
    embedded = params["embed"][batch]
    pooled, places, columns = [], [], []
    for w in WIDTHS:
        stacked = np.concatenate([embedded[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
        response = stacked @ params[w]
        best = response.argmax(axis=1)
        pooled.append(np.take_along_axis(response, best[:, None, :], 1)[:, 0])
        places.append(best)
        columns.append(stacked)
    before = np.concatenate(pooled, axis=1) + params["bias"]
    hidden = np.maximum(before, 0)
    logits = hidden @ params["dense"] + params["offset"]
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p *= (weight[y] / n)[:, None]
    back = (p @ params["dense"].T) * (before > 0)
    grads = {"dense": hidden.T @ p, "offset": p.sum(axis=0), "bias": back.sum(axis=0), "embed": np.zeros_like(params["embed"])}
    for k, w in enumerate(WIDTHS):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        taken = columns[k][np.arange(n)[:, None], places[k]]  # only the pooled places have a gradient
        grads[w] = np.einsum("nfd,nf->df", taken, part)
        inward = np.einsum("nf,df->nfd", part, params[w]).reshape(n, FILTERS, w, EMBED)
        bytes_at = batch[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(w)]
        np.add.at(grads["embed"], bytes_at.reshape(-1), inward.reshape(-1, EMBED))
    return grads


def training_sample(docs: DataFrame, text: str, lang: str, learn: Column, order: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """Up to ``per_language`` labelled texts per language, those with the smallest ``order`` hash.

    Two windows of bytes are taken from each, at a place that depends on the hash.
    Ranks are cut before the shuffle, so a language with most rows is no hot key.
    """
    usable = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    data = F.col(text).cast("binary")
    room = F.greatest(F.octet_length(data) - 2 * WINDOW, F.lit(0))
    cut = F.substring(data, (F.pmod(order, room + 1) + 1).cast("int"), F.lit(2 * WINDOW))
    ranked = usable.select(F.col(lang).alias("lang"), order.alias("order"), cut.alias("data"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "data"))
    kept = ranked.withColumn("rank", rank).where(F.col("rank") <= per_language)
    return sorted((bytes(r.data), r.lang) for r in kept.select("data", "lang").collect())


def predict(docs: DataFrame, model: ByteCnn | None, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its probability to every row of ``docs``.

    A text that is NULL, empty or without a letter gets ``und`` and 0.0, and so does
    every text when nothing could be learnt. Columns called ``out`` or ``score`` are replaced.
    """

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = model.tables() if model else []
        for texts in batches:
            yield pd.DataFrame(_score(model, tables, texts), columns=["lang", "score"])

    found = docs.withColumn("__language", scored(F.col(text).cast("binary")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (out, score)]
    return found.select(*kept, F.col("__language.lang").alias(out), F.col("__language.score").alias(score))


def _score(model: ByteCnn | None, tables: list, texts: pd.Series) -> list[tuple[str, float]]:
    out = [(UNKNOWN, 0.0)] * len(texts)
    if model is None:
        return out
    waiting, owners, lengths, held = [], [], [], 0
    totals = np.zeros((len(texts), len(model.languages)))

    def flush():
        nonlocal held
        rows = np.concatenate(waiting)
        owner, length = np.concatenate(owners), np.concatenate(lengths)
        for at in range(0, len(rows), BATCH_WINDOWS):
            logs = log_probabilities(model, rows[at : at + BATCH_WINDOWS], tables)
            np.add.at(totals, owner[at : at + BATCH_WINDOWS], logs * length[at : at + BATCH_WINDOWS, None])
        waiting.clear(), owners.clear(), lengths.clear()
        held = 0

    sizes = np.ones(len(texts))
    seen = np.zeros(len(texts), bool)
    for i, data in enumerate(texts):
        if data is None or not any(map(str.isalpha, bytes(data).decode("utf-8", "replace"))):
            continue
        rows = windows_of(bytes(data))
        size = np.full(len(rows), WINDOW, float)
        size[-1] = len(data) - WINDOW * (len(rows) - 1)
        seen[i], sizes[i] = True, len(data)
        waiting.append(rows), owners.append(np.full(len(rows), i)), lengths.append(size)
        held += len(rows)
        if held >= 4 * BATCH_WINDOWS:
            flush()
    if held:
        flush()
    mean = totals / sizes[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    for i in np.flatnonzero(seen):
        out[i] = (model.languages[best[i]], float(p[i, best[i]]))
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteCnn | None:
    """Learn from the rows whose crc32(id) mod 3 is not 1 and whose language is known."""
    learn = F.coalesce(crc_bucket(F.col(key), 3) != 1, F.lit(False))
    return train(training_sample(docs, text, lang, learn, F.xxhash64(F.col(key))))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return predict(docs, fit(docs)).select("doc_id", held, "lang_pred", "score")


# Below this probability no learnt language is believable; a text of one clear word is well above it.
REJECT_BELOW = 0.3


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents without a recognisable language go."""
    columns = docs.columns
    named = predict(docs, fit(docs), out="__lang_pred", score="__lang_score")
    return named.where((F.col("__lang_pred") != UNKNOWN) & (F.col("__lang_score") >= REJECT_BELOW)).select(*columns)


__all__ = ["ByteCnn", "fit", "predict", "staged", "train"]
