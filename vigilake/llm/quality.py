"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and its neighbours;
forward-backward gives each line's marginal, and the length-weighted mean of the
marginals is the document's quality, mapped to a probability on the training rows.
The model is trained in numpy on a bounded sample of labelled documents.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import crc_bucket, staged, table

# Bounds of the training sample: documents per label, and lines of each that are used.
SAMPLE_PER_LABEL = 3000
SAMPLE_LINES = 64
KNOTS = 4
THRESHOLD = 0.7

LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
WHITE = b" \t\r\x0b\x0c"

OWN = 8  # real features of one line


def line_features(line: bytes) -> tuple[float, ...]:
    """Log length, letters, capitals, digits, marks, distinct words, word length, doubled words: all of one line."""
    n = len(line)
    if not n:
        return (0.0,) * OWN
    letters = n - len(line.translate(None, LETTERS))
    upper, digits = n - len(line.translate(None, UPPER)), n - len(line.translate(None, DIGITS))
    white = n - len(line.translate(None, WHITE))
    words = line.split()
    count = max(1, len(words))
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    return (
        float(np.log1p(n)), letters / n, upper / max(1, letters), digits / n, (n - letters - digits - white) / n,
        len(set(words)) / count ** 0.9, min(30.0, n / count), doubled / count,
    )


def chain_features(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths) of a text; an empty text is one empty line."""
    lines = (data or b"").split(b"\n")
    own = np.array([line_features(line) for line in lines])
    same = np.array([0.0, *(float(a == b and len(a) > 0) for a, b in zip(lines, lines[1:], strict=False))])
    none = np.full((1, OWN), -1.0)
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    lengths = np.array([len(line) for line in lines], float) + 1e-6
    return np.concatenate([own, before, after, same[:, None]], axis=1), lengths


@dataclass
class LineCrf:
    knots: np.ndarray  # features x KNOTS
    weights: np.ndarray  # of the good label's score; the bad label's is 0
    moves: np.ndarray  # 2 x 2
    slope: float
    shift: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Each feature as a constant-size set of steps, so that the score need not be linear in it."""
        steps = (x[:, :, None] > self.knots[None]).reshape(len(x), -1)
        return np.concatenate([steps, np.ones((len(x), 1))], axis=1).astype(np.float32)


def marginals(good: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over a batch of chains (batch x lines): P(good), expected moves per chain, log Z."""
    batch, lines = good.shape
    scores = np.stack([np.zeros_like(good), good], axis=2)
    forward = np.zeros((batch, lines, 2))
    forward[:, 0] = scores[:, 0]
    for t in range(1, lines):
        came = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1])
        forward[:, t] = np.where(mask[:, t, None], came + scores[:, t], forward[:, t - 1])
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    backward = np.zeros((batch, lines, 2))
    expected = np.zeros((batch, 2, 2))
    for t in range(lines - 2, -1, -1):
        onward = scores[:, t + 1] + backward[:, t + 1]
        both = moves[None] + onward[:, None, :]
        expected += np.where(mask[:, t + 1, None, None], np.exp(forward[:, t, :, None] + both - total[:, None, None]), 0)
        backward[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(both[:, :, 0], both[:, :, 1]), 0)
    posterior = np.exp(forward + backward - total[:, None, None])
    return posterior[:, :, 1] / posterior.sum(axis=2), expected, total


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, parts))
    out, mask = np.zeros((len(parts), longest)), np.zeros((len(parts), longest), bool)
    for i, part in enumerate(parts):
        out[i, : len(part)], mask[i, : len(part)] = part, True
    return out, mask


def train(samples: list[tuple[bytes, int]], rounds: int = 120) -> LineCrf | None:
    """Fit on documents: their lines take the document's label, and weights are kept small.

    Lines that occur in good and bad documents alike get weights near zero, and the
    chain lets their neighbours decide. None if there is no sample.
    """
    if not samples:
        return None
    chains = [chain_features(data) for data, _ in samples]
    chains = [(x[:SAMPLE_LINES], n[:SAMPLE_LINES]) for x, n in chains]
    label = np.array([y for _, y in samples])
    stacked = np.concatenate([x for x, _ in chains])
    knots = np.quantile(stacked, (np.arange(KNOTS) + 0.5) / KNOTS, axis=0).T
    # Plain knots miss rare extremes: two more at the ends of the range seen.
    knots = np.concatenate([knots, np.quantile(stacked, [0.02, 0.06, 0.94, 0.98], axis=0).T], axis=1)
    model = LineCrf(knots, np.zeros(knots.size + 1), np.array([[0.5, -0.5], [-0.5, 0.5]]), 1.0, 0.0)
    x = model.expand(stacked)
    sizes = [len(n) for _, n in chains]
    ends = np.cumsum(sizes)
    _, mask = padded([np.zeros(s) for s in sizes])
    gold = np.repeat(label, sizes).astype(float)
    balance = len(label) / (2.0 * np.bincount(label, minlength=2).clip(1))
    weight = balance[label] / np.array(sizes)  # every document counts alike
    gold_moves = np.zeros((len(label), 2, 2))
    gold_moves[np.arange(len(label)), label, label] = np.array(sizes) - 1
    first, second = [np.zeros_like(model.weights), np.zeros((2, 2))], [np.zeros_like(model.weights), np.zeros((2, 2))]
    for step in range(1, rounds + 1):
        flat = x @ model.weights
        good, _ = padded(np.split(flat, ends[:-1]))
        p, expected, _ = marginals(good, model.moves, mask)
        error = (p[mask] - gold) * np.repeat(weight, sizes) / len(label)
        grads = [x.T @ error + 1e-4 * model.weights, ((expected - gold_moves) * weight[:, None, None]).mean(axis=0) + 0.05 * model.moves]
        for i, (value, grad) in enumerate(zip((model.weights, model.moves), grads, strict=True)):
            first[i] += 0.1 * (grad - first[i])
            second[i] += 0.01 * (grad * grad - second[i])
            value -= 0.08 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    raw = np.array([_quality(model, c) for c in chains])
    _calibrate(model, raw, label)
    return model


def _quality(model: LineCrf, chain: tuple[np.ndarray, np.ndarray]) -> float:
    """Log-odds of the length-weighted mean marginal."""
    x, lengths = chain
    good = model.expand(x) @ model.weights
    p, _, _ = marginals(good[None], model.moves, np.ones((1, len(good)), bool))
    return _odds(float((p[0] * lengths).sum() / lengths.sum()))


def _odds(mean):
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def _calibrate(model: LineCrf, raw: np.ndarray, label: np.ndarray) -> None:
    """Logistic map from aggregated log-odds to the probability of label 1."""
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -30, 30)))
        balance = len(label) / (2.0 * np.bincount(label, minlength=2).clip(1))
        error = (p - label) * balance[label]
        model.slope -= 0.02 * float((error * raw).mean())
        model.shift -= 0.1 * float(error.mean())
    model.slope = max(model.slope, 1e-3)


def scores(model: LineCrf | None, texts) -> np.ndarray:
    """Probability of good quality for each text; 0.5 if nothing could be learnt.

    Chains of like length are run together, in blocks, so memory follows the longest text of a block.
    """
    out = np.full(len(texts), 0.5)
    if model is None or not len(texts):
        return out
    for at in range(0, len(texts), 256):
        chains = [chain_features(None if t is None else bytes(t)) for t in texts[at : at + 256]]
        flat = model.expand(np.concatenate([x for x, _ in chains])) @ model.weights
        parts = np.split(flat, np.cumsum([len(n) for _, n in chains])[:-1])
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        begin = 0
        while begin < len(order):
            # As many chains as stay within twice the shortest one's length.
            end = begin + 1
            while end < len(order) and len(parts[order[end]]) <= 2 * len(parts[order[begin]]) + 8:
                end += 1
            group = order[begin:end]
            good, mask = padded([parts[i] for i in group])
            p, _, _ = marginals(good, model.moves, mask)
            for row, i in enumerate(group):
                lengths = chains[i][1]
                mean = float((p[row, : len(lengths)] * lengths).sum() / lengths.sum())
                out[at + i] = 1 / (1 + np.exp(-np.clip(model.slope * _odds(mean) + model.shift, -30, 30)))
            begin = end
    return out


def with_quality(docs: DataFrame, model: LineCrf | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add the quality score of every whole text; a NULL text counts as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(model, list(texts)))

    return docs.withColumn(out, scored(F.col(text).cast("binary")))


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> list[tuple[bytes, int]]:
    """Up to ``per_label`` documents of each label whose crc32(id) mod 4 is not 2, by the hash of their id.

    The ids are chosen from the labels alone, so the texts that are read are few:
    at most two labels times ``per_label`` ids are broadcast. An id with both labels is left out.
    """
    learnable = labels.where(F.col("quality").isin(0, 1) & (crc_bucket(F.col("doc_id"), 4) != 2))
    agreed = learnable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__top")).where("quality = __top")
    rank = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = staged(agreed.withColumn("__rank", rank).where(F.col("__rank") <= per_label).select("doc_id", "quality"), "quality-sample")
    found = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")).join(F.broadcast(chosen), "doc_id")
    # One text per id where ids repeat, and of each text at most the lines that are used.
    lines = F.substring("data", 1, 400 * SAMPLE_LINES)
    taken = found.groupBy("doc_id", "quality").agg(F.min(lines).alias("data"))
    return sorted((bytes(r.data), int(r.quality)) for r in taken.select("data", "quality").collect())


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(training_sample(docs, labels.select("doc_id", "quality")))
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    scored = with_quality(docs, model)
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
