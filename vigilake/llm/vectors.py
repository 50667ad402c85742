"""Embedding near-duplicates by cross-polytope hashing.

Vectors are rotated by rounds of random signs and the fast Hadamard transform; the
nearest signed axis of a rotation is one hash, several make a bucket, and each table
also probes the next-best buckets. How many tables a wanted recall needs is computed
from simulated pairs at the threshold itself. Buckets are cut into blocks, pairs of
blocks are compared by exact cosines in double precision, and a pair counts only in
the first bucket where it meets, so a crowded bucket costs arithmetic, not rows.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import components, staged, table

THRESHOLD = 0.95
MISS = 0.002  # expected share of pairs at the threshold that meet in no bucket
PROBES = 2  # buckets per table that a vector is posted in, best first
BLOCK = 256  # vectors of a bucket that are compared at a time
GROUP = 2_000  # rows of small buckets that go to one call
BUCKET_LOAD = 8  # vectors a bucket should hold if they were spread evenly


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


@dataclass(frozen=True)
class Plan:
    """Hash functions of one dimension: ``tables`` tables of ``depth`` rotations each."""

    dim: int
    depth: int
    tables: int
    seed: int = 11

    @property
    def padded(self) -> int:
        return max(2, 1 << (self.dim - 1).bit_length())

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(n x tables x PROBES) bucket numbers of unit vectors; the first probe is the nearest axes."""
        n, d = len(x), self.padded
        wide = np.zeros((n, d))
        wide[:, : self.dim] = x
        rng = np.random.default_rng([self.seed, self.dim])
        out = np.zeros((n, self.tables, PROBES), np.int64)
        for t in range(self.tables):
            first, second, gap = [], [], []
            for _ in range(self.depth):
                turned = wide
                for _ in range(3):
                    turned = hadamard(turned * rng.choice([-1.0, 1.0], d))
                size = np.abs(turned)
                top = np.argpartition(-size, 1, axis=1)[:, :2]
                swap = size[np.arange(n), top[:, 0]] < size[np.arange(n), top[:, 1]]
                top[swap] = top[swap][:, ::-1]
                axis = 2 * top + (np.take_along_axis(turned, top, 1) < 0)
                first.append(axis[:, 0])
                second.append(axis[:, 1])
                best = np.take_along_axis(size, top, 1)
                gap.append(best[:, 0] - best[:, 1])
            # The next-best bucket changes the rotation whose two largest coordinates are closest.
            weakest = np.argmin(np.array(gap), axis=0)
            out[:, t] = 0
            for k in range(self.depth):
                out[:, t, 0] = out[:, t, 0] * (2 * d) + first[k]
                out[:, t, 1] = out[:, t, 1] * (2 * d) + np.where(weakest == k, second[k], first[k])
        return out


@lru_cache(maxsize=64)
def plan_for(dim: int, rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> Plan:
    """Depth from the number of vectors, tables from how often pairs at the threshold meet.

    The meeting rate is measured on simulated pairs whose cosine is the threshold, so
    recall does not fall when more rows ask for finer buckets.
    """
    axes = 2 * max(2, 1 << (dim - 1).bit_length())
    depth = max(1, math.ceil(math.log(max(rows / BUCKET_LOAD, 2), axes)))
    rng = np.random.default_rng(5)
    a = rng.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim == 1:
        return Plan(dim, depth, 1)
    b = rng.normal(size=(2000, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * b
    trial = Plan(dim, depth, 8)
    x, y = trial.buckets(a), trial.buckets(b)
    rate = float((x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean())
    rate = min(max(rate, 0.01), 0.999999)
    return Plan(dim, depth, max(2, math.ceil(math.log(miss) / math.log(1 - rate))))


def unit_rows(vectors: list) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that extreme values neither overflow nor vanish."""
    x = np.array([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> F.Column:
    """Not NULL or empty, all components finite, and not zero."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    parts = F.col(vector).cast("array<double>")
    return F.coalesce((F.size(parts) > 0) & ~F.exists(parts, bad) & F.exists(parts, lambda v: v != 0), F.lit(False))


CALL = ["dim", "part", "own_slot", "own_bucket", "own_left", "own_right"]


def in_calls(postings: DataFrame) -> DataFrame:
    """Postings (dim, slot, bucket, cls) once for each pair of blocks they meet in; ``CALL`` says which are compared in one call.

    Most buckets are tiny: about GROUP rows of many of them are one call. A pair of blocks
    of a larger bucket is a call of its own, so no call grows with the table.
    """
    sizes = staged(postings.groupBy("dim", "slot", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    parts = max(1, math.ceil((sizes.where(F.col("n") <= BLOCK).agg(F.sum("n")).first()[0] or 0) / GROUP))
    listed = postings.join(sizes, ["dim", "slot", "bucket"])
    # A bucket is cut into blocks by a hash; block i meets the blocks j >= i.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    cut = listed.withColumns({"many": blocks > 1, "blocks": blocks, "own": own})
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("left"), F.greatest("own", j).alias("right")))
    spread = cut.select("dim", "slot", "bucket", "many", "cls", "own", F.inline(meetings))
    place = {f"own_{c}": F.when(F.col("many"), F.col(c)) for c in ("slot", "bucket", "left", "right")}
    return spread.withColumns(place).withColumn("part", F.when(~F.col("many"), F.pmod(F.xxhash64("slot", "bucket"), F.lit(parts))))


def near_links(classes: DataFrame, rows_by_dim: dict[int, int], threshold: float = THRESHOLD) -> DataFrame:
    """(kind, a, b, n) from ``classes`` (cls, dim, vec, weight), distinct usable vectors.

    kind 0: ``n`` rows are linked to class ``a`` in one comparison of blocks; kind 1: classes
    ``a`` and ``b`` are connected. For each block, connections are a spanning forest, so
    what is sent on grows with the vectors, not with their pairs.
    """
    plans = {dim: plan_for(dim, rows, threshold) for dim, rows in rows_by_dim.items()}

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                for at in range(0, len(part), 4096):
                    rows = part.iloc[at : at + 4096]
                    found = plans[dim].buckets(unit_rows(list(rows["vec"])))
                    n, tables, probes = found.shape
                    yield pd.DataFrame({
                        "dim": dim, "slot": np.tile(np.repeat(np.arange(tables), probes), n), "bucket": found.reshape(-1), "cls": np.repeat(rows["cls"].to_numpy(), tables * probes),
                    })

    postings = staged(classes.select("cls", "dim", "vec").mapInPandas(post, "dim int, slot int, bucket bigint, cls bigint").distinct(), "vector-postings")
    grouped = in_calls(postings).join(classes.select("cls", "vec", "weight"), "cls")

    def compare(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slot", "bucket", "left", "right", "cls"], ignore_index=True)
        x = unit_rows(list(group["vec"]))
        probes = plans[int(keys[0])].buckets(x)
        own, cls, weight = group["own"].to_numpy(), group["cls"].to_numpy(), group["weight"].to_numpy()
        places = group[["slot", "bucket", "left", "right"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]).any(axis=1)]))
        counts, edges = np.zeros(len(group), np.int64), []
        tree = list(range(len(group)))

        def root(i):
            while tree[i] != i:
                tree[i] = tree[tree[i]]
                i = tree[i]
            return i

        for begin, end in zip(starts, [*starts[1:], len(group)], strict=True):
            slot, bucket, left, right = places[begin].tolist()
            for at in range(begin, end, BLOCK):
                i, j = np.nonzero(x[at : min(at + BLOCK, end)] @ x[begin:end].T >= threshold)
                i, j = i + at, j + begin
                keep = (i < j) & ((own[i] == left) & (own[j] == right) | (own[i] == right) & (own[j] == left))
                i, j = i[keep], j[keep]
                # Count a pair only in the first table and bucket where it meets.
                for k in range(0, len(i), 65_536):
                    a, b = i[k : k + 65_536], j[k : k + 65_536]
                    same = (probes[a][:, :, :, None] == probes[b][:, :, None, :]).any(axis=3)
                    first = same.any(axis=2).argmax(axis=1)
                    within = np.take_along_axis(same, first[:, None, None], 1)[:, 0].argmax(axis=1)
                    mine = (first == slot) & (probes[a, first, within] == bucket)
                    a, b = a[mine], b[mine]
                    np.add.at(counts, a, weight[b])
                    np.add.at(counts, b, weight[a])
                    for p, q in zip(a.tolist(), b.tolist(), strict=True):
                        p, q = root(p), root(q)
                        if p != q:
                            tree[max(p, q)] = min(p, q)
                            edges.append((1, cls[p], cls[q], 0))
        rows = [(0, cls[i], -1, counts[i]) for i in np.flatnonzero(counts)] + edges
        return pd.DataFrame(rows, columns=["kind", "a", "b", "n"])

    return grouped.groupBy(*CALL).applyInPandas(compare, "kind int, a bigint, b bigint, n bigint")


def dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    Rows with equal vectors are one class and link with each other. A row whose vector
    links with nothing is its own component. NULL keys never name a component that has
    another key; a row is kept if its key is its component's.
    """
    # Adding zero makes -0.0 equal to 0.0.
    values = F.transform(F.col(vector).cast("array<double>"), lambda v: v + F.lit(0.0))
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.when(usable(vector), values).alias("vec"))
    rows = staged(rows.withColumn("cls", F.xxhash64("vec")), "vectors")
    good = rows.where("vec IS NOT NULL")
    # 64-bit hashes name the classes; a shared hash with different vectors would be an error, so it is looked for.
    classes = good.groupBy("cls").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("key").alias("smallest"), F.min(F.hash("vec")).alias("low"), F.max(F.hash("vec")).alias("high"))
    classes = staged(classes.withColumn("dim", F.size("vec")), "vector-classes")
    if classes.where("low <> high").limit(1).count():
        raise ValueError("two vectors share a 64-bit class number; use another hash")
    dims = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = staged(near_links(classes, dims, threshold), "vector-links")
    linked = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    joined = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = classes.join(joined.withColumnRenamed("node", "cls"), "cls", "left").join(linked, "cls", "left")
    rooted = staged(rooted.select("cls", "weight", "smallest", F.coalesce("root", "cls").alias("root"), F.coalesce("n", F.lit(0)).alias("n")), "vector-roots")
    named = staged(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "vector-components")
    final = staged(rooted.join(named, "root").select("cls", "component_id", (F.col("n") + F.col("weight") - 1).alias("n_links")), "vector-classes-final")
    own = good.join(final, "cls").select("key", "n_links", "component_id")
    alone = rows.where("vec IS NULL").select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    return own.union(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
