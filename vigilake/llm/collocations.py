"""Collocations of two to four words, mined with stripes.

A stripe belongs to a prefix of up to three words and holds a counter of the words that come
next. Every task builds the stripes of the text it reads; stripes of one prefix are merged
elementwise. A merged stripe gives the counts of all its extensions (its entries) and of the prefix
itself (their sum), and the stripes of longer prefixes give those of the shorter ones and
the greatest extension of each phrase.

Words rarer than the support cannot be part of a candidate, so the corpus is read into shards of
numbered words first, one dictionary says which words are frequent, and only those enter stripes.
A prefix with very many occurrences has its stripe split by the next words, as
the dictionary's counts ask, so no task gets a whole hot prefix.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import int_bytes, staged, table
from vigilake.llm.terms import BUCKET_BYTES, Vocabulary, bucket_count, by_bucket, chunks

SUPPORT = 30
TOP = 2000
SCALE = 2_000_000
LONGEST = 4
# Text bytes of a shard of numbered words.
SHARD_BYTES = 8 << 20
# Windows that one merge is meant to take, and occurrences of a pair beyond which its stripe is split.
BUCKET_ROWS = 400_000
SPLIT_ROWS = 100_000
# Groups within a language that are cut to the top before the language is.
RANK_PARTS = 64

_BREAK = b"\xff"  # in no UTF-8 text
FREQUENT = ("shard", "places", "ids", "counts", "part", "word", "word_id", "f")
_FREQUENT_TYPES = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.int64(), pa.int64())
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_BREAKS = b".,;:!?\n\v\f\r"
_CLEAN = bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + _BREAK * len(_BREAKS) + b" ")


def pieces(data: bytes) -> bytes:
    """Lower-case ``data`` with every piece boundary as a word of its own."""
    return data.translate(_CLEAN).replace(_BREAK, b" \xff ")


_BLOCK = pa.struct([("bucket", pa.int32()), ("places", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.binary())])


def word_shards(docs: DataFrame, text: str, part: str, buckets: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards (shard, part, tokens, n, blocks): texts of one part as numbers of the shard's own words.

    Token 0 is a boundary between pieces. ``blocks`` hold the words, their numbers and
    counts by bucket of the dictionary; ``n`` is the sum of the counts.
    """
    wanted = docs.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("und")).alias("part"), F.col(f"`{text}`").cast("binary").alias("data"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = {}, 0

        def shards():
            for name, (vocabulary, found) in open_.items():
                tokens = np.concatenate(found)
                counts = np.bincount(tokens, minlength=len(vocabulary))[1:]
                blocks = [
                    {"bucket": k, "places": int_bytes(places + 1), "words": words, "counts": int_bytes(counts[places])}
                    for k, places, words in by_bucket(list(vocabulary)[1:], buckets, name.encode())
                ]
                columns = {
                    "part": pa.array([name], pa.string()),
                    "tokens": pa.array([int_bytes(tokens)], pa.binary()),
                    "n": pa.array([int(counts.sum())], pa.int64()),
                    "blocks": pa.array([blocks], pa.list_(_BLOCK)),
                }
                yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for name, value in zip(batch.column("part"), batch.column("data"), strict=True):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                if open_ and held + len(data) > shard_bytes:
                    yield from shards()
                    open_, held = {}, 0
                name = name.as_py()
                if name not in open_:
                    open_[name] = Vocabulary({_BREAK: 0}), [np.zeros(1, np.int32)]
                vocabulary, found = open_[name]
                for chunk in chunks(pieces(data)):
                    words = chunk.split()
                    found.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                found.append(np.zeros(1, np.int32))
                held += len(data)
        yield from shards()

    made = wanted.mapInArrow(pack, "part string, tokens binary, n bigint, blocks array<struct<bucket: int, places: binary, words: array<binary>, counts: binary>>")
    return staged(made.select(F.monotonically_increasing_id().alias("shard"), "*"), "word-shards")


def frequent_words(shards: DataFrame, buckets: int, support: int) -> DataFrame:
    """Words with at least ``support`` occurrences, in two kinds of rows.

    With a shard: its ``places``, ``ids`` and ``counts`` (over the corpus) of frequent words. Without
    one: a frequent word's part, word, word_id (from 1) and f.
    """

    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")  # the same numbers whenever this runs
        sizes = np.array([len(x) for x in rows.column("words")])
        part = rows.column("part").combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        # No word holds a line feed, so the last one ends the part.
        named = pc.binary_join_element_wise(part.cast(pa.binary()), pa.concat_arrays([x.values for x in rows.column("words")]), b"\n")
        encoded = named.dictionary_encode()
        index = encoded.indices.to_numpy()
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("counts")])
        f = np.zeros(len(encoded.dictionary), np.int64)
        np.add.at(f, index, counts)
        ids = np.cumsum(f >= support) * buckets - rows.column("bucket")[0].as_py()
        if len(ids) and ids[-1] >= 1 << 31:
            raise ValueError("more than 2^31 frequent words; raise the support")
        out = {c: [] for c in FREQUENT}
        bounds = np.append(0, np.cumsum(sizes))
        for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            kept = np.flatnonzero(f[index[a:b]] >= support)
            places = np.frombuffer(rows.column("places")[row].as_buffer(), "<i4")[kept]
            known = index[a:b][kept]
            values = rows.column("shard")[row].as_py(), int_bytes(places), int_bytes(ids[known]), f[known].astype("<i8").tobytes()
            for c, v in zip(FREQUENT, (*values, None, None, None, None), strict=True):
                out[c].append(v)
        for k in np.flatnonzero(f >= support):
            part_of, _, word = encoded.dictionary[int(k)].as_py().rpartition(b"\n")
            for c, v in zip(FREQUENT, (None, None, None, None, part_of.decode(), word, int(ids[k]), int(f[k])), strict=True):
                out[c].append(v)
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), _FREQUENT_TYPES, strict=True)})

    blocks = shards.select("shard", "part", F.inline("blocks"))
    schema = "shard bigint, places binary, ids binary, counts binary, part string, word binary, word_id bigint, f bigint"
    return staged(blocks.groupBy("bucket").applyInArrow(number, schema), "frequent-words")


def _mixed(*values: np.ndarray) -> np.ndarray:
    h = np.zeros(len(values[0]), np.uint64)
    for v in values:
        h = (h ^ v.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def windows(tokens: np.ndarray, local: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Different windows of four frequent words and their counts, in order of their words.

    ``local`` gives a token's place among the ``size`` frequent words, from 1, or 0. A window that a
    boundary or a rare word ends is filled up with 0; windows of one word are left out.
    """
    w = np.concatenate([local[tokens], np.zeros(3, np.int64)])
    first = np.flatnonzero((w[:-3] > 0) & (w[1:-2] > 0))
    second, third, fourth = w[first + 1], w[first + 2], w[first + 3]
    fourth = np.where(third > 0, fourth, 0)
    base = size + 1
    if base**4 < 1 << 63:
        keys, n = np.unique(((w[first] * base + second) * base + third) * base + fourth, return_counts=True)
        keys, fourth = np.divmod(keys, base)
    else:
        keys = (w[first] * base + second) * base + third if base**3 < 1 << 63 else None
        order = np.lexsort((fourth, keys) if keys is not None else (fourth, third, second, w[first]))
        rows = np.stack([w[first], second, third, fourth])[:, order]
        new = np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]) if rows.shape[1] else np.empty(0, bool)
        at = np.flatnonzero(new)
        return *rows[:, at], np.diff(np.append(at, rows.shape[1]))
    keys, third = np.divmod(keys, base)
    first, second = np.divmod(keys, base)
    return first, second, third, fourth, n


STRIPES = "bucket int, w1 binary, w2 binary, w3 binary, split binary, sizes binary, next binary, n binary"


def stripes(shards: DataFrame, frequent: DataFrame, buckets: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Blocks of stripes: prefixes (w1, w2, w3), the sizes of their stripes, and the entries (next, n).

    ``split`` is 1 where a pair's stripes lie in several buckets and 2 where one prefix's do.
    """
    # A shard's own list of words is as long as the shard, not as the corpus.
    named = frequent.groupBy("shard").agg(F.collect_list(F.struct("places", "ids", "counts")).alias("known"))
    joined = shards.select("shard", "tokens").join(named, "shard")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), "<i4")
                known = batch.column("known")[i].values
                place, ids, f = (
                    np.concatenate([np.frombuffer(x.as_buffer(), t) for x in known.field(c)]).astype(np.int64) for c, t in (("places", "<i4"), ("ids", "<i4"), ("counts", "<i8"))
                )
                if not len(place):
                    continue
                order = np.argsort(ids)
                place, ids, f = place[order], np.append(0, ids[order]), np.append(0, f[order])
                local = np.zeros(max(int(tokens.max(initial=0)), int(place.max())) + 1, np.int64)
                local[place] = np.arange(1, len(ids))
                a, b, c, d, n = windows(tokens, local, len(ids) - 1)
                if not len(n):
                    continue
                pair = np.minimum(f[a], f[b])
                parts2 = -(-pair // split_rows)
                parts3 = np.where(c > 0, -(-np.minimum(pair, f[c]) // split_rows), 1)
                by_third = _mixed(ids[c]) % parts2.astype(np.uint64)
                by_next = _mixed(ids[d]) % parts3.astype(np.uint64)
                bucket = (_mixed(ids[a], ids[b], by_third, by_next) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, n = bucket[order], n[order]
                a, b, c, d = (ids[x[order]] for x in (a, b, c, d))
                split = ((parts2 > 1).astype(np.int64) + (parts3 > 1))[order]
                starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                for low, high in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
                    s = slice(low, high)
                    heads = np.flatnonzero(np.append(True, (np.diff(a[s]) != 0) | (np.diff(b[s]) != 0) | (np.diff(c[s]) != 0)))
                    prefix = [x[s][heads] for x in (a, b, c, split)]
                    arrays = [*prefix, np.diff(np.append(heads, high - low)), d[s], n[s]]
                    columns = [pa.array([int(bucket[low])], pa.int32())] + [pa.array([int_bytes(x)], pa.binary()) for x in arrays]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "w1", "w2", "w3", "split", "sizes", "next", "n"])

    return joined.mapInArrow(build, STRIPES)


def merge(blocks: DataFrame, support: int) -> DataFrame:
    """(words, a): phrases of two to four words with at least ``support`` occurrences."""

    def merged(table: pa.Table) -> pa.Table:
        def ints(c):
            return np.concatenate([np.frombuffer(v.as_buffer(), "<i4") for v in table.column(c)]).astype(np.int64)

        sizes, n = ints("sizes"), ints("n")
        head, tail = np.repeat(ints("w1") << 32 | ints("w2"), sizes), np.repeat(ints("w3"), sizes) << 32 | ints("next")
        split = np.repeat(ints("split"), sizes)
        order = np.lexsort((tail, head))
        head, tail, split, n = head[order], tail[order], split[order], n[order]

        def summed(new):
            at = np.flatnonzero(np.append(True, new))
            return at, np.add.reduceat(n, at)

        new_head = head[1:] != head[:-1]
        out = []
        for level, new in ((4, new_head | (tail[1:] != tail[:-1])), (3, new_head | (tail[1:] >> 32 != tail[:-1] >> 32)), (2, new_head)):
            at, total = summed(new)
            third, fourth = tail[at] >> 32, tail[at] & 0xFFFFFFFF
            # A sum over part of a split stripe is kept whatever it is.
            part = split[at] >= {4: 3, 3: 2, 2: 1}[level]
            keep = ((total >= support) | part) & {4: fourth > 0, 3: third > 0, 2: np.ones(len(at), bool)}[level]
            words = [head[at] >> 32, head[at] & 0xFFFFFFFF, third, fourth][:level]
            zero = np.zeros(int(keep.sum()), np.int64)
            out.append(([w[keep] for w in words] + [zero] * (LONGEST - level), total[keep]))
        arrays = [pa.array(np.concatenate([rows[k] for rows, _ in out])) for k in range(LONGEST)]
        return pa.Table.from_arrays([*arrays, pa.array(np.concatenate([t for _, t in out]))], names=["w1", "w2", "w3", "w4", "n"])

    found = blocks.groupBy("bucket").applyInArrow(merged, "w1 bigint, w2 bigint, w3 bigint, w4 bigint, n bigint")
    counted = found.groupBy("w1", "w2", "w3", "w4").agg(F.sum("n").alias("a")).where(F.col("a") >= support)
    return counted.select(F.filter(F.array("w1", "w2", "w3", "w4"), lambda w: w > 0).alias("words"), "a")


def collocations(docs: DataFrame, text: str = "text", part: str = "lang", support: int = SUPPORT, top: int = TOP, **sizes) -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): each part's ``top`` phrases of two to four words.

    A NULL part is ``und``, a NULL text is empty; repeated rows count as often as they are there;
    a phrase's ties are broken by its count, then its bytes. A table without frequent phrases gives no rows. Other
    columns of ``docs`` are not looked at, whatever their names. ``sizes`` may set
    shard_bytes, bucket_bytes, bucket_rows and split_rows; the result does not depend on them.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    buckets = bucket_count(docs, text, sizes.get("bucket_bytes", BUCKET_BYTES))
    shards = word_shards(docs, text, part, buckets, sizes.get("shard_bytes", SHARD_BYTES))
    known = frequent_words(shards, buckets, support)
    frequent, dictionary = known.where(F.col("shard").isNotNull()), known.where(F.col("shard").isNull()).select("part", "word", "word_id", "f")
    totals = staged(shards.groupBy("part").agg(F.sum("n").alias("n")), "part-totals")
    everything = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-everything // sizes.get("bucket_rows", BUCKET_ROWS)))
    blocks = stripes(shards, frequent, buckets, sizes.get("split_rows", SPLIT_ROWS))
    phrases = staged(merge(blocks, support), "phrases")

    single = dictionary.select(F.array("word_id").alias("words"), F.col("f").alias("a"))
    parts = phrases.where(F.size("words") < LONGEST).union(single)
    cut = phrases.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cut = cut.select("*", F.expr("slice(words, 1, k)").alias("left"), F.expr("slice(words, k + 1, size(words) - k)").alias("right"))
    cut = cut.join(parts.select(F.col("words").alias("left"), F.col("a").alias("l")), "left")
    cut = cut.join(parts.select(F.col("words").alias("right"), F.col("a").alias("r")), "right")
    wide_cut = cut.select("words", "a", "k", "l", "r", (wide("a") * SCALE).alias("top"), (wide("l") + wide("r")).alias("bottom"))
    scored = wide_cut.select("words", "a", F.struct(F.expr("`top` div bottom").alias("score"), "k", "l", "r").alias("cut"))
    lowest = scored.groupBy("words").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    # What contains a phrase and is two words longer contains a phrase of one word more that is as frequent or more.
    longer = phrases.where(F.size("words") > 2)
    inner = F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))
    greatest = longer.select(F.explode(inner).alias("words"), "a").groupBy("words").agg(F.max("a").alias("ext"))
    subsumed = F.coalesce(wide("ext") * 100 >= wide("a") * 80, F.lit(False))
    kept = staged(lowest.join(greatest, "words", "left").where(~subsumed).select("words", "a", "cut"), "collocations")

    spelt = kept.select("words", F.posexplode("words").alias("pos", "word_id")).join(dictionary, "word_id")
    spelt = spelt.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("word").cast("string").alias("word")))).alias("spelt"), F.first("part").alias("part"))
    named = staged(kept.join(spelt, "words").select("part", F.concat_ws(" ", "spelt.word").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"), "named")

    # Only rows whose score is among the first ``top`` of their part, in steps of a few percent, are ranked.
    step = F.floor(16 * F.log2(F.col("score") + 1))
    steps = named.groupBy("part", step.alias("step")).agg(F.count("*").alias("rows"))
    above = F.sum("rows").over(Window.partitionBy("part").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1))
    least = steps.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < top).groupBy("part").agg(F.min("step").alias("__least"))
    named = named.join(least, "part").where(step >= F.col("__least")).drop("__least")

    def first_of(df, *keys):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        return df.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)

    few = first_of(named.withColumn("__range", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))), "part", "__range")
    ranked = first_of(few.drop("rank", "__range"), "part")
    return ranked.join(totals, "part").select("part", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang")).withColumnRenamed("part", "lang")


def op12_sql(support: int = SUPPORT, top: int = TOP) -> str:
    """DuckDB SQL for op12_collocations, from all occurrences of all phrases."""
    upper, lower = _UPPER.decode(), _UPPER.lower().decode()
    return rf"""WITH pieces AS (SELECT COALESCE(lang, 'und') AS lang,
        UNNEST(string_split_regex(translate(COALESCE(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
      split AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
      placed AS (SELECT lang, p, UNNEST(w) AS x, generate_subscripts(w, 1) AS i FROM split),
      led AS (SELECT lang, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o] AS w FROM placed WINDOW o AS (PARTITION BY p ORDER BY i)),
      counted AS (SELECT lang, k, w[1:k] AS words, COUNT(*) AS f FROM led, (SELECT UNNEST(range(1, 5)) AS k) WHERE w[k] IS NOT NULL GROUP BY ALL),
      totals AS (SELECT lang, SUM(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
      candidates AS (SELECT lang, k AS len, words, f AS a FROM counted WHERE k >= 2 AND f >= {support}),
      cuts AS (SELECT c.*, UNNEST(range(1, len)) AS k FROM candidates c),
      scored AS (SELECT c.lang, c.len, c.words, c.a, c.k, x.f AS l, y.f AS r, {SCALE}::HUGEINT * c.a // (x.f + y.f) AS score
        FROM cuts c JOIN counted x ON x.lang = c.lang AND x.words = c.words[1:c.k] JOIN counted y ON y.lang = c.lang AND y.words = c.words[c.k + 1:]),
      lowest AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM scored),
      inside AS (SELECT d.lang, d.a, d.words[i:i + m - 1] AS words FROM candidates d, (SELECT UNNEST(range(2, 4)) AS m), (SELECT UNNEST(range(1, 4)) AS i)
        WHERE m < d.len AND i + m - 1 <= d.len),
      greatest AS (SELECT lang, words, MAX(a) AS ext FROM inside GROUP BY ALL),
      kept AS (SELECT l.*, array_to_string(l.words, ' ') AS phrase FROM lowest l LEFT JOIN greatest g ON g.lang = l.lang AND g.words = l.words
        WHERE place = 1 AND NOT COALESCE(100::HUGEINT * ext >= 80::HUGEINT * a, false)),
      ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
      SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
      FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
