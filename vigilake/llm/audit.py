"""How document filters interact: every order of five filters, from one pass over the corpus.

The number of words and of different words of a document are the row sums and the numbers
of entries of the document-term matrix (``terms.py``). With the other conditions each document
has a set of filters that it fails; documents are counted by that set, so all orders of the
filters are worked out on a table whose size does not depend on the corpus.
"""

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import staged, table
from vigilake.llm.terms import row_stats, term_matrix

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes within a code point


def measures(data: bytes) -> list[int]:
    """Capitals A-Z, code points, and symbols of a text in UTF-8."""
    return [len(data) - len(data.translate(None, _CAPITALS)), len(data.translate(None, _FOLLOWING)), len(data) - len(data.translate(None, SYMBOLS))]


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per different (key, text, part) of ``docs``: part, digest, key, fails, n (its repeats).

    ``fails`` lists the letters of the filters that the document fails. A NULL text counts as
    empty, a NULL part as the empty string. A row without key is taken to have a larger key
    than any other; rows with equal key and text are no copies of each other.
    Other columns of ``docs`` are not looked at, whatever their names.
    """
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    labelled = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("key"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(data.cast("binary"), 256)).alias("digest"),
        data.alias("text"),
    )
    matrix, _ = term_matrix(labelled, measure=measures)
    a = F.col("__words") < MIN_WORDS
    b = 100 * F.col("__distinct") < MIN_DISTINCT_PERCENT * F.col("__words")
    c = 100 * F.col("capitals") > MAX_CAPITALS_PERCENT * F.col("points")
    rows = row_stats(matrix, measures=("capitals", "points", "symbols"))
    rows = rows.select("key", "part", "digest", a.alias("a"), b.alias("b"), c.alias("c"), (F.col("symbols") > 0).alias("d"))
    # Equal rows are counted before any shuffle, so no repeated row makes a hot key.
    rows = staged(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "audit-rows")
    first = rows.groupBy(F.col("digest").alias("same")).agg(F.min("key").alias("first"))
    # Joined on text and key together: however many copies a text has, one row of each key matches.
    at_first = (F.col("digest") == F.col("same")) & F.col("key").eqNullSafe(F.col("first"))
    marked = rows.join(first, at_first, "left").withColumn("e", F.col("same").isNull())
    letters = [F.when(F.col(x.lower()), x).otherwise("") for x in FILTERS]
    return marked.select("part", "digest", "key", F.concat(*letters).alias("fails"), "n")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``good`` and ``toxic``: whether any label of the key says so; false without a label."""
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(
        F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic")
    )
    # Rows without key match nothing and are dealt by their text.
    salted = rows.withColumn("__salt", F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("bigint")))
    known = known.withColumn("__zero", F.lit(0).cast("bigint"))
    joined = salted.join(known, (F.col("key") == F.col("__id")) & (F.col("__salt") == F.col("__zero")), "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return joined.select("part", "fails", "n", flag("good"), flag("toxic"))


def interactions(classes: DataFrame) -> DataFrame:
    """Every order and step for documents counted by (part, fails, good, toxic)."""
    counted = classes.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))
    # A few hundred combinations per part at most, each repeated for 120 orders of five steps.
    orders = F.explode(F.split(F.lit(",".join(ORDERS)), ","))
    steps = counted.select("*", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    own = F.expr("instr(fails, substring(filter_order, step, 1)) > 0")
    earlier = F.expr("length(translate(fails, substring(filter_order, 1, step - 1), '')) < length(fails)")

    def count(condition, value=None):
        return F.sum(F.when(condition, F.col("n") if value is None else value).otherwise(0)).cast("bigint")

    return steps.groupBy("part", "filter_order", "step").agg(
        count(~own & ~earlier).alias("kept"),
        count(own & ~earlier).alias("removed"),
        count(own & earlier).alias("redundant"),
        count(F.expr("fails = substring(filter_order, step, 1)")).alias("unique_fails"),
        count(own & ~earlier & F.col("good")).alias("good_lost"),
        count(own & ~earlier & F.col("toxic")).alias("toxic_lost"),
        # Of the filters that a document fails, each comes first in an equal share of the orders.
        count(own, F.expr(f"n * ({len(ORDERS)} div length(fails))")).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Counts per language, order of filters and step over all documents; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return interactions(with_labels(failures(docs), table(spark, sf_dir, "labels")))


def op13_sql() -> str:
    """DuckDB SQL for op13_filter_audit."""
    letters = " || ".join(f"CASE WHEN {x.lower()} THEN '{x}' ELSE '' END" for x in FILTERS)
    order = " || ".join(f"p{i}.x" for i in range(1, 6))
    different = " AND ".join(f"p{i}.x <> p{j}.x" for i in range(2, 6) for j in range(1, i))
    sources = ", ".join(f"letters p{i}" for i in range(1, 6))
    return rf"""WITH texts AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text,
        regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
      flagged AS (SELECT doc_id, part, len(words) < {MIN_WORDS} AS a, 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(text) AS c, regexp_matches(text, '[{SYMBOLS.decode()}]') AS d,
        doc_id > MIN(doc_id) OVER (PARTITION BY text) AS e FROM texts),
      failing AS (SELECT part, {letters} AS fails, COALESCE(quality = 1, false) AS good, COALESCE(toxic = 1, false) AS toxic
        FROM flagged LEFT JOIN labels USING (doc_id)),
      letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
      orders AS (SELECT {order} AS filter_order FROM {sources} WHERE {different}),
      classes AS (SELECT part, fails, good, toxic, COUNT(*) AS n FROM failing GROUP BY ALL),
      steps AS (SELECT *, filter_order[step] AS own, regexp_matches(fails, filter_order[step]) AS failed,
        step > 1 AND regexp_matches(fails, '[' || filter_order[1:step - 1] || 'x]') AS earlier
        FROM classes, orders, (SELECT CAST(UNNEST(range(1, 6)) AS INT) AS step)),
      counted AS (SELECT part, filter_order, step, own,
        CAST(SUM(CASE WHEN NOT failed AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
        CAST(SUM(CASE WHEN failed AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
        CAST(SUM(CASE WHEN failed AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
        CAST(SUM(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
        CAST(SUM(CASE WHEN failed AND NOT earlier AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
        CAST(SUM(CASE WHEN failed AND NOT earlier AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
        FROM steps GROUP BY ALL)
      SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted"""
