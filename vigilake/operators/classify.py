"""Classification of text columns into class hits with spans."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.once import with_once
from vigilake.functions.text import spans
from vigilake.operators.taxonomy import NER, Taxonomy

HIT = "struct<cls:string,start:int,end:int,text:string,location:string,ord:int>"
TOUCHED = "struct<class:string,instances:bigint,in_prompt:boolean,in_response:boolean>"
ENTITY = "struct<label:string,start:int,end:int,text:string>"
LOCATIONS = ("prompt", "response")

# A recognizer gets a batch of texts and gives, per text, (label, start, end) triples.
Recognizer = Callable[[list[str]], list[list[tuple[str, int, int]]]]


def _entities_udf(recognizer: Recognizer):
    @F.pandas_udf(f"array<{ENTITY}>")
    def entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            known = batch.fillna("").tolist()
            yield pd.Series(
                [
                    [{"label": lab, "start": b, "end": e, "text": text[b:e]} for lab, b, e in found]
                    for text, found in zip(known, recognizer(known))
                ]
            )

    return entities


def _tagged(found: Column, cls: str) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(F.lit(cls).alias("cls"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")),
    )


def _labelled(entities: Column, label: str) -> Column:
    return F.filter(entities, lambda e: e["label"] == label)


def hit_array(text: Column, taxonomies: list[Taxonomy], location: str, entities: Column | None = None) -> Column:
    """Hits of every class of every taxonomy, in declared order, as one array column."""
    if location not in LOCATIONS:
        raise ValueError(f"a location is one of {LOCATIONS}, got {location!r}")
    per_class = []
    for data_class in (c for t in taxonomies for c in t.classes):
        if data_class.recognizer == NER:
            if entities is None:
                raise ValueError(f"{data_class.name}: this class needs an entity recognizer and none was given")
            found = _labelled(entities, data_class.pattern)
        else:
            found = spans(text, data_class.pattern)
        per_class.append(_tagged(found, data_class.name))
    numbered = F.transform(
        F.concat(*per_class),
        lambda h, i: F.struct(
            h["cls"].alias("cls"),
            h["start"].alias("start"),
            h["end"].alias("end"),
            h["text"].alias("text"),
            F.lit(location).alias("location"),
            i.alias("ord"),
        ),
    )
    return F.coalesce(numbered, F.array().cast(f"array<{HIT}>"))


def with_hits(
    df: DataFrame,
    text: str,
    taxonomies: list[Taxonomy],
    location: str = "prompt",
    out: str = "hits",
    recognizer: Recognizer | None = None,
) -> DataFrame:
    """Add the hit array of ``text``. One narrow stage, no shuffle."""
    needs_entities = any(c.recognizer == NER for t in taxonomies for c in t.classes)
    if not needs_entities:
        return with_once(df, {out: hit_array(F.col(text), taxonomies, location)})
    if recognizer is None:
        hit_array(F.col(text), taxonomies, location)  # raises, naming the class
    found = f"__entities_{out}"
    tagged = df.withColumn(found, _entities_udf(recognizer)(F.col(text)))
    return with_once(tagged, {out: hit_array(F.col(text), taxonomies, location, F.col(found))}).drop(found)


def hit_rows(df: DataFrame, keys: list[str], hits: str = "hits") -> DataFrame:
    """One row per hit: the keys and the hit's fields."""
    return df.select(*keys, F.inline(hits))


def data_classes(hits: Column) -> Column:
    """Per class, in order of first hit: how often and where it was seen. In-row, no shuffle."""
    classes = F.array_distinct(F.transform(hits, lambda h: h["cls"]))

    def fold(cls):
        of_class = F.filter(hits, lambda h: h["cls"] == cls)
        return F.struct(
            cls.alias("class"),
            F.size(of_class).cast("bigint").alias("instances"),
            F.exists(of_class, lambda h: h["location"] == "prompt").alias("in_prompt"),
            F.exists(of_class, lambda h: h["location"] == "response").alias("in_response"),
        )

    return F.transform(classes, fold).cast(f"array<{TOUCHED}>")


def with_expectation(df: DataFrame, expected: str, hits: str = "hits") -> DataFrame:
    """Compare found classes with an ``expected`` array: true / false positives and misses per row."""
    got = F.array_distinct(F.transform(F.col(hits), lambda h: h["cls"]))
    scored = df.withColumn("got", F.array_sort(got))
    want = F.array_distinct(expected)
    return scored.withColumns(
        {
            "tp": F.size(F.array_intersect("got", want)),
            "fp": F.size(F.array_except("got", want)),
            "fn": F.size(F.array_except(want, F.col("got"))),
        }
    )


def quality(scored: DataFrame) -> DataFrame:
    """Micro precision and recall over a table made by :func:`with_expectation`."""
    sums = scored.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])

    def ratio(other):
        total = F.col("tp") + F.col(other)
        return F.when(total == 0, F.lit(1.0)).otherwise(F.col("tp") / total)

    return sums.withColumns({"precision": ratio("fp"), "recall": ratio("fn")})


def mismatches(scored: DataFrame) -> DataFrame:
    """Rows whose found classes differ from the expected ones."""
    return scored.where((F.col("fp") > 0) | (F.col("fn") > 0))
