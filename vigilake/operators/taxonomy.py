"""Sensitive-data taxonomies: small driver-side config turned into Java patterns."""

import re
from dataclasses import dataclass
from importlib import resources
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import variant as V
from vigilake.functions.once import with_once
from vigilake.functions.text import REGEX_FLAGS

REGEX, KEYWORDS, NER = "regex", "keyword_list", "spacy_ner"
RECOGNIZERS = (REGEX, KEYWORDS, NER)


class TaxonomyError(ValueError):
    pass


@dataclass(frozen=True)
class DataClass:
    """One class of a taxonomy; ``pattern`` is a Java regex, or a label for NER."""

    name: str
    recognizer: str
    pattern: str


@dataclass(frozen=True)
class Taxonomy:
    namespace: str
    classes: tuple[DataClass, ...]


def _java_regex(pattern: str, owner: str) -> str:
    """Check a pattern and rewrite the constructs Java spells differently."""
    try:
        compiled = re.compile(pattern)
    except re.error as exc:
        raise TaxonomyError(f"{owner}: invalid regex: {exc}") from exc
    for probe in ("", "a", "1", " ", "a 1"):
        if any(m.start() == m.end() for m in compiled.finditer(probe)):
            raise TaxonomyError(f"{owner}: pattern can match the empty string")
    if "(?P=" in pattern or "(?P>" in pattern:
        raise TaxonomyError(f"{owner}: named back-references are not supported")
    return REGEX_FLAGS + pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


def _keyword_regex(words: list) -> str:
    ordered = sorted((re.sub(r"([^\w\s]|_)", r"\\\1", str(w)) for w in words), key=len, reverse=True)
    # Looking at the first letter before the word boundary halves the scan time and changes no match.
    first = "".join(sorted({w[:2] if w[0] == "\\" else w[0] for w in ordered}))
    return REGEX_FLAGS + f"(?=[{first}])" + r"\b(?:" + "|".join(ordered) + r")\b"


def _data_class(namespace: str, entry) -> DataClass:
    if not isinstance(entry, dict):
        raise TaxonomyError(f"{namespace}: class entries must be mappings, got {entry!r}")
    name, recognizer, pattern = (entry.get(k) for k in ("class", "recognizer", "pattern"))
    if not name or not recognizer or pattern is None:
        raise TaxonomyError(f"{namespace}: class, recognizer and pattern are all required in {entry!r}")
    full = f"{namespace}:{name}"
    if recognizer == REGEX:
        if not isinstance(pattern, str):
            raise TaxonomyError(f"{full}: a regex pattern is a string")
        return DataClass(full, recognizer, _java_regex(pattern, full))
    if recognizer == KEYWORDS:
        if not isinstance(pattern, list) or not pattern:
            raise TaxonomyError(f"{full}: a keyword pattern is a non-empty list")
        return DataClass(full, recognizer, _keyword_regex(pattern))
    if recognizer == NER:
        if not isinstance(pattern, str):
            raise TaxonomyError(f"{full}: an entity label is a string")
        return DataClass(full, recognizer, pattern)
    raise TaxonomyError(f"{full}: recognizer {recognizer!r} is none of {', '.join(RECOGNIZERS)}")


def taxonomy(namespace: str, classes: list) -> Taxonomy:
    if not namespace or ":" in namespace:
        raise TaxonomyError(f"a namespace is non-empty and holds no ':', got {namespace!r}")
    if not classes:
        raise TaxonomyError(f"{namespace}: no classes declared")
    return Taxonomy(namespace, tuple(_data_class(namespace, c) for c in classes))


def load_taxonomy(path: str | Path) -> Taxonomy:
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not {"namespace", "classes"} <= data.keys():
        raise TaxonomyError(f"{path}: 'namespace' and 'classes' are required at the top")
    return taxonomy(data["namespace"], data["classes"])


def shipped(name: str) -> Taxonomy:
    """A taxonomy that comes with the package: ``phi`` or ``generic``."""
    return load_taxonomy(resources.files("vigilake").joinpath("taxonomies", f"{name}.yaml"))


# Texts on which a pattern that can match nothing shows it.
_PROBES = ("", "a", "1", " ", "a 1")


def java_pattern(pattern: Column) -> Column:
    """A pattern as written in a taxonomy, in Java's spelling."""
    return F.concat(F.lit(REGEX_FLAGS), F.replace(F.replace(pattern, F.lit("(?P<"), F.lit("(?<")), F.lit(r"\Z"), F.lit(r"\z")))


def pattern_error(pattern: Column) -> Column:
    """What is wrong with a regex, compiled as it will be used; NULL for a good one."""
    java = java_pattern(pattern)
    # A pattern that does not compile gives NULL instead of an error.
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java).isNotNull()
    empty = F.exists(F.array(*map(F.lit, _PROBES)), lambda p: F.array_contains(F.regexp_extract_all(p, java, F.lit(0)), F.lit("")))
    return (
        F.when(pattern.contains("(?P=") | pattern.contains("(?P>") | pattern.rlike(r"\(\?\(\w"), F.lit("back-references by name and conditions are not supported"))
        .when(~compiled, F.lit("invalid regex"))
        .when(empty, F.lit("pattern can match the empty string"))
    )


def taxonomy_violations(raw: DataFrame) -> DataFrame:
    """(file, position, message) of everything wrong with taxonomies in a table of ``file`` and JSON ``body``.

    Problems of the document have no position, those of a class the one it is listed at. One pass, without
    a shuffle; patterns are compiled in the JVM, row by row.
    """
    docs = with_once(raw.select("file", "body"), {"doc": V.parse_strict(F.col("body"))})
    doc = F.col("doc")
    namespace = V.string_at(doc, "$.namespace")
    keys = F.map_keys(V.fields_of(doc))
    top = F.array(
        F.when(~V.is_object(doc) | ~F.array_contains(keys, "namespace") | ~F.array_contains(keys, "classes"), F.lit("'namespace' and 'classes' are required at the top"))
        .when(F.coalesce(namespace, F.lit("")).rlike("^$|:"), F.lit("a namespace is non-empty and holds no ':'"))
        .when(F.size(V.list_at(doc, "$.classes")) == 0, F.lit("no classes declared"))
    )

    def entry(item):
        name, recognizer = V.text_at(item, "$.class"), V.text_at(item, "$.recognizer")
        pattern = V.at(item, "$.pattern")
        missing = (F.coalesce(name, F.lit("")) == "") | (F.coalesce(recognizer, F.lit("")) == "") | (F.coalesce(V.kind(pattern), F.lit("VOID")) == "VOID")
        text = V.string_at(item, "$.pattern")
        return (
            F.when(~V.is_object(item), F.lit("class entries must be mappings"))
            .when(missing, F.lit("class, recognizer and pattern are all required"))
            .when(~recognizer.isin(*RECOGNIZERS), F.concat(F.lit("recognizer is none of "), F.lit(", ".join(RECOGNIZERS))))
            .when((recognizer == REGEX) & text.isNull(), F.lit("a regex pattern is a string"))
            .when(recognizer == REGEX, pattern_error(text))
            .when((recognizer == KEYWORDS) & (F.size(V.list_at(item, "$.pattern")) == 0), F.lit("a keyword pattern is a non-empty list"))
            .when((recognizer == NER) & text.isNull(), F.lit("an entity label is a string"))
        )

    nowhere = F.lit(None).cast("int")
    whole = F.transform(F.filter(top, lambda m: m.isNotNull()), lambda m: F.struct(nowhere.alias("position"), m.alias("message")))
    listed = F.transform(V.list_at(doc, "$.classes"), lambda c, i: F.struct(i.cast("int").alias("position"), entry(c).alias("message")))
    # A document that is wrong at the top has no classes to speak of.
    found = F.when(F.size(whole) > 0, whole).otherwise(F.filter(listed, lambda m: m["message"].isNotNull()))
    return docs.select("file", found.alias("found")).select("file", F.inline("found"))


def as_dataframe(spark: SparkSession, taxonomies: list[Taxonomy]) -> DataFrame:
    rows = [(t.namespace, i, c.name, c.recognizer, c.pattern) for t in taxonomies for i, c in enumerate(t.classes)]
    return spark.createDataFrame(rows, "namespace string, position int, cls string, recognizer string, pattern string")
