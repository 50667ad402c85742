"""Policies: loading, validation and the set version.

A policy set is driver-side config of tens of rules. Raw documents are checked
as a table of JSON rows, so the same rules also run over large policy archives.
"""

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vigilake.functions import variant as V
from vigilake.functions.once import with_fields_once, with_once

# The closed vocabularies and formats of a policy document.
SCHEMA_VERSION = "1.0"
DIRECTIONS = ("prompt", "response")
DESTINATIONS = ("external_vendor", "internal", "any")
VERDICTS = ("block", "redact", "alert")
FAIL_MODES = ("fail_open", "fail_closed")
POLICY_ID = r"^[a-z][a-z0-9_]{2,127}$"
NAMESPACED = r"^[a-z][a-z0-9_]*:[a-z][a-z0-9_]*$"
EMPTY_SET = "empty"
VERSION_LENGTH = 12
TOP_FIELDS = (
    "schema_version", "policy_id", "policy_version", "description", "match", "verdict",
    "block_config", "redact_config", "alert_config", "audit_only", "on_classifier_error",
)

RAW = "file string, content string, body string"


class PolicyLoadError(ValueError):
    """All problems of a policy directory at once."""

    def __init__(self, errors: list[tuple[str, str]]):
        self.errors = errors
        super().__init__(f"{len(errors)} policy problem(s):\n" + "\n".join(f"  {f}: {m}" for f, m in errors))


@dataclass(frozen=True)
class Policy:
    policy_id: str
    policy_version: str
    direction: str
    destination: str
    match_mode: str
    classes: tuple[str, ...]
    verdict: str
    user_message: str | None = None
    redact_with: str | None = None
    classes_to_redact: tuple[str, ...] | None = None
    webhook: str | None = None
    audit_only: bool = False
    on_classifier_error: str = "fail_open"
    source_file: str = ""


@dataclass(frozen=True)
class PolicySet:
    policies: tuple[Policy, ...]
    version: str


def _section(doc: Column, name: str, fields: tuple[str, ...]) -> Column:
    """Error unless ``name`` is absent, null or an object holding only ``fields``."""
    part = V.at(doc, f"$.{name}")
    extra = F.array_except(F.map_keys(V.fields_of(doc, f"$.{name}")), F.array(*map(F.lit, fields)))
    return F.when(
        _given(doc, name) & ~V.is_object(part), F.lit(f"{name}: must be a mapping")
    ).when(F.size(extra) > 0, F.concat(F.lit(f"{name}: unknown field "), F.array_join(extra, ", ")))


def _given(doc: Column, name: str) -> Column:
    return F.coalesce(V.kind(V.at(doc, f"$.{name}")), F.lit("VOID")) != "VOID"


def _one_of(doc: Column, name: str, allowed: tuple[str, ...], required: bool = True) -> Column:
    value = V.string_at(doc, f"$.{name}")
    bad = ~F.coalesce(value.isin(*allowed), F.lit(False))
    present = V.at(doc, f"$.{name}").isNotNull()
    return F.when(bad if required else (present & bad), F.lit(f"{name}: must be one of {', '.join(allowed)}"))


def _text(doc: Column, name: str, when: Column | None = None) -> Column:
    value = F.coalesce(V.string_at(doc, f"$.{name}"), F.lit(""))
    wrong = value == ""
    return F.when(wrong if when is None else (when & wrong), F.lit(f"{name}: must be a non-empty string"))


def _strings(doc: Column, path: str) -> Column:
    return F.transform(V.list_at(doc, path), lambda c: V.string_at(c, "$"))


def _all_namespaced(names: Column) -> Column:
    return F.forall(names, lambda n: F.coalesce(n.rlike(NAMESPACED), F.lit(False)))


def violations(doc: Column) -> Column:
    """Array of everything wrong with one policy document (a VARIANT)."""
    any_of, all_of = _given(doc, "match.classes.any_of"), _given(doc, "match.classes.all_of")
    listed = F.when(any_of, _strings(doc, "$.match.classes.any_of")).otherwise(_strings(doc, "$.match.classes.all_of"))
    verdict = V.string_at(doc, "$.verdict")
    template = V.string_at(doc, "$.redact_config.redact_with")
    to_redact = _strings(doc, "$.redact_config.classes_to_redact")
    narrows = _given(doc, "redact_config.classes_to_redact")
    webhook = V.string_at(doc, "$.alert_config.webhook")
    unknown = F.array_except(F.map_keys(V.fields_of(doc)), F.array(*map(F.lit, TOP_FIELDS)))
    checks = [
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(unknown, ", "))),
        _one_of(doc, "schema_version", (SCHEMA_VERSION,)),
        F.when(
            ~F.coalesce(V.string_at(doc, "$.policy_id").rlike(POLICY_ID), F.lit(False)),
            F.lit("policy_id: must be snake_case, 3 to 128 characters, starting with a letter"),
        ),
        _text(doc, "policy_version"),
        F.when(
            _given(doc, "description") & V.string_at(doc, "$.description").isNull(),
            F.lit("description: must be a string"),
        ),
        F.when(~_given(doc, "match"), F.lit("match: required")),
        _section(doc, "match", ("direction", "destination", "classes")),
        _section(doc, "match.classes", ("any_of", "all_of")),
        _one_of(doc, "match.direction", DIRECTIONS),
        _one_of(doc, "match.destination", DESTINATIONS),
        F.when(any_of == all_of, F.lit("match.classes: exactly one of any_of and all_of"))
        .when(F.size(listed) == 0, F.lit("match.classes: at least one class"))
        .when(~_all_namespaced(listed), F.lit("match.classes: classes are written namespace:name")),
        _one_of(doc, "verdict", VERDICTS),
        *[
            F.when(_given(doc, f"{v}_config") != F.coalesce(verdict == v, F.lit(False)),
                   F.when(verdict == v, F.lit(f"{v}_config: required by the verdict"))
                   .otherwise(F.lit(f"{v}_config: does not belong to the verdict")))
            for v in VERDICTS
        ],
        _section(doc, "block_config", ("user_message",)),
        _section(doc, "redact_config", ("redact_with", "classes_to_redact")),
        _section(doc, "alert_config", ("webhook",)),
        _text(doc, "block_config.user_message", _given(doc, "block_config")),
        _text(doc, "redact_config.redact_with", _given(doc, "redact_config")),
        F.when(
            F.exists(F.regexp_extract_all(template, F.lit(r"\{([^{}]*)\}"), F.lit(1)), lambda t: t != "class"),
            F.lit("redact_config.redact_with: only {class} is replaced"),
        ),
        F.when(narrows & (F.size(to_redact) == 0), F.lit("redact_config.classes_to_redact: must not be empty"))
        .when(narrows & ~_all_namespaced(to_redact),
              F.lit("redact_config.classes_to_redact: classes are written namespace:name"))
        .when(narrows & (F.size(F.array_except(to_redact, listed)) > 0),
              F.lit("redact_config.classes_to_redact: classes must be among match.classes")),
        F.when(
            _given(doc, "alert_config.webhook")
            & ~F.coalesce(webhook.rlike("^https?://"), F.lit(False)),
            F.lit("alert_config.webhook: must be an http(s) URL"),
        ),
        F.when(
            V.at(doc, "$.audit_only").isNotNull() & (V.kind(V.at(doc, "$.audit_only")) != "BOOLEAN"),
            F.lit("audit_only: must be a boolean"),
        ),
        _one_of(doc, "on_classifier_error", FAIL_MODES, required=False),
    ]
    return F.when(V.is_object(doc), F.filter(F.array(*checks), lambda c: c.isNotNull())).otherwise(
        F.array(F.lit("a policy is one mapping"))
    )


def validation_errors(raw: DataFrame) -> DataFrame:
    """(file, message) rows for a table of raw policies: ``file`` and the JSON ``body``."""
    doc = raw.select("file", V.parse_strict(F.col("body")).alias("doc"))
    return doc.select("file", F.explode(violations(F.col("doc"))).alias("message"))


def _duplicates(files: Column, policy_id: Column) -> Column:
    """Messages for all but the first of the sorted files that declare an id."""
    told = F.concat(F.lit("duplicate policy_id "), policy_id, F.lit(" of "), F.element_at(files, 1))
    later = F.slice(files, 2, F.greatest(F.size(files) - 1, F.lit(0)))
    return F.transform(later, lambda f: F.struct(f.alias("file"), told.alias("message")))


def duplicate_ids(raw: DataFrame) -> DataFrame:
    """Files that declare a policy id an earlier file (by name) already has.

    One aggregate; its list holds the names of the files of one directory that share an id.
    """
    ids = raw.select("file", V.string_at(V.parse_strict(F.col("body")), "$.policy_id").alias("policy_id")).where("policy_id is not null")
    files = ids.groupBy("policy_id").agg(F.array_sort(F.collect_list("file")).alias("files")).where(F.size("files") > 1)
    return files.select(F.inline(_duplicates(F.col("files"), F.col("policy_id"))))


def load_errors(raw: DataFrame, directory: str | None = None) -> DataFrame:
    """Everything that keeps the policies from being loaded, in one table of (directory, file, message).

    Each file is parsed and checked once; a valid one stands for its id, an invalid one for its
    errors, and one aggregate finds the ids that several valid files of a directory declare. A column
    ``error`` of ``raw`` may say why a file could not be read; it is then not looked into.
    """
    own = [directory] if directory else []
    unread = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    parsed = with_once(raw.select(*own, "file", unread.alias("__unread"), "body"), {"__doc": V.parse_strict(F.col("body"))})
    found = F.when(F.col("__unread").isNotNull(), F.array("__unread")).otherwise(violations(F.col("__doc")))
    checked = with_once(parsed, {"__errors": found, "__id": V.string_at(F.col("__doc"), "$.policy_id")})
    none = F.lit(None).cast("string")
    wrong = F.transform("__errors", lambda m: F.struct(none.alias("id"), F.col("file").alias("bad"), m.alias("message")))
    entries = F.when(F.size("__errors") > 0, wrong).otherwise(F.array(F.struct(F.col("__id").alias("id"), none.alias("bad"), none.alias("message"))))
    rows = checked.select(*own, "file", F.inline(entries))
    groups = rows.groupBy(*own, "id", "bad", "message").agg(F.array_sort(F.collect_list("file")).alias("files"))
    told = F.when(F.col("id").isNull(), F.array(F.struct(F.col("bad").alias("file"), "message"))).otherwise(_duplicates(F.col("files"), F.col("id")))
    return groups.select(*own, told.alias("told")).select(*own, F.inline("told"))


@F.pandas_udf(StructType([StructField("body", StringType()), StructField("error", StringType())]))
def yaml_as_json(contents: pd.Series) -> pd.DataFrame:
    """Policy documents in YAML as JSON text, or why they cannot be read."""
    import yaml

    # The same documents from libyaml, where it is built in; what it refuses is told in the words of the other.
    fast = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def load(text):
        try:
            return yaml.load(text, Loader=fast)
        except yaml.YAMLError:
            return yaml.safe_load(text)

    def one(content):
        try:
            return json.dumps(load(bytes(content).decode("utf-8")), default=str), None
        except UnicodeDecodeError as exc:
            return None, f"not valid UTF-8: {exc.reason}"
        except yaml.YAMLError as exc:
            return None, f"YAML parse error: {getattr(exc, 'problem', None) or exc}"

    return pd.DataFrame([one(c) for c in contents], columns=["body", "error"])


def read_directories(files: DataFrame) -> DataFrame:
    """Policy files (directory, file, content) of many directories, parsed where they are read: adds body and error."""
    read = with_fields_once(files, yaml_as_json(F.col("content")))
    return read.select("directory", "file", "content", "body", "error")


def directory_sets(read: DataFrame) -> DataFrame:
    """One row per directory: its files, its problems, and its version where there is none.

    Directories are independent of each other; ids only have to differ within one.
    """
    errors = load_errors(read, "directory").groupBy("directory").agg(F.count("*").alias("n_errors"))
    sets = set_versions(read.select("directory", "file", F.col("content").alias("content"))).join(errors, "directory", "left")
    loaded = F.col("n_errors").isNull()
    return sets.select("directory", "n_files", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.when(loaded, F.col("policy_set_version")).alias("policy_set_version"))


def set_versions(files: DataFrame, directory: str = "directory") -> DataFrame:
    """Version of every policy directory in a table of (directory, file, content).

    Contents are hashed before the shuffle, so a directory travels as one short
    line per file. Each directory is one rule set, whose version is one hash over all its lines.
    """
    line = F.concat("file", F.lit(":"), F.sha2("content", 256))
    lines = files.select(directory, F.struct("file", line.alias("line")).alias("entry"))
    grouped = lines.groupBy(directory).agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("entry")).alias("es"))
    text = F.array_join(F.col("es.line"), "\n")
    return grouped.select(
        directory,
        "n_files",
        F.substring(F.sha2(text, 256), 1, VERSION_LENGTH).alias("policy_set_version"),
    )


def set_version(files: list[tuple[str, bytes]]) -> str:
    """Version of one directory given as (file name, content)."""
    if not files:
        return EMPTY_SET
    lines = [f"{name}:{hashlib.sha256(content).hexdigest()}" for name, content in sorted(files)]
    return hashlib.sha256("\n".join(lines).encode("utf-8")).hexdigest()[:VERSION_LENGTH]


def policy(doc: dict, source_file: str = "") -> Policy:
    """Policy from a document that has been validated."""
    classes = doc["match"]["classes"]
    mode = "any_of" if classes.get("any_of") is not None else "all_of"
    redact = doc.get("redact_config") or {}
    narrowed = redact.get("classes_to_redact")
    return Policy(
        policy_id=doc["policy_id"],
        policy_version=doc["policy_version"],
        direction=doc["match"]["direction"],
        destination=doc["match"]["destination"],
        match_mode=mode,
        classes=tuple(classes[mode]),
        verdict=doc["verdict"],
        user_message=(doc.get("block_config") or {}).get("user_message"),
        redact_with=redact.get("redact_with"),
        classes_to_redact=tuple(narrowed) if narrowed is not None else None,
        webhook=(doc.get("alert_config") or {}).get("webhook"),
        audit_only=doc.get("audit_only", False),
        on_classifier_error=doc.get("on_classifier_error", "fail_open"),
        source_file=source_file,
    )


def load_policies(spark: SparkSession, directory: str | Path) -> PolicySet:
    """Policies of one directory (``*.yaml`` and ``*.yml``, not below); fails listing every problem."""
    import yaml

    folder = Path(directory).expanduser()
    if not folder.exists():
        raise FileNotFoundError(f"no such policy directory: {folder}")
    if not folder.is_dir():
        raise NotADirectoryError(f"not a directory: {folder}")
    contents, documents, errors = [], {}, []
    for path in sorted({*folder.glob("*.yaml"), *folder.glob("*.yml")}):
        try:
            content = path.read_bytes()
            document = yaml.safe_load(content.decode("utf-8"))
        except (OSError, UnicodeDecodeError, yaml.YAMLError) as exc:
            errors.append((path.name, f"unreadable: {exc}"))
            continue
        contents.append((path.name, content))
        documents[path.name] = document
    if documents:
        rows = [(name, None, json.dumps(doc, default=str)) for name, doc in documents.items()]
        found = load_errors(spark.createDataFrame(rows, RAW)).collect()
        errors += sorted((r["file"], r["message"]) for r in found)
    if errors:
        raise PolicyLoadError(errors)
    return PolicySet(tuple(policy(doc, name) for name, doc in documents.items()), set_version(contents))


def as_dataframe(spark: SparkSession, policy_set: PolicySet) -> DataFrame:
    schema = (
        "policy_id string, policy_version string, direction string, destination string, match_mode string, "
        "classes array<string>, verdict string, user_message string, redact_with string, "
        "classes_to_redact array<string>, webhook string, audit_only boolean, on_classifier_error string, "
        "source_file string"
    )
    rows = [
        (
            p.policy_id, p.policy_version, p.direction, p.destination, p.match_mode, list(p.classes), p.verdict,
            p.user_message, p.redact_with, list(p.classes_to_redact) if p.classes_to_redact is not None else None,
            p.webhook, p.audit_only, p.on_classifier_error, p.source_file,
        )
        for p in policy_set.policies
    ]
    return spark.createDataFrame(rows, schema)
