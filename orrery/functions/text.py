"""Text functions as Column builders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where identifiers part; fixed value.
_SPLIT = r"[_\-./]+|(?<=[a-z0-9])(?=[A-Z])"

#: Leading verbs of the default risk guess; fixed values.
DESTRUCTIVE = ("delete", "remove", "drop", "destroy", "purge", "revoke", "terminate", "wipe", "erase")
MUTATING = ("create", "update", "write", "send", "post", "put", "patch", "set", "insert", "modify", "restart", "deploy")

#: Labels of the sections of index texts; fixed values.
NAMESPACE_LABEL = "namespace: "
TAGS_LABEL = "tags: "
EXAMPLES_LABEL = "examples: "
PARAMETERS_LABEL = "parameters: "
REQUIRED_LABEL = " [required]"

#: Names that models accept: at most 64 characters, namespace and name joined by this separator.
NAME_SEPARATOR, MAX_NAME = "__", 64


def humanize(identifier: Column) -> Column:
    """``get_user_by_id`` and ``getUserById`` become ``get user by id``."""
    return F.lower(F.array_join(F.filter(F.split(identifier, _SPLIT), lambda p: p != ""), " "))


def tokenize(text: Column) -> Column:
    """Lower-case ASCII word tokens, identifiers taken apart; other characters separate."""
    broken = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_remove(F.split(F.lower(F.regexp_replace(broken, r"[^A-Za-z0-9]+", " ")), " "), "")


def normalise_phrase(phrase: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(phrase, r"\s+", " ")))


def flatten_name(namespace: Column, name: Column) -> Column:
    """Name fit for model APIs. Longer results keep as much head as leaves room for the name's tail."""
    raw = F.when(namespace == "default", name).otherwise(F.concat(namespace, F.lit(NAME_SEPARATOR), name))
    safe = F.regexp_replace(raw, r"[^a-zA-Z0-9_-]", "_")
    tail = F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "_")
    room = F.greatest(F.lit(MAX_NAME - 1) - F.length(tail), F.lit(0))
    cut = F.concat(F.substring(safe, F.lit(1), room), F.lit("_"), F.substring(tail, -(MAX_NAME - 1), MAX_NAME - 1))
    return F.when(F.length(safe) <= MAX_NAME, safe).otherwise(cut)


def risk_by_name(name: Column) -> Column:
    """Tier guessed from the leading verb: destructive is high, mutating medium, anything else low."""
    low = F.lower(name)
    return F.when(low.rlike("^(?:" + "|".join(DESTRUCTIVE) + ")"), "high").when(low.rlike("^(?:" + "|".join(MUTATING) + ")"), "medium").otherwise("low")


def content_hash(*parts: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the parts, each preceded by its length."""
    framed = F.concat(*(x for p in parts for x in (F.length(F.coalesce(p, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(p, F.lit("")))))
    return F.substring(F.sha2(framed, 256), 1, 16)


def token_estimate(rendered: Column) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(F.length(rendered) / 4).cast("long")


@dataclass(frozen=True)
class TextConfig:
    """What of an item goes into its index text, and how often."""

    include_name: bool = True
    include_namespace: bool = True
    include_description: bool = True
    include_tags: bool = True
    include_examples: bool = True
    include_parameters: bool = True
    name_weight: int = 1
    description_weight: int = 1
    max_description_chars: int = 1000
    max_parameters: int = 12


def describe_schema(schema: Column, max_parameters: int = 12) -> Column:
    """A JSON Schema's parameters as text, in declaration order: ``parameters: a: what it is; b (type) [required]``."""
    names = F.slice(F.json_object_keys(F.get_json_object(schema, "$.properties")), 1, max_parameters)
    required = F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), F.array().cast("array<string>"))
    specs = F.from_json(F.get_json_object(schema, "$.properties"), "map<string,struct<description:string,type:string>>")

    def piece(name: Column) -> Column:
        spec = F.element_at(specs, name)
        about = F.when(F.length(spec["description"]) > 0, F.concat(F.lit(": "), spec["description"]))
        kind = F.when(spec["type"].isNotNull(), F.concat(F.lit(" ("), spec["type"], F.lit(")")))
        return F.concat(humanize(name), F.coalesce(about, kind, F.lit("")), F.when(F.array_contains(required, name), REQUIRED_LABEL).otherwise(""))

    return F.when(F.size(names) > 0, F.concat(F.lit(PARAMETERS_LABEL), F.array_join(F.transform(names, piece), "; ")))


def index_text(columns: set[str], config: TextConfig = TextConfig()) -> Column:
    """Searchable text of an item: weighted sections joined by line feeds, empty ones left out."""
    parts: list[Column] = []
    c = F.col
    if config.include_name and config.name_weight:
        readable = humanize(c("name"))
        line = F.when(readable == c("name"), c("name")).otherwise(F.concat(c("name"), F.lit(" ("), readable, F.lit(")")))
        parts += [line] * config.name_weight
    if config.include_namespace and "namespace" in columns:
        parts.append(F.when(c("namespace") != "default", F.concat(F.lit(NAMESPACE_LABEL), humanize(c("namespace")))))
    if config.include_description and "description" in columns and config.description_weight:
        text = F.substring(F.trim(c("description")), 1, config.max_description_chars)
        parts += [F.when(c("description") != "", text)] * config.description_weight
    if config.include_tags and "tags" in columns:
        parts.append(F.when(F.size("tags") > 0, F.concat(F.lit(TAGS_LABEL), F.array_join(F.array_sort("tags"), ", "))))
    if config.include_parameters and "input_schema" in columns:
        parts.append(describe_schema(c("input_schema"), config.max_parameters))
    if config.include_examples and "examples" in columns:
        parts.append(F.when(F.size("examples") > 0, F.concat(F.lit(EXAMPLES_LABEL), F.array_join("examples", " | "))))
    return F.concat_ws("\n", *parts)
