"""The catalogue's data model: row schema, ordered tiers, identifiers, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

#: Ordered tiers; the position is the level that comparisons use.
RISK_TIERS = ("low", "medium", "high", "critical")
COST_TIERS = ("free", "low", "medium", "high")

ITEM = StructType(
    [
        StructField("name", StringType(), False),
        StructField("namespace", StringType()),
        StructField("description", StringType()),
        StructField("input_schema", StringType()),
        StructField("tags", ArrayType(StringType())),
        StructField("examples", ArrayType(StringType())),
        StructField("risk", StringType()),
        StructField("cost", StringType()),
        StructField("required_scopes", ArrayType(StringType())),
        StructField("source_id", StringType()),
        StructField("metadata", MapType(StringType(), StringType())),
    ]
)


class OrreryError(Exception):
    """Base of the package's errors."""


class SourceError(OrreryError):
    """A source could not be read."""


class ConfigError(OrreryError):
    """A configuration is invalid."""


class DimensionMismatchError(OrreryError):
    """Vectors of another width than the index."""


class EmbeddingError(OrreryError):
    """An embedder that is missing or doesn't answer as it should."""


class StoreError(OrreryError):
    """A table that can't be read or written."""


class InvocationError(OrreryError):
    """An item that nothing can carry out."""


class ToolNotFoundError(OrreryError):
    """An id that the catalogue doesn't have."""


class NotIndexedError(OrreryError):
    """A query before anything was indexed."""


class PolicyError(OrreryError):
    """A policy is invalid."""


class RegistryError(OrreryError):
    """An unknown or clashing plugin name."""


class RenderError(OrreryError):
    """Two items render to one name."""


def item_id(namespace: Column, name: Column) -> Column:
    return F.concat(namespace, F.lit("/"), name)


def level(tier: Column, tiers: tuple[str, ...]) -> Column:
    """Position of a tier; null for an unknown one."""
    return F.array_position(F.array(*map(F.lit, tiers)), F.lower(tier)).cast("int") - 1


def tier(level_: Column, tiers: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, tiers)), level_.cast("int") + 1)


def valid_identifier(value: Column) -> Column:
    """Whether a name or namespace, once stripped, is non-empty, printable and free of ``/``."""
    return (F.length(value) > 0) & ~value.contains("/") & ~value.rlike(r"[\p{Cntrl}\p{Zl}\p{Zp}]")


def normalised_items(df: DataFrame) -> DataFrame:
    """Defaults filled, identifiers stripped and checked, ``tool_id``, ``risk_level`` and ``cost_level`` added.

    A row with an invalid identifier or tier fails the job with its value, and its ``position`` if there is one, in the
    message.
    """
    have = set(df.columns)
    where = F.concat(F.lit("item "), F.col("position"), F.lit(": ")) if "position" in have else F.lit("")
    defaults = {"namespace": F.lit("default"), "description": F.lit(""), "input_schema": F.lit("{}"), "risk": F.lit("low"), "cost": F.lit("free"), "source_id": F.lit("inline")}
    out = df
    for f in ITEM.fields:
        base = F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            base = F.coalesce(base, defaults[f.name])
        elif f.name in ("tags", "required_scopes"):
            base = F.array_sort(F.array_distinct(F.coalesce(base, F.array().cast("array<string>"))))
        elif f.name == "examples":
            base = F.coalesce(base, F.array().cast("array<string>"))
        out = out.withColumn(f.name, base)
    for name in ("name", "namespace"):
        value = F.trim(F.col(name))
        out = out.withColumn(name, F.when(valid_identifier(value), value).otherwise(F.raise_error(F.concat(where, F.lit(f"invalid {name}: "), F.coalesce(value, F.lit("null"))))))
    for name, tiers in (("risk", RISK_TIERS), ("cost", COST_TIERS)):
        lv = level(F.col(name), tiers)
        out = out.withColumn(f"{name}_level", F.coalesce(lv, F.raise_error(F.concat(where, F.lit(f"unknown {name}: "), F.col(name))).cast("int")))
    return out.drop("position").withColumn("tool_id", item_id(F.col("namespace"), F.col("name")))
