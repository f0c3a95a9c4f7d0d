"""Python callables as catalogue rows; the callables stay in a registry on the driver."""

from __future__ import annotations

import inspect
import json
import keyword
import re
import types
import typing
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, NullType, StringType, StructField, StructType

from ..schema import ITEM
from .catalogue import normalised_items

_JSON = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", tuple: "array", set: "array", dict: "object", type(None): "null"}


def type_schema(hint: Any) -> dict[str, Any]:
    """JSON Schema of a type hint; unknown ones allow anything."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        return {"anyOf": [type_schema(a) for a in args]}
    if origin is typing.Literal:
        return {"enum": list(args)}
    if origin in (list, set, tuple, frozenset):
        return {"type": "array", "items": type_schema(args[0])} if args else {"type": "array"}
    if origin is dict:
        return {"type": "object"}
    return {"type": _JSON[hint]} if hint in _JSON else {}


_SPARK = {"string": StringType(), "integer": LongType(), "number": DoubleType(), "boolean": BooleanType(), "null": NullType()}


def safe_field_name(name: str) -> str:
    """A name that is an identifier: other characters become underlines, a digit in front gets one before it."""
    clean = re.sub(r"\W", "_", name, flags=re.A) or "_"
    return f"_{clean}" if clean[0].isdigit() or keyword.iskeyword(clean) else clean


def spark_type(schema: Any) -> DataType:
    """The Spark type of a JSON Schema; what isn't one plain type is a string."""
    if not isinstance(schema, Mapping):
        return StringType()
    kind = schema.get("type")
    if isinstance(kind, list):  # a type or null
        kinds = [k for k in kind if k != "null"]
        return spark_type({**schema, "type": kinds[0]}) if len(kinds) == 1 else StringType()
    if kind == "array":
        return ArrayType(spark_type(schema.get("items")))
    if kind == "object" or (kind is None and "properties" in schema):
        return struct_type(schema) if schema.get("properties") else MapType(StringType(), StringType())
    return _SPARK.get(kind, StringType())


def struct_type(schema: Mapping[str, Any]) -> StructType:
    """The Spark struct of an object schema: declaration order, required fields not null, names made safe and unique."""
    required, fields, taken = set(schema.get("required") or ()), [], set()
    for name, field in (schema.get("properties") or {}).items():
        safe = safe_field_name(str(name))
        while safe in taken:
            safe += "_"
        taken.add(safe)
        fields.append(StructField(safe, spark_type(field), name not in required))
    return StructType(fields)


def split_docstring(doc: str | None) -> tuple[str, dict[str, str]]:
    """The first paragraph and the parameters under ``Args:``."""
    text = inspect.cleandoc(doc or "")
    about = " ".join(text.split("\n\n")[0].split())
    params: dict[str, str] = {}
    section = re.search(r"^Args:\n((?:[ \t]+.*\n?|\n)+)", text, re.M)
    name = ""
    for line in section[1].splitlines() if section else []:
        m = re.match(r"\s{2,8}(\*{0,2}\w+)(?:\s*\([^)]*\))?:\s*(.*)", line)
        if m:
            name = m[1].lstrip("*")
            params[name] = m[2]
        elif name and line.strip():
            params[name] += " " + line.strip()
    return about, params


def function_row(f: Callable, namespace: str, source_id: str, risk: Callable[[str], str] | None = None) -> dict[str, Any]:
    about, params = split_docstring(f.__doc__)
    hints = typing.get_type_hints(f)
    properties: dict[str, Any] = {}
    required = []
    for name, p in inspect.signature(f).parameters.items():
        if name in ("self", "cls") or p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD):
            continue
        field = type_schema(hints.get(name))
        if name in params:
            field["description"] = params[name]
        if p.default is p.empty:
            required.append(name)
        elif isinstance(p.default, (str, int, float, bool, type(None))):
            field["default"] = p.default
        properties[name] = field
    schema: dict[str, Any] = {"type": "object", "properties": properties}
    if required:
        schema["required"] = required
    low = f.__name__.lower()
    from ..functions.text import DESTRUCTIVE, MUTATING

    tier = risk(f.__name__) if risk else "high" if low.startswith(DESTRUCTIVE) else "medium" if low.startswith(MUTATING) else "low"
    return {"name": f.__name__, "namespace": namespace, "description": about, "input_schema": json.dumps(schema), "tags": [], "examples": [], "risk": tier, "cost": "free", "required_scopes": [], "source_id": source_id, "metadata": {}}


class FunctionSource:
    """Callables by id; ``rows`` are theirs in the catalogue."""

    def __init__(self, functions: Iterable[Callable] = (), source_id: str = "functions", namespace: str = "default") -> None:
        self.source_id, self.namespace = source_id, namespace
        self.callables: dict[str, Callable] = {}
        for f in functions:
            self.add(f)

    def add(self, f: Callable) -> Callable:
        self.callables[f"{self.namespace}/{f.__name__}"] = f
        return f

    def rows(self, spark: SparkSession) -> DataFrame:
        rows = [function_row(f, self.namespace, self.source_id) for f in self.callables.values()]
        return normalised_items(spark.createDataFrame([tuple(r[f.name] for f in ITEM.fields) for r in rows], ITEM))
