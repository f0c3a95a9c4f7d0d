"""Rendering items for model APIs, with a registry of renderers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flatten_name
from ..schema import InvocationError, RegistryError, RenderError

_EMPTY = '{"type":"object","properties":{}}'


def _schema(c: Column) -> Column:
    return F.when(c.isNull() | (c == "{}"), F.lit(_EMPTY)).otherwise(c)


def _quoted(c: Column) -> Column:
    """A string as JSON, without the braces of the struct that to_json needs."""
    j = F.to_json(F.struct(c.alias("v")))
    return F.substring(j, F.lit(6), F.length(j) - 6)


def openai(df: DataFrame, strict: bool = False) -> DataFrame:
    name = _quoted(flatten_name(F.col("namespace"), F.col("name")))
    more = ',"strict":true' if strict else ""
    body = F.concat(F.lit('{"type":"function","function":{"name":'), name, F.lit(',"description":'), _quoted(F.col("description")), F.lit(',"parameters":'), _schema(F.col("input_schema")), F.lit(more + "}}"))
    return df.select("tool_id", body.alias("rendered"))


def anthropic(df: DataFrame) -> DataFrame:
    name = _quoted(flatten_name(F.col("namespace"), F.col("name")))
    body = F.concat(F.lit('{"name":'), name, F.lit(',"description":'), _quoted(F.col("description")), F.lit(',"input_schema":'), _schema(F.col("input_schema")), F.lit("}"))
    return df.select("tool_id", body.alias("rendered"))


RENDERERS: dict[str, Callable[[DataFrame], DataFrame]] = {"openai": openai, "anthropic": anthropic}


def collisions(df: DataFrame) -> DataFrame:
    """flat, n: flattened names that more than one item would get."""
    flat = flatten_name(F.col("namespace"), F.col("name"))
    return df.groupBy(flat.alias("flat")).agg(F.count("*").alias("n")).filter("n > 1")


def resolve_name(df: DataFrame, flat: str) -> DataFrame:
    return df.filter(flatten_name(F.col("namespace"), F.col("name")) == flat)


def register_renderer(name: str, renderer: Callable[[DataFrame], DataFrame], replace: bool = False) -> None:
    """A renderer for another API or framework: items to (tool_id, rendered)."""
    if name in RENDERERS and not replace:
        raise RegistryError(f"renderer {name!r} exists")
    RENDERERS[name] = renderer


def rendered(df: DataFrame, name: str) -> DataFrame:
    if name not in RENDERERS:
        raise RegistryError(f"no renderer named {name!r}; have {sorted(RENDERERS)}")
    return RENDERERS[name](df)


@dataclass(frozen=True)
class Binding:
    """A selected item, its flattened name and what carries it out."""

    tool_id: str
    name: str
    rendered: str
    run: Callable[..., Any] | None = None

    def __call__(self, **arguments: Any) -> Any:
        if self.run is None:
            raise InvocationError(f"nothing carries out {self.tool_id}")
        return self.run(**arguments)


def bind(selected: DataFrame, functions: Mapping[str, Callable[..., Any]], remote: Callable[[str, dict], Any] | None = None, renderer: str = "openai", skip: bool = False) -> dict[str, Binding]:
    """The items of one selection by flattened name, each with its local function or else with ``remote`` (tool_id,
    arguments). An item with neither is an error, or with ``skip`` left out. Two items with one name are an error."""
    rows = rendered(selected, renderer).join(selected.select("tool_id", flatten_name(F.col("namespace"), F.col("name")).alias("flat")), "tool_id").orderBy("tool_id").collect()
    out: dict[str, Binding] = {}
    for r in rows:
        run = functions.get(r.tool_id)
        if run is None and remote is not None:
            run = lambda _id=r.tool_id, **arguments: remote(_id, arguments)
        if run is None:
            if skip:
                continue
            raise InvocationError(f"nothing carries out {r.tool_id}")
        if r.flat in out:
            raise RenderError(f"{out[r.flat].tool_id} and {r.tool_id} both become {r.flat}")
        out[r.flat] = Binding(r.tool_id, r.flat, r.rendered, run)
    return out
