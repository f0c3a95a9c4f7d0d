"""Hooks: observers and DataFrame transformers by event; plugin registry."""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..schema import RegistryError

EVENTS = (
    "before_discovery", "after_discovery", "transform_tool", "before_indexing", "transform_index_text", "after_indexing",
    "transform_query", "before_retrieval", "transform_hits", "after_retrieval", "before_selection", "after_selection",
)

log = logging.getLogger(__name__)


class Hooks:
    """Handlers by event. Transformers map a DataFrame to another (None: unchanged; a filter drops rows).

    A handler that fails is logged and skipped, unless ``strict``.
    """

    def __init__(self, strict: bool = False) -> None:
        self.strict = strict
        self._handlers: dict[str, list[Callable]] = {e: [] for e in EVENTS}

    def on(self, event: str, handler: Callable) -> Callable:
        if event not in self._handlers:
            raise RegistryError(f"unknown event {event!r}")
        self._handlers[event].append(handler)
        return handler

    def off(self, event: str, handler: Callable) -> None:
        self._handlers[event].remove(handler)

    def emit(self, event: str, **payload: Any) -> None:
        for h in self._handlers[event]:
            try:
                h(**payload)
            except Exception:
                if self.strict:
                    raise
                log.exception("handler of %s failed", event)

    def transform(self, event: str, df: DataFrame) -> DataFrame:
        for h in self._handlers[event]:
            try:
                out = h(df)
                if out is not None:
                    out.schema
                    df = out
            except Exception:
                if self.strict:
                    raise
                log.exception("handler of %s failed", event)
        return df


_plugins: dict[tuple[str, str], Callable] = {}


def register(group: str, name: str, factory: Callable, replace: bool = False) -> None:
    if (group, name) in _plugins and not replace:
        raise RegistryError(f"{group} {name!r} exists")
    _plugins[group, name] = factory


def create(group: str, name: str, **options: Any) -> Any:
    """An instance by registered name or dotted path ``package.module:attribute``."""
    factory = _plugins.get((group, name))
    if factory is None and ":" in name:
        module, attribute = name.split(":", 1)
        factory = getattr(importlib.import_module(module), attribute)
    if factory is None:
        raise RegistryError(f"no {group} named {name!r}; have {sorted(n for g, n in _plugins if g == group)}")
    return factory(**options)
