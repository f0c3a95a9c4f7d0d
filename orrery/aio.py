"""Selections and syncs for callers with an event loop: the jobs run in threads."""

from __future__ import annotations

import asyncio
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from .operators.maintain import VersionedStore
from .operators.select import Engine


async def in_thread(function: Callable[..., Any], *arguments: Any, **named: Any) -> Any:
    return await asyncio.to_thread(function, *arguments, **named)


async def select(engine: Engine, requests: DataFrame, k: int = 5, **how: Any) -> list:
    """The rows of ``Engine.select``."""
    return await in_thread(lambda: engine.select(requests, k, **how).collect())


async def sync(store: VersionedStore, incoming: DataFrame, embed: Callable[[DataFrame], DataFrame], **how: Any) -> dict[str, int] | None:
    return await in_thread(store.sync, incoming, embed, **how)
