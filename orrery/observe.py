"""Spans around steps of a job and JSON logging."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("orrery")

#: Called with name, attributes and seconds when a span ends; None: no tracing.
Tracer = Callable[[str, dict[str, Any], float], None]
_tracer: Tracer | None = None


def set_tracer(tracer: Tracer | None) -> None:
    global _tracer
    _tracer = tracer


def get_tracer() -> Tracer | None:
    return _tracer


def tracing_enabled() -> bool:
    return _tracer is not None


@contextmanager
def span(name: str, spark: SparkSession | None = None, **attributes: Any) -> Iterator[dict[str, Any]]:
    """A named step. Spark's jobs of the step carry its name; the tracer gets it at the end, also of a failed one.

    Attributes may be added to what the span yields. A tracer that fails is logged and ignored.
    """
    start = time.perf_counter()
    if spark is not None:
        spark.sparkContext.setJobDescription(name)
    try:
        yield attributes
    except BaseException as error:
        attributes["error"] = type(error).__name__
        raise
    finally:
        if spark is not None:
            with suppress(Exception):
                spark.sparkContext.setJobDescription("")
        if _tracer is not None:
            try:
                _tracer(name, dict(attributes), time.perf_counter() - start)
            except Exception:
                log.exception("the tracer failed at %s", name)


class JsonFormatter(logging.Formatter):
    """One JSON object a line: time, level, logger, message, and what was passed as ``extra``."""

    _own = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in self._own}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


def log_json(level: int = logging.INFO) -> None:
    """This package's log as JSON lines on standard error."""
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter())
    log.handlers, log.propagate = [handler], False
    log.setLevel(level)
