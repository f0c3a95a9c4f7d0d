"""Settings from JSON or YAML files with environment references ``${NAME}``, ``${NAME:-default}`` and ``$${``."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import observe
from .operators import hooks as H
from .operators import state
from .operators.maintain import DriftGuard
from .operators.policy import AgentPolicies, build_policy
from .schema import ConfigError
from .sources import catalogue, functions, openapi

_REFERENCE = re.compile(r"(\$\$\{)|\$\{(\w+)(?::-([^}]*))?\}")
SECTIONS = frozenset({"sources", "embedder", "retrieval", "policies", "usage", "index", "drift", "aliases", "savings", "hooks", "tracer", "fallback"})


def interpolate(value: Any, env: Mapping[str, str] | None = None, where: str = "") -> Any:
    env = os.environ if env is None else env
    if isinstance(value, str):

        def one(m: re.Match) -> str:
            if m[1]:
                return "${"
            found = env.get(m[2], m[3])
            if found is None:
                raise ConfigError(f"{where or 'config'}: {m[2]} is not set and has no default")
            return found

        return _REFERENCE.sub(one, value)
    if isinstance(value, Mapping):
        return {k: interpolate(v, env, f"{where}.{k}".lstrip(".")) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, env, f"{where}[{k}]") for k, v in enumerate(value)]
    return value


def load(path: str, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as missing:
            raise ConfigError("YAML settings need the yaml package; use JSON") from missing
        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)
    if not isinstance(raw, dict) or not set(raw) <= SECTIONS:
        raise ConfigError(f"{path}: sections must be among {', '.join(sorted(SECTIONS))}")
    return interpolate(raw, env)


def agent_policies(settings: Mapping[str, Any]) -> AgentPolicies:
    """Policies of the section ``policies``: default, strict and by agent."""
    section = settings.get("policies") or {}
    return AgentPolicies({a: build_policy(p) for a, p in (section.get("agents") or {}).items()}, build_policy(section.get("default") or {}), bool(section.get("strict")))


def _known(section: str, given: Mapping[str, Any], known: set[str]) -> dict[str, Any]:
    if set(given) - known:
        raise ConfigError(f"{section}: unknown settings {', '.join(sorted(set(given) - known))}; known are {', '.join(sorted(known))}")
    return dict(given)


def engine_options(settings: Mapping[str, Any]) -> dict[str, Any]:
    """What the sections ``retrieval`` and ``usage`` set of an engine."""
    metric = _known("retrieval", settings.get("retrieval") or {}, {"metric"})
    usage = _known("usage", settings.get("usage") or {}, {"weight", "path", "half_life"})
    return ({"metric": metric["metric"]} if metric else {}) | ({"usage_weight": float(usage["weight"])} if "weight" in usage else {})


def sources(spark: SparkSession, settings: Mapping[str, Any]) -> tuple[DataFrame | None, DataFrame]:
    """(rows, failures) of the section ``sources``: a list of kind (file, openapi, functions or a dotted path), id and settings."""
    readers = {}
    for k, one in enumerate(settings.get("sources") or []):
        given = dict(one)
        kind = given.pop("kind", "file")
        name = str(given.pop("id", f"{kind}-{k}"))
        if name in readers:
            raise ConfigError(f"sources[{k}]: the id {name} stands twice")
        if kind == "file":
            readers[name] = lambda g=given, n=name: catalogue.read_items(spark, g["path"], n)
        elif kind == "openapi":
            readers[name] = lambda g=given, n=name: catalogue.stamped(openapi.read_openapi_files(spark, g["path"], **{k: v for k, v in g.items() if k != "path"}), n)
        elif kind == "functions":
            readers[name] = lambda g=given, n=name: functions.FunctionSource([_dotted(f) for f in g["functions"]], **{k: v for k, v in g.items() if k != "functions"}).rows(spark)
        else:
            readers[name] = lambda g=given, kind=kind: H.create("source", kind, spark=spark, **g)
    return catalogue.discover(spark, readers)


def _dotted(path: str) -> Any:
    module, _, attribute = path.partition(":")
    if not attribute:
        raise ConfigError(f"{path} is no package.module:attribute")
    import importlib

    return getattr(importlib.import_module(module), attribute)


def drift_guard(settings: Mapping[str, Any]) -> DriftGuard | None:
    """The guard of the section ``drift``; None without one."""
    if settings.get("drift") is None:
        return None
    given = _known("drift", settings["drift"], {"quarantine", "trust_on_first_use", "path"})
    return DriftGuard(**{k: bool(v) for k, v in given.items() if k != "path"})


def tables(spark: SparkSession, settings: Mapping[str, Any]) -> dict[str, state.Table]:
    """The state tables that sections ``usage``, ``aliases`` and ``drift`` name a path for, and the audit of ``savings``."""
    kinds = {"usage": state.Usage, "aliases": state.Aliases, "drift": state.Approvals}
    out = {n: kind(spark, settings[n]["path"]) for n, kind in kinds.items() if (settings.get(n) or {}).get("path")}
    audited = (settings.get("savings") or {}).get("path")
    return out | ({"savings": state.Table(spark, audited, state.AUDIT)} if audited else {})


def hooks(settings: Mapping[str, Any]) -> H.Hooks:
    """Handlers by event from the section ``hooks``: dotted paths; ``strict`` lets their errors through."""
    section = dict(settings.get("hooks") or {})
    made = H.Hooks(bool(section.pop("strict", False)))
    for event, paths in section.items():
        for path in paths:
            made.on(event, _dotted(path))
    return made


def tracer(settings: Mapping[str, Any]) -> None:
    """Sets the tracer that the section ``tracer`` names by a dotted path."""
    if settings.get("tracer"):
        observe.set_tracer(_dotted(settings["tracer"]))


def on_error(settings: Mapping[str, Any]) -> str:
    """What a failing retrieval does by the section ``fallback``: fail, empty or fallback."""
    said = (settings.get("fallback") or {}).get("on_error", "fallback")
    if said not in ("fail", "empty", "fallback"):
        raise ConfigError(f"fallback.on_error: {said!r} is none of fail, empty, fallback")
    return said
