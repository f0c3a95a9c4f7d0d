"""Policy: rules as verdict Columns, combining modes, selection rules, agent routing.

A rule gives (decision, reason) or abstains with null. All rules of a policy are one array column in evaluation
order, so any number of rules is one pass over the candidates, without a UDF.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COST_TIERS, RISK_TIERS, PolicyError, tier

ALLOW, DENY = "allow", "deny"
VERDICT = "struct<decision:string,reason:string>"

#: Reasons of verdicts. Exclusions are compared by them.
DENIED = "denied by pattern"
ALLOWED = "matched allow pattern "
NOT_ALLOWED = "not in the allowlist"
NO_SCOPES = "missing scopes: "
ALL_SCOPES = "all required scopes held"
SHARED = "shared tool, no tenant"
UNOWNED = "tool has no tenant and shared tools are disabled"
NO_TENANT = "request declared no tenant"
OTHER_TENANT = "belongs to another tenant"
OWN_TENANT = "tenant "
DENIED_TAGS = "carries denied tag(s): "
NO_TAGS = "missing required tag(s): "
BY_DEFAULT = "denied by default policy"
ABOVE = " exceeds ceiling "
BELOW = " below threshold "
BEYOND = "beyond max_tools limit of "


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored Java regular expression: ``*`` and ``?`` cross ``/``, ``[...]`` is a class."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", k + 2 if pattern[k : k + 1] == "!" else k + 1)
            if end < 0:
                out.append(r"\[")
            else:
                inner = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[k:end])
                out.append("[^" + inner[1:] + "]" if inner.startswith("!") else "[" + inner + "]")
                k = end + 1
        else:
            out.append(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", c))
    return r"(?s)\A" + "".join(out) + r"\z"


def first_match(patterns: Sequence[str], case_sensitive: bool = False) -> Column:
    """The first pattern that the id matches, or null."""
    target = F.col("tool_id") if case_sensitive else F.lower("tool_id")
    hits = [F.when(target.rlike(glob_regex(p if case_sensitive else p.lower())), F.lit(p)) for p in patterns]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def verdict(decision: str, reason: Column | str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _words(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in sorted(set(values)))).cast("array<string>")


@dataclass(frozen=True)
class Rule:
    name: str
    mandatory: bool = False

    def check(self) -> Column:
        raise NotImplementedError


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


@dataclass(frozen=True)
class DenyTools(Rule):
    patterns: tuple[str, ...] = ()
    reason: str = DENIED
    case_sensitive: bool = False

    def check(self) -> Column:
        hit = first_match(self.patterns, self.case_sensitive)
        return F.when(hit.isNotNull(), verdict(DENY, F.concat(F.lit(f"{self.reason}: "), _quoted(hit))))


@dataclass(frozen=True)
class AllowTools(Rule):
    """Allows what matches and denies everything else."""

    patterns: tuple[str, ...] = ()
    case_sensitive: bool = False

    def check(self) -> Column:
        hit = first_match(self.patterns, self.case_sensitive)
        return F.when(hit.isNotNull(), verdict(ALLOW, F.concat(F.lit(ALLOWED), _quoted(hit)))).otherwise(verdict(DENY, NOT_ALLOWED))


@dataclass(frozen=True)
class RequireScopes(Rule):
    """Denies items whose scopes the caller (array column ``scopes``) lacks; abstains if none are required."""

    def check(self) -> Column:
        need = F.coalesce(F.col("required_scopes"), F.array().cast("array<string>"))
        missing = F.array_sort(F.array_except(need, F.coalesce(F.col("scopes"), F.array().cast("array<string>"))))
        denied = verdict(DENY, F.concat(F.lit(NO_SCOPES), F.array_join(missing, ", ")))
        return F.when(F.size(need) == 0, F.lit(None).cast(VERDICT)).when(F.size(missing) > 0, denied).otherwise(verdict(ALLOW, ALL_SCOPES))


@dataclass(frozen=True)
class TenantIsolation(Rule):
    """Items of a tenant (column ``owner``) are for callers of that tenant (column ``tenant``); decides on every row."""

    mandatory: bool = True
    shared: bool = True

    def check(self) -> Column:
        owner, tenant = F.col("owner"), F.col("tenant")
        unowned = verdict(ALLOW, SHARED) if self.shared else verdict(DENY, UNOWNED)
        return (
            F.when(owner.isNull(), unowned)
            .when(tenant.isNull(), verdict(DENY, NO_TENANT))
            .when(owner != tenant, verdict(DENY, OTHER_TENANT))
            .otherwise(verdict(ALLOW, F.concat(F.lit(OWN_TENANT), owner)))
        )


@dataclass(frozen=True)
class MaxLevel(Rule):
    kind: str = "risk"
    ceiling: str = "medium"

    def check(self) -> Column:
        tiers = RISK_TIERS if self.kind == "risk" else COST_TIERS
        level = F.col(f"{self.kind}_level")
        reason = F.concat(F.lit(f"{self.kind} "), tier(level, tiers), F.lit(ABOVE + self.ceiling))
        return F.when(level > tiers.index(self.ceiling), verdict(DENY, reason))


def MaxRisk(ceiling: str, name: str = "max_risk") -> MaxLevel:
    return MaxLevel(name, kind="risk", ceiling=ceiling)


def MaxCost(ceiling: str, name: str = "max_cost") -> MaxLevel:
    return MaxLevel(name, kind="cost", ceiling=ceiling)


@dataclass(frozen=True)
class DenyTags(Rule):
    tags: tuple[str, ...] = ()

    def check(self) -> Column:
        hit = F.array_sort(F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")), _words(self.tags)))
        return F.when(F.size(hit) > 0, verdict(DENY, F.concat(F.lit(DENIED_TAGS), F.array_join(hit, ", "))))


@dataclass(frozen=True)
class RequireTags(Rule):
    tags: tuple[str, ...] = ()

    def check(self) -> Column:
        missing = F.array_sort(F.array_except(_words(self.tags), F.coalesce("tags", F.array().cast("array<string>"))))
        return F.when(F.size(missing) > 0, verdict(DENY, F.concat(F.lit(NO_TAGS), F.array_join(missing, ", "))))


@dataclass(frozen=True)
class PredicateRule(Rule):
    """Any boolean Column. True with on_true=allow abstains and false then denies; true with on_true=deny denies."""

    predicate: Column | None = None
    reason: str = "predicate"
    on_true: str = ALLOW

    def check(self) -> Column:
        holds = F.coalesce(self.predicate, F.lit(False))
        return F.when(~holds if self.on_true == ALLOW else holds, verdict(DENY, self.reason))


@dataclass(frozen=True)
class MinScore:
    """Selection rule: keep hits scoring at least ``threshold``."""

    threshold: float
    name: str = "min_score"

    def dropped(self, df: DataFrame) -> Column:
        reason = F.concat(F.lit("score "), F.format_string("%.4f", "score"), F.lit(f"{BELOW}{self.threshold:.4f}"))
        return F.when(F.col("score") < self.threshold, reason)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with __drop, the reason for which a row of __live goes."""
        return df.withColumn("__drop", F.when(F.col("__live"), self.dropped(df)))


@dataclass(frozen=True)
class MaxTools:
    """Selection rule: at most ``limit`` hits a query, pinned ones first; negative is unlimited, pins may exceed it."""

    limit: int
    pinned: tuple[str, ...] = ()
    name: str = "max_tools"

    def apply(self, df: DataFrame) -> DataFrame:
        if self.limit < 0:
            return df.withColumn("__drop", F.lit(None).cast("string"))
        pin = F.col("tool_id").isin(list(self.pinned)) if self.pinned else F.lit(False)
        pins = F.sum(pin.cast("int")).over(Window.partitionBy("query_id", "__live"))
        place = F.row_number().over(Window.partitionBy("query_id", "__live", "__pin").orderBy("rank"))
        room = F.greatest(F.lit(self.limit) - pins, F.lit(0))
        out = df.withColumn("__pin", pin).withColumn("__room", room).withColumn("__place", place)
        reason = F.lit(f"{BEYOND}{self.limit}")
        over = F.col("__live") & ~F.col("__pin") & (F.col("__place") > F.col("__room"))
        return out.withColumn("__drop", F.when(over, reason)).drop("__pin", "__room", "__place")


@dataclass(frozen=True)
class Policy:
    """Rules in order (mandatory ones first), then selection rules.

    ``deny_overrides``: any denial denies. ``first_match``: the first verdict decides. A mandatory denial decides
    at once in both, and later rules are not recorded; under first_match a mandatory allow sets the verdict without
    ending the evaluation. Rows without a verdict get ``default``.
    """

    rules: tuple[Rule, ...] = ()
    selection: tuple[MinScore | MaxTools, ...] = ()
    mode: str = "deny_overrides"
    default: str = ALLOW
    dry_run: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("deny_overrides", "first_match"):
            raise PolicyError(f"unknown mode {self.mode!r}")

    def ordered(self) -> list[Rule]:
        return sorted(self.rules, key=lambda r: not r.mandatory)

    def firings(self) -> Column:
        """array<struct<rule,decision,reason,mandatory>> in evaluation order, cut behind the deciding firing."""
        kind = "array<struct<rule:string,decision:string,reason:string,mandatory:boolean>>"
        if not self.rules:
            return F.array().cast(kind)
        made = []
        for r in self.ordered():
            v = r.check()
            fired = F.struct(F.lit(r.name).alias("rule"), v["decision"].alias("decision"), v["reason"].alias("reason"), F.lit(r.mandatory).alias("mandatory"))
            made.append(F.when(v.isNotNull(), fired))
        every = F.array_compact(F.array(*made))
        ends = lambda x: (x["mandatory"] & (x["decision"] == DENY)) | ((~x["mandatory"]) if self.mode == "first_match" else F.lit(False))
        at = F.array_position(F.transform(every, ends), F.lit(True)).cast("int")
        return F.when(at > 0, F.slice(every, 1, at)).otherwise(every).cast(kind)

    def decision(self) -> Column:
        """Verdict by the column ``firings``."""
        if self.mode == "deny_overrides":
            return F.when(F.exists("firings", lambda x: x["decision"] == DENY), DENY).when(F.size("firings") > 0, ALLOW).otherwise(self.default)
        return F.when(F.size("firings") > 0, F.element_at("firings", -1)["decision"]).otherwise(self.default)

    def judged(self, candidates: DataFrame) -> DataFrame:
        """``candidates`` with firings, decision and, for denied rows, reason."""
        return _explained(candidates.withColumn("firings", self.firings()).withColumn("decision", self.decision()))

    def evaluate(self, candidates: DataFrame) -> DataFrame:
        """Every candidate (query_id, tool_id, score, rank, ...) with firings, ``stage`` and ``reason`` of its exclusion.

        Kept rows have a null ``stage``. In a dry run everything is recorded but nothing counts as excluded, and each
        selection rule sees the whole list.
        """
        out = self.judged(candidates)
        out = out.withColumn("stage", F.when(F.col("decision") == DENY, "policy"))
        for rule in self.selection:
            out = rule.apply(out.withColumn("__live", F.lit(True) if self.dry_run else F.col("stage").isNull()))
            gone = F.col("__drop").isNotNull() & F.col("stage").isNull()
            out = out.withColumn("reason", F.when(gone, F.col("__drop")).otherwise(F.col("reason"))).withColumn("stage", F.when(gone, rule.name).otherwise(F.col("stage")))
            out = out.drop("__drop", "__live")
        return out.withColumn("kept", F.lit(True) if self.dry_run else F.col("stage").isNull())


def _explained(judged: DataFrame) -> DataFrame:
    denials = F.filter("firings", lambda x: x["decision"] == DENY)
    said = F.array_join(F.transform(denials, lambda x: F.concat(x["rule"], F.lit(": "), x["reason"])), "; ")
    reason = F.when(F.size(denials) > 0, said).otherwise(BY_DEFAULT)
    return judged.withColumn("reason", F.when(F.col("decision") == DENY, reason))


def exclusions(evaluated: DataFrame) -> DataFrame:
    return evaluated.filter("stage is not null").select("query_id", "tool_id", "stage", "reason")


def firing_rows(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("query_id", "tool_id", F.explode("firings").alias("f")).select("query_id", "tool_id", "f.rule", "f.decision", "f.reason")


@dataclass(frozen=True)
class AgentPolicies:
    """Routing by agent: none given uses the default; unknown ones too, unless ``strict`` denies them everything."""

    by_agent: Mapping[str, Policy] = field(default_factory=dict)
    default: Policy = field(default_factory=Policy)
    strict: bool = False

    def judged(self, candidates: DataFrame) -> DataFrame:
        """Each row by its agent's policy, all in one pass over the candidates."""
        agent = F.col("agent")
        routes = [(agent == name, policy) for name, policy in self.by_agent.items()]
        rest = Policy(default=DENY) if self.strict else self.default
        routes.append((agent.isNull(), self.default))

        def routed(column) -> Column:
            made = F.lit(None)
            for k, (here, policy) in enumerate(routes):
                made = F.when(here, column(policy)) if k == 0 else made.when(here, column(policy))
            return made.otherwise(column(rest))

        return _explained(candidates.withColumn("firings", routed(Policy.firings)).withColumn("decision", routed(Policy.decision)))


def build_policy(config: Mapping) -> Policy:
    """A policy from plain settings, rules in the fixed order: allow, deny, tags, tiers, scopes, tenant; floor before cap."""
    rules: list[Rule] = []
    if config.get("allow") is not None:
        rules.append(AllowTools("allow", patterns=tuple(config["allow"])))
    if config.get("deny"):
        rules.append(DenyTools("deny", patterns=tuple(config["deny"])))
    if config.get("deny_tags"):
        rules.append(DenyTags("deny_tags", tags=tuple(config["deny_tags"])))
    if config.get("require_tags"):
        rules.append(RequireTags("require_tags", tags=tuple(config["require_tags"])))
    if config.get("max_risk"):
        rules.append(MaxRisk(config["max_risk"]))
    if config.get("max_cost"):
        rules.append(MaxCost(config["max_cost"]))
    if config.get("require_scopes"):
        rules.append(RequireScopes("require_scopes"))
    if config.get("tenant_isolation"):
        rules.append(TenantIsolation("tenant_isolation"))
    selection: list[MinScore | MaxTools] = []
    if config.get("min_score"):
        selection.append(MinScore(float(config["min_score"])))
    if config.get("max_tools") is not None:
        selection.append(MaxTools(int(config["max_tools"]), tuple(config.get("pinned", ()))))
    return Policy(tuple(rules), tuple(selection), config.get("mode", "deny_overrides"), config.get("default", ALLOW), bool(config.get("dry_run")))


def describe_rules(policy: Policy) -> list[dict[str, object]]:
    """The rules of a policy in their order, then its selection rules: kind, name, mandatory and settings."""

    def one(rule) -> dict[str, object]:
        settings = {k: list(v) if isinstance(v, tuple) else v for k, v in vars(rule).items() if k not in ("name", "mandatory") and not callable(v)}
        return {"kind": type(rule).__name__, "name": rule.name, "mandatory": bool(getattr(rule, "mandatory", False)), "settings": settings}

    return [one(r) for r in (*policy.rules, *policy.selection)]
