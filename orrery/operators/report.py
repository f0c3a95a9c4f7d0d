"""Reports as text and plain dictionaries, from the small tables that analyses and evaluations end in."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILURES, FINDINGS = 20, 20


def plain(df: DataFrame, digits: int = 4) -> list[dict[str, Any]]:
    """Rows as dictionaries, doubles rounded."""
    return [{k: round(v, digits) if isinstance(v, float) else v for k, v in r.asDict(True).items()} for r in df.collect()]


def benchmark(summary: DataFrame, by_category: DataFrame, results: DataFrame) -> dict[str, Any]:
    """Totals, categories by rising hit rate and the first failures by query."""
    failed = results.filter("not hit")
    return {
        "total": plain(summary)[0], "categories": plain(by_category.orderBy("hit_rate", "category")),
        "failures": plain(failed.orderBy("query_id").limit(FAILURES)), "failed": failed.count(),
    }


def benchmark_text(made: dict[str, Any]) -> str:
    t = made["total"]
    lines = [f"{t['cases']} cases, {t['hits']} hits ({t['hit_rate']:.1%})", f"recall {t['mean_recall']:.3f}  precision {t['mean_precision']:.3f}  MRR {t['mean_reciprocal_rank']:.3f}  context saved {t['context_reduction']:.1%}"]
    lines += [f"  {c['category']}: {c['hits']} of {c['cases']} ({c['hit_rate']:.1%})" for c in made["categories"]]
    lines += [f"  missed: {f['query_id']}" for f in made["failures"]]
    return "\n".join(lines + ([f"  and {made['failed'] - len(made['failures'])} more"] if made["failed"] > len(made["failures"]) else []))


def calibration_text(calibration: DataFrame) -> str:
    rows = calibration.orderBy("percentile").collect()
    return "\n".join(f"p{r.percentile}: floor {r.floor:.4f}  noise rejected {r.noise_rejected:.1%}  emptied {r.samples_emptied:.1%}  thinned {r.samples_thinned:.1%}" for r in rows)


def diagnosis_text(findings: DataFrame) -> str:
    total = findings.count()
    bad = findings.filter(F.size("issues") > 0)
    rows = bad.orderBy(F.desc(F.size("issues")), "tool_id").limit(FINDINGS).collect()
    return "\n".join([f"{bad.count()} of {total} items with an issue", *(f"  {r.tool_id}: {', '.join(r.issues)}" for r in rows)])


def diff_text(diff: DataFrame) -> str:
    """Gained and lost items by agent, twenty a side at most."""
    lines = []
    for r in diff.groupBy("agent", "change").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("tool_id")), 1, FINDINGS).alias("ids")).orderBy("agent", "change").collect():
        lines.append(f"{r.agent} {r.change} {r.n}: {', '.join(r.ids)}" + (", ..." if r.n > len(r.ids) else ""))
    return "\n".join(lines) or "no change"


def sync_text(counts: dict[str, int]) -> str:
    changed = counts["added"] + counts["reembedded"] + counts["rewritten"] + counts["removed"]
    return f"{changed} changed of {counts['total']}: " + ", ".join(f"{counts[k]} {k}" for k in ("added", "reembedded", "rewritten", "unchanged", "removed"))


def savings_text(savings: DataFrame) -> str:
    r = savings.first()
    how = "measured" if r.measured else "estimated"
    return f"{r.selections} selections: {r.tokens_sent or 0} of {r.tokens_if_full or 0} tokens sent ({how}), {r.saved_share:.1%} saved"


def drift_text(changes: DataFrame) -> DataFrame:
    """tool_id, kind, text of each change; long values are cut."""
    cut = lambda c: F.when(F.length(c) > 60, F.concat(F.substring(c, 1, 57), F.lit("..."))).otherwise(F.col(c))
    mark = F.when(F.col("quarantined"), F.lit(" (held)")).otherwise(F.lit(""))
    return changes.select("tool_id", "kind", F.concat("tool_id", F.lit(": "), "kind", F.lit(" changed from '"), cut("before"), F.lit("' to '"), cut("after"), F.lit("'"), mark).alias("text"))
