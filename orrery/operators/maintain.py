"""Index maintenance: dedup, upsert, delete, incremental sync, pruning, drift."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import TextConfig, content_hash, index_text
from ..schema import RISK_TIERS, tier


def dedup_last_wins(items: DataFrame, seq_col: str, id_col: str = "tool_id") -> DataFrame:
    """One row an id: the last writer's values at the first sighting's position (``first_seq``)."""
    each = Window.partitionBy(id_col)
    last = F.row_number().over(each.orderBy(F.desc(seq_col)))
    return items.withColumn("first_seq", F.min(seq_col).over(each)).withColumn("__last", last).filter("__last = 1").drop("__last", seq_col)


def duplicate_ids(items: DataFrame, id_col: str = "tool_id") -> DataFrame:
    """Ids that occur more than once and how many rows a dedup skips for each."""
    return items.groupBy(id_col).agg((F.count("*") - 1).alias("skipped")).filter("skipped > 0")


def last_wins(records: DataFrame, id_col: str = "tool_id") -> DataFrame:
    """One row an id, the last one in the order of the table's partitions."""
    return dedup_last_wins(records.withColumn("__seq", F.monotonically_increasing_id()), "__seq", id_col).drop("first_seq")


def upsert(existing: DataFrame, records: DataFrame, id_col: str = "tool_id") -> DataFrame:
    """``existing`` with ``records`` in place of the rows of their ids; of records with one id the last one counts."""
    return existing.join(records.select(id_col), id_col, "left_anti").unionByName(last_wins(records, id_col))


def delete(existing: DataFrame, ids: DataFrame, id_col: str = "tool_id") -> DataFrame:
    return existing.join(ids.select(id_col), id_col, "left_anti")


def with_text(items: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    return items.withColumn("text", index_text(set(items.columns), config))


def privilege(risk: Column, scopes: Column, tags: Column) -> Column:
    """The fields that authorisation depends on, as text."""
    words = lambda xs: F.when(F.size(xs) > 0, F.array_join(F.array_sort(xs), ",")).otherwise("none")
    return F.concat(F.lit("risk="), risk, F.lit(" scopes="), words(scopes), F.lit(" tags="), words(tags))


def sensitive_digest(description: Column, schema: Column) -> Column:
    return content_hash(description, schema)


def _state() -> Column:
    """One hash over all that makes a rewrite necessary."""
    return content_hash(
        F.col("text"), F.col("source_id"), F.col("risk_level").cast("string"), F.col("cost_level").cast("string"),
        F.array_join(F.array_sort("tags"), ","), F.array_join(F.array_sort("required_scopes"), ","), F.coalesce("owner", F.lit("")),
    )


def classify(existing: DataFrame, incoming: DataFrame, answered: DataFrame | None = None, prune: bool = True) -> DataFrame:
    """tool_id, action: added, reembed (text changed), rewrite (anything else changed), unchanged, removed or kept.

    Both sides need ``text``. A row that is gone is removed only if its source answered (``answered``: source_id);
    without ``answered`` all sources did.
    """
    left = existing.select("tool_id", F.xxhash64("text").alias("old_text"), _state().alias("old_state"), F.col("source_id").alias("old_source"))
    right = incoming.select("tool_id", F.xxhash64("text").alias("new_text"), _state().alias("new_state"))
    both = left.join(right, "tool_id", "full_outer")
    gone = F.lit(prune)
    if answered is not None:
        both = both.join(answered.select(F.col("source_id").alias("old_source"), F.lit(True).alias("__answered")).distinct(), "old_source", "left")
        gone = gone & F.coalesce("__answered", F.lit(False))
    action = (
        F.when(F.col("old_state").isNull(), "added")
        .when(F.col("new_state").isNull(), F.when(gone, "removed").otherwise("kept"))
        .when(F.col("old_text") != F.col("new_text"), "reembed")
        .when(F.col("old_state") != F.col("new_state"), "rewrite")
        .otherwise("unchanged")
    )
    return both.select("tool_id", action.alias("action"))


def apply_sync(existing: DataFrame | None, incoming: DataFrame, embed: Callable[[DataFrame], DataFrame], answered: DataFrame | None = None, prune: bool = True) -> DataFrame:
    """The next version of an index: ``embed`` runs on new rows and on rows with another text only.

    Rows that changed elsewhere are rewritten with the vector they have, unchanged ones stay as they are, and rows that
    are gone go if their source answered (see ``classify``). Of incoming rows with one id the last counts. ``embed`` maps
    rows with ``text`` to the same rows with the columns that only the index has.
    """
    incoming = last_wins(incoming)
    if existing is None:
        return embed(incoming)
    acts = classify(existing, incoming, answered, prune)
    fresh = incoming.join(acts.filter(F.col("action").isin("added", "reembed", "rewrite")), "tool_id")
    made = embed(fresh.filter("action <> 'rewrite'").drop("action"))
    own = [c for c in existing.columns if c not in incoming.columns]
    rewritten = fresh.filter("action = 'rewrite'").drop("action").join(existing.select("tool_id", *own), "tool_id")
    kept = existing.join(acts.filter(F.col("action").isin("unchanged", "kept")), "tool_id", "left_semi")
    return kept.unionByName(rewritten.select(*existing.columns)).unionByName(made.select(*existing.columns))


def report(classified: DataFrame) -> DataFrame:
    """One row of counts: added, reembedded, rewritten, unchanged, removed, total (without removed and kept)."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return classified.agg(
        n("added").alias("added"), n("reembed").alias("reembedded"), n("rewrite").alias("rewritten"), n("unchanged").alias("unchanged"),
        n("removed").alias("removed"), n("added", "reembed", "rewrite", "unchanged").alias("total"),
    )


def prunable(existing: DataFrame, incoming: DataFrame, answered: DataFrame) -> DataFrame:
    """Rows that an answering source no longer has."""
    return existing.join(incoming.select("tool_id"), "tool_id", "left_anti").join(answered.select("source_id").distinct(), "source_id", "left_semi")


@dataclass(frozen=True)
class DriftGuard:
    """Holds back changed or new items until their digest is approved.

    ``trust_on_first_use``: new items are served and approved at once.
    """

    quarantine: bool = True
    trust_on_first_use: bool = True

    def changes(self, previous: DataFrame, incoming: DataFrame, approvals: DataFrame) -> DataFrame:
        """tool_id, kind (description, schema, privilege), before, after, quarantined; privilege changes never are."""
        part = lambda df, side: df.select(
            "tool_id", F.col("description").alias(f"d_{side}"), F.col("input_schema").alias(f"s_{side}"),
            privilege(tier(F.col("risk_level"), RISK_TIERS), F.col("required_scopes"), F.col("tags")).alias(f"p_{side}"),
            sensitive_digest(F.col("description"), F.col("input_schema")).alias(f"digest_{side}"),
        )
        both = part(previous, "old").join(part(incoming, "new"), "tool_id").join(approvals.select("tool_id", F.col("digest").alias("__ok")), "tool_id", "left")
        held = F.lit(self.quarantine) & ~F.col("digest_new").eqNullSafe(F.col("__ok"))
        made = [
            F.when(F.col(f"{c}_old") != F.col(f"{c}_new"), F.struct(F.lit(kind).alias("kind"), F.col(f"{c}_old").alias("before"), F.col(f"{c}_new").alias("after"), (held if c != "p" else F.lit(False)).alias("quarantined")))
            for c, kind in (("d", "description"), ("s", "schema"), ("p", "privilege"))
        ]
        return both.select("tool_id", F.explode(F.array_compact(F.array(*made))).alias("c")).select("tool_id", "c.*")

    def decide(self, previous: DataFrame, incoming: DataFrame, approvals: DataFrame) -> DataFrame:
        """tool_id, state: held_new, new, held, changed or same. Held items keep their previous version."""
        new = incoming.select("tool_id", sensitive_digest(F.col("description"), F.col("input_schema")).alias("digest"), privilege(tier(F.col("risk_level"), RISK_TIERS), F.col("required_scopes"), F.col("tags")).alias("p"))
        old = previous.select("tool_id", sensitive_digest(F.col("description"), F.col("input_schema")).alias("old_digest"), privilege(tier(F.col("risk_level"), RISK_TIERS), F.col("required_scopes"), F.col("tags")).alias("old_p"))
        both = new.join(old, "tool_id", "left").join(approvals.select("tool_id", F.col("digest").alias("__ok")), "tool_id", "left")
        approved = F.col("digest").eqNullSafe(F.col("__ok"))
        differs = (F.col("digest") != F.col("old_digest")) | (F.col("p") != F.col("old_p"))
        fresh = F.when(F.lit(self.quarantine and not self.trust_on_first_use) & ~approved, "held_new").otherwise("new")
        state = F.when(F.col("old_digest").isNull(), fresh).when(differs, F.when(F.lit(self.quarantine) & ~approved, "held").otherwise("changed")).otherwise("same")
        return both.select("tool_id", state.alias("state"))

    def accepted(self, previous: DataFrame, incoming: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the rows to serve, the approvals afterwards).

        A held item is served in its previous version and a held new one not at all; all that is served as it came is
        approved by its digest.
        """
        states = self.decide(previous, incoming, approvals)
        held = states.filter(F.col("state").isin("held", "held_new"))
        served = incoming.join(held, "tool_id", "left_anti")
        old = previous.join(states.filter("state = 'held'"), "tool_id", "left_semi")
        return served.unionByName(old, allowMissingColumns=True), upsert(approvals, approvals_of(served))


def approvals_of(items: DataFrame) -> DataFrame:
    """tool_id, digest of items as they are: what approving them records."""
    return items.select("tool_id", sensitive_digest(F.col("description"), F.col("input_schema")).alias("digest"))


class VersionedStore:
    """An index as Parquet folders below one path and a manifest a version, which names the folder of every partition.

    A change writes the partitions that it touches and a new manifest; the others stay where they are. Readers see the
    last manifest, which appears last, so neither they nor failed writers see half an index. Two writers of one version
    collide on the manifest's name, and the second one fails.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ("namespace",)) -> None:
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), partition_by

    def _fs(self) -> tuple[Any, Any]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, start: str) -> list[str]:
        fs, path = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []
        return sorted(n for n in found if n.startswith(start))

    def versions(self) -> list[str]:
        return [n for n in self._names("v") if n.endswith(".json")]

    def manifest(self, version: str | None = None) -> dict[str, Any] | None:
        """schema and folders (by partition) of a version, the last one unless named; None where there is none."""
        names = self.versions()
        if not names:
            return None
        (text,) = self.spark.read.text(f"{self.path}/{version or names[-1]}", wholetext=True).collect()
        return json.loads(text.value)

    def current(self) -> DataFrame | None:
        held = self.manifest()
        if held is None:
            return None
        schema = StructType.fromJson(held["schema"])
        if not held["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", self.path).schema(schema).parquet(*(f"{self.path}/{f}" for f in sorted(set(held["folders"].values())))).select(*schema.names)

    def _keys(self, df: DataFrame) -> list[str]:
        return [c for c in self.partition_by if c in df.columns]

    def _put(self, df: DataFrame) -> dict[str, str]:
        """Writes rows to a folder of their own; its partitions by name."""
        fs, path = self._fs()
        folder, keys = f"batch=u{uuid.uuid4().hex}", self._keys(df)
        if not keys:
            df.write.parquet(f"{self.path}/{folder}")
            return {"all": folder}
        df.repartition(*keys).sortWithinPartitions(*keys).write.partitionBy(*keys).parquet(f"{self.path}/{folder}")

        def partitions(at: str, depth: int) -> list[str]:
            names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{folder}/{at}".rstrip("/"))) if s.isDirectory()]
            below = [f"{at}/{n}".lstrip("/") for n in names if "=" in n]
            return below if depth == 1 else [x for b in below for x in partitions(b, depth - 1)]

        return {p: f"{folder}/{p}" for p in partitions("", len(keys))}

    def _commit(self, schema: StructType, folders: dict[str, str]) -> None:
        fs, path = self._fs()
        text = json.dumps({"schema": schema.jsonValue(), "folders": folders})
        out = fs.create(path(f"{self.path}/v{len(self.versions()):08d}.json"), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write(self, df: DataFrame) -> None:
        """A version of these rows alone."""
        self._commit(df.schema, self._put(df))

    def change(self, records: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """A version with ``records`` in place of the rows of their ids and without the ids in ``gone``; rewrites only the
        partitions in which such rows are or come to be."""
        held, now = self.manifest(), self.current()
        if held is None or now is None:
            if records is not None:
                self.write(last_wins(records))
            return
        ids = [x.select("tool_id") for x in (records, gone) if x is not None]
        touched = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
        keys = self._keys(now)
        if not held["folders"]:
            dirs: set[str] = set()
        elif keys:
            hit = now.join(touched, "tool_id", "left_semi").select(*keys)
            hit = (hit if records is None else hit.unionByName(records.select(*keys))).distinct()
            located = now.select(*keys, F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("__dir"))
            same = [located[k].eqNullSafe(hit[k]) for k in keys]
            found = {unquote(r[0]) for r in located.join(hit, same, "left_semi").select("__dir").distinct().collect()}  # a row a partition
            dirs = {p for p, f in held["folders"].items() if any(d.endswith("/" + f) for d in found)}
        else:
            dirs = set(held["folders"])
        rest = None
        if dirs:
            read = self.spark.read.option("basePath", self.path).schema(now.schema).parquet(*(f"{self.path}/{held['folders'][d]}" for d in sorted(dirs))).select(*now.columns)
            rest = read.join(touched, "tool_id", "left_anti")
        new = None if records is None else last_wins(records).select(*now.columns)
        both = rest if new is None else new if rest is None else rest.unionByName(new)
        self._commit(now.schema, {p: f for p, f in held["folders"].items() if p not in dirs} | ({} if both is None else self._put(both)))

    def upsert(self, records: DataFrame) -> None:
        self.change(records)

    def delete(self, ids: DataFrame) -> int:
        now = self.current()
        if now is None:
            return 0
        gone = now.join(ids.select("tool_id"), "tool_id", "left_semi").count()
        if gone:
            self.change(gone=ids)
        return gone

    def sync(self, incoming: DataFrame, embed: Callable[[DataFrame], DataFrame], answered: DataFrame | None = None, prune: bool = True) -> dict[str, int] | None:
        """Brings the index in step with ``incoming`` (with ``text``) and gives the report; None for the first version.

        Only rows with a new text are embedded, only partitions with a change are written.
        """
        now = self.current()
        if now is None:
            self.write(apply_sync(None, incoming, embed))
            return None
        incoming = last_wins(incoming)
        acts = classify(now, incoming, answered, prune).persist()
        try:
            counts = report(acts).first().asDict()
            changed = acts.filter(F.col("action").isin("added", "reembed", "rewrite")).select("tool_id")
            after = apply_sync(now, incoming, embed, answered, prune).join(changed, "tool_id", "left_semi")
            if counts["added"] + counts["reembedded"] + counts["rewritten"] + counts["removed"]:
                self.change(after, acts.filter("action = 'removed'").select("tool_id"))
        finally:
            acts.unpersist()
        return counts

    def get(self, *ids: str) -> list:
        now = self.current()
        return [] if now is None else now.filter(F.col("tool_id").isin(*ids)).orderBy("tool_id").collect()

    def clear(self) -> None:
        """A version without rows."""
        held = self.manifest()
        if held is not None:
            self._commit(StructType.fromJson(held["schema"]), {})

    def __len__(self) -> int:
        now = self.current()
        return 0 if now is None else now.count()

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the last ``keep`` versions names, and those of failed writes; gives their number.

        Versions before them can't be read any more. Not to be called while somebody writes.
        """
        fs, path = self._fs()
        held = [set((self.manifest(v) or {"folders": {}})["folders"].values()) for v in self.versions()]
        used = set().union(*held[-keep:]) if held else set()
        named = set().union(*held) if held else set()
        unnamed = {n for n in self._names("batch=") if not any(f.split("/")[0] == n for f in named)}
        old = [f for f in sorted((named - used) | unnamed) if fs.exists(path(f"{self.path}/{f}"))]
        for f in old:
            fs.delete(path(f"{self.path}/{f}"), True)
        return len(old)
