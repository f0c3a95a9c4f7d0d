"""State that outlives a job: usage and alias events, approvals, audits, as Parquet tables with tolerant readers."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import StoreError
from . import feedback, maintain

log = logging.getLogger(__name__)

USAGE = "tool_id string, ts timestamp, count double"
ALIASES = "tool_id string, phrase string, ts timestamp, weight double"
APPROVALS = "tool_id string, digest string"
AUDIT = "query_id string, tool_id string, rank int, stage string, reason string, ts timestamp"


@dataclass
class Table:
    """Rows of a fixed schema below a path. A missing or unreadable table is an empty one, unless ``missing_ok`` is false."""

    spark: SparkSession
    path: str
    ddl: str
    missing_ok: bool = True

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def read(self) -> DataFrame:
        empty = self.spark.createDataFrame([], self.ddl)
        fs, path = self._fs()
        try:
            if not fs.exists(path(self.path)):
                raise StoreError(f"{self.path} doesn't exist")
            df = self.spark.read.parquet(self.path).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema))
            df.limit(1).collect()
            return df
        except (StoreError, PySparkException, Py4JJavaError) as broken:
            if not self.missing_ok:
                raise StoreError(f"{self.path} can't be read") from broken
            log.warning("%s is taken as empty: %s", self.path, str(broken).splitlines()[0])
            return empty

    def append(self, rows: DataFrame) -> None:
        empty = self.spark.createDataFrame([], self.ddl)
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema)).write.mode("append").parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """Writes the new rows beside the old ones and then takes their place, so a failed write leaves the old ones."""
        fs, path = self._fs()
        beside = f"{self.path.rstrip('/')}.{uuid.uuid4().hex}"
        rows.write.parquet(beside)
        old = f"{beside}.old"
        if fs.exists(path(self.path)):
            fs.rename(path(self.path), path(old))
        if not fs.rename(path(beside), path(self.path)):
            raise StoreError(f"{self.path} can't be written")
        fs.delete(path(old), True)

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], self.ddl))


class Usage(Table):
    """Confirmed uses; counts decay with time."""

    def __init__(self, spark: SparkSession, path: str, missing_ok: bool = True) -> None:
        super().__init__(spark, path, USAGE, missing_ok)

    def record(self, *ids: str, count: float = 1.0) -> None:
        rows = self.spark.createDataFrame([(i, float(count)) for i in ids], "tool_id string, count double")
        self.append(rows.withColumn("ts", F.current_timestamp()))

    def counts(self, as_of: float | None = None, half_life: float = feedback.USAGE_HALF_LIFE) -> DataFrame:
        now = F.unix_micros(F.current_timestamp()) / 1e6 if as_of is None else F.lit(float(as_of))
        return feedback.usage_counts(self.read(), now, half_life)

    def forget(self, ids: DataFrame) -> None:
        self.replace(feedback.forget(self.read(), ids))


class Aliases(Table):
    """What people asked when they then used an item."""

    def __init__(self, spark: SparkSession, path: str, missing_ok: bool = True) -> None:
        super().__init__(spark, path, ALIASES, missing_ok)

    def record(self, phrase: str, tool_id: str, weight: float = 1.0) -> None:
        row = self.spark.createDataFrame([(tool_id, phrase, float(weight))], "tool_id string, phrase string, weight double")
        self.append(row.withColumn("ts", F.current_timestamp()))

    def snapshot(self, as_of: float) -> DataFrame:
        return feedback.alias_weights(self.read(), F.lit(float(as_of)))

    def weight_of(self, tool_id: str, phrase: str, as_of: float) -> float:
        mine = self.read().filter(F.col("tool_id") == tool_id)
        asked = self.spark.createDataFrame([(phrase,)], "p string").select(feedback.normalise_phrase(F.col("p"))).first()[0]
        found = feedback.alias_weights(mine, F.lit(float(as_of))).filter(F.col("phrase") == asked).first()
        return 0.0 if found is None else found.weight

    def known_items(self) -> DataFrame:
        return self.read().select("tool_id").distinct()

    def forget(self, ids: DataFrame) -> None:
        self.replace(feedback.forget(self.read(), ids))


class Approvals(Table):
    """Digests that a person, or trust on first use, has approved."""

    def __init__(self, spark: SparkSession, path: str, missing_ok: bool = True) -> None:
        super().__init__(spark, path, APPROVALS, missing_ok)

    def approve(self, items: DataFrame) -> None:
        self.replace(maintain.upsert(self.read(), maintain.approvals_of(items)))

    def forget(self, ids: DataFrame) -> None:
        self.replace(feedback.forget(self.read(), ids))

    def accept(self, guard: maintain.DriftGuard, previous: DataFrame, incoming: DataFrame) -> DataFrame:
        """The rows to serve (see ``DriftGuard.accepted``); what is served as it came is approved."""
        served, after = guard.accepted(previous, incoming, self.read())
        served = served.persist()
        served.count()  # what is served was judged by the approvals before
        self.replace(after)
        return served


def audit(table: Table, evaluated: DataFrame) -> None:
    """Appends every candidate of a batch of selections with its final rank, or the stage and reason of its exclusion."""
    rows = evaluated.select(F.col("query_id").cast("string").alias("query_id"), "tool_id", F.col("final_rank").cast("int").alias("rank"), "stage", "reason", F.current_timestamp().alias("ts"))
    table.append(rows)
