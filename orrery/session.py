"""Session helpers: configuration and sending this package to the executors."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session as the queries expect it: UTC, adaptive execution, ANSI."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.ansi.enabled", "true").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


#: Rows are handed to Python in batches of at most so many bytes, unless the session sets a size of its own.
BATCH_BYTES = 8 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Make the session ready for this package's Python functions.

    Sends the package to the executors once an application, so that they need no installation, and lowers Spark's
    default of 64 MB a batch, which several copies of a batch in each worker would multiply.
    """
    if spark.conf.get(_BATCH_KEY) == _BATCH_DEFAULT:  # with a default of its own, get would not tell Spark's
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="orrery-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def _trim() -> None:
    """Return freed memory to the system after a batch and at the end of a task, where the C library can."""
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back() -> None:
    """Return what this process has freed to the system: after large tables were on the driver, or in a worker."""
    pa.default_memory_pool().release_unused()
    _trim()


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors; workers give memory back after each batch."""
    ship(df.sparkSession)

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            give_back()
        _trim()

    return df.mapInArrow(frugal, schema)


def spread(df: DataFrame) -> DataFrame:
    """A table as read, over all cores where its files have fewer splits than that (one file of one row group is one
    task). Large tables have enough splits and stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
