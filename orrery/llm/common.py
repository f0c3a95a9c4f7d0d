"""Helpers shared by the corpus operators: staging, group statistics and skew-proof joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import give_back, map_arrow, ship, spread

__all__ = ["Memo", "documents", "give_back", "join_groups", "map_arrow", "release_staged", "shared_dir", "ship", "staged", "word_count"]

#: ASCII white space, the separator of words in every operator here.
WHITE = r"[\x20\x09-\x0D]"
#: A word: a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Groups with more than total / HOT_PARTS rows count as hot, so there are at most HOT_PARTS of them.
HOT_PARTS = 1024

_own_dirs: dict[str, str] = {}
_staged: list[str] = []


class Memo(dict):
    """What a worker remembers about words, at most ``most`` of them. Only the one in use keeps its words, so a worker
    that has served several operators holds no more than a fresh one."""

    _all: list[Memo] = []

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self._all.append(self)

    def use(self) -> None:
        """Call before a batch: empties the other memos, and this one when it is full."""
        for m in self._all:
            if m and (m is not self or len(m) >= self.most):
                m.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session that is all in one process may
    leave it unset and gets a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="orrery-")
    return _own_dirs[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> int:
    """Deletes what ``staged`` has written for this driver so far, once the results that read it are written themselves;
    gives the number of tables."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _staged:
        path = at(_staged.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def documents(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """The documents as they are stored; over all cores, unless their order within a file is wanted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs if in_order else spread(docs)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key, ``size`` rows of ``rows`` each) whatever a group's size.

    A group with more than ``total / HOT_PARTS`` rows is hot; there are at most HOT_PARTS of those by arithmetic, so
    their keys' hashes go into a filter, they are broadcast and their rows stay where they are. All other groups are
    small, so the shuffled join has no skewed key. Null keys never match.
    """
    key = F.xxhash64(*keys)
    hashes = [r.h for r in groups.filter(F.col(size) > max(total // HOT_PARTS, 1)).select(key.alias("h")).collect()]
    if not hashes:
        return rows.join(groups, keys, how)
    hot = key.isin(hashes)  # another group with the hash of a hot one is broadcast too
    in_hot = rows.filter(hot).join(F.broadcast(groups.filter(hot)), keys, how)
    in_cold = rows.filter(~hot).join(groups.filter(~hot), keys, how)
    return in_hot.unionByName(in_cold)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
