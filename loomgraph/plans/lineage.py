"""Cutting lineage: each round of an iterative plan is written to the shared folder and read again.

The folder is the one in ``spark.checkpoint.dir``; only where that is unset
(tests, one machine) a temporary one is made. Lost executors cost the tasks
they ran; rounds that ended stay.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None

#: Rows of a narrow table (two ids or an id and a number) that may be broadcast.
MAX_BROADCAST = 500_000


def shared_dir(spark: SparkSession) -> str:
    global _own
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


class Rounds:
    """Scratch tables of one computation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], {}

    def cut(self, df: DataFrame, by: str | None = None, dealt: bool = False) -> DataFrame:
        """With ``by``, rows lie in buckets by that column: joins and groups on it are not shuffled again.

        ``dealt``: ``df`` comes dealt by it already.
        """
        name = f"round_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/loomgraph/{name.replace('_', '-')}"
        self.paths.append(path)
        if by is None:
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (df if dealt else df.repartition(n, by)).write.bucketBy(n, by).option("path", path).format("parquet").saveAsTable(name)
        self.tables[path] = name
        out = self.spark.table(name)
        out._stored_by = by
        return out

    def drop(self, keep: int) -> None:
        """Delete all but the last ``keep`` tables."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while len(self.paths) > keep:
            path = self.paths.pop(0)
            if path in self.tables:
                self.spark.sql(f"drop table if exists {self.tables.pop(path)}")
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def stored_by(df: DataFrame, by: str) -> bool:
    """Whether ``df`` is a table that :meth:`Rounds.cut` put in buckets by that column."""
    return getattr(df, "_stored_by", None) == by


def small(df: DataFrame, rows: int = MAX_BROADCAST) -> DataFrame:
    """Hint a broadcast only where ``df`` has ``rows`` rows at most; the count stops there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
