"""Shared helpers: table reading, shared scratch tables, checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and 0x09-0x0D.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = "[\\x20\\x09-\\x0D]+"

#: Seconds after which it is looked whether the shuffles of ended plans are gone.
WAITS = (0.1, 0.2, 0.4, 0.8)

_own_dir: str | None = None
_stored: dict[str, list[str]] = {}
#: Names in the catalogue of those that are dealt by a key.
_tables: dict[str, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (tests, one machine) a temporary folder is made.
    """
    global _own_dir
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, _own_dir, True)
        spark.sparkContext.setCheckpointDir(_own_dir)
    return f"file://{_own_dir}"


def scratch_path(spark: SparkSession, name: str, owner: str = "") -> str:
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    _stored.setdefault(owner, []).append(path)
    return path


def store(df: DataFrame, name: str, owner: str = "") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: this cuts the lineage.

    Lost executors cost only the task they ran; a stored table never has to be
    made again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, owner)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, owner: str = "") -> DataFrame:
    """Like :func:`store`, dealt by ``key``, so that joins on it do not shuffle it again."""
    spark = df.sparkSession
    path, n = scratch_path(spark, name, owner), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "loomgraph_" + re.sub("[^0-9a-z]", "_", path.rsplit("/", 1)[1])
    df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).format("parquet").saveAsTable(table)
    _tables.setdefault(owner, []).append(table)
    return spark.table(table)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have ended.

    It does so only once the driver's garbage collector has found the plans
    unused, which a driver with little to do may put off for half an hour. A
    plan is in use until its end has been told to all listeners, so where
    shuffles are left it is looked again, a few times.
    """
    jvm = spark.sparkContext._jvm
    left = jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    for seconds in WAITS:
        gc.collect()
        jvm.System.gc()
        time.sleep(seconds)
        if left.isEmpty():
            return


def release(spark: SparkSession, owner: str) -> None:
    """Delete the scratch tables of ``owner``; their readers must have ended."""
    for table in _tables.pop(owner, []):
        spark.sql(f"drop table if exists {table}")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _stored.pop(owner, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if ``df`` (a stored, narrow table) has at most ``max_rows`` rows.

    The count stops at the bound. Larger tables are left to shuffle joins.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ascii_lower(col):
    """Lower-case A-Z only; other letters stay.

    ``lower`` does the same for texts of ASCII alone and is much faster.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))
