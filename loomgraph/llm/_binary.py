"""Binary files through Spark's own writers and readers, on any store that Spark reaches.

Every row's bytes become one file of their own. The text writer is used, with
bytes passed through as a string unchanged; after each row it puts a
separator, so every file ends with ``TRAILER``, an empty skippable frame of
Zstandard. Task commits make this safe where executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAILER = b"P*M\x18\x00\x00\x00\x00"


def write_files(df: DataFrame, path: str, column: str = "data", by: str | None = None, mode: str = "error") -> None:
    """Write the bytes in ``column`` of each row to a file below ``path``, in a folder for each value of ``by`` if given."""
    data = F.col(column).cast("string").alias("value")
    out = df.select(data, *([by] if by else [])).write.option("lineSep", TRAILER.decode("latin-1")).option("maxRecordsPerFile", 1).option("compression", "none").mode(mode)
    (out.partitionBy(by) if by else out).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files that :func:`write_files` made, with their trailer; folders of ``by`` give a column."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
