"""Change files as a stream: each new file is parsed and appended to a table of changes, from which
snapshots are built as in batch. Files that arrive again are not read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kairograph.sources.changes import steps_of, typed

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_changes(spark: SparkSession, folder: str, edges: bool = True) -> DataFrame:
    """A streaming table of typed changes from the change files of a folder."""
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "changes_t*_t*_*.json").load(folder)
    return typed(steps_of(raw), edges)


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, edges: bool = True) -> StreamingQuery:
    """Append the changes to a Parquet table, partitioned by step; stops once all files there are read."""
    return stream_changes(spark, folder, edges).writeStream.format("parquet").partitionBy("t").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
