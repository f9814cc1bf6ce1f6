"""Helpers shared by the training-data operators: column selection that ignores
clashing extra columns, and what Python workers keep."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.tables import cut, release, ship

__all__ = ["cut", "in_worker", "parallelism", "pick", "release", "scratch", "ship", "table"]

#: What a Python worker keeps from task to task, for one operator at a time.
_scratch: dict[str, object] = {}


def scratch(name: str, make: Callable[[], object]) -> object:
    """A value that lives in this worker until another operator's tasks come."""
    if name not in _scratch:
        _scratch.clear()
        _scratch[name] = make()
    return _scratch[name]


def in_worker(name: str, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` as a task of an operator: before it, what other operators left goes; after it, free memory
    goes back to the system, as idle workers count against their executor."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [k for k in _scratch if k != name]:
            del _scratch[other]
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, taken by position, so that neither extra columns nor ones
    that differ only in case make a reference ambiguous."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
