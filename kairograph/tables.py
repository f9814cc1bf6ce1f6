"""Written tables in the folder that driver and executors share, and the package on Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, as they may run on
    machines that do not have it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="kairograph-"), "kairograph_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent).as_posix())
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only in local mode (tests) may it be unset; then
    a folder is made for this application."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="kairograph-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def holding(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` of the session hold within."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, label: str = "cut", codec: str | None = None, settings: dict[str, str] | None = None, dealt: tuple[str, int] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, every executor sees the
    files, and a lost executor costs no recomputation of what came before. What the write
    shuffled is not needed afterwards, so Spark removes it when the write ends. ``settings`` of the session
    hold for the write. A table that is ``dealt`` out by a column into so many buckets is read back so."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with holding(spark, {_CLEANUP: "true"} | (settings or {})):
        if dealt is None:
            df.write.parquet(path, compression=codec)
        else:
            name = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
            df.write.bucketBy(dealt[1], dealt[0]).saveAsTable(name, format="parquet", path=path, **({"compression": codec} if codec else {}))
    if dealt is not None:
        out = spark.table(name)
        out._cut_path, out._cut_name = path, name
        return out
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        if hasattr(t, "_cut_name"):
            spark.sql(f"DROP TABLE IF EXISTS {t._cut_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
