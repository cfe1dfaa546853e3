"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of just this name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, changed where a column has one of them already."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


#: Folders that this process has made, by session.
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which a cluster must set. Where it is unset on one machine, below a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def stored(df: DataFrame, folder: str, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    writer = df.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a stored table, or a folder of them, that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def made(spark: SparkSession) -> list[str]:
    """The folders of this session so far."""
    return list(_made.get(spark.sparkContext.applicationId, ()))


def clean(spark: SparkSession) -> None:
    """Removes all intermediate tables of this session; results that have not been written must not be read afterwards."""
    for folder in _made.pop(spark.sparkContext.applicationId, []):
        discard(spark, folder)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for jobs that run inside the block, with __ for a dot; put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of an Arrow batch: texts are long, and each of a task's stages holds a batch or two.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, unless the session's own setting is smaller. The setting stays: results run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that this Python worker does not use back to the system: workers are kept for later tasks, also of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow that releases memory at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # other pools keep what they free
        yield from work(batches)
        release()

    return run
