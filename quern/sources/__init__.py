"""Reading and writing tables: COPY FROM, COPY TO and copy_from()."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("csv", "parquet", "json", "orc")


def resolved(path: str, basepath: str) -> str:
    """``path`` below ``basepath``, unless it is absolute or has a scheme."""
    return path if "://" in path or os.path.isabs(path) else os.path.join(basepath, path)


def _options(options: dict) -> tuple[str, dict]:
    rest = {k.lower(): v for k, v in options.items()}
    kind = rest.pop("format", "csv").lower()
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if "delimiter" in rest:
        rest["sep"] = rest.pop("delimiter")
    return kind, rest


def read_table(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """A file or folder. CSV has a header and inferred types unless the options say otherwise; ``schema`` spares the inference pass."""
    kind, rest = _options(options)
    reader = spark.read
    if "schema" in rest:
        reader = reader.schema(rest.pop("schema"))
    elif kind == "csv":
        rest = {"inferSchema": "true"} | rest
    if kind == "csv":
        rest = {"header": "true"} | rest
    return reader.format(kind).options(**rest).load(path)


def write_table(df: DataFrame, path: str, options: dict) -> None:
    """A folder of part files, or with the option ``single`` one file, which one task writes."""
    kind, rest = _options(options)
    single = str(rest.pop("single", False)).lower() == "true"
    if kind == "csv":
        rest = {"header": "true"} | rest
    if not single:
        df.write.mode("overwrite").format(kind).options(**rest).save(path)
        return
    jvm, side = df.sparkSession._jvm, f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.mode("overwrite").format(kind).options(**rest).save(side)
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = place(side).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in files.listStatus(place(side)) if x.getPath().getName().startswith("part-"))
    files.delete(place(path), True)
    if not files.rename(part, place(path)):
        raise OSError(f"cannot write {path}")
    files.delete(place(side), True)
