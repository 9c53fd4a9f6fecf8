"""Small files and folders through Spark's file systems, so that any shared store will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, where: str) -> bool:
    fs, path = _at(spark, where)
    return fs.exists(path)


def delete(spark: SparkSession, where: str) -> None:
    """Deletes a file or folder; none is fine."""
    fs, path = _at(spark, where)
    fs.delete(path, True)


def make_folder(spark: SparkSession, where: str) -> None:
    fs, path = _at(spark, where)
    fs.mkdirs(path)


def names(spark: SparkSession, where: str) -> list[str]:
    """Names of what a folder holds, in order; of none, nothing."""
    fs, path = _at(spark, where)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def move(spark: SparkSession, old: str, new: str, stamp: int | None = None) -> None:
    """Renames a file; stamp is an order that its modification time shall tell, in seconds."""
    fs, path = _at(spark, new)
    fs.rename(_at(spark, old)[1], path)
    if stamp is not None:
        fs.setTimes(path, 1_000_000_000_000 + 1000 * stamp, -1)


def read_text(spark: SparkSession, where: str) -> str | None:
    """The text of a small file; null if there is none."""
    fs, path = _at(spark, where)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, where: str, text: str) -> None:
    """Writes a small file beside its place and renames it there."""
    fs, path = _at(spark, where)
    beside = f"{where}.{uuid.uuid4().hex}"
    stream = fs.create(_at(spark, beside)[1])
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(path, False)
    fs.rename(_at(spark, beside)[1], path)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that isn't set a local session may use the warehouse; on a cluster it
    must be set, as no machine's own folder would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
