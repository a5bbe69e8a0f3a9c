"""Small files on any file system that Spark can reach, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


def join(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/") or "/", *names]) if folder else "/".join(names)


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark names files."""
    system, where = _at(spark, path)
    return system.makeQualified(where).toString()


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.mkdirs(where)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Write a file, replacing one that is there; folders above are made."""
    system, where = _at(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def write_text(spark: SparkSession, path: str, text: str) -> str:
    return write_bytes(spark, path, text.encode())
