"""JSON lines in and out, append-only caches, raw pages and gzip snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiesmith.schemas import TABLES


def read_jsonl(spark: SparkSession, path: str, name: str | None = None, schema: str | None = None) -> DataFrame:
    """A table of JSON objects, one a line; blank lines are skipped. The schema is that of stage table `name`, or given."""
    return spark.read.schema(schema or TABLES[name]).json(path)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False, compress: bool = False) -> None:
    """JSON lines with explicit nulls. `order` sorts them by range, so the parts in turn are in order; `one_file` is for tables that fit one task."""
    if one_file:
        df = df.coalesce(1).sortWithinPartitions(*order) if order else df.coalesce(1)
    elif order:
        df = df.orderBy(*order)
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip" if compress else "none").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(qid, html) of stored pages named by their id; empty files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.*)\.[^.]*$", 1)
    return files.where("length > 0").select(name.alias("qid"), F.col("content").alias("html"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
