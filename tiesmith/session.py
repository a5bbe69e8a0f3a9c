"""Session construction and the few settings every stage shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tiesmith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; `conf` overrides any of it."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint.

    The files go to the shared folder that the session names in spark.checkpoint.dir,
    so they outlive any executor. A folder of our own is set only where none is named: a temporary one
    on one machine, as in tests, else one beside the warehouse, which a cluster shares.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        alone = context.master.startswith("local") and not context.master.startswith("local-cluster")
        context.setCheckpointDir(named or (tempfile.mkdtemp(prefix="tiesmith-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"))
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Parts for a stage that computes much over few bytes, which sizes alone would give to too few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
