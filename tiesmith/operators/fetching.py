"""What was fetched, what is still to do, and how large the rest will be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_ok(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last successful attempt of each key; `order` decides, repeated rows count once."""
    last = F.max_by(F.struct(*[F.col(c) for c in log.columns]), F.struct(*[F.col(c) for c in order]))
    return log.where("status = 'ok'").groupBy(key).agg(last.alias("r")).select("r.*")


def still_to_do(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of `wanted` whose key `done` lacks: a resumed run starts from these."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def last_of_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, as an append-only cache is read."""
    last = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order]))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("r")).select("r.*")


def size_estimate(pages: DataFrame, plain: str, rich: str) -> DataFrame:
    """Sum, mean, median and most of plain sizes, and the ratio of rich to plain ones: mean, median, weighted."""
    ratio = F.col(rich) / F.nullif(F.col(plain), F.lit(0))
    return pages.agg(
        F.count(F.lit(1)).alias("pages"), F.sum(plain).cast("bigint").alias("total"), F.floor(F.avg(plain)).cast("bigint").alias("mean"),
        F.floor(F.median(plain)).cast("bigint").alias("median"), F.max(plain).cast("bigint").alias("largest"),
        F.round(F.avg(ratio), 4).alias("ratio_mean"), F.round(F.median(ratio), 4).alias("ratio_median"),
        F.round(F.sum(rich) / F.sum(plain), 4).alias("ratio_weighted"),
    )


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int, within: list[str] | None = None) -> DataFrame:
    """`n` rows by the order of a hash of seed and key, in all or within each group: the same at every run."""
    from pyspark.sql import Window as W

    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    if not within:
        return rows.withColumn("_draw", draw).orderBy("_draw", key).limit(n).drop("_draw")
    order = W.partitionBy(*within).orderBy("_draw", key)
    return rows.withColumn("_draw", draw).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_draw", "_rank")
