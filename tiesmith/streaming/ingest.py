"""Documents that keep arriving: the stateless stages as a stream, roll-ups by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiesmith.operators.segment import segment
from tiesmith.schemas import TABLES


def read_documents(spark: SparkSession, folder: str, schema: str | None = None, files_a_batch: int = 100) -> DataFrame:
    """JSON lines that are added to a folder."""
    return spark.readStream.schema(schema or TABLES["documents"]).option("maxFilesPerTrigger", files_a_batch).json(folder)


def sections(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode("sections").alias("section_idx", "s")).select("doc_id", "section_idx", F.col("s.text").alias("text"))


def write_sentences(documents: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Sentences of each arriving document as Parquet; a restart goes on where the checkpoint stands.

    Numbers run within a section, which one document brings whole, so each batch is final.
    """

    def put(batch: DataFrame, number: int) -> None:
        segment(sections(batch)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    stream = documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def fetch_rates(log: DataFrame, lateness: str = "14 days", window: str = "1 day") -> DataFrame:
    """Attempts a day by status of a log that streams in; rows later than `lateness` are left out, repeated rows count once."""
    timed = log.withWatermark("logged_at", lateness).dropDuplicatesWithinWatermark(["doc_id", "logged_at", "status"])
    return timed.groupBy(F.window("logged_at", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("attempts")).select(F.col("w.start").alias("day"), "status", "attempts")
