"""Mails as a stream: the batch stages run on each micro-batch unchanged, as they are stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postsieve.settings import DEFAULT, Settings
from postsieve.sources import mail

_FILES = "path string, modificationTime timestamp, length long, content binary"


def read(spark: SparkSession, path: str, s: Settings = DEFAULT) -> DataFrame:
    """(path, content) of new ``.eml`` files."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.eml").load(path)
    return files.filter(F.col("length") <= s.max_email_bytes).select("path", "content")


def documents(spark: SparkSession, path: str, level: str = "standard", salt: str = "") -> DataFrame:
    return mail.ingest(read(spark, path), level, salt)


def write(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends documents as Parquet, each once; ends when all files that are there are done."""
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(observations: DataFrame, late: str = "1 day") -> DataFrame:
    """label_id, lemma and hour counts of a stream of observations; what comes later than ``late`` is left out."""
    timed = observations.withWatermark("observed_at", late)
    return timed.groupBy(F.window("observed_at", "1 hour").alias("hour"), "label_id", "lemma").agg(F.sum("count").alias("total_count"))
