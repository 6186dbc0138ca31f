"""Helpers shared by the corpus operators.

Every operator takes a DataFrame with ``doc_id`` and ``text``, selects exactly these two and
ignores the rest, so further columns may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from postsieve.session import ship, work_dir, written

__all__ = ["BLANKS", "id_bytes", "id_remainder", "id_text", "listed", "table", "work_dir", "written"]

#: Separators of words in every contract: space, tab, line feed, vertical tab, form feed, return.
#: ``bytes.split()`` splits on exactly these, ``bytes.lower()`` lower-cases exactly A-Z.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of strings and longs that the driver has, as part of the plan.

    From a list of tuples Spark makes an RDD instead, for which executors start Python workers of another kind beside those they have.
    """
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({n: pa.array(c, k) for c, (n, k) in zip(columns, fields, strict=True)}))


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` as string; all else is dropped."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def id_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the UTF-8 bytes of ``text``, null where the text is null."""
    return id_text(docs).select("doc_id", F.col("text").cast("binary").alias("raw"))


def id_remainder(n: int) -> Column:
    """crc32 of the decimal id, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
