"""The corpus pipeline: language ID, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns
a DataFrame: all but the last return rows of ``docs`` with its columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postsieve.llm.common import table, written
from postsieve.llm.decontaminate import decontaminate
from postsieve.llm.exact_dedup import exact_dedup
from postsieve.llm.language import UNKNOWN, fit_profiles, identify_language
from postsieve.llm.near_dedup import near_dedup
from postsieve.llm.packing import pack
from postsieve.llm.queries import tokenizer_path

_ROW, _FILE, _AT, _NUMBER = "__stage_row", "__stage_file", "__stage_at", "__stage_number"
#: The one profile where no row has a label: it takes all texts with letters. No text holds the n-gram 0.
_ANY = {"=": [0]}


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with a key of their own, and the same with that key as doc_id, for the operators.

    Stages decide by row: ids may be null or repeated. A row's key is its place: the number of its file, in the order of names, and
    its number in the file. So it is the same however often and in whatever splits the files are read, and texts need not be written
    again for it. Rows that don't come straight from files are written first.
    """
    if docs._jdf.queryExecution().optimizedPlan().nodeName() != "LogicalRelation":
        docs = written(docs)
    placed = docs.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_AT))
    names = placed.select(_FILE).distinct().withColumn(_NUMBER, F.row_number().over(Window.orderBy(_FILE)).cast("long"))
    rows = placed.join(written(names), _FILE).withColumn(_ROW, F.shiftleft(_NUMBER, 40) + F.col(_AT)).select(*docs.columns, _ROW)
    return rows, rows.withColumn("doc_id", F.col(_ROW))


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key isn't dropped (as doc_id).

    The keys are written first, so that Spark knows their size before it plans the join: few ones are
    broadcast under its threshold and the texts stay where they are, many are joined by a shuffle.
    """
    keys = written(dropped.select(F.col("doc_id").alias(_ROW)).distinct())
    return rows.join(keys, _ROW, "left_anti").select(*(c for c in rows.columns if c != _ROW))


def _all_but_least(rows: DataFrame, told: DataFrame, group: str) -> DataFrame:
    """Of each group the keys of all rows but the one with the least doc_id (null after all others, equal ones by key)."""
    members = written(told.select("doc_id", F.col(group).alias("of")))
    ids = rows.select(F.col(_ROW).alias("doc_id"), F.col("doc_id").cast("long").alias("id"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("least")
    kept = members.join(ids, "doc_id").groupBy("of").agg(least).select(F.col("least.doc_id").alias("doc_id"))
    return members.join(kept, "doc_id", "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language can be told (null texts and texts without letters)."""
    rows, keyed = _keyed(docs)
    named = {f"={name}": grams for name, grams in fit_profiles(rows).items()}  # no label reads as UNKNOWN then
    predicted = identify_language(keyed, named or _ANY)
    return _without(rows, predicted.filter(F.col("lang_pred") == UNKNOWN))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts, that of the least doc_id."""
    rows, keyed = _keyed(docs)
    return _without(rows, _all_but_least(rows, exact_dedup(keyed), "keep_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, 0.8), that of the least doc_id."""
    rows, keyed = _keyed(docs)
    return _without(rows, _all_but_least(rows, near_dedup(keyed, words=5, percent=80), "component_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a passage of the benchmark."""
    rows, keyed = _keyed(docs)
    return _without(rows, decontaminate(keyed, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("packing", packed)]

#: SQL has no MinHash, profiles, SimHash or best-fit packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
