"""Exact deduplication by content sort; DataFrame functions only.

Texts are normalised (each run of blanks becomes one space). Rows are range-partitioned by splitters
that Spark samples from a bounded key, the first ``PREFIX`` characters of the normalised text and a
64-bit hash of all of it. In a partition the external sort places equal texts next to each other,
and each row is compared with the one before it on the whole text: where they differ a run starts,
and the run's least doc_id comes first. Runs are the groups; no digest decides what is equal.

A text with more than one in ``HOT`` of all rows or bytes is dealt over as many runs as that share goes into it, so that
no task holds more of it. Each such run is then represented by its first row with the whole text, and
the representatives are sorted and compared with their neighbours in the same way. There are at most 2 * ``HOT`` texts
of this kind, and one for each ``MOST_BYTES`` of the input, which bounds the table that deals them: two numbers a text, some 5 MB at 100 TB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import BLANKS, id_text, written

PREFIX = 16
HOT = 16_384
#: Rows and bytes of a text that always go to one run, and bytes that never do, as a window holds the rows of a run.
ROWS, BYTES, MOST_BYTES = 1000, 4 << 20, 256 << 20
KEY = ("head", "h", "salt", "run")


def _runs(rows: DataFrame, within: WindowSpec, text: str) -> DataFrame:
    """Adds ``starts`` (the text differs from that of the row before), ``run`` (the number of starts so far) and ``least`` (doc_id of the run's first row)."""
    starts = rows.withColumn("starts", ~F.col(text).eqNullSafe(F.lag(text).over(within)))
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.last(F.when(F.col("starts"), F.struct("doc_id")), ignorenulls=True).over(upto)
    return starts.withColumns({"run": F.sum(F.col("starts").cast("long")).over(upto), "least": first["doc_id"]})


def _dealt(norm: DataFrame) -> DataFrame:
    """Texts with their sort key, and a salt for those that one task shouldn't hold alone."""
    sizes = written(norm.groupBy(F.xxhash64("norm").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("norm")).alias("bytes")))
    rows, size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = F.ceil(F.greatest(F.col("n") / max(ROWS, rows / HOT), F.col("bytes") / max(BYTES, min(MOST_BYTES, size / HOT)))).cast("int")
    hot = sizes.select(F.col("h").alias("hot"), parts.alias("parts")).filter("parts > 1")
    keyed = norm.select("doc_id", "norm", F.substring("norm", 1, PREFIX).alias("head"), F.xxhash64("norm").alias("h"))
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    return keyed.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left").select("doc_id", "norm", "head", "h", F.coalesce(salt, F.lit(-1)).alias("salt"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group (a text of blanks only is one space, a
    group of its own). Of equal texts the smallest doc_id stays. A row with a null doc_id is only
    kept if no row of its group has an id; its group's keep_id is then null. Rows that repeat an id
    within a group are all kept if the id is the smallest. No rows in, no rows out.
    """
    norm = id_text(docs).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ").alias("norm"))
    ordered = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1], F.col("doc_id").asc_nulls_last())
    # The range partitioning by (head, h, salt) already clusters the windows' keys: no second exchange.
    runs = _runs(_dealt(norm).repartitionByRange("head", "h", "salt"), ordered("head", "h", "salt", "norm"), "norm")
    split = F.col("salt") >= 0
    told = runs.select("doc_id", *KEY, "least", F.when(F.col("starts") & split, F.col("norm")).alias("text"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    rows = written(told.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*KEY))))
    merged = _merged(rows.filter("text is not null").select(*KEY, F.col("least").alias("doc_id"), "size", "text"))
    joined = rows.drop("text").join(merged, list(KEY), "left")
    whole = F.col("group_size").isNull()
    keep_id = F.when(whole, F.col("least")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.when(whole, F.col("size")).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


def _merged(parts: DataFrame) -> DataFrame:
    """For the runs of texts that were dealt: the least doc_id and the size of all runs of the same text."""
    same = _runs(parts.withColumnRenamed("run", "own"), Window.partitionBy("head", "h").orderBy("text", F.col("doc_id").asc_nulls_last()), "text")
    found = written(same.select("head", "h", "salt", "own", "run", "least", "size"))
    sizes = found.groupBy("head", "h", "run").agg(F.first("least").alias("keep_id"), F.sum("size").alias("group_size"))
    return written(found.join(sizes, ["head", "h", "run"]).select("head", "h", "salt", F.col("own").alias("run"), "keep_id", "group_size"))
