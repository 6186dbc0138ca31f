"""What a Spark session needs to run the package's Python code on its executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows that go to a Python worker at once at most. Spark's default of 10000 rows of long texts takes hundreds of megabytes on either side.
BATCH_ROWS = 512
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once for each context; Spark fetches it anew on every executor that joins later.

    Also bounds the rows of a batch; a smaller bound that the session already has is kept.
    """
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_postsieve_shipped", False):
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="postsieve-")) / "postsieve.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path("postsieve") / f.relative_to(here))
    sc.addPyFile(str(path))
    sc._postsieve_shipped = True


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is missing and all runs on one machine (tests) a temporary folder takes its place; executors of a
    cluster wouldn't see each other's files in one, so there the setting is required.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.gettempdir() + "/postsieve-checkpoints"
    return f"{top.rstrip('/')}/postsieve/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends in files that survive lost executors."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
