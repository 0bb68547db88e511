"""Shared helpers: the cluster's scratch folder, word patterns, folds."""

from __future__ import annotations

import tempfile
import uuid
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a temporary folder is
    made and set, so that every later call sees the same one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="remanence-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, label: str, batch_rows: int | None = None, files: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a lineage cut that
    survives the loss of any executor, and that later reads can prune.

    ``files``: most files to write, in proportion to the rows to come; without
    it every partition is a file, and small tables are very many small files.

    ``batch_rows`` bounds the rows that go to a Python worker at once while the
    table is made, where rows are wide.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    if batch_rows is not None:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    try:
        (df if files is None else df.coalesce(max(1, files))).write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(conf).delete(path, True)


def repeated_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``counts[i]`` of them) for every i."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale or script."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def fold(id_column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as ''."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % parts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
