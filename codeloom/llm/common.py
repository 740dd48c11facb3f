"""Small helpers that several operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, for Java's, RE2's and Python's expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def widened(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` with further columns, all nullable."""
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    return T.StructType(fields + T.StructType.fromDDL(more).fields)


def word_count(text: Column) -> Column:
    """The number of words of a text as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows of documents apart: two rows that agree in it are repeated rows. The parts are not null."""
    text = F.coalesce(text, F.lit(""))
    return [F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text), F.octet_length(text)]


def by_text(batch, column: str, most_bytes: int):
    """Slices of an Arrow batch with at most ``most_bytes`` of text each (one row at least), to bound a task's memory."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def file_system(path: str):
    """(pyarrow file system, path in it) of a folder that executors share, for files in formats of our own."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Within it, tasks get their rows from Spark in Arrow batches of at most this size, for rows that carry whole texts or
    sets: a task holds a batch several times over. It is for jobs that run at once, such as writing a table."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
