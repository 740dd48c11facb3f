"""Source texts to parse records: one row per definition, import and call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.parse_records import parse_batches
from codeloom.operators.joins import spread
from codeloom.schema import LANGUAGES

RECORDS = (
    "file_path STRING, language STRING, record STRING, pos INT, name STRING, kind STRING, qualified STRING, "
    "start_line INT, end_line INT, content_hash STRING, module_path STRING, names ARRAY<STRING>, alias STRING, "
    "is_relative BOOLEAN, qualifier STRING, scope STRING, message STRING"
)


def language_of(file_path: Column) -> Column:
    """Language by suffix, null for all other files."""
    found = F.lit(None).cast("string")
    for suffix, language in LANGUAGES.items():
        found = F.when(file_path.endswith(suffix), language).otherwise(found)
    return found


def parse_files(files: DataFrame) -> DataFrame:
    """Parse records of ``files(file_path, content[, content_hash])``. Each text is parsed by itself, wherever it lies; a text that
    cannot be parsed gives a record ``error`` and the others go on. A file has one record ``file``."""
    known = files.select("file_path", "content", language_of(F.col("file_path")).alias("language"),
                         *[c for c in files.columns if c == "content_hash"]).where(F.col("language").isNotNull())
    # Dealt by a hash of the rows: dealing them out in turn would sort all texts first.
    dealt = spread(known, *known.columns)
    if "content_hash" not in files.columns:
        dealt = dealt.withColumn("content_hash", F.sha2("content", 256))
    return dealt.mapInArrow(parse_batches, RECORDS)


def definitions(records: DataFrame) -> DataFrame:
    return records.where(F.col("record") == "definition").select(
        "file_path", "language", "pos", "name", "kind", "qualified", "start_line", "end_line", "content_hash")


def imports(records: DataFrame) -> DataFrame:
    return records.where(F.col("record") == "import").select(
        "file_path", "language", "pos", "module_path", "names", "alias", "is_relative", "start_line")


def calls(records: DataFrame) -> DataFrame:
    return records.where(F.col("record") == "call").select(
        "file_path", "language", "pos", F.col("name").alias("callee"), "qualifier", "scope", "start_line")
