"""The memory log: two boxes of categorized entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lookup import contains_text
from codeloom.schema import MEMORY_CATEGORIES


def check_entry(box: str, category: str) -> None:
    """Raise ValueError for an unknown box or a category that is not one of its own."""
    if box not in MEMORY_CATEGORIES:
        raise ValueError(f"unknown box {box!r}: use one of {sorted(MEMORY_CATEGORIES)}")
    if category not in MEMORY_CATEGORIES[box]:
        raise ValueError(f"unknown category {category!r} of {box}: use one of {sorted(MEMORY_CATEGORIES[box])}")


def query_entries(
    memory: DataFrame, box: str | None = None, category: str | None = None, search: str | None = None, limit: int = 50
) -> DataFrame:
    """The newest entries of a box, optionally of a category and with a text in the description."""
    if box is not None:
        memory = memory.where(F.col("box") == box)
    if category is not None:
        memory = memory.where(F.col("category") == category)
    if search:
        memory = memory.where(contains_text(F.col("description"), search))
    return memory.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def markdown_lines(memory: DataFrame, box: str) -> DataFrame:
    """(category, created_at, id, value): the lines of the export of a box in order, headings with no id."""
    entries = memory.where(F.col("box") == box)

    def extra(before: str, column: str, after: str):
        has = F.coalesce(F.col(column), F.lit("")) != ""
        return F.when(has, F.concat(F.lit(before), F.col(column), F.lit(after))).otherwise(F.lit(""))

    line = F.concat(F.lit("- **"), F.col("description"), F.lit("**"), extra(" -- ", "context", ""),
                    extra(" _(agent: ", "source_agent", ")_"))
    lines = entries.select("category", "created_at", "id", line.alias("value"))
    headings = entries.select("category").distinct().select(
        "category", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("long").alias("id"),
        F.concat(F.lit("\n## "), F.col("category"), F.lit("\n")).alias("value"))
    title = "# Litter Box\n" if box == "litter" else "# Treat Box\n"
    first = entries.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("long").alias("id"), F.lit(title).alias("value"))
    return first.unionByName(headings).unionByName(lines).orderBy(
        F.asc_nulls_first("category"), F.asc_nulls_first("created_at"), F.asc_nulls_first("id"))


def export_markdown(memory: DataFrame, box: str, path: str) -> None:
    """Write the export as text. The rows are sorted across the cluster; the parts in order are the document."""
    markdown_lines(memory, box).select("value").write.mode("overwrite").text(path)
