"""Counts over the graph: statistics, directories, the directory tree and bundles of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_stale() -> F.Column:
    """Annotated, with a content hash that is not the one it was annotated at."""
    return (
        (F.col("annotation_status") == "annotated")
        & F.col("content_hash").isNotNull()
        & (F.col("annotated_content_hash").isNull() | (F.col("content_hash") != F.col("annotated_content_hash")))
    )


def status_counts(nodes: DataFrame) -> DataFrame:
    """One row: pending, annotated, failed, stale."""
    return nodes.agg(
        *[F.count_if(F.col("annotation_status") == s).alias(s) for s in ("pending", "annotated", "failed")],
        F.count_if(is_stale()).alias("stale"),
    )


def kind_counts(nodes: DataFrame) -> DataFrame:
    """(kind, count), most frequent first."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "kind")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and nodes per annotation status."""
    of_nodes = nodes.select(F.lit(1).alias("node"), F.lit(0).alias("edge"), "annotation_status")
    of_edges = edges.select(F.lit(0).alias("node"), F.lit(1).alias("edge"), F.lit(None).cast("string"))
    return of_nodes.union(of_edges).agg(
        F.coalesce(F.sum("node"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edge"), F.lit(0)).alias("edges"),
        *[F.count_if(F.col("annotation_status") == s).alias(s) for s in ("annotated", "pending", "failed")],
    )


def _per_file(nodes: DataFrame, *more: str) -> DataFrame:
    return (
        nodes.where((F.col("kind") != "file") & F.col("file_path").isNotNull())
        .groupBy("file_path", *more).agg(F.count(F.lit(1)).alias("node_count"))
    )


def file_counts(nodes: DataFrame) -> DataFrame:
    """(file_path, node_count) without file nodes."""
    return _per_file(nodes)


def directory_rollup(nodes: DataFrame) -> DataFrame:
    """(path, node_count, file_count, kinds map) per parent directory. The rows are first counted per file and
    kind, so a directory that holds much of the graph still arrives as few rows."""
    last = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    path = F.when(F.contains(F.col("file_path"), F.lit("/")), last).otherwise("(root)")
    per_file = _per_file(nodes, "kind").withColumn("path", path)
    files = per_file.groupBy("path", "file_path").agg(F.sum("node_count").alias("n"))
    files = files.groupBy("path").agg(F.sum("n").alias("node_count"), F.count(F.lit(1)).alias("file_count"))
    kinds = per_file.groupBy("path", "kind").agg(F.sum("node_count").alias("n"))
    kinds = kinds.groupBy("path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    return files.join(kinds, "path")


def directory_tree(nodes: DataFrame) -> DataFrame:
    """One row per directory and file: (path, parent, name, type, depth, node_count). A directory counts
    everything below it; the root is ``(root)``. Order by (depth, parent, type, name) to draw it."""
    per_file = _per_file(nodes)
    steps = F.split("file_path", "/")
    size = F.size(steps)
    prefixes = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(
            F.when(i == 0, F.lit("(root)")).otherwise(F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("path"),
            F.when(i == 0, F.lit(None)).when(i == 1, F.lit("(root)"))
            .otherwise(F.array_join(F.slice(steps, F.lit(1), F.greatest(i - 1, F.lit(0))), "/")).alias("parent"),
            F.when(i == 0, F.lit("(root)")).otherwise(F.get(steps, i - 1)).alias("name"),
            F.when(i == size, F.lit("file")).otherwise(F.lit("directory")).alias("type"),
            i.alias("depth"),
        ),
    )
    levels = per_file.select(F.explode(prefixes).alias("at"), "node_count")
    return (
        levels.groupBy("at.path", "at.parent", "at.name", "at.type", "at.depth")
        .agg(F.sum("node_count").alias("node_count"))
    )


def edge_bundles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_a, file_b, edge_count, dominant_kind, kinds: count per kind) per pair of files with edges between them in either
    direction. Among kinds of equal count the first in the alphabet is taken."""
    from codeloom.operators.lookup import named_edges

    ends = named_edges(nodes, edges).where(F.col("source_file") != F.col("target_file"))
    per_kind = ends.groupBy(
        F.least("source_file", "target_file").alias("file_a"),
        F.greatest("source_file", "target_file").alias("file_b"), "kind",
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_kind.groupBy("file_a", "file_b").agg(
        F.sum("n").alias("edge_count"),
        F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("dominant_kind"),
        F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("kinds"),
    )


def group_by_file(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(file_path, entries) of a result that is already limited to a page."""
    return rows.groupBy(F.coalesce("file_path", F.lit("")).alias("file_path")).agg(
        F.collect_list(F.struct(*columns)).alias("entries"))
