"""Snapshots, structural differences, change detection and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lookup import edge_scope, named_edges
from codeloom.operators.rank import in_scope
from codeloom.operators.rollup import is_stale
from codeloom.schema import CHECKS

ISSUE_COLUMNS = ["check", "severity", "message", "source", "target", "edge_kind", "node"]


def snapshot_nodes(nodes: DataFrame, file_paths: Sequence[str] | None = None) -> DataFrame:
    """(qualified_name, kind, name, file_path, content_hash); an empty list of files selects nothing."""
    if file_paths is not None:
        nodes = nodes.where(F.col("file_path").isin(*file_paths)) if file_paths else nodes.where(F.lit(False))
    return nodes.select("qualified_name", "kind", "name", "file_path", "content_hash")


def snapshot_edges(nodes: DataFrame, edges: DataFrame, file_paths: Sequence[str] | None = None) -> DataFrame:
    """(source, target, kind) by qualified names, of edges with an end in the files."""
    ends = named_edges(nodes, edges)
    if file_paths is not None:
        if file_paths:
            ends = ends.where(F.col("source_file").isin(*file_paths) | F.col("target_file").isin(*file_paths))
        else:
            ends = ends.where(F.lit(False))
    return ends.select("source", "target", "kind")


def node_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, qualified_name, kind, name, file_path): added, removed, and modified where the content hash
    differs. One full outer join of the two snapshots."""
    old = before.select("qualified_name", F.struct("kind", "name", "file_path", "content_hash").alias("old"))
    new = after.select("qualified_name", F.struct("kind", "name", "file_path", "content_hash").alias("new"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old.content_hash").eqNullSafe(F.col("new.content_hash")), "modified")
    )
    row = F.coalesce("new", "old")
    return (
        old.join(new, "qualified_name", "full_outer")
        .select(change.alias("change"), "qualified_name", row["kind"].alias("kind"), row["name"].alias("name"),
                row["file_path"].alias("file_path"))
        .where(F.col("change").isNotNull())
    )


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, source, target, kind): edges in only one of the snapshots, in one grouping of both."""
    key = ["source", "target", "kind"]
    both = before.select(*key, F.lit(True).alias("was"), F.lit(False).alias("is")).unionByName(
        after.select(*key, F.lit(False).alias("was"), F.lit(True).alias("is")))
    seen = both.groupBy(*key).agg(F.max("was").alias("was"), F.max("is").alias("is"))
    return seen.where(F.col("was") != F.col("is")).select(
        F.when(F.col("is"), "added").otherwise("removed").alias("change"), *key)


def filter_diff(
    nodes: DataFrame, edges: DataFrame, file_paths: Sequence[str] | None
) -> tuple[DataFrame, DataFrame]:
    """A diff restricted to files; an edge stays if one of its ends is a node that stays."""
    if file_paths is None:
        return nodes, edges
    kept = nodes.where(F.col("file_path").isin(*file_paths)) if file_paths else nodes.where(F.lit(False))
    ends = edges.withColumn("end", F.explode(F.array_distinct(F.array("source", "target"))))
    names = kept.select(F.col("qualified_name").alias("end"))
    return kept, ends.join(names, "end", "left_semi").select(*edges.columns).distinct()


def diff_summary(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row of counts."""
    counts = nodes.select("change", "file_path", F.lit("node").alias("what"))
    if edges is not None:
        counts = counts.unionByName(edges.select("change", F.lit(None).cast("string").alias("file_path"),
                                                 F.lit("edge").alias("what")))

    def n(what: str, change: str):
        return F.count_if((F.col("what") == what) & (F.col("change") == change))

    columns = [F.count_distinct("file_path").alias("files_affected")]
    columns += [n("node", c).alias(f"nodes_{c}") for c in ("added", "removed", "modified")]
    if edges is not None:
        columns += [n("edge", c).alias(f"edges_{c}") for c in ("added", "removed")]
    return counts.agg(*columns)


def changed_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(file_path, change_type) from two tables (file_path, content_hash): new, modified or deleted."""
    old = stored.select("file_path", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
    new = current.select("file_path", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
    change = (
        F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted")
        .when(F.col("old") != F.col("new"), "modified")
    )
    joined = old.join(new, "file_path", "full_outer")
    return joined.select("file_path", change.alias("change_type")).where(F.col("change_type").isNotNull())


def stored_hashes(nodes: DataFrame) -> DataFrame:
    """(file_path, content_hash) of the file nodes."""
    return nodes.where((F.col("kind") == "file") & F.col("content_hash").isNotNull()).select(
        "file_path", "content_hash")


def stale_nodes(nodes: DataFrame, file_paths: Sequence[str] | None = None, limit: int | None = 50) -> DataFrame:
    """Annotated nodes whose content has changed since, by qualified name."""
    found = nodes.where(is_stale() & in_scope(file_paths)).withColumn("reason", F.lit("content_hash_changed"))
    return found if limit is None else found.orderBy("qualified_name").limit(limit)


def _issue(df: DataFrame, check: str, severity: str, message, **columns) -> DataFrame:
    values = {name: F.lit(None).cast("string") for name in ISSUE_COLUMNS} | columns
    values |= {"check": F.lit(check), "severity": F.lit(severity), "message": message}
    return df.select(*[values[name].alias(name) for name in ISSUE_COLUMNS])


def dangling_edges(
    nodes: DataFrame, edges: DataFrame,
    file_paths: Sequence[str] | None = None, qualified_names: Sequence[str] | None = None,
) -> DataFrame:
    """Edges with an end that does not exist."""
    ends = named_edges(nodes, edges, how="left").where(
        (F.col("source").isNull() | F.col("target").isNull())
        & edge_scope(F.col("source_file"), F.col("target_file"), F.col("source"), F.col("target"),
                     file_paths, qualified_names))

    def label(name: str, key: str):
        return F.coalesce(F.col(name), F.concat(F.lit("<missing id="), F.col(key).cast("string"), F.lit(">")))

    which = F.when(F.col("source").isNull(), "source").otherwise("target")
    return _issue(
        ends, "dangling_edges", "error", F.concat(F.lit("Edge references non-existent "), which, F.lit(" node")),
        source=label("source", "source_id"), target=label("target", "target_id"), edge_kind=F.col("kind"))


def orphan_nodes(
    nodes: DataFrame, edges: DataFrame,
    file_paths: Sequence[str] | None = None, qualified_names: Sequence[str] | None = None,
) -> DataFrame:
    """Nodes other than files and modules without incoming edges."""
    scoped = nodes.where(~F.col("kind").isin("file", "module") & in_scope(file_paths, qualified_names))
    # The targets are reduced to one row each before the join, so a hub is one row.
    targets = edges.select(F.col("target_id").alias("id")).distinct()
    return _issue(scoped.join(targets, "id", "left_anti"), "orphan_nodes", "warning",
                  F.lit("Node has no incoming edges"), node=F.col("qualified_name"))


def stale_annotations(
    nodes: DataFrame, file_paths: Sequence[str] | None = None, qualified_names: Sequence[str] | None = None
) -> DataFrame:
    """Stale annotations as issues."""
    return _issue(nodes.where(is_stale() & in_scope(file_paths, qualified_names)), "stale_annotations", "warning",
                  F.lit("Annotation is outdated"), node=F.col("qualified_name"))


def active_checks(checks: Sequence[str] | None) -> list[str]:
    """The checks to run: those given that exist, or all where none are given."""
    return [c for c in CHECKS if c in checks] if checks else list(CHECKS)


def validate(
    nodes: DataFrame, edges: DataFrame,
    file_paths: Sequence[str] | None = None, qualified_names: Sequence[str] | None = None,
    checks: Sequence[str] | None = None,
) -> DataFrame:
    """All issues of the chosen checks."""
    found = {
        "dangling_edges": lambda: dangling_edges(nodes, edges, file_paths, qualified_names),
        "orphan_nodes": lambda: orphan_nodes(nodes, edges, file_paths, qualified_names),
        "stale_annotations": lambda: stale_annotations(nodes, file_paths, qualified_names),
    }
    chosen = active_checks(checks)
    if not chosen:
        return found["orphan_nodes"]().where(F.lit(False))
    out = found[chosen[0]]()
    for check in chosen[1:]:
        out = out.unionByName(found[check]())
    return out


def validation_summary(issues: DataFrame, checks: Sequence[str] | None = None) -> DataFrame:
    """One row: checks_run, errors, warnings, passed."""
    run = len(active_checks(checks))
    errors, warnings = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return issues.agg(errors.alias("errors"), warnings.alias("warnings")).select(
        F.lit(run).cast("long").alias("checks_run"), "errors", "warnings",
        (F.lit(run) - (F.col("errors") > 0).cast("int") - (F.col("warnings") > 0).cast("int"))
        .cast("long").alias("passed"))
