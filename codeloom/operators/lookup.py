"""Lookups, filters, projections, neighbors and subgraphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import compact_text, parse_properties

PROPERTIES = "role STRING, tags ARRAY<STRING>, requeue_reason ARRAY<STRING>, requeue_count INT, confidence STRING"


def find_nodes(
    nodes: DataFrame,
    kind: str | None = None,
    file_path: str | None = None,
    name: str | None = None,
    id: int | None = None,  # noqa: A002 - the column is called id
    qualified_name: str | None = None,
) -> DataFrame:
    """Nodes that match every given value; without any, all nodes."""
    wanted = {"kind": kind, "file_path": file_path, "name": name, "id": id, "qualified_name": qualified_name}
    for column, value in wanted.items():
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    return nodes


def find_edges(
    edges: DataFrame, source_id: int | None = None, target_id: int | None = None, kind: str | None = None
) -> DataFrame:
    """Edges that match every given value; without any, all edges."""
    for column, value in {"source_id": source_id, "target_id": target_id, "kind": kind}.items():
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return edges


def resolve_names(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per name that is found: the node with that qualified name, else the one with
    that name and the least id. Adds ``requested``."""
    wanted = list(names)
    matched = nodes.where(F.col("qualified_name").isin(*wanted) | F.col("name").isin(*wanted))
    hits = F.filter(
        F.array(
            F.struct(F.col("qualified_name").alias("requested"), F.lit(0).alias("by")),
            F.struct(F.col("name").alias("requested"), F.lit(1).alias("by")),
        ),
        lambda hit: hit["requested"].isin(*wanted),
    )
    rows = matched.select(F.struct(*nodes.columns).alias("node"), F.explode(hits).alias("hit"))
    best = rows.groupBy(F.col("hit.requested").alias("requested")).agg(
        F.min_by("node", F.struct("hit.by", "node.id")).alias("node")
    )
    return best.select("requested", "node.*")


def edge_scope(
    source_file: Column, target_file: Column, source_name: Column, target_name: Column,
    file_paths: Sequence[str] | None, qualified_names: Sequence[str] | None,
) -> Column:
    """Edge filter: an end in one of the files, or an end among the names; no lists, no filter."""
    if not file_paths and not qualified_names:
        return F.lit(True)
    cond = F.lit(False)
    if file_paths:
        cond = cond | source_file.isin(*file_paths) | target_file.isin(*file_paths)
    if qualified_names:
        cond = cond | source_name.isin(*qualified_names) | target_name.isin(*qualified_names)
    return cond


def named_edges(nodes: DataFrame, edges: DataFrame, how: str = "inner") -> DataFrame:
    """Edges with the names and files of both ends (``left`` keeps edges whose ends are missing)."""
    ends = nodes.select("id", "qualified_name", "file_path")
    source = ends.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source"),
                         F.col("file_path").alias("source_file"))
    target = ends.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target"),
                         F.col("file_path").alias("target_file"))
    return edges.join(source, "source_id", how).join(target, "target_id", how)


def under_directory(file_path: Column, directory: str) -> Column:
    """Whether the path lies below the directory. Upper and lower case ASCII count as the same, and
    ``%`` and ``_`` in the directory are wildcards, as in SQL LIKE."""
    return F.lower(file_path).like(directory.lower() + "/%")


def contains_text(column: Column, term: str) -> Column:
    """Substring test that takes upper and lower case as the same."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def neighbors(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(of_id, direction, edge_kind, and the columns of the neighbor) for all nodes in ``chosen(id)``."""
    picked = chosen.select(F.col("id").alias("of_id"))
    outgoing = edges.join(picked, edges["source_id"] == picked["of_id"]).select(
        "of_id", F.lit("outgoing").alias("direction"), F.col("kind").alias("edge_kind"),
        F.col("target_id").alias("other_id"))
    incoming = edges.join(picked, edges["target_id"] == picked["of_id"]).select(
        "of_id", F.lit("incoming").alias("direction"), F.col("kind").alias("edge_kind"),
        F.col("source_id").alias("other_id"))
    both = outgoing.unionByName(incoming)
    return both.join(nodes, both["other_id"] == nodes["id"]).drop("other_id")


def induced_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``chosen(id)``."""
    ids = chosen.select("id")
    return (
        edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        .select(*edges.columns)
    )


def graph_slice(
    nodes: DataFrame,
    edges: DataFrame,
    file_path: str | None = None,
    directory: str | None = None,
    limit: int = 300,
    full: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` nodes of a file, a directory or the whole graph (``full``: all of them), and the edges among them."""
    order = ["file_path", "start_line", "id"]
    if file_path:
        nodes = nodes.where((F.col("file_path") == file_path) & (F.col("kind") != "file"))
        order = ["start_line", "id"]
    elif directory:
        nodes = nodes.where(under_directory(F.col("file_path"), directory) & (F.col("kind") != "file"))
    chosen = nodes.orderBy(*order) if full else nodes.orderBy(*order).limit(limit)
    return chosen, induced_edges(edges, chosen)


def shape(nodes: DataFrame, response_shape: str = "standard") -> DataFrame:
    """Node rows in one of three shapes: ``compact``, ``standard`` or ``full``."""
    props = parse_properties(F.col("properties"), PROPERTIES)
    role = F.coalesce(props["role"], F.lit("")).alias("role")
    tags = F.coalesce(props["tags"], F.array().cast("array<string>")).alias("tags")
    have = set(nodes.columns)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind).alias(name)

    if response_shape == "compact":
        columns = ["qualified_name", "kind", role, compact_text(F.col("summary")).alias("summary"),
                   col("centrality", "double")]
    elif response_shape in ("standard", "full"):
        columns = ["id", "kind", "name", "qualified_name", col("file_path"), col("start_line", "int"),
                   col("end_line", "int"), col("language"), col("summary"), col("annotation_status"),
                   tags, role, col("centrality", "double")]
        if response_shape == "full":
            columns += [col("properties"), col("content_hash"), col("annotated_content_hash"),
                        col("graph_version", "bigint"), col("created_at", "timestamp"),
                        col("updated_at", "timestamp"), col("in_degree_cache", "bigint")]
    else:
        raise ValueError(f"unknown response_shape {response_shape!r}: use compact, standard or full")
    columns += [F.col(c) for c in ("depth", "in_degree", "out_degree", "transitive_count", "rank", "reason")
                if c in have]
    return nodes.select(*columns)
