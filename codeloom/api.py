"""The tools of the engine in one class.

Every tool returns a dict. Lists in it are DataFrames, so nothing is collected until asked for;
``respond`` turns such a dict into plain values, within a token budget if one is given.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import annotate, diff, lookup, memory, paging, rank, rollup, traverse
from codeloom.schema import TAG_TAXONOMY
from codeloom.sources import tree
from codeloom.sources.paths import storage_paths
from codeloom.sources.store import GraphStore, MemoryLog
from codeloom.sources.tree import source_tree
from codeloom.session import written

ANNOTATIONS = "qualified_name STRING, summary STRING, tags ARRAY<STRING>, role STRING, failed BOOLEAN, position BIGINT"


def respond(result: dict[str, Any], token_budget: int | None = None) -> dict[str, Any]:
    """The result with its tables collected. With a budget only as many of a table's first rows are fetched as could fit it
    (a row takes two characters at least), and the rest is counted, so that ``truncated_items`` counts every row left out."""
    if token_budget is None:
        return {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in result.items()}
    plain, more = {}, {}
    for name, value in result.items():
        if isinstance(value, DataFrame):
            rows = value.limit(2 * max(1, token_budget) + 1).collect()
            plain[name] = [r.asDict(recursive=True) for r in rows]
            if len(rows) > 2 * max(1, token_budget):
                more[name] = value.count() - len(rows)
        else:
            plain[name] = value
    return paging.fit(plain, token_budget, more)


def _split_scope(scope: Sequence[str] | None) -> tuple[list[str] | None, list[str] | None]:
    def is_path(entry: str) -> bool:
        return "/" in entry or entry.endswith((".py", ".ts", ".js"))

    scope = scope or []
    return [s for s in scope if is_path(s)] or None, [s for s in scope if not is_path(s)] or None


class CodeGraph:
    """A project's graph: index it, then ask."""

    def __init__(self, spark: SparkSession, project_root: str | None = None, storage_root: str | None = None):
        self.spark = spark
        self.paths = storage_paths(project_root, storage_root)
        self.store = GraphStore(spark, self.paths.store)
        self.memory = MemoryLog(spark, self.paths.memory)

    def call(self, tool: str, **settings: Any) -> dict[str, Any]:
        """A tool by its name; what a caller got wrong is told in the answer, not raised."""
        if tool.startswith("_") or not callable(getattr(type(self), tool, None)):
            return {"error": f"no tool is called {tool!r}"}
        try:
            return getattr(self, tool)(**settings)
        except paging.InvalidCursor as exc:
            return {"error": str(exc), "code": "invalid_cursor"}
        except (ValueError, TypeError) as exc:
            return {"error": str(exc)}

    # ---- indexing and status ------------------------------------------------------------------------------------

    def index_codebase(self, full: bool = False, files: DataFrame | None = None) -> dict[str, Any]:
        root = self.paths.project_root
        if full or self.store.version() == 0:
            version = self.store.index_all(source_tree(self.spark, root) if files is None else files)
        elif files is not None:
            version = self.store.index_changed(files)
        else:
            found = written(tree.changes(diff.stored_hashes(self.store.nodes()), root), "changes")
            wanted = found.where(F.col("change_type") != "deleted").select("file_path")
            version = self.store.index_changes(found, tree.read_sources(wanted, root))
        stats = self.store.manifest().where(F.col("graph_version") == version).first()
        errors = self.store.records().where(F.col("record") == "error").select("message")
        return {
            "files_parsed": stats["files_parsed"], "files_deleted": stats["files_deleted"], "errors": errors,
            "nodes_created": self.store.nodes().where(F.col("graph_version") == version).count(),
            "edges_created": self.store.edges().count(), "diff_available": True, "cleanable": True,
            "diff_summary": self.graph_diff()["summary"]}

    def annotation_status(self) -> dict[str, Any]:
        return rollup.status_counts(self.store.nodes()).first().asDict() | {"cleanable": True}

    # ---- lookups --------------------------------------------------------------------------------------------------

    def _find(self, nodes: DataFrame, names: Sequence[str]) -> DataFrame:
        return lookup.resolve_names(nodes, names)

    def _neighbors(self, nodes: DataFrame, chosen: DataFrame, response_shape: str) -> DataFrame:
        found = lookup.neighbors(nodes, self.store.edges(), chosen.select("id"))
        ends = found.select("of_id", "direction", "edge_kind", F.col("id").alias("_id"))
        shown = lookup.shape(nodes, "full" if response_shape == "full" else "standard")
        return ends.join(shown, ends["_id"] == shown["id"]).drop("_id")

    def query_node(self, name: str, response_shape: str = "standard") -> dict[str, Any]:
        paging.check_shape(response_shape)
        nodes = self.store.ranked_nodes()
        chosen = self._find(nodes, [name]).drop("requested")
        if chosen.isEmpty():
            return {"found": False, "message": f"nothing in the graph is called {name!r}"}
        result = {"found": True, "node": lookup.shape(chosen, response_shape)}
        if response_shape != "compact":
            result["neighbors"] = self._neighbors(nodes, chosen, response_shape)
        return result

    def batch_query_nodes(self, names: Sequence[str], include_neighbors: bool = True, response_shape: str = "standard",
                          cursor: str | None = None, limit: int | None = None) -> dict[str, Any]:
        paging.check_shape(response_shape)
        call = paging.call_mark("batch_query_nodes", names=list(names), include_neighbors=include_neighbors,
                                response_shape=response_shape)
        start = (paging.read_cursor(cursor, call, 1) or [0])[0]
        stop = start + limit if limit and limit > 0 else len(names)
        here = list(names)[start:stop]
        nodes = self.store.ranked_nodes()
        found = self._find(nodes, here) if here else nodes.withColumn("requested", F.lit("")).limit(0)
        known = {r[0] for r in found.select("requested").collect()}
        result = {
            "found": len(known), "not_found": [n for n in here if n not in known],
            "nodes": lookup.shape(found.drop("requested"), response_shape),
            "next_cursor": paging.write_cursor(call, [stop]) if stop < len(names) else None}
        if include_neighbors and response_shape != "compact":
            result["neighbors"] = self._neighbors(nodes, found, response_shape)
        return result

    def get_context_summary(self, file_paths: Sequence[str] | None = None, qualified_names: Sequence[str] | None = None,
                            include_edges: bool = False, max_nodes: int = 50, response_shape: str = "standard",
                            cursor: str | None = None) -> dict[str, Any]:
        paging.check_shape(response_shape)
        call = paging.call_mark("get_context_summary", file_paths=file_paths, qualified_names=qualified_names,
                                include_edges=include_edges, response_shape=response_shape)
        found = rank.context_summary(self.store.nodes(), self.store.centrality(), file_paths, qualified_names, None)
        rows, following = paging.page(found, ["-centrality", "-in_degree", "qualified_name"], cursor, max_nodes, call)
        shown = lookup.shape(rows, response_shape)
        if "file_path" not in shown.columns:
            shown = shown.join(rows.select("qualified_name", "file_path"), "qualified_name")
        result = {
            "total_nodes": rows.count(),
            "groups": rollup.group_by_file(shown, [c for c in shown.columns if c != "file_path"]),
            "next_cursor": following}
        if include_edges:
            inner = lookup.induced_edges(self.store.edges(), rows)
            result["edges"] = lookup.named_edges(rows, inner).select(
                F.col("source").alias("from"), F.col("target").alias("to"), "kind")
        return result

    def search(self, query: str, kind: str | None = None, limit: int = 20, response_shape: str = "standard",
               cursor: str | None = None) -> dict[str, Any]:
        paging.check_shape(response_shape)
        call = paging.call_mark("search", query=str(query), kind=kind, response_shape=response_shape)
        found = self.store.search(query, kind, limit=None, with_centrality=True)
        rows, following = paging.page(found, ["rank", "qualified_name"], cursor, limit, call)
        return {"count": rows.count(), "results": lookup.shape(rows, response_shape), "next_cursor": following}

    def get_file_structure(self, file_path: str, response_shape: str = "standard", cursor: str | None = None,
                           limit: int | None = None) -> dict[str, Any]:
        paging.check_shape(response_shape)
        nodes = lookup.find_nodes(self.store.ranked_nodes(), file_path=file_path)
        if nodes.isEmpty():
            return {"found": False, "message": f"the graph has nothing from {file_path!r}"}
        call = paging.call_mark("get_file_structure", file_path=file_path, response_shape=response_shape)
        rows, following = paging.page(nodes, ["start_line", "qualified_name"], cursor, limit, call)
        result = {"found": True, "file_path": file_path, "nodes": lookup.shape(rows, response_shape),
                  "next_cursor": following}
        if response_shape != "compact":
            ids = rows.select("id")
            edges = self.store.edges().select("source_id", "target_id", "kind")
            result["edges"] = (
                edges.join(ids, edges["source_id"] == ids["id"], "left_semi").withColumn("direction", F.lit("outgoing"))
                .unionByName(edges.join(ids, edges["target_id"] == ids["id"], "left_semi")
                             .withColumn("direction", F.lit("incoming"))))
        return result

    # ---- walks and ranks ------------------------------------------------------------------------------------------

    def _walk(self, name, edge_kinds, max_depth, response_shape, cursor, limit, reverse):
        paging.check_shape(response_shape)
        nodes = self.store.ranked_nodes()
        start = self._find(nodes, [name]).select("id", "qualified_name").first()
        if start is None:
            return {"found": False, "message": f"nothing in the graph is called {name!r}"}
        tool, source, items = (("find_dependents", "target", "dependents") if reverse
                               else ("find_dependencies", "source", "dependencies"))
        call = paging.call_mark(tool, name=name, edge_kinds=edge_kinds, max_depth=max_depth, response_shape=response_shape)
        seed = self.spark.range(1).select(F.lit(start["id"]).alias("seed_id"))
        reached = traverse.closure(self.store.links(reverse, edge_kinds), seed, max_depth).drop("seed_id")
        found = traverse.closure_nodes(nodes, reached)
        rows, following = paging.page(found, ["depth", "qualified_name"], cursor, limit, call)
        return {"found": True, source: start.asDict(), "count": rows.count(), items: lookup.shape(rows, response_shape),
                "next_cursor": following}

    def find_dependencies(self, name: str, edge_kinds: Sequence[str] | None = None, max_depth: int = 5,
                          response_shape: str = "standard", cursor: str | None = None, limit: int | None = None):
        return self._walk(name, edge_kinds, max_depth, response_shape, cursor, limit, reverse=False)

    def find_dependents(self, name: str, edge_kinds: Sequence[str] | None = None, max_depth: int = 5,
                        response_shape: str = "standard", cursor: str | None = None, limit: int | None = None):
        return self._walk(name, edge_kinds, max_depth, response_shape, cursor, limit, reverse=True)

    def rank_nodes(self, scope: Sequence[str] | None = None, kind: str | None = None, limit: int = 20,
                   algorithm: str = "in_degree", response_shape: str = "standard", cursor: str | None = None):
        paging.check_shape(response_shape)
        if algorithm not in ("in_degree", "transitive"):
            raise ValueError(f"unknown algorithm {algorithm!r}: use in_degree or transitive")
        files, names = _split_scope(scope)
        call = paging.call_mark("rank_nodes", scope=scope, kind=kind, algorithm=algorithm, response_shape=response_shape)
        nodes, edges = self.store.ranked_nodes(), self.store.edges()
        if algorithm == "in_degree":
            ranked = rank.rank_by_in_degree(nodes, edges, files, names, kind, None)
            ranked, score = ranked.withColumn("score", F.col("in_degree")), "in_degree"
        else:
            scoped = nodes.where(rank.in_scope(files, None, kind))
            ranked = rank.rank_by_transitive(scoped, edges, names, None)
            ranked, score = ranked.withColumn("score", F.col("transitive_count")), "transitive_count"
        rows, following = paging.page(ranked, [f"-{score}", "qualified_name"], cursor, limit, call)
        return {"ranked": lookup.shape(rows, response_shape), "next_cursor": following}

    # ---- annotation -----------------------------------------------------------------------------------------------

    def get_pending_annotations(self, batch_size: int = 10, retry_failed: bool = False, files: DataFrame | None = None):
        nodes, edges = self.store.ranked_nodes(), self.store.edges()
        if files is None:  # only the files that the batch names are read
            wanted = annotate.pending_nodes(nodes, batch_size, retry_failed).select("file_path").distinct()
            files = tree.read_sources(wanted, self.paths.project_root)
        batch = annotate.pending_queue(nodes, edges, files, batch_size, retry_failed)
        return {"batch": batch, "neighbors": annotate.queue_neighbors(nodes, edges, batch), "taxonomy": TAG_TAXONOMY,
                "count": batch.count()}

    def submit_annotations(self, annotations: Sequence[Any] | DataFrame) -> dict[str, Any]:
        skipped = 0
        if not isinstance(annotations, DataFrame):
            rows = []
            for position, item in enumerate(annotations):
                if not isinstance(item, dict) or not item.get("qualified_name"):
                    skipped += 1
                    continue
                tags = item.get("tags") if isinstance(item.get("tags"), list) else []
                rows.append((str(item["qualified_name"]), str(item.get("summary") or ""),
                             [t for t in tags if isinstance(t, str)], str(item.get("role") or ""),
                             bool(item.get("failed")), position))
            annotations = self.spark.createDataFrame(rows, ANNOTATIONS)
        base = self.store.entry()
        parts = self.store.parts_of(annotations)
        nodes = self.store.nodes(parts=parts)
        stats = annotate.write_stats(nodes, annotations).first().asDict()
        if stats["written"] or stats["failed"]:
            self.store.commit(annotate.write_annotations(nodes, annotations), parts=parts, base=base)
        return stats | {"skipped": stats["skipped"] + skipped}

    def find_stale_annotations(self, file_paths: Sequence[str] | None = None, limit: int = 50):
        found = diff.stale_nodes(self.store.nodes(), file_paths, limit)
        return {"count": found.count(), "stale_nodes": lookup.shape(found)}

    def find_low_quality_annotations(self, limit: int = 100):
        found = annotate.low_quality(self.store.nodes(), limit)
        return {"count": found.count(), "low_quality_nodes": found}

    def requeue_low_quality_annotations(self, dry_run: bool = True, limit: int = 100):
        base, nodes = self.store.entry(), self.store.nodes()
        found = annotate.low_quality(nodes, limit)
        stats = annotate.requeue_stats(found, dry_run).first().asDict()
        result = stats | {"dry_run": dry_run, "nodes": found}
        if not dry_run and stats["low_quality"]:
            parts = self.store.parts_of(found)
            self.store.commit(annotate.requeue(self.store.nodes(parts=parts), limit), parts=parts, base=base)
        return result

    # ---- changes --------------------------------------------------------------------------------------------------

    def graph_diff(self, file_paths: Sequence[str] | None = None, include_edges: bool = True,
                   before: int | None = None, after: int | None = None) -> dict[str, Any]:
        """What changed between two versions, by default the last two."""
        after = self.store.version() if after is None else after
        if after == 0:
            return {"error": "there is no version to compare yet: index the project first"}
        before = after - 1 if before is None else before
        nodes, edges = self.store.node_diff(before, after), self.store.edge_diff(before, after)
        nodes, edges = diff.filter_diff(nodes, edges, file_paths)
        parts = {f"nodes_{c}": nodes.where(F.col("change") == c).drop("change").orderBy("qualified_name")
                 for c in ("added", "removed", "modified")}
        if include_edges:
            parts |= {f"edges_{c}": edges.where(F.col("change") == c).drop("change").orderBy("source", "target", "kind")
                      for c in ("added", "removed")}
        return parts | {"summary": diff.diff_summary(nodes, edges if include_edges else None)}

    def validate_graph(self, scope: Sequence[str] | None = None, checks: Sequence[str] | None = None) -> dict[str, Any]:
        files, names = _split_scope(scope)
        nodes = self.store.nodes()
        if scope is None and self.store.version():
            # The files of the last diff, as a table: there may be very many of them.
            changed = self.graph_diff(include_edges=False)
            touched = changed["nodes_added"].select("file_path").union(changed["nodes_removed"].select("file_path")).union(
                changed["nodes_modified"].select("file_path")).distinct()
            if not touched.isEmpty():
                nodes_in = nodes.join(touched, "file_path", "left_semi")
                ids = nodes_in.select("id")
                edges = self.store.edges()
                near = edges.join(ids, (edges["source_id"] == ids["id"]), "left_semi").unionByName(
                    edges.join(ids, (edges["target_id"] == ids["id"]), "left_semi")).distinct()
                issues = diff.validate(nodes_in, edges, checks=[c for c in diff.active_checks(checks) if c != "dangling_edges"]
                                       or ["none"])
                if "dangling_edges" in diff.active_checks(checks):
                    issues = issues.unionByName(diff.dangling_edges(nodes, near))
                return self._issues(issues, checks)
        return self._issues(diff.validate(nodes, self.store.edges(), files, names, checks), checks)

    def _issues(self, issues: DataFrame, checks) -> dict[str, Any]:
        summary = diff.validation_summary(issues, checks).first().asDict()
        passed = summary["errors"] == 0 and summary["warnings"] == 0
        return {"passed": passed, "issues": issues, "summary": summary} | ({"cleanable": True} if passed else {})

    # ---- memory ---------------------------------------------------------------------------------------------------

    def _add(self, box, category, description, context, source_agent):
        number = self.memory.add(box, category, description, context, source_agent)
        target = f"{self.paths.data_dir}/{box}_box_export"
        memory.export_markdown(self.memory.entries(), box, target)
        return {"id": number, "box": box, "exported_to": target}

    def add_litter_box_entry(self, category: str, description: str, context: str = "", source_agent: str = ""):
        return self._add("litter", category, description, context, source_agent)

    def add_treat_box_entry(self, category: str, description: str, context: str = "", source_agent: str = ""):
        return self._add("treat", category, description, context, source_agent)

    def _query(self, box, category, search, limit):
        rows = memory.query_entries(self.memory.entries(), box, category, search, limit)
        return {"count": rows.count(), "entries": rows}

    def query_litter_box(self, category: str | None = None, search: str | None = None, limit: int = 50):
        return self._query("litter", category, search, limit)

    def query_treat_box(self, category: str | None = None, search: str | None = None, limit: int = 50):
        return self._query("treat", category, search, limit)

    # ---- the explorer's views -------------------------------------------------------------------------------------

    def stats(self) -> dict[str, Any]:
        nodes, edges = self.store.nodes(), self.store.edges()
        return rollup.graph_stats(nodes, edges).first().asDict() | {"kinds": rollup.kind_counts(nodes)}

    def list_nodes(self, kind: str | None = None, limit: int = 50, offset: int = 0) -> dict[str, Any]:
        rows = lookup.find_nodes(self.store.nodes(), kind=kind).orderBy("file_path", "start_line", "id")
        rows = rows.offset(offset).limit(limit) if offset else rows.limit(limit)
        return {"count": rows.count(), "nodes": lookup.shape(rows, "full")}

    def node_detail(self, node_id: int) -> dict[str, Any]:
        nodes = self.store.ranked_nodes()
        chosen = lookup.find_nodes(nodes, id=node_id)
        if chosen.isEmpty():
            return {"error": f"no node has the id {node_id}"}
        return {"node": lookup.shape(chosen, "full"), "neighbors": self._neighbors(nodes, chosen, "full")}

    def list_edges(self, source_id: int | None = None, target_id: int | None = None, kind: str | None = None):
        """Edges that match; without any filter none, unlike ``find_edges``."""
        edges = lookup.find_edges(self.store.edges(), source_id, target_id, kind)
        if source_id is None and target_id is None and kind is None:
            edges = edges.limit(0)
        return {"count": edges.count(), "edges": edges}

    def graph(self, file_path: str | None = None, directory: str | None = None, limit: int = 300, full: bool = False):
        nodes, edges = lookup.graph_slice(self.store.nodes(), self.store.edges(), file_path, directory, limit, full)
        return {"nodes": lookup.shape(nodes, "full"), "edges": edges}

    def find_text(self, query: str, kind: str | None = None, limit: int = 20) -> dict[str, Any]:
        if not query:
            return {"count": 0, "results": []}
        rows = self.store.search(query, kind, limit)
        return {"count": rows.count(), "results": lookup.shape(rows, "full")}

    def files(self) -> dict[str, Any]:
        return {"files": rollup.file_counts(self.store.nodes()).orderBy("file_path")}

    def directories(self) -> dict[str, Any]:
        return {"directories": rollup.directory_rollup(self.store.nodes()).orderBy("path")}

    def tree(self) -> dict[str, Any]:
        return {"tree": rollup.directory_tree(self.store.nodes()).orderBy("depth", "parent", "type", "name")}

    def bundles(self) -> dict[str, Any]:
        return {"bundles": rollup.edge_bundles(self.store.nodes(), self.store.edges())}
