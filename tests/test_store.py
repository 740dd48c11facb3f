"""The stored graph and the tools, end to end on a project on disk."""

import os
import re

import pytest

from codeloom.api import CodeGraph, respond
from codeloom.operators import paging, rank
from codeloom.sources.store import GraphStore
from codeloom.sources.tree import ignore_expression, list_sources, source_tree
from tests.test_code import EDGES, PROJECT
from tests.test_rank import loop_pagerank


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("project"))
    write(root, PROJECT)
    graph = CodeGraph(spark, root)
    first = graph.index_codebase(full=True)
    return root, graph, first


def test_tree_rules(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"a.py": "", "pkg/__init__.py": "", ".hidden.py": "", ".dot/x.py": "", "node_modules/y.js": "", "gen/z.py": "",
                 "deep/er/k.tsx": "", "skip_me.py": "", "notes.md": "", ".gitignore": "# c\n\ngen/\nskip_*\n"})
    os.symlink(os.path.join(root, "a.py"), os.path.join(root, "link.py"))
    found = sorted(r[0] for r in list_sources(spark, root).collect())
    assert found == [".hidden.py", "a.py", "deep/er/k.tsx", "pkg/__init__.py"]
    for pattern, yes, no in [("gen/", "x/gen/y.py", "x/gene.py"), ("*.log", "a/b.log", "a/b.logs"), ("a[!b]c?", "q/azcd", "abcd"),
                             ("src/*.py", "src/x/y.py", "b/src/a.py"), ("a.b+c(1)", "a.b+c(1)", "aXb+c(1)")]:
        assert re.match(ignore_expression([pattern]), yes) and not re.match(ignore_expression([pattern]), no)


def test_content_is_hashed_by_bytes(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = '\xff'\n")
    row = source_tree(spark, str(tmp_path)).first()
    import hashlib

    assert row["content_hash"] == hashlib.sha256(b"x = '\xff'\n").hexdigest() and "\ufffd" in row["content"]


def test_index_and_lookups(project):
    _, graph, first = project
    assert first["files_parsed"] == 6 and first["nodes_created"] == 18 and first["edges_created"] == len(EDGES)
    node = respond(graph.query_node("UserService", "full"))
    assert node["found"] and node["node"][0]["qualified_name"].endswith("::UserService")
    assert not graph.query_node("nobody")["found"]
    batch = respond(graph.batch_query_nodes(["models.user::User", "nobody", "main"], limit=2))
    assert (batch["found"], batch["not_found"]) == (1, ["nobody"]) and batch["next_cursor"]
    rest = respond(graph.batch_query_nodes(["models.user::User", "nobody", "main"], limit=2, cursor=batch["next_cursor"]))
    assert rest["found"] == 1 and rest["next_cursor"] is None
    with pytest.raises(paging.InvalidCursor):
        graph.batch_query_nodes(["other"], cursor=batch["next_cursor"])
    assert graph.call("batch_query_nodes", names=["other"], cursor=batch["next_cursor"])["code"] == "invalid_cursor"
    assert "error" in graph.call("rank_nodes", algorithm="bogus") and "error" in graph.call("nothing")
    structure = respond(graph.get_file_structure("src/models/user.py", "compact"))
    assert len(structure["nodes"]) == 3
    with pytest.raises(ValueError):
        graph.query_node("main", "bogus")


def test_walks_ranks_search(project):
    _, graph, _ = project
    out = respond(graph.find_dependents("models.user::User"))
    names = {(d["qualified_name"], d["depth"]) for d in out["dependents"]}
    assert ("services.user_service::UserService::add_user", 1) in names and ("file::src/services/user_service.py", 2) in names
    page = respond(graph.find_dependencies("file::src/main.py", limit=2))
    assert page["count"] == 2 and page["next_cursor"]
    again = respond(graph.find_dependencies("file::src/main.py", limit=2, cursor=page["next_cursor"]))
    assert not {(d["id"], d["depth"]) for d in page["dependencies"]} & {(d["id"], d["depth"]) for d in again["dependencies"]}
    ranked = respond(graph.rank_nodes(kind="class", limit=2))["ranked"]
    assert [r["in_degree"] for r in ranked] == sorted([r["in_degree"] for r in ranked], reverse=True)
    assert respond(graph.rank_nodes(algorithm="transitive", limit=3))["ranked"]
    found = respond(graph.search("user service", limit=3))
    assert found["count"] == 3 and found["next_cursor"]
    assert found["results"][0]["centrality"] is not None
    summary = respond(graph.get_context_summary(file_paths=["src/services/user_service.py"], include_edges=True))
    assert summary["total_nodes"] == 5 and len(summary["groups"]) == 1
    assert {(e["from"], e["to"]) for e in summary["edges"]} >= {
        ("services.user_service::UserService::add_user", "services.user_service::UserService::check")}


def test_views(project):
    _, graph, _ = project
    stats = respond(graph.stats())
    assert stats["nodes"] == 18 and stats["edges"] == len(EDGES) and stats["pending"] == 18
    dirs = {r["path"]: r for r in respond(graph.directories())["directories"]}
    assert dirs["src/services"]["node_count"] == 4 and dirs["src/services"]["kinds"] == {"class": 1, "method": 3}
    tree = {r["path"]: r for r in respond(graph.tree())["tree"]}
    assert tree["(root)"]["node_count"] == 12 and tree["web"]["node_count"] == 5 and tree["web"]["type"] == "directory"
    assert respond(graph.graph(directory="WEB"))["nodes"]
    assert respond(graph.list_edges())["count"] == 0 and graph.list_edges(kind="imports")["count"] == 4
    assert graph.list_nodes(kind="class", limit=2)["count"] == 2
    assert graph.find_text("")["count"] == 0 and graph.find_text("user")["count"] > 0
    bundles = {(r["file_a"], r["file_b"]): r for r in respond(graph.bundles())["bundles"]}
    assert bundles[("web/main.ts", "web/service.ts")]["edge_count"] == 2
    assert respond(graph.find_dependents("models.user::User"), token_budget=120)["truncated_items"] > 0


def test_annotate_change_and_diff(spark, tmp_path):
    root = str(tmp_path)
    write(root, PROJECT)
    graph = CodeGraph(spark, root)
    graph.index_codebase()
    batch = respond(graph.get_pending_annotations(batch_size=3))
    assert batch["count"] == 3 and all(b["source"] for b in batch["batch"])
    stats = graph.submit_annotations([
        {"qualified_name": "models.user::User", "summary": "The User record with a display name.", "tags": ["DB"], "role": "model"},
        {"qualified_name": "web.types::User", "summary": "Short", "role": "class"},
        {"qualified_name": "web.types::UserID", "failed": True}, "junk", {"qualified_name": "nobody"}])
    assert stats == {"written": 2, "failed": 1, "skipped": 2}
    assert graph.annotation_status() == {"pending": 15, "annotated": 2, "failed": 1, "stale": 0, "cleanable": True}
    weak = respond(graph.requeue_low_quality_annotations(dry_run=False))
    assert (weak["low_quality"], weak["requeued"], weak["failed"]) == (1, 1, 0)
    assert graph.annotation_status()["pending"] == 16
    assert graph.store.nodes().where("qualified_name = 'models.user::User'").first()["graph_version"] == 1

    write(root, {"src/services/user_service.py": PROJECT["src/services/user_service.py"].replace("check", "verify"),
                 "src/extra.py": "from services.user_service import UserService\n\nUserService()\n"})
    os.remove(os.path.join(root, "web/main.ts"))
    out = graph.index_codebase()
    assert (out["files_parsed"], out["files_deleted"]) == (2, 2)
    changes = respond(graph.graph_diff())
    assert {n["qualified_name"] for n in changes["nodes_added"]} == {
        "services.user_service::UserService::verify", "file::src/extra.py"}
    assert {n["qualified_name"] for n in changes["nodes_removed"]} == {
        "services.user_service::UserService::check", "file::web/main.ts"}
    assert "services.user_service::UserService::add_user" in {n["qualified_name"] for n in changes["nodes_modified"]}
    # Edges between changed and unchanged files are all there, as after a full run.
    names = {r["id"]: r["qualified_name"] for r in graph.store.nodes().collect()}
    edges = {(names[r["source_id"]], names[r["target_id"]], r["kind"]) for r in graph.store.edges().collect()}
    fresh = CodeGraph(spark, root, storage_root=str(tmp_path / "other"))
    fresh.index_codebase(full=True)
    names = {r["id"]: r["qualified_name"] for r in fresh.store.nodes().collect()}
    assert edges == {(names[r["source_id"]], names[r["target_id"]], r["kind"]) for r in fresh.store.edges().collect()}
    assert ("main::main", "services.user_service::UserService", "calls") in edges
    times = graph.store.nodes().selectExpr("count(created_at)", "count(updated_at)", "count(*)").first()
    assert times[0] == times[1] == times[2]
    limited = respond(graph.graph_diff(file_paths=["src/extra.py"], include_edges=False))
    assert [n["name"] for n in limited["nodes_added"]] == ["extra.py"] and "edges_added" not in limited
    checked = respond(graph.validate_graph())
    assert checked["summary"]["errors"] == 0
    assert graph.validate_graph(checks=["dangling_edges"])["passed"]
    assert graph.annotation_status()["annotated"] == 1


def test_memory(spark, tmp_path):
    graph = CodeGraph(spark, str(tmp_path))
    one = graph.add_litter_box_entry("failure", "Broke the build", "on main", "bot")
    two = graph.add_litter_box_entry("never-do", "Push to main")
    graph.add_treat_box_entry("convention", "Sort imports")
    assert (one["id"], two["id"]) == (1, 2)
    assert graph.query_litter_box()["count"] == 2 and graph.query_litter_box(category="failure")["count"] == 1
    assert [r["description"] for r in respond(graph.query_litter_box(search="BUILD"))["entries"]] == ["Broke the build"]
    with pytest.raises(ValueError):
        graph.add_treat_box_entry("failure", "wrong box")
    text = "\n".join(r[0] for r in spark.read.text(two["exported_to"]).collect())
    parts = sorted(p for p in os.listdir(two["exported_to"]) if p.startswith("part-"))
    text = "".join(open(os.path.join(two["exported_to"], p)).read() for p in parts)
    assert text == ("# Litter Box\n\n\n## failure\n\n- **Broke the build** -- on main _(agent: bot)_\n"
                    "\n## never-do\n\n- **Push to main**\n")


def edges_by_name(store):
    names = {r["id"]: r["qualified_name"] for r in store.nodes().collect()}
    return {(names[r["source_id"]], names[r["target_id"]], r["kind"]) for r in store.edges().collect()}


def nodes_by_name(store):
    return {(r["qualified_name"], r["file_path"], r["kind"]) for r in store.nodes().collect()}


@pytest.mark.parametrize(("before", "after"), [
    # the second definition of a name goes, and the first comes back
    ({"a/x.py": "def f():\n    pass\n", "src/a/x.py": "def f():\n    pass\n", "m.py": "from a.x import f\n\n\ndef g():\n    f()\n"},
     {"a/x.py": "def f():\n    pass\n", "m.py": "from a.x import f\n\n\ndef g():\n    f()\n"}),
    # a new file takes over a module
    ({"a/x.py": "def f():\n    pass\n", "m.py": "from a.x import f\n\n\ndef g():\n    f()\n"},
     {"a/x.py": "def f():\n    pass\n", "src/a/x.py": "def h():\n    pass\n", "m.py": "from a.x import f\n\n\ndef g():\n    f()\n"}),
])
def test_an_incremental_index_equals_a_full_one(spark, tmp_path, before, after):
    root = str(tmp_path / "project")
    write(root, before)
    graph = CodeGraph(spark, root)
    graph.index_codebase()
    graph.submit_annotations([{"qualified_name": "m::g", "summary": "The g function calls f.", "tags": [], "role": "caller"}])
    for path in before.keys() - after.keys():
        os.remove(os.path.join(root, path))
    write(root, {p: t for p, t in after.items() if p not in before})
    graph.index_codebase()
    fresh = CodeGraph(spark, root, storage_root=str(tmp_path / "other"))
    fresh.index_codebase(full=True)
    assert nodes_by_name(graph.store) == nodes_by_name(fresh.store)
    assert edges_by_name(graph.store) == edges_by_name(fresh.store)
    assert graph.store.nodes().where("qualified_name = 'm::g'").first()["annotation_status"] == "annotated"


def test_annotations_write_only_the_parts_they_touch(spark, tmp_path):
    root = str(tmp_path)
    write(root, PROJECT)
    graph = CodeGraph(spark, root)
    graph.index_codebase()
    one = graph.store._entry(1)
    graph.submit_annotations([{"qualified_name": "models.user::User", "summary": "The user.", "tags": [], "role": ""}])
    two = graph.store._entry(2)
    assert (one["edges"], one["records"]) == (two["edges"], two["records"])
    assert sum(one["nodes"][p] != two["nodes"][p] for p in one["nodes"]) == 1 and one["nodes"].keys() == two["nodes"].keys()
    assert graph.store.nodes().count() == graph.store.nodes(1).count()


def test_ranks_go_on_from_the_version_before(spark, tmp_path, monkeypatch, graph):
    store = GraphStore(spark, str(tmp_path))
    names, edges = "ABCDE", [("A", "B", "calls"), ("B", "C", "calls"), ("C", "A", "imports"), ("D", "C", "calls")]
    store.commit(*graph(names, edges))
    store.centrality()
    edges = edges[1:] + [("E", "A", "calls"), ("A", "D", "inherits")]
    store.commit(None, graph(names, edges)[1])
    monkeypatch.setattr(rank, "pagerank", None)  # not called again
    got = {r["id"]: r["centrality"] for r in store.centrality().collect()}
    places = {n: i for i, n in enumerate(names, 1)}
    want = loop_pagerank(set(places.values()), [(places[a], places[b], k) for a, b, k in edges], 1000)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_unknown_kinds_are_refused(spark, tmp_path):
    store = CodeGraph(spark, str(tmp_path)).store
    nodes = spark.createDataFrame([(1, "planet", "x", "x")], "id BIGINT, kind STRING, name STRING, qualified_name STRING")
    with pytest.raises(ValueError):
        store.commit(nodes)
    with pytest.raises(ValueError):
        store.commit(None, spark.createDataFrame([(1, 2, "hates")], "source_id BIGINT, target_id BIGINT, kind STRING"))
    assert store.version() == 0 and store.search("anything").count() == 0


def test_git_tells_what_changed(spark, tmp_path):
    import subprocess

    root = str(tmp_path)
    write(root, {"a.py": "x = 1\n", "b.py": "y = 1\n"})
    git = ["git", "-c", "user.email=a@b", "-c", "user.name=n", "-C", root]
    for args in (["init", "-q"], ["add", "."], ["commit", "-qm", "one"]):
        subprocess.run([*git, *args], check=True)
    graph = CodeGraph(spark, root)
    graph.index_codebase()
    write(root, {"a.py": "def f():\n    pass\n", "c.py": "z = 1\n"})
    os.remove(os.path.join(root, "b.py"))
    out = graph.index_codebase()
    assert (out["files_parsed"], out["files_deleted"]) == (2, 2)
    assert nodes_by_name(graph.store) == {("file::a.py", "a.py", "file"), ("a::f", "a.py", "function"), ("file::c.py", "c.py", "file")}


def test_a_commit_gets_resolved_tables(spark, tmp_path, monkeypatch):
    # it counts, checks, samples and writes them, and each of these would resolve all files again
    given, plain = [], GraphStore.commit

    def commit(self, nodes, edges=None, *args, **kwargs):
        given.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in (nodes, edges))
        return plain(self, nodes, edges, *args, **kwargs)

    monkeypatch.setattr(GraphStore, "commit", commit)
    files = spark.createDataFrame([("src/a.py", "def f():\n    return g()\n\n\ndef g():\n    pass\n")], "file_path STRING, content STRING")
    store = GraphStore(spark, f"{tmp_path}/store")
    store.index_all(files)
    assert len(given) == 2 and not any("Join" in plan or "Aggregate" in plan for plan in given)
    assert store.edges().where("kind = 'calls'").count() == 1
