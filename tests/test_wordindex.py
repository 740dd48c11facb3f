"""The word index of a store from version to version, and differences of versions that share parts."""

import re

import pytest

from codeloom.operators import diff, search
from codeloom.operators.merge import stable_id
from codeloom.sources.store import GraphStore

WORDS = "alpha beta gamma delta things relations of the user service".split()


def nodes_of(spark, texts):
    rows = [(k, "function", f"n{k}", f"mod.n{k}", text, f"h{text}") for k, text in texts.items()]
    return spark.createDataFrame(
        rows, "id BIGINT, kind STRING, name STRING, qualified_name STRING, summary STRING, content_hash STRING")


def text(k):
    return None if k % 50 == 0 else " ".join(WORDS[(k * i + k // 7) % len(WORDS)] for i in range(1, 4 + k % 9))


def ranks(found):
    return {r["id"]: round(r["rank"], 9) for r in found.select("id", "rank").collect()}


def same_as_rebuilt(store, version, queries=("user", "thing AND relation", '"of the" OR new*', "alpha NOT beta")):
    texts = search.index_texts(store.nodes(version))
    for q in queries:
        want = ranks(search.search_index(search.postings(texts), search.lengths(texts), q))
        assert ranks(store.search(q, limit=None, version=version)) == want, q


def files_read(df, part=r"part=(\d+)"):
    return {m.group(1) for m in (re.search(part, f) for f in df.inputFiles()) if m}


def test_a_change_writes_one_small_segment(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    texts = {k: text(k) for k in range(1, 401)}
    store.commit(nodes_of(spark, texts))
    same_as_rebuilt(store, 1)
    first = store.words().state(store._entry(1))
    assert len(first["segments"]) == 1 and first["nodes"] == 400

    # five nodes: changed, emptied, filled, gone, new
    texts |= {3: "new user words", 4: None, 50: "the new service", 1001: "relations of the newest"}
    del texts[9]
    store.commit(nodes_of(spark, texts))
    same_as_rebuilt(store, 2)
    second = store.words().state(store._entry(2))
    assert second["segments"][0] == first["segments"][0] and len(second["segments"]) == 2
    read = lambda name: spark.read.parquet(f"{tmp_path}/words/{second['segments'][1]['folder']}/{name}")
    assert {r["id"] for r in read("lengths").collect()} == {3, 4, 50, 1001}
    assert {r["id"] for r in read("dead").collect()} == {3, 4, 9, 50} and read("postings").count() < 40
    assert (second["nodes"], second["words"]) == tuple(
        search.lengths(search.index_texts(store.nodes(2))).selectExpr("count(*)", "sum(dl)").first())

    # a change that leaves all texts as they are writes no segment; the next small one joins the last
    store.commit(nodes_of(spark, texts).selectExpr("*", "'annotated' AS annotation_status"))
    assert store.words().state(store._entry(3))["segments"] == second["segments"]
    texts |= {3: "user again", 5: "alpha alone", 9: "back as new"}
    store.commit(nodes_of(spark, texts))
    same_as_rebuilt(store, 4)
    fourth = store.words().state(store._entry(4))
    assert len(fourth["segments"]) == 2 and fourth["segments"][0] == first["segments"][0]
    # older versions answer as before, one without an index included
    same_as_rebuilt(store, 1, ["user"])
    same_as_rebuilt(store, 2, ["user"])

    # most of it changes: all segments become one
    store.commit(nodes_of(spark, {k: f"the user {k}" for k in range(1, 300)}))
    same_as_rebuilt(store, 5)
    fifth = store.words().state(store._entry(5))
    store.commit(nodes_of(spark, {}))
    assert store.search("user").count() == 0 and store.words().state(store._entry(None))["nodes"] == 0
    assert fifth["nodes"] == 299


def test_an_index_of_nothing(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    assert store.search("user").count() == 0 and store.postings().count() == 0
    store.commit(nodes_of(spark, {}))
    assert store.search("user").count() == 0
    store.commit(nodes_of(spark, {1: "a user"}))
    assert ranks(store.search("user")).keys() == {1}


@pytest.fixture(scope="module")
def versions(spark, tmp_path_factory):
    """Three versions: of 300 nodes two change; then one goes that edges lead to, one comes that an edge waits for."""
    store = GraphStore(spark, str(tmp_path_factory.mktemp("versions")))
    names = {k: f"mod.n{k}" for k in range(300)}

    def rows(hashes):
        found = spark.createDataFrame([(names[k], "function", f"n{k}", "x.py", h) for k, h in hashes.items()],
                                      "qualified_name STRING, kind STRING, name STRING, file_path STRING, content_hash STRING")
        return found.withColumn("id", stable_id("qualified_name"))

    def links(pairs):
        found = spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "a STRING, b STRING")
        return found.selectExpr("xxhash64(a) AS source_id", "xxhash64(b) AS target_id", "'calls' AS kind")

    hashes = {k: f"h{k}" for k in range(299)}
    pairs = [(k, (k * 7 + 1) % 298) for k in range(298)] + [(5, 299)]
    store.commit(rows(hashes), links(pairs))
    parts = store.parts_of(rows({3: "", 4: ""}).select("qualified_name"))
    changed = hashes | {3: "other", 4: None}
    store.commit(rows(changed).where(store_part(store).isin(*parts)), parts=parts)
    del changed[8]
    store.commit(rows(changed | {299: "new"}), links(pairs[1:] + [(1, 2)]))
    return store


def store_part(store):
    from codeloom.sources.store import part_of

    return part_of("qualified_name", store._node_parts(store._entry(None)))


def plain(store, a, b):
    nodes = diff.node_diff(*[diff.snapshot_nodes(store.nodes(v)) for v in (a, b)])
    edges = diff.edge_diff(*[diff.snapshot_edges(store.nodes(v), store.edges(v)) for v in (a, b)])
    return nodes, edges


@pytest.mark.parametrize("pair", [(1, 2), (2, 3), (1, 3), (3, 1), (2, 2), (0, 1)])
def test_differences_of_versions(versions, pair):
    for got, want in zip((versions.node_diff(*pair), versions.edge_diff(*pair)), plain(versions, *pair), strict=True):
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_equal_parts_are_not_opened(versions):
    found = versions.node_diff(1, 2)
    assert len(files_read(found)) <= 2 and found.count() == 2
    assert files_read(versions.node_diff(2, 2)) == set()
    assert versions.edge_diff(1, 2).count() == 0


def test_an_index_is_written_without_a_shuffle_of_its_words(spark, tmp_path, monkeypatch):
    nodes = spark.createDataFrame([(i, f"n{i % 3}", f"m::n{i}", "the the end" if i % 2 else "") for i in range(50)] + [(7, "x", "m::x", "more")],
                                  "id BIGINT, name STRING, qualified_name STRING, summary STRING")
    monkeypatch.setattr(search, "SORTED_NODES", 5)
    search.write_index(nodes, f"{tmp_path}/index")
    texts = search.index_texts(nodes)
    for name, want in (("postings", search.postings(texts)), ("lengths", search.lengths(texts))):
        found = search.open_index(spark, f"{tmp_path}/index", name)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(*found.columns).collect()))
    # more nodes, more tasks: each writes the words of its own nodes, in order
    files = sorted((tmp_path / "index" / "postings").glob("*.parquet"))
    assert len(files) >= 8
    terms = [r["term"] for r in spark.read.parquet(str(files[0])).collect()]
    assert terms == sorted(terms)


def test_stems_of_a_batch(spark):
    from codeloom.functions import porter

    rows = [(["things", "relational", "things"],), ([],), (None,), (["a", None, "running"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "w ARRAY<STRING>").coalesce(1).select(porter.stem_tokens("w")).collect()]
    assert got == [[porter.stem("things"), porter.stem("relational"), porter.stem("things")], [], None, ["a", None, porter.stem("running")]]
