"""Stored links, and commits by several writers."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from codeloom import session
from codeloom.operators import joins, traverse
from codeloom.sources.store import CommitConflict, GraphStore, MemoryLog


def plain_walk(rows, seeds, depth, kinds=None, reverse=False):
    found, level = set(), {(s, s) for s in seeds}
    ends = [(b, a) if reverse else (a, b) for a, b, k in rows if not kinds or k in kinds]
    for d in range(1, depth + 1):
        level = {(s, b) for s, here in level for a, b in ends if a == here}
        found |= {(s, n, d) for s, n in level}
    return found


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "source_id BIGINT, target_id BIGINT, kind STRING")


def random_rows(n):
    rng = random.Random(n)
    return [(rng.randrange(60), 0 if rng.random() < 0.3 else rng.randrange(60), rng.choice(["calls", "imports"])) for _ in range(n)]


@pytest.mark.parametrize("hot_rows, few, small", [(10 ** 6, 500, 10 ** 6), (4, 500, 10 ** 6), (4, 0, 10 ** 6), (4, 0, 0)])
def test_walks_over_stored_links(spark, tmp_path, monkeypatch, hot_rows, few, small):
    monkeypatch.setattr(traverse, "FEW", few)
    monkeypatch.setattr(traverse, "SMALL", small)
    monkeypatch.setattr(session, "LEAST_BUCKET_ROWS", 20)
    rows = random_rows(150)
    seeds = spark.createDataFrame([(0,), (3,), (5,)], "seed_id BIGINT")
    for reverse in (False, True):
        told = traverse.write_links(edges_of(spark, rows), f"{tmp_path}/{reverse}", reverse, hot_rows)
        assert told["buckets"] > 1 and (told["split"] > 0) == (hot_rows == 4)
        for kinds in (None, ["calls"]):
            got = traverse.closure(traverse.StoredLinks(spark, told, kinds), seeds, 4)
            assert {tuple(r) for r in got.select("seed_id", "node_id", "depth").collect()} == plain_walk(rows, [0, 3, 5], 4, kinds, reverse)


@pytest.mark.parametrize("few, small", [(500, 10 ** 6), (0, 0)])
def test_a_long_list_of_frequent_nodes_is_not_broadcast(spark, tmp_path, monkeypatch, few, small):
    for module in (joins, traverse):
        monkeypatch.setattr(module, "MOST_BROADCAST", 2)
    monkeypatch.setattr(traverse, "FEW", few)
    monkeypatch.setattr(traverse, "SMALL", small)
    monkeypatch.setattr(session, "LEAST_BUCKET_ROWS", 20)
    hints, broadcast = [], joins.F.broadcast
    monkeypatch.setattr(joins.F, "broadcast", lambda df: hints.append(df.columns) or broadcast(df))
    rows = random_rows(150) + [(None, 1, "calls")] * 5 + [(1, None, "calls")]
    seeds = spark.createDataFrame([(0,), (3,), (5,)], "seed_id BIGINT")
    told = traverse.write_links(edges_of(spark, rows), f"{tmp_path}/out", False, 4)
    assert told["hot"] > 2 and told["split"] > 0
    got = traverse.closure(traverse.StoredLinks(spark, told), seeds, 4)
    assert {tuple(r) for r in got.select("seed_id", "node_id", "depth").collect()} == plain_walk(rows, [0, 3, 5], 4)
    own = traverse.closure(edges_of(spark, rows), seeds, 4, hot_rows=4, small=0)
    assert {tuple(r) for r in own.select("seed_id", "node_id", "depth").collect()} == plain_walk(rows, [0, 3, 5], 4)
    assert all("seed_id" in columns for columns in hints)  # frontiers, which are counted


def test_a_step_reads_only_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "LEAST_BUCKET_ROWS", 20)
    told = traverse.write_links(edges_of(spark, random_rows(400)), f"{tmp_path}/out", False)
    table = traverse.StoredLinks(spark, told)
    one = spark.createDataFrame([(7, 7)], "seed_id BIGINT, here BIGINT")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)  # the plan then names the chosen buckets
    try:
        plan = table.step(one, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert f"SelectedBucketsCount: 1 out of {told['buckets']}" in plan
    # a large frontier is shuffled, the links are not
    monkeypatch.setattr(traverse, "SMALL", 0)
    monkeypatch.setattr(traverse, "FEW", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = table.step(one, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_links_of_a_store_are_written_once(spark, tmp_path, graph):
    nodes, edges = graph("ABC", [("A", "B", "calls"), ("B", "C", "imports")])
    store = GraphStore(spark, str(tmp_path / "g"))
    store.commit(nodes, edges)
    first = {r["there"] for r in store.links().plain.collect()}
    files = sorted(str(p) for p in (tmp_path / "g").rglob("*.parquet"))
    store.commit(store.nodes())  # other nodes, the same edges
    assert {r["there"] for r in store.links(version=2).plain.collect()} == first == {2, 3}
    assert [f for f in sorted(str(p) for p in (tmp_path / "g").rglob("*.parquet")) if "edges-links" in f] == [f for f in files if "edges-links" in f]
    assert [r["name"] for r in traverse.dependents(store.nodes(), store.links(reverse=True), "mod.B", None, 3).collect()] == ["A"]
    empty = GraphStore(spark, str(tmp_path / "none"))
    assert empty.links().plain.count() == 0


def at_once(*work):
    done = []

    def run(fn):
        try:
            done.append(fn())
        except Exception as error:  # noqa: BLE001
            done.append(error)

    threads = [threading.Thread(target=run, args=(fn,)) for fn in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return done


def test_of_two_full_commits_one_fails(spark, tmp_path, graph):
    nodes, edges = graph("AB", [("A", "B", "calls")])
    store = GraphStore(spark, str(tmp_path / "g"))
    store.commit(nodes, edges)
    base = store.entry()
    done = at_once(*[lambda: store.commit(nodes, edges, base=base)] * 2)
    assert sorted(map(str, map(type, done))) == sorted(map(str, (int, CommitConflict)))
    assert [r["graph_version"] for r in store.manifest().orderBy("graph_version").collect()] == [1, 2]


def test_commits_to_different_parts_both_hold(spark, tmp_path, graph):
    nodes, edges = graph([f"n{i}" for i in range(40)], [("n0", "n1", "calls")])
    store = GraphStore(spark, str(tmp_path / "g"))
    store.commit(nodes, edges)
    names = [spark.createDataFrame([(f"mod.n{i}",)], "qualified_name STRING") for i in (0, 1)]
    parts = [store.parts_of(n) for n in names]
    assert not parts[0] & parts[1]
    base = store.entry()

    def noted(k):
        own = store.nodes(parts=parts[k]).withColumn("summary", F.lit(f"by {k}"))
        return lambda: store.commit(own, parts=parts[k], base=base)

    assert sorted(at_once(noted(0), noted(1))) == [2, 3]
    by = {r["qualified_name"]: r["summary"] for r in store.nodes().collect()}
    assert by["mod.n0"] == "by 0" and by["mod.n1"] == "by 1" and len(by) == 40
    with pytest.raises(CommitConflict):
        noted(0)()


def test_entries_added_at_once_have_ids_of_their_own(spark, tmp_path):
    log = MemoryLog(spark, str(tmp_path / "log"))
    ids = at_once(*[lambda: log.add("treat", "convention", "x")] * 3)
    assert sorted(ids) == sorted(r["id"] for r in log.entries().collect()) and len(set(ids)) == 3


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "m" / "one.json")
    assert session.put_if_absent(spark, path, "first") and not session.put_if_absent(spark, path, "second")
    assert open(path).read() == "first" and [p.name for p in (tmp_path / "m").iterdir()] == ["one.json"]
    assert sum(at_once(*[lambda: session.put_if_absent(spark, str(tmp_path / "m" / "two"), "x")] * 6)) == 1


def test_buckets_of_frequent_nodes_follow_their_rows(spark, tmp_path):
    # 1,500 nodes of two parts each are few rows, so they need no bucket for each part
    rows = spark.range(4500).selectExpr("id % 1500 AS source_id", "id AS target_id", "'calls' AS kind")
    told = traverse.write_links(rows, f"{tmp_path}/out", False, 2)
    assert 0 < told["split"] <= 4
    seeds = spark.createDataFrame([(7,)], "seed_id BIGINT")
    found = traverse.closure(traverse.StoredLinks(spark, told), seeds, 1).collect()
    assert sorted(r["node_id"] for r in found) == [7, 1507, 3007]
