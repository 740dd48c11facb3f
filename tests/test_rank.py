import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import rank
from codeloom.schema import EDGE_WEIGHTS


def loop_pagerank(ids, edges, rounds=50):
    n = len(ids)
    out = {}
    for s, t, k in edges:
        if s in ids and t in ids:
            out.setdefault(s, []).append((t, EDGE_WEIGHTS.get(k, 0.5)))
    r = dict.fromkeys(ids, 1 / n)
    for _ in range(rounds):
        sunk = sum(r[u] for u in ids if u not in out)
        new = dict.fromkeys(ids, 0.15 / n + 0.85 * sunk / n)
        for u, targets in out.items():
            total = sum(w for _, w in targets)
            for t, w in targets:
                new[t] += 0.85 * r[u] * w / total
        delta = sum(abs(new[u] - r[u]) for u in ids)
        r = new
        if delta < 1e-8:
            break
    return {u: v / max(r.values()) for u, v in r.items()}


def scores(nodes, edges, **options):
    found = rank.pagerank(nodes, edges, **options).join(nodes, "id").collect()
    return {r["name"]: r["centrality"] for r in found}, {r["name"]: r["in_degree"] for r in found}


def test_cycle_star_and_isolated(graph):
    c, _ = scores(*graph("ABC", [("A", "B", "calls"), ("B", "C", "calls"), ("C", "A", "calls")]))
    assert all(abs(v - 1) < 1e-6 for v in c.values())
    c, d = scores(*graph("HXYZ", [(x, "H", "calls") for x in "XYZ"]))
    assert c["H"] == 1.0 and c["X"] == c["Y"] == c["Z"] < 1 and d == {"H": 3, "X": 0, "Y": 0, "Z": 0}
    c, _ = scores(*graph("AB", []))
    assert c == {"A": 1.0, "B": 1.0}


def test_weights_order_targets(graph):
    c, _ = scores(*graph("SXY", [("S", "X", "calls"), ("S", "Y", "contains")]))
    assert c["X"] > c["Y"]


def test_no_nodes(spark, graph):
    nodes, edges = graph("A", [])
    assert rank.pagerank(nodes.where("false"), edges).count() == 0


@pytest.mark.parametrize("options", [{}, {"hot_rows": 10}])
def test_random_graph_against_loop(spark, options):
    rng = random.Random(3)
    kinds = [*EDGE_WEIGHTS, "other"]
    edges = list({(0 if rng.random() < 0.35 else rng.randrange(30), rng.randrange(33), rng.choice(kinds)) for _ in range(140)})
    ids = set(range(30))
    want = loop_pagerank(ids, edges)
    nodes = spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    frame = spark.createDataFrame(edges, "source_id BIGINT, target_id BIGINT, kind STRING")
    got = {r["id"]: r for r in rank.pagerank(nodes, frame, **options).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[u]["centrality"] - want[u]) for u in ids) < 1e-7
    assert all(got[u]["in_degree"] == sum(t == u for _, t, _ in edges) for u in ids)


@pytest.mark.parametrize("options", [{}, {"hot_rows": 10, "small": 0}])
def test_ranks_after_a_change_against_loop(spark, options):
    rng = random.Random(5)
    kinds = [*EDGE_WEIGHTS, "other"]
    before = {(0 if rng.random() < 0.3 else rng.randrange(40), rng.randrange(43), rng.choice(kinds)) for _ in range(90)}
    after = {e for e in before if e[0] != 7 and e[1] != 3} | {(7, 8, "calls"), (41, 5, "imports"), (5, 41, "calls")}
    ids = (set(range(40)) | {41}) - {12}
    old = loop_pagerank(set(range(40)), before, 1000)
    want = loop_pagerank(ids, after, 1000)
    nodes = spark.createDataFrame([(i,) for i in ids], "id BIGINT")
    frame = spark.createDataFrame(list(after), "source_id BIGINT, target_id BIGINT, kind STRING")
    # a node that is gone and one without a rank are no burden; neither is a start from nothing
    for known in ([*old.items(), (99, None)], []):
        got = {r["id"]: r for r in rank.pagerank_from(nodes, frame, spark.createDataFrame(known, "id BIGINT, centrality DOUBLE"), **options).collect()}
        assert got.keys() == want.keys() and max(abs(got[u]["centrality"] - want[u]) for u in ids) < 1e-6
        assert all(got[u]["in_degree"] == sum(t == u for _, t, _ in after) for u in ids)


def test_degree_and_transitive_ranks(graph):
    nodes, edges = graph("ABCD", [("A", "B", "calls"), ("B", "C", "calls"), ("D", "C", "calls"), ("A", "C", "imports")])
    rows = rank.rank_by_in_degree(nodes, edges, limit=2).collect()
    assert [(r["name"], r["in_degree"], r["out_degree"]) for r in rows] == [("C", 3, 0), ("B", 1, 1)]
    rows = rank.rank_by_transitive(nodes, edges, limit=2).collect()
    # A reaches C at depths 1 and 2, which are two rows.
    assert [(r["name"], r["transitive_count"]) for r in rows] == [("C", 4), ("B", 1)]
    rows = rank.rank_by_transitive(nodes, edges, ["mod.A", "mod.B"]).collect()
    assert [(r["name"], r["transitive_count"]) for r in rows] == [("B", 1), ("A", 0)]


def test_context_summary(graph):
    nodes, edges = graph("HXY", [("X", "H", "calls"), ("Y", "H", "calls")])
    rows = rank.context_summary(nodes, rank.pagerank(nodes, edges), max_nodes=2)
    assert [r["name"] for r in rows.collect()] == ["H", "X"]
    assert rank.context_summary(nodes, rank.pagerank(nodes, edges), qualified_names=["mod.Y"]).select(F.col("name")).first()[0] == "Y"


def test_a_round_does_not_shuffle_the_edges(spark, graph):
    nodes, edges = graph("ABCD", [("A", "B", "calls"), ("B", "C", "calls"), ("D", "C", "calls"), ("A", "C", "imports")])
    shares, state, hot = rank.edge_shares(nodes, edges)
    ranks = state.select("id", "sink", F.lit(0.25).alias("rank"), F.lit(0.25).alias("prev"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rank.pagerank_round(shares, ranks, hot, 0.1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [x for x in plan.split("\n") if "share" in x and "FileScan" in x]
    assert below and all("Bucketed: true" in x for x in below)
    before_scan = plan.split("Bucketed: true")[0].split("SortMergeJoin")[-1]
    assert "Exchange" not in before_scan.split("FileScan")[-1]


def test_more_candidates_than_fifty(graph):
    names = [f"n{i:03d}" for i in range(70)] + ["hub"]
    nodes, edges = graph(names, [(n, "hub", "calls") for n in names[:70]] + [("hub", n, "calls") for n in names[60:70]])
    every = rank.rank_by_transitive(nodes, edges, [f"mod.{n}" for n in names], limit=None)
    assert every.count() == 71
    assert rank.rank_by_transitive(nodes, edges, limit=None, candidates=None).count() == 71
    assert rank.rank_by_transitive(nodes, edges, limit=100).count() == 50


def test_the_query_over_all_nodes_counts_every_kind(spark):
    from codeloom.plans.catalog import QUERIES
    from codeloom.plans.graph_view import graph_edges, graph_nodes

    sf = "/root/testdata/sf0.001"
    edges = [tuple(r) for r in graph_edges(spark, sf).select("source_id", "target_id").collect()]
    into = {}
    for source, target in edges:
        into.setdefault(target, []).append(source)
    want = {}
    for row in graph_nodes(spark, sf).collect():
        level, rows = {row["id"]}, 0
        for _ in range(10):
            level = {s for n in level for s in into.get(n, ())}
            rows += len(level)
        want[row["qualified_name"]] = (len(into.get(row["id"], ())), rows)
    got = QUERIES["rank_transitive_all"](spark, sf).collect()
    assert len(got) == len(want)
    assert {r["qualified_name"]: (r["in_degree"], r["transitive_count"]) for r in got} == want


def test_a_round_meets_only_what_the_round_before_has_reached(graph, monkeypatch):
    names = [f"n{i}" for i in range(40)]
    nodes, edges = graph(names, [("n0", "n1", "calls"), ("n1", "n2", "calls"), ("n3", "n2", "imports"), ("n2", "n4", "calls")])
    made, plain = [], rank.pagerank_round

    def counted(*args):
        rows = plain(*args)
        made.append(rows.count())
        return rows

    monkeypatch.setattr(rank, "pagerank_round", counted)
    c, _ = scores(nodes, edges)
    want = loop_pagerank(set(range(1, 41)), [(1, 2, "calls"), (2, 3, "calls"), (4, 3, "imports"), (3, 5, "calls")])
    assert max(abs(c[n] - want[i]) for i, n in enumerate(names, 1)) < 1e-7
    assert made == [3, 2, 1, 0]


def test_a_node_that_comes_twice_is_one_after_the_first_round(spark):
    nodes = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id BIGINT")
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls"), (3, 2, "imports")], "source_id BIGINT, target_id BIGINT, kind STRING")
    got = {}
    for r in rank.pagerank(nodes, edges, 3).collect():
        got.setdefault(r["id"], []).append(r["centrality"])
    r = {1: 0.5, 2: 0.25, 3: 0.25}
    for _ in range(3):
        r = {1: 0.0375, 2: 0.0375 + 0.85 * (r[1] + r[3]), 3: 0.0375 + 0.85 * r[2]}
    assert got.keys() == r.keys() and len(got[1]) == 2
    assert all(abs(v - r[k] / max(r.values())) < 1e-9 for k, values in got.items() for v in values)
