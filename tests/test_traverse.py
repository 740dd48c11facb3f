import random
import sqlite3

import pytest

from codeloom.operators import traverse


def pairs(df):
    return sorted((r["name"], r["depth"]) for r in df.collect())


def test_chain_and_fan_in(graph):
    nodes, edges = graph("ABC", [("A", "B", "calls"), ("B", "C", "calls")])
    assert pairs(traverse.dependencies(nodes, edges, "mod.A")) == [("B", 1), ("C", 2)]
    nodes, edges = graph("ABC", [("A", "C", "calls"), ("B", "C", "calls")])
    assert pairs(traverse.dependents(nodes, edges, "mod.C")) == [("A", 1), ("B", 1)]


def test_cycle_lists_a_node_once_per_depth(graph):
    nodes, edges = graph(["1", "2", "3"], [("1", "2", "calls"), ("2", "1", "calls"), ("1", "3", "calls"), ("2", "3", "calls")])
    found = pairs(traverse.dependencies(nodes, edges, "mod.1", max_depth=4))
    assert found == sorted([("2", 1), ("3", 1), ("1", 2), ("3", 2), ("2", 3), ("3", 3), ("1", 4), ("3", 4)])


def test_kinds_bounds_and_unknown_names(graph):
    nodes, edges = graph("ABC", [("A", "B", "calls"), ("A", "B", "imports"), ("A", "C", "imports"), ("B", "C", "calls")])
    assert pairs(traverse.dependencies(nodes, edges, "mod.A", ["calls"])) == [("B", 1), ("C", 2)]
    assert pairs(traverse.dependencies(nodes, edges, "mod.A", [])) == [("B", 1), ("C", 1), ("C", 2)]
    assert pairs(traverse.dependencies(nodes, edges, "mod.A", max_depth=0)) == [("B", 1), ("C", 1)]
    assert pairs(traverse.dependencies(nodes, edges, "nobody")) == []


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_random_graph_against_recursive_union(spark, hot_rows):
    rng = random.Random(7)
    rows = [(rng.randrange(40), 0 if rng.random() < 0.3 else rng.randrange(40), rng.choice(["calls", "imports"]))
            for _ in range(120)]
    con = sqlite3.connect(":memory:")
    con.execute("create table e(s, t, k)")
    con.executemany("insert into e values (?, ?, ?)", rows)
    seeds = [0, 3, 5]
    want = set()
    for seed in seeds:
        want |= {(seed, n, d) for n, d in con.execute(
            "with recursive w(n, d) as (select s, 1 from e where t = ? union select s, d + 1 from w join e on t = n where d < 6)"
            " select n, d from w", (seed,))}
    edges = spark.createDataFrame(rows, "source_id BIGINT, target_id BIGINT, kind STRING")
    got = traverse.closure(edges, spark.createDataFrame([(s,) for s in seeds], "seed_id BIGINT"), 6, reverse=True,
                           hot_rows=hot_rows).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_counts_of_many_seeds_equal_the_closure(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(90), rng.randrange(90), "calls") for _ in range(200)]
    edges = spark.createDataFrame(rows, "source_id BIGINT, target_id BIGINT, kind STRING")
    seeds = list(range(70))
    frame = spark.createDataFrame([(s,) for s in seeds], "seed_id BIGINT")
    want = {s: 0 for s in seeds} | {r["seed_id"]: r["count"] for r in traverse.closure(
        edges, frame, 4, reverse=True).groupBy("seed_id").count().collect()}
    ids = frame.withColumnRenamed("seed_id", "id")
    assert dict(map(tuple, traverse.dependent_counts(edges, ids.repartition(1), 4).collect())) == want
    some = traverse.dependent_counts(edges, ids.where("id < 5").repartition(3), 4, hot_rows=3)
    assert dict(map(tuple, some.collect())) == {s: want[s] for s in range(5)}
    assert traverse.dependent_counts(edges.limit(0), ids, 4).agg({"transitive_count": "sum"}).first()[0] == 0


def test_a_step_does_not_shuffle_the_links(spark):
    edges = spark.createDataFrame([(i, i + 1, "calls") for i in range(50)], "source_id BIGINT, target_id BIGINT, kind STRING")
    table = traverse.Links(edges)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.step(spark.range(5).withColumnRenamed("id", "here"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    links = plan[plan.index("SortMergeJoin"):]
    assert "Bucketed: true" in links and links.count("Exchange hashpartitioning") == 1


def test_small_and_large_frontiers_walk_alike(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(50), 0 if rng.random() < 0.4 else rng.randrange(50), "calls") for _ in range(150)]
    edges = spark.createDataFrame(rows, "source_id BIGINT, target_id BIGINT, kind STRING")
    seeds = spark.createDataFrame([(0,), (1,)], "seed_id BIGINT")
    found = [sorted(map(tuple, traverse.closure(edges, seeds, 5, reverse=True, hot_rows=5, small=small).collect())) for small in (0, 20, 10 ** 6)]
    assert found[0] == found[1] == found[2]


def test_counting_bits_takes_one_column_a_level(spark):
    rows = spark.createDataFrame([(i, i + 1, "calls") for i in range(130)], "source_id BIGINT, target_id BIGINT, kind STRING")
    counts = traverse.dependent_counts(rows, spark.range(131).select("id"), 3)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("getbit") <= 6
    assert {r["id"]: r["transitive_count"] for r in counts.collect()} == {i: min(i, 3) for i in range(131)}
