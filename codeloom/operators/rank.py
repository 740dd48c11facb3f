"""Degree, transitive and PageRank rankings."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.operators.joins import HOT_ROWS, hot_keys, with_every_salt, with_salt
from codeloom.operators.traverse import dependent_counts
from codeloom.schema import (
    DEFAULT_EDGE_WEIGHT,
    EDGE_WEIGHTS,
    PAGERANK_DAMPING,
    PAGERANK_ROUNDS,
    PAGERANK_STOP_DELTA,
    PAGERANK_WARN_DELTA,
)
from codeloom.session import bucketed, materialize, scratch_path, written


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node that has an edge, in one pass over the edges."""
    ends = edges.select(
        F.explode(F.array(
            F.struct(F.col("target_id").alias("id"), F.lit(1).alias("inc"), F.lit(0).alias("out")),
            F.struct(F.col("source_id").alias("id"), F.lit(0).alias("inc"), F.lit(1).alias("out")),
        )).alias("end")
    )
    return ends.groupBy(F.col("end.id").alias("id")).agg(
        F.sum("end.inc").alias("in_degree"), F.sum("end.out").alias("out_degree")
    )


def in_scope(
    file_paths: Sequence[str] | None = None,
    qualified_names: Sequence[str] | None = None,
    kind: str | None = None,
) -> Column:
    """Node filter: each given list must hold; an empty list does not filter."""
    cond = F.lit(True)
    if file_paths:
        cond = cond & F.col("file_path").isin(*file_paths)
    if qualified_names:
        cond = cond & F.col("qualified_name").isin(*qualified_names)
    if kind is not None:
        cond = cond & (F.col("kind") == kind)
    return cond


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = degrees(edges)
    return nodes.join(found, "id", "left").fillna(0, ["in_degree", "out_degree"])


def rank_by_in_degree(
    nodes: DataFrame,
    edges: DataFrame,
    file_paths: Sequence[str] | None = None,
    qualified_names: Sequence[str] | None = None,
    kind: str | None = None,
    limit: int | None = 20,
) -> DataFrame:
    """Nodes by incoming edges, most first; ties by qualified name. Without a limit all, in no order."""
    ranked = with_degrees(nodes.where(in_scope(file_paths, qualified_names, kind)), edges)
    return ranked if limit is None else ranked.orderBy(F.desc("in_degree"), "qualified_name").limit(limit)


def rank_by_transitive(
    nodes: DataFrame,
    edges: DataFrame,
    qualified_names: Sequence[str] | None = None,
    limit: int | None = 20,
    candidates: int | None = 50,
) -> DataFrame:
    """Nodes by rows of their reverse closure to depth 10; ties by qualified name. The candidates are the nodes named, or
    else the top ones by in-degree (50 unless said otherwise; None: all nodes)."""
    if qualified_names:
        chosen = with_degrees(nodes.where(F.col("qualified_name").isin(*qualified_names)), edges)
    else:
        chosen = rank_by_in_degree(nodes, edges, limit=candidates)
    chosen = written(chosen, "candidates")
    scored = chosen.join(dependent_counts(edges, chosen), "id")
    return scored if limit is None else scored.orderBy(F.desc("transitive_count"), "qualified_name").limit(limit)


def edge_weight(kind: Column) -> Column:
    """Weight of an edge kind; kinds that are not listed get the default."""
    out = None
    for name, weight in EDGE_WEIGHTS.items():
        out = F.when(kind == name, weight) if out is None else out.when(kind == name, weight)
    return out.otherwise(DEFAULT_EDGE_WEIGHT)


def edge_shares(nodes: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a round needs: (shares, state, hot). shares(source_id, _salt, target_id, share) are the edges between known nodes
    with the part of the source's rank each carries, bucketed by source; state(id, sink, in_degree); hot: the split of sources
    with very many edges."""
    ids = nodes.select("id")
    # Equal ends are summed first, so that no later step meets a hub's repeated edges. Of the joins with the known nodes,
    # each has plain shuffles on both sides, which adaptive execution splits where an end is very frequent.
    pairs = written(edges.groupBy("source_id", "target_id").agg(
        F.sum(edge_weight(F.col("kind"))).alias("w"), F.count(F.lit(1)).alias("n")), "edge-pairs")
    known = written(ids, "node-ids")
    valid = written(pairs.join(known.withColumnRenamed("id", "target_id"), "target_id")
                    .join(known.withColumnRenamed("id", "source_id"), "source_id").select("source_id", "target_id", "w"), "edge-weights")
    totals = written(valid.groupBy(F.col("source_id").alias("id")).agg(F.sum("w").alias("total")), "source-totals")
    in_degree = pairs.groupBy(F.col("target_id").alias("id")).agg(F.sum("n").alias("in_degree"))
    state = known.join(totals, "id", "left").join(in_degree, "id", "left").select(
        "id", F.col("total").isNull().alias("sink"), F.coalesce("in_degree", F.lit(0).cast("long")).alias("in_degree"))
    shares = valid.join(totals.withColumnRenamed("id", "source_id"), "source_id").select(
        "source_id", "target_id", (PAGERANK_DAMPING * F.col("w") / F.col("total")).alias("share"))
    hot, _ = materialize(hot_keys(valid, ["source_id"], hot_rows))
    return bucketed(with_salt(shares, ["source_id"], hot), "edge-shares", ["source_id", "_salt"], valid.count()), state, hot


def pagerank_round(shares: DataFrame, ranks: DataFrame, hot: DataFrame, base: float = 0.0) -> DataFrame:
    """What the edges carry of ``ranks(id, ...)``, plus ``base``, for every node that gets any: the ranks meet the edges where
    these lie, and one partial sum per target and task is shuffled."""
    told = [c for c, kind in ranks.dtypes if kind == "double"]
    sent = with_every_salt(ranks.select(F.col("id").alias("source_id"), *told), ["source_id"], hot)
    got = shares.join(sent, ["source_id", "_salt"]).select(
        F.col("target_id").alias("id"), *[(F.col(c) * F.col("share")).alias(c) for c in told])
    return got.groupBy("id").agg(*[(F.sum(c) + F.lit(base)).alias(c) for c in told])


def _between(shares: DataFrame, seen: dict) -> DataFrame:
    """The shares whose sources lie between the least and the greatest id that is sent; readers skip the files' other pages."""
    return shares.where(F.col("source_id").between(seen["low"], seen["high"]))


_SPAN = {"low": F.min, "high": F.max}


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = PAGERANK_ROUNDS, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, centrality, in_degree): weighted PageRank divided by its maximum.

    The edges are divided by their source's total weight and bucketed by source once. A round's ranks are what the edges carry of the
    ranks before it, plus an even share of what the sinks hold; so they are a sum of levels: level k is an even start carried along
    k edges, and only its factor changes from round to round. What the sinks hold of a level follows from its sum and the next one's. So each
    level is made once, from the nodes that the level before has reached, and is written; the factors are numbers, and all levels are added
    at the end. The early stop goes by an upper bound of the change, the warning by the change itself.
    """
    shares, state, hot = edge_shares(nodes, edges, hot_rows)
    state, info = materialize(state)
    n = info["rows"]
    if n == 0:
        return state.select("id", F.lit(0.0).alias("centrality"), "in_degree")
    folder = scratch_path(state.sparkSession, "rank-levels")
    rows = state.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    repeated = not rows.where("rows > 1").isEmpty()
    # A node that comes several times starts several times; from then on it is one.
    series = {"unit": F.lit(1.0 / n)} | ({"start": F.col("rows") / n} if repeated else {})
    level, seen = _written_level(rows.select("id", *[c.alias(name) for name, c in series.items()]), folder, 0)
    unit, start = [seen["unit"]], [seen["start" if repeated else "unit"]]
    factors, change = [1.0], None  # of an even start in each round; the last round's change is at most ``change``
    for t in range(1, rounds + 1):
        if seen["rows"]:
            level, seen = _written_level(pagerank_round(_between(shares, seen), level, hot), folder, t)
        unit.append(seen["unit"] or 0.0)
        start.append(seen["start" if repeated else "unit"] or 0.0)
        # the sinks keep what is not carried on
        kept, kept_start = ([m - after / PAGERANK_DAMPING for m, after in zip(sums, sums[1:], strict=False)] for sums in (unit, start))
        sunk = sum(factors[t - 1 - k] * kept[k] for k in range(t - 1)) + kept_start[t - 1]
        factors.append(1.0 - PAGERANK_DAMPING + PAGERANK_DAMPING * sunk)
        last = factors[1] * unit[t - 1] + start[t - 1] if repeated else abs(factors[1] - 1.0) * unit[t - 1]
        change = sum(abs(factors[t - k] - factors[t - 1 - k]) * unit[k] for k in range(t - 1)) + last + start[t]
        if change < PAGERANK_STOP_DELTA:
            break
    done = len(factors) - 1

    def added(t: int) -> Column:
        each = F.array(*[F.lit(float(factors[t - k] if k < t else not repeated and k == t)) for k in range(done + 1)])
        whole = F.col("unit") * F.get(each, F.col("level"))
        return F.sum(whole + F.when(F.col("level") == t, F.col("start")).otherwise(0.0) if repeated else whole)

    levels = state.sparkSession.read.schema(", ".join(f"{c} {t}" for c, t in [*level.dtypes, ("level", "int")])).parquet(folder)
    ranks, sums = materialize(levels.groupBy("id").agg(added(done).alias("rank"), added(max(done - 1, 0)).alias("prev")),
                              top=F.max("rank"), delta=F.sum(F.abs(F.col("rank") - F.col("prev"))))
    if done and sums["delta"] > PAGERANK_WARN_DELTA:
        warnings.warn(f"PageRank stopped after {done} rounds with a delta of {sums['delta']:.3g}", stacklevel=2)
    return written(state.join(ranks.select("id", "rank"), "id").select(
        "id", (F.col("rank") / F.lit(sums["top"])).alias("centrality"), "in_degree"), "pagerank")


def _written_level(rows: DataFrame, folder: str, number: int) -> tuple[DataFrame, dict]:
    """A level as a folder of a table, and its number of rows, the sums of its columns and the span of its ids."""
    seen, path = Observation(), f"{folder}/level={number}"
    sums = [F.sum(c).alias(c) for c in rows.columns if c != "id"]
    spans = [of("id").alias(name) for name, of in _SPAN.items()]
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *sums, *spans).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), seen.get


#: Pushed nodes up to this number are sent to the edges where they lie.
SMALL_PUSH = 200_000


def pagerank_from(nodes: DataFrame, edges: DataFrame, known: DataFrame, stop: float = PAGERANK_STOP_DELTA, max_rounds: int = 500, *,
                  hot_rows: int = HOT_ROWS, small: int = SMALL_PUSH) -> DataFrame:
    """What ``pagerank`` tells, going on from ``known(id, centrality)`` of an earlier graph.

    Spreading the sinks' rank evenly only scales the solution of y = 1 + damping * (what y's edges carry), which a change touches
    around itself only. One pass over the edges gives each node's residual, how far it is off; then nodes with a residual hand it on, round by
    round, and no other node is met. Residuals below an even share of half the bound stay where they are. At the end all residuals together are at
    most ``stop`` of the sum of the ranks, the bound that ``pagerank`` ends by where its rounds suffice; a warning tells if ``max_rounds`` ended it.
    """
    shares, state, hot = edge_shares(nodes, edges, hot_rows)
    known = known.select("id", "centrality").where("centrality IS NOT NULL")
    ranks, info = materialize(state.select("id", "in_degree").join(known, "id", "left").fillna(0.0, ["centrality"]))
    n = info["rows"]
    if n == 0:
        return ranks.select("id", F.lit(0.0).alias("centrality"), "in_degree")
    sent = with_every_salt(ranks.select(F.col("id").alias("source_id"), "centrality"), ["source_id"], hot)
    carried = shares.join(sent, ["source_id", "_salt"]).select(
        F.col("target_id").alias("id"), (F.col("share") * F.col("centrality")).alias("gap"))
    own = ranks.select("id", (-F.col("centrality")).alias("gap"))
    gaps = written(carried.unionByName(own).groupBy("id").agg(F.sum("gap").alias("gap")), "rank-gaps")
    # Where nothing has changed, the gap is that of one unit of y: the usual gap tells the scale of ``known``.
    usual = gaps.where("gap < 0").agg(F.percentile_approx("gap", 0.5, 10_000)).first()[0]
    scale = -1.0 / usual if usual else 1.0
    total = max(scale * (ranks.agg(F.sum("centrality")).first()[0] or 0.0), n)
    quiet = stop * total / (2 * n)
    off = gaps.select("id", (1.0 + F.col("gap") * scale).alias("rest"))
    far = F.abs("rest") > quiet
    active, seen = materialize(off.where(far), **{name: of("id") for name, of in _SPAN.items()})
    # What is quiet waits in pieces, which are added when nothing else is left to push: a round meets the pushed nodes only.
    pushed, waiting, rounds, moves, added = [], [], 0, seen["rows"], True
    spans = {"active": F.count_if(far)} | {name: of(F.when(far, F.col("id"))) for name, of in _SPAN.items()}
    while rounds < max_rounds and (moves or not added):
        if moves:
            rounds += 1
            pushed.append(active)
            if len(pushed) == 10:
                pushed = [written(_sums(pushed), "rank-pushes")]
            moving = with_every_salt(active.withColumnRenamed("id", "source_id"), ["source_id"], hot)
            if moves <= small:
                moving = F.broadcast(moving)
            got = _between(shares, seen).join(moving, ["source_id", "_salt"]).select(
                F.col("target_id").alias("id"), (F.col("rest") * F.col("share")).alias("rest"))
            left, seen = materialize(_sums([got]), **spans)
            waiting.append(left.where(~far))
            added = False
            if len(waiting) == 10:
                waiting = [written(_sums(waiting), "rank-waiting")]
        else:
            left, seen = materialize(_sums(waiting), **spans)
            waiting, added = [left.where(~far)], True
        active, moves = left.where(far), seen["active"]
    if moves:
        warnings.warn(f"PageRank stopped after {rounds} rounds with {moves} nodes left to push", stacklevel=2)
    done = ranks.select("id", "in_degree", (F.col("centrality") * scale).alias("rank"))
    if pushed:
        done = done.join(_sums(pushed), "id", "left").select("id", "in_degree", (F.col("rank") + F.coalesce("rest", F.lit(0.0))).alias("rank"))
    done = written(done, "ranks")
    top = done.agg(F.max("rank")).first()[0]
    return done.select("id", (F.col("rank") / F.lit(top)).alias("centrality"), "in_degree")


def _sums(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("id").agg(F.sum("rest").alias("rest"))


def context_summary(
    nodes: DataFrame,
    ranks: DataFrame,
    file_paths: Sequence[str] | None = None,
    qualified_names: Sequence[str] | None = None,
    max_nodes: int | None = 50,
) -> DataFrame:
    """The most central nodes in scope, with ``centrality`` and ``in_degree``; without a number all, in no order."""
    drop = [c for c in ("centrality", "in_degree", "in_degree_cache") if c in nodes.columns]
    scoped = nodes.drop(*drop).where(in_scope(file_paths, qualified_names))
    joined = scoped.join(ranks, "id", "left").fillna(0.0, ["centrality"]).fillna(0, ["in_degree"])
    if max_nodes is None:
        return joined
    return joined.orderBy(F.desc("centrality"), F.desc("in_degree"), "qualified_name").limit(max_nodes)
