"""Forward and reverse closures over the edge table.

The rows are pairs (node, depth): a node is listed once for each depth at which a walk from
the seed can end on it, and the seed itself is listed when a cycle leads back to it. Depth
grows by one per step, so removing duplicates level by level gives exactly the set that a
recursive UNION gives.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from codeloom.functions import seed_sets
from codeloom.operators.joins import HOT_ROWS, MOST_BROADCAST, hot_keys, listed, with_every_salt, with_salt
from codeloom.session import bucket_number, bucketed, materialize, open_bucketed, scratch_path, write_bucketed, written


#: Rows of a frontier that go to the links as they are, and ids that are listed to pick the buckets of stored links.
SMALL, FEW = 200_000, 500
STORED = "here BIGINT, there BIGINT, kind STRING"


def links(edges: DataFrame, edge_kinds: Sequence[str] | None = None, reverse: bool = False) -> DataFrame:
    """The edge table as (here, there), filtered to ``edge_kinds`` (none or empty: all kinds)."""
    return _ends(_of_kinds(edges, edge_kinds), reverse).select("here", "there")


def _of_kinds(rows: DataFrame, edge_kinds: Sequence[str] | None) -> DataFrame:
    return rows.where(F.col("kind").isin(*edge_kinds)) if edge_kinds else rows


def _ends(edges: DataFrame, reverse: bool) -> DataFrame:
    here, there = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return edges.select(F.col(here).alias("here"), F.col(there).alias("there"), "kind")


class Links:
    """The links of a walk over any edges. A frontier of at most ``small`` rows, counted before, is broadcast to the edges
    where they lie. For the first larger one the links are written once: bucketed by the node they leave, the rows of very
    frequent nodes split by size; from then on a step shuffles the frontier only."""

    def __init__(self, edges: DataFrame, edge_kinds: Sequence[str] | None = None, reverse: bool = False, hot_rows: int = HOT_ROWS,
                 small: int = SMALL):
        self.source, self.hot_rows, self.small = links(edges, edge_kinds, reverse), hot_rows, small
        self.hot = self.table = self.keys = None

    def _write(self):
        self.hot, info = materialize(hot_keys(self.source, ["here"], self.hot_rows))
        self.keys = info["rows"]
        salted = with_salt(self.source, ["here"], self.hot, self.keys)
        self.table = bucketed(salted, "links", ["here", "_salt"], self.source.count())

    def step(self, frontier: DataFrame, rows: int | None = None) -> DataFrame:
        """``frontier(here, ...)`` with ``there`` for every link; ``rows`` is its size, if known."""
        if rows is not None and rows <= self.small:
            return self.source.join(F.broadcast(frontier), "here")
        if self.table is None:
            self._write()
        return self.table.join(with_every_salt(frontier, ["here"], self.hot, self.keys), ["here", "_salt"]).drop("_salt")


def write_links(edges: DataFrame, folder: str, reverse: bool, hot_rows: int = HOT_ROWS) -> dict:
    """``edges(source_id, target_id, kind)`` as stored links of one direction; what is returned opens them again.

    Links of ordinary nodes lie in buckets by the node they leave; those of very frequent nodes lie beside them, in buckets
    by the node and a part of its links. How many buckets there are follows from their rows, not from the number of such parts."""
    rows = _ends(edges, reverse)
    spark = edges.sparkSession
    hot, info = materialize(hot_keys(rows, ["here"], hot_rows), most=F.sum("_salts"))
    n, keys = bucket_number(spark, rows.count()), info["rows"]
    write_bucketed(rows.join(listed(hot, keys), "here", "left_anti"), f"{folder}/plain", ["here"], n)
    split = 0
    if info["rows"]:
        split = min(info["most"], bucket_number(spark, info["most"] * hot_rows))
        (hot.coalesce(1) if keys <= MOST_BROADCAST else hot).write.parquet(f"{folder}/hot")
        frequent = with_salt(rows.join(listed(hot.select("here"), keys), "here", "left_semi"), ["here"], hot, keys)
        write_bucketed(frequent, f"{folder}/split", ["here", "_salt"], split)
    return {"folder": folder, "buckets": n, "split": split, "hot": keys}


class StoredLinks:
    """Links that ``write_links`` has written: a walk writes no edge, and a step from few nodes reads only their buckets."""

    def __init__(self, spark, told: dict, edge_kinds: Sequence[str] | None = None):
        self.kinds = edge_kinds
        self.plain = open_bucketed(spark, f"{told['folder']}/plain", STORED, ["here"], told["buckets"])
        self.split = self.hot = None
        self.keys = told.get("hot")  # not told by older stores
        if told["split"]:
            self.hot = spark.read.schema("here BIGINT, _salts INT").parquet(f"{told['folder']}/hot")
            self.split = open_bucketed(spark, f"{told['folder']}/split", f"{STORED}, _salt INT", ["here", "_salt"], told["split"])

    def step(self, frontier: DataFrame, rows: int) -> DataFrame:
        plain = self.plain
        sent = frontier
        if rows <= FEW:
            plain = plain.where(F.col("here").isin([r["here"] for r in frontier.select("here").distinct().collect()]))
        if rows <= SMALL:
            sent = F.broadcast(frontier)
        found = _of_kinds(plain, self.kinds).drop("kind").join(sent, "here")
        if self.split is not None:
            many = self.keys is not None and self.keys > MOST_BROADCAST
            # of many frequent nodes those of the frontier are found where the list lies
            salted = (sent if many else frontier).join(listed(self.hot, self.keys), "here").withColumn(
                "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
            more = _of_kinds(self.split, self.kinds).drop("kind").join(salted, ["here", "_salt"]).drop("_salt")
            found = found.unionByName(more)
        return found


def closure(
    edges: DataFrame | Links | StoredLinks,
    seeds: DataFrame,
    max_depth: int = 10,
    edge_kinds: Sequence[str] | None = None,
    reverse: bool = False,
    *,
    hot_rows: int = HOT_ROWS,
    small: int = SMALL,
) -> DataFrame:
    """(seed_id, node_id, depth) for every seed in ``seeds(seed_id)``, all seeds in one pass. Each level is written to the
    shared folder and counted on the way. ``edges`` are an edge table, or links whose kinds and direction are settled."""
    table = Links(edges, edge_kinds, reverse, hot_rows, small) if isinstance(edges, DataFrame) else edges
    frontier, info = materialize(seeds.select("seed_id", F.col("seed_id").alias("here")).distinct())
    levels = []
    for depth in range(1, max(max_depth, 1) + 1):
        reached = table.step(frontier, info["rows"]).select("seed_id", F.col("there").alias("here")).distinct()
        frontier, info = materialize(reached)
        levels.append(frontier.select("seed_id", F.col("here").alias("node_id"), F.lit(depth).alias("depth")))
        if info["rows"] == 0:
            break
    return reduce(DataFrame.unionByName, levels)


def closure_nodes(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Reached pairs joined to their node rows."""
    return reached.join(nodes, reached["node_id"] == nodes["id"]).drop("node_id")


def dependencies(
    nodes: DataFrame,
    edges: DataFrame | Links | StoredLinks,
    qualified_name: str,
    edge_kinds: Sequence[str] | None = None,
    max_depth: int = 10,
) -> DataFrame:
    """Everything the named node depends on: node columns plus ``depth``."""
    return _walk(nodes, edges, qualified_name, edge_kinds, max_depth, reverse=False)


def dependents(
    nodes: DataFrame,
    edges: DataFrame | Links | StoredLinks,
    qualified_name: str,
    edge_kinds: Sequence[str] | None = None,
    max_depth: int = 10,
) -> DataFrame:
    """Everything that depends on the named node: node columns plus ``depth``."""
    return _walk(nodes, edges, qualified_name, edge_kinds, max_depth, reverse=True)


def _walk(nodes, edges, qualified_name, edge_kinds, max_depth, reverse):
    # Qualified names are unique, so there is at most one seed.
    seeds = nodes.where(F.col("qualified_name") == qualified_name).select(F.col("id").alias("seed_id"))
    reached = closure(edges, seeds, max_depth, edge_kinds, reverse)
    return closure_nodes(nodes, reached.drop("seed_id"))


BITS = 62
#: Seeds up to this number go as words of bits.
FEW_SEEDS = 256
#: Bytes of a level that one task puts together, about, and bytes of sets that count as one row of a frontier.
PIECE_BYTES, ROW_BYTES = 64_000_000, 64


def dependent_counts(edges: DataFrame | Links | StoredLinks, seeds: DataFrame, max_depth: int = 10, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, transitive_count) for every node in ``seeds(id)``: the rows of its reverse closure, pairs (node, depth).

    All seeds walk together, few as words of bits, more as sets.
    """
    ids = written(seeds.select("id").distinct(), "seeds-of-walk")
    table = Links(edges, reverse=True, hot_rows=hot_rows) if isinstance(edges, DataFrame) else edges
    return (_counts_by_words if ids.count() <= FEW_SEEDS else _counts_by_sets)(table, ids, max_depth)


def _counts_by_sets(table: Links | StoredLinks, ids: DataFrame, max_depth: int) -> DataFrame:
    """Seeds are numbered by id, within ranges of it, in blocks of 65,536. A node carries for each block the set of its seeds that have
    reached it at this depth, two bytes for a seed or less (``functions.seed_sets``). So a level's bytes grow with its pairs of
    node and seed, however the seeds lie, and at the end the sets of all levels are counted by seed."""
    spark = ids.sparkSession
    parts = written(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "seeds")
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    block = F.shiftleft(F.col("part").cast("long"), 32) + F.floor(place / seed_sets.WIDTH)
    numbered = written(parts.select("id", block.alias("block"), (place % seed_sets.WIDTH).cast("int").alias("bit")), "seed-blocks")
    rows = numbered.count()
    digits = F.lpad(F.hex("bit"), 4, "0")
    frontier = numbered.select(F.col("id").alias("here"), "block", F.unhex(F.concat(F.right(digits, F.lit(2)), F.left(digits, F.lit(2)))).alias("seen"))
    folder, levels, least = scratch_path(spark, "walk-levels"), 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = [F.count(F.lit(1)).alias("rows"), F.sum(F.length("seen")).alias("bytes")]
    pieces = least
    while levels < max_depth and rows:
        sent, left, path = Observation(), Observation(), f"{folder}/level={levels}"
        reached = table.step(frontier, rows).select(F.col("there").alias("here"), "block", "seen")
        reached = reached.mapInArrow(seed_sets.combined, seed_sets.SETS).observe(sent, *size)
        level = reached.repartition(pieces, "here", "block").sortWithinPartitions("here", "block").mapInArrow(seed_sets.merged, seed_sets.SETS)
        level.observe(left, *size).write.parquet(path)
        frontier, levels = spark.read.schema(seed_sets.SETS).parquet(path), levels + 1
        rows = max(left.get["rows"], (left.get["bytes"] or 0) // ROW_BYTES)
        if rows:  # else adaptive execution has left out the step that ``sent`` looks at
            pieces = max(least, math.ceil((sent.get["bytes"] or 0) / PIECE_BYTES))
    if not levels:
        return numbered.select("id", F.lit(0).cast("long").alias("transitive_count"))
    counts = spark.read.schema(seed_sets.SETS).parquet(*[f"{folder}/level={k}" for k in range(levels)]).mapInArrow(seed_sets.tallied, seed_sets.COUNTS)
    total = counts.groupBy("block", "bit").agg(F.sum("n").alias("n"))
    return numbered.join(total, ["block", "bit"], "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("transitive_count"))


def _counts_by_words(table: Links | StoredLinks, ids: DataFrame, max_depth: int) -> DataFrame:
    """Seeds are numbered within parts of the table and go in blocks of 62: a node carries one bit per seed of a block that has
    reached it at this depth."""
    parts = written(ids.withColumn("part", F.spark_partition_id()), "seeds")
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    numbered = written(parts.select("id", F.struct("part", F.floor(place / BITS).alias("n")).alias("block"),
                                    (place % BITS).cast("int").alias("bit")), "seed-blocks")
    rows = numbered.count()
    frontier = numbered.select("block", F.col("id").alias("here"), F.expr("shiftleft(1L, bit)").alias("seen"))
    levels = []
    for _ in range(max_depth):
        reached = table.step(frontier, rows).groupBy("block", F.col("there").alias("here")).agg(F.bit_or("seen").alias("seen"))
        frontier, info = materialize(reached)
        rows = info["rows"]
        if rows == 0:
            break
        # equal sets of seeds are counted first, so that few rows are taken apart into bits
        sets = frontier.groupBy("block", "seen").agg(F.count(F.lit(1)).alias("n"))
        bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("seen", i) == 1)
        levels.append(sets.select("block", F.explode(bits).alias("bit"), "n").groupBy("block", "bit").agg(F.sum("n").alias("n")))
    found = numbered
    if levels:
        total = reduce(DataFrame.unionByName, levels).groupBy("block", "bit").agg(F.sum("n").alias("n"))
        found = numbered.join(total, ["block", "bit"], "left")
    else:
        found = numbered.withColumn("n", F.lit(None).cast("long"))
    return found.select("id", F.coalesce("n", F.lit(0).cast("long")).alias("transitive_count"))
