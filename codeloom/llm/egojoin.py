"""Groups of near-equal vectors by an epsilon grid order join.

Cosine of at least ``least`` between two vectors is a distance of at most ``eps`` between the unit vectors. The unit vectors are
sorted by their cells (of width eps) on the leading principal dimensions, within their label; the sequence is cut into blocks.
Two blocks meet only if their boxes on these dimensions are within eps; inside a pair of blocks the sequences are halved
recursively, skipping parts whose boxes are too far apart, down to small products of matrices. A pair of blocks gives each
vector its number of links and the smallest vector it is connected to there, never the pairs themselves, and the components
follow from these. Equal vectors of a label are one class, joined once and counted as often as they occur.

Vectors that are null, empty or zero, or hold null, NaN or infinite components, and those without a label, link with nothing;
nor do vectors of different lengths. Rows that share an id are one vector where components are named, and rows without an id
link with nothing and are kept, their component being null. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.ann import inner_products, matrix, sound
from codeloom.llm.components import components, local_roots
from codeloom.session import written

LEADING, BLOCK, LEAF = 8, 1024, 128
LEAST = 0.93


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows ** 2).sum(axis=1))[:, None]


def principal(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, its leading principal dimensions (columns), from the sums of all unit vectors' products.
    The driver gets one matrix per length of vectors."""
    def run(batches):
        sums = {}
        for batch in batches:
            for size in set(batch.column("dims").to_pylist()):
                rows = unit(matrix(batch.filter(pa.array([d == size for d in batch.column("dims").to_pylist()])).column("embedding")))
                rows = np.column_stack([np.ones(len(rows)), rows])
                sums[size] = sums.get(size, 0) + rows.T @ rows
        for size, total in sums.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size)), pa.array(i), pa.array(j), pa.array(total.reshape(-1))],
                                             names=["dims", "i", "j", "total"])

    sums = classes.select("dims", "embedding").mapInArrow(run, "dims long, i long, j long, total double")
    found = {}
    for r in sums.groupBy("dims", "i", "j").agg(F.sum("total").alias("total")).collect():
        found.setdefault(r["dims"], np.zeros((r["dims"] + 1,) * 2))[r["i"], r["j"]] = r["total"]
    axes = {}
    for size, s in found.items():
        mean = s[0, 1:] / s[0, 0]
        spread = s[1:, 1:] / s[0, 0] - np.outer(mean, mean)
        axes[size] = np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1][:, :LEADING]
    return axes


def blocks_of(classes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Blocks of the sequence: label, dims, block, low and high (the box), and the rows packed."""
    def place(batches):
        for batch in batches:
            sizes = np.array(batch.column("dims").to_pylist())
            cells = np.empty(len(sizes), object)
            for size in set(sizes.tolist()):
                own = np.flatnonzero(sizes == size)
                found = np.floor(unit(matrix(batch.column("embedding").take(pa.array(own)))) @ axes[size] / eps).astype(int)
                for i, row in zip(own, found.tolist(), strict=True):
                    cells[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "cells"])

    def pack(batches):
        from pyspark import TaskContext

        part, number, held, key = TaskContext.get().partitionId(), 0, [], None

        def block():
            nonlocal number
            number += 1
            rows = np.stack([r[3] for r in held])
            spots = unit(rows) @ axes[key[1]]
            return {"label": key[0], "dims": key[1], "block": part * (1 << 32) + number,
                    "low": spots.min(axis=0).tolist(), "high": spots.max(axis=0).tolist(),
                    "ids": np.array([r[:3] for r in held], np.int64).tobytes(), "times": np.array([r[4] for r in held], np.int64).tobytes(),
                    "vectors": rows.tobytes()}

        for batch in batches:
            for label, size, rep, h1, h2, times, vector in zip(*(batch.column(c).to_pylist() for c in (
                    "label", "dims", "rep", "h1", "h2", "times", "embedding")), strict=True):
                if held and (key != (label, size) or len(held) == BLOCK):
                    yield pa.RecordBatch.from_pylist([block()], shape)
                    held = []
                key = label, size
                held.append((rep, h1, h2, np.array(vector, np.float64), times))
        if held:
            yield pa.RecordBatch.from_pylist([block()], shape)

    shape = pa.schema([("label", pa.string()), ("dims", pa.int64()), ("block", pa.int64()), ("low", pa.list_(pa.float64())),
                       ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("times", pa.binary()), ("vectors", pa.binary())])
    rows = classes.select(F.col("label").cast("string").alias("label"), "dims", "rep", "h1", "h2", "times", "embedding")
    kinds = "label string, dims long, rep long, h1 long, h2 long, times long, embedding array<double>"
    order = ["label", "dims", "cells", "rep", "h1"]
    sequence = rows.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(
        place, kinds + ", cells array<int>").repartitionByRange(*order).sortWithinPartitions(*order)
    return sequence.mapInArrow(pack, "label string, dims long, block long, low array<double>, high array<double>, "
                                     "ids binary, times binary, vectors binary")


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b, of blocks of one label whose boxes are within eps of each other. Blocks meet in the cells of the first
    dimension, of which a block covers a few and one more on either side."""
    box = blocks.select("label", "dims", "block", "low", "high")
    first, last = F.floor(F.col("low")[0] / eps), F.floor(F.col("high")[0] / eps)
    a = box.select("label", "dims", F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                   F.explode(F.sequence(first - 1, last + 1)).alias("cell"))
    b = box.select("label", "dims", F.col("block").alias("b"), "low", "high", F.explode(F.sequence(first, last)).alias("cell"))
    gap = F.aggregate(
        F.transform(F.arrays_zip("low_a", "high_a", "low", "high"), lambda d: F.pow(F.greatest(
            d["low"] - d["high_a"], d["low_a"] - d["high"], F.lit(0.0)), 2)), F.lit(0.0), lambda s, x: s + x)
    return (a.join(b, ["label", "dims", "cell"]).where((F.col("a") <= F.col("b")) & (gap <= eps * eps + 1e-9))
            .select("a", "b").distinct())


class Side:
    def __init__(self, ids, times, vectors, dims, axes):
        self.ids = np.frombuffer(ids, np.int64).reshape(-1, 3)
        self.times = np.frombuffer(times, np.int64)
        self.rows = np.frombuffer(vectors, np.float64).reshape(-1, dims)
        self.units = unit(self.rows)
        self.spots = self.units @ axes[dims]


def join_blocks(x: Side, y: Side, same: bool, least: float):
    """(i, j) of all links between two blocks, each link once if they are the same block."""
    eps2 = 2 - 2 * least + 1e-9
    found = []

    def boxes_far(i, j, m, n):
        a, b = x.spots[i:j], y.spots[m:n]
        gap = np.maximum(np.maximum(b.min(axis=0) - a.max(axis=0), a.min(axis=0) - b.max(axis=0)), 0)
        return (gap ** 2).sum() > eps2

    def meet(i, j, m, n):
        if i == j or m == n or boxes_far(i, j, m, n):
            return
        if j - i <= LEAF and n - m <= LEAF:
            cosine = x.units[i:j] @ y.units[m:n].T
            a, b = np.nonzero(cosine >= least - 1e-9)
            if same:
                a, b = a[a + i < b + m], b[a + i < b + m]
            if len(a):
                near = np.flatnonzero(np.abs(cosine[a, b] - least) < 1e-9)
                fine = np.ones(len(a), bool)
                for k in near:  # so close to the bound that the order of additions matters
                    p, q = x.rows[i + a[k]], y.rows[m + b[k]]
                    length = np.sqrt(inner_products(p[None], p)[0]) * np.sqrt(inner_products(q[None], q)[0])
                    fine[k] = inner_products(p[None], q)[0] / length >= least
                found.append((a[fine] + i, b[fine] + m))
        elif same and i == m and j == n:
            h = (i + j) // 2
            meet(i, h, i, h)
            meet(i, h, h, j)
            meet(h, j, h, j)
        elif j - i >= n - m:
            h = (i + j) // 2
            meet(i, h, m, n)
            meet(h, j, m, n)
        else:
            h = (m + n) // 2
            meet(i, j, m, h)
            meet(i, j, h, n)

    meet(0, len(x.rows), 0, len(y.rows))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    eps = float(np.sqrt(2 - 2 * least))
    counts = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumns({
        "h1": F.when(counts, F.xxhash64(F.lit(1), "label", "embedding")),
        "h2": F.when(counts, F.xxhash64(F.lit(2), "embedding", "label"))})
    classes = written(rows.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding")).withColumn("dims", F.size("embedding").cast("long")), "ego-classes")
    axes = principal(classes)
    blocks = written(blocks_of(classes, axes, eps), "ego-blocks")
    pairs = block_pairs(blocks, eps)
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(
        blocks.select("block", "dims", "ids", "times", "vectors"), "block")

    def run(group: pa.Table) -> pa.Table:
        # one or two blocks; equal ids stand for the same class on both sides
        both = [Side(*(group.column(c)[i].as_py() for c in ("ids", "times", "vectors", "dims")), axes) for i in range(group.num_rows)]
        x, y = both[0], both[-1]
        i, j = join_blocks(x, y, len(both) == 1, least)
        shift = 0 if len(both) == 1 else len(x.rows)
        ids = x.ids if len(both) == 1 else np.concatenate([x.ids, y.ids])
        links = np.bincount(i, y.times[j], len(ids)) + np.bincount(j + shift, x.times[i], len(ids))
        order = np.argsort(ids[:, 0], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        root = ids[order[local_roots(len(ids), rank[i], rank[j + shift])[rank]], 0]
        own = np.flatnonzero(links > 0)
        return pa.table({"rep": ids[own, 0], "h1": ids[own, 1], "h2": ids[own, 2], "links": links[own].astype(np.int64), "root": root[own]})

    linked = written(sides.groupBy("a", "b").applyInArrow(run, "rep long, h1 long, h2 long, links long, root long"), "ego-links")
    named = components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    degree = linked.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    result = written(classes.select("h1", "h2", "rep", "times").join(degree, ["h1", "h2"], "left")
                     .join(named.withColumnRenamed("node", "rep"), "rep", "left")
                     .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"),
                             F.coalesce("component", "rep").alias("component")), "ego-result")
    return rows.select("vec_id", "h1", "h2").join(result, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce("component", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))


SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null
    and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, p.b from r join p on r.b = p.a)
select e.vec_id, (select count(*) from p where p.a = e.vec_id) as n_links, min(r.b) as component_id, min(r.b) = e.vec_id as kept
from embeddings e join r on r.a = e.vec_id group by e.vec_id
"""
