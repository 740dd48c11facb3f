"""Nearest neighbours by inner product with collision-counting hashing.

Vectors lie in shards of about ``SHARD`` rows. A shard's index is one sorted array per random projection. A query widens a
window around its own projection in every array at once (virtual rehashing: the same arrays serve every radius), counts for
each vector the windows it is in, and verifies those that are in at least ``ENOUGH`` of the ``PROJECTIONS`` windows. It stops
one growth beyond a radius within which ``k`` verified vectors lie, so that a true neighbour is in enough windows with a
probability of at least 0.96, whatever the distances; a last window over everything ends searches in small or odd shards
exactly. Inner products become distances by one further coordinate that lifts all vectors of an index to one length.

A shard has one index for each range of lengths, longest first, so that a few long vectors do not lift all others: within an
index the longest is at most ``SPREAD`` times the shortest. Fewer than ``FEW`` vectors of a range go, with the next shorter
ones, into a part that is searched exactly. A part is left out for a query only if its longest vector cannot reach the
query's k-th product.

Every query meets every shard, in blocks: a task has one shard and at most ``QUERIES`` queries; the shards' best are merged.
Vectors that are null, empty or zero, or hold null, NaN or infinite components take no part, nor do rows without an id.
Vectors of other lengths than the query's are no candidates. Repeated rows count once; rows that share an id with the query
are its own. Ties go to the smaller id. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, QUERIES = 8192, 16384
PROJECTIONS, ENOUGH = 40, 25
#: Growth of the radius from round to round, and rounds before the window over everything.
GROWTH, ROUNDS = 1.12, 8
#: Longest to shortest vector of an index, and vectors that are searched without one.
SPREAD, FEW = 1.25, 64


def sound(vector: Column) -> Column:
    """Whether a vector can take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of equal length of an Arrow list column, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, component after component, so that equal vectors have equal products."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += rows[:, d] * query[d]
    return total


class Index:
    """The sorted projections of the vectors of one range of lengths; ``few`` vectors are all verified."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, few: bool = False):
        self.ids, self.vectors = ids, vectors
        self.rounds = 0 if few else ROUNDS
        n, dims = vectors.shape
        squares = (vectors ** 2).sum(axis=1)
        self.length = np.sqrt(squares.max())
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(self.length ** 2 - squares, 0))])
        self.lines = np.random.default_rng(dims).standard_normal((dims + 1, PROJECTIONS))
        projected = lifted @ self.lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(projected, axis=0).T.copy()
        self.some = lifted[:: max(1, n // 256)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """For each query, (places of its k nearest, their products), nearest first."""
        n = len(self.ids)
        aimed = np.column_stack([queries * (self.length / np.sqrt((queries ** 2).sum(axis=1)))[:, None], np.zeros(len(queries))])
        centre = aimed @ self.lines
        # begin just below the smallest distance to a few of the shard's vectors
        near = ((self.some ** 2).sum(axis=1) - 2 * aimed @ self.some.T).min(axis=1) + (aimed ** 2).sum(axis=1)
        radius = np.sqrt(np.maximum(near, 1e-12))[:, None] * 0.9 * GROWTH ** np.arange(self.rounds)
        low = np.empty((PROJECTIONS, *radius.shape), np.int64)
        high = np.empty_like(low)
        for i in range(PROJECTIONS):
            low[i] = np.searchsorted(self.sorted[i], centre[:, i, None] - radius, side="left")
            high[i] = np.searchsorted(self.sorted[i], centre[:, i, None] + radius, side="right")
        for q in range(len(queries)):
            counts = np.zeros(n, np.int64)
            waiting = self.ids != query_ids[q]
            places, gaps = np.empty(0, np.int64), np.empty(0)
            before = None
            for r in range(self.rounds + 1):
                if r == self.rounds:
                    fresh = np.flatnonzero(waiting)
                else:
                    a, b = low[:, q, r].tolist(), high[:, q, r].tolist()
                    if before is None:
                        parts = [self.order[i, a[i]:b[i]] for i in range(PROJECTIONS)]
                    else:
                        parts = [self.order[i, a[i]:before[0][i]] for i in range(PROJECTIONS)]
                        parts += [self.order[i, before[1][i]:b[i]] for i in range(PROJECTIONS)]
                    before = a, b
                    counts += np.bincount(np.concatenate(parts), minlength=n)
                    fresh = np.flatnonzero(waiting & (counts >= ENOUGH))
                if len(fresh):
                    waiting[fresh] = False
                    places = np.concatenate([places, fresh])
                    gaps = np.concatenate([gaps, 2 * self.length ** 2 - 2 * (self.vectors[fresh] @ aimed[q, :-1])])
                if r < self.rounds and len(gaps) >= k and np.partition(gaps, k - 1)[k - 1] <= (radius[q, r] / GROWTH) ** 2:
                    break
            if len(gaps) > k:  # the order is decided by the products below
                places = places[gaps <= np.partition(gaps, k - 1)[k - 1] * (1 + 1e-9) + 1e-12]
            product = inner_products(self.vectors[places], queries[q])
            best = np.lexsort((self.ids[places], -product))[:k]
            yield places[best], product[best]


class Shard:
    """The vectors of one shard, an index for each range of lengths."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, vectors, lengths = ids[order], vectors[order], lengths[order]
        self.parts, start = [], 0
        while start < len(ids):
            end = int(np.searchsorted(-lengths, -lengths[start] / SPREAD, side="right"))
            few = end - start < FEW
            if few:
                end = min(start + FEW, len(ids))
            self.parts.append((start, lengths[start], Index(self.ids[start:end], vectors[start:end], few)))
            start = end

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """For each query, (places of its k nearest, their products), nearest first."""
        lengths = np.sqrt((queries ** 2).sum(axis=1))
        least = np.full(len(queries), -np.inf)  # the k-th product so far
        found = [(np.empty(0, np.int64), np.empty(0)) for _ in queries]
        for start, longest, index in self.parts:
            open_ = np.flatnonzero(longest * lengths * (1 + 1e-9) >= least)
            for q, (places, products) in zip(open_.tolist(), index.search(query_ids[open_], queries[open_], k), strict=True):
                places, products = np.concatenate([found[q][0], start + places]), np.concatenate([found[q][1], products])
                best = np.lexsort((self.ids[places], -products))[:k]
                found[q] = places[best], products[best]
                if len(best) == k:
                    least[q] = found[q][1][-1]
        return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD) -> DataFrame:
    """The k nearest found of every query: query_id, rank, vec_id, score. Both tables have vec_id (long) and embedding."""
    def clean(df: DataFrame) -> DataFrame:
        return (df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
                .where(sound(F.col("embedding")) & F.col("vec_id").isNotNull()).distinct()
                .withColumn("dims", F.size("embedding")))

    base, asked = clean(vectors), clean(queries)
    shards = max(1, -(-base.count() // shard_rows))
    groups = max(1, -(-asked.count() // QUERIES))
    mark = F.xxhash64("vec_id", "embedding")
    left = (base.withColumn("shard", F.pmod(mark, F.lit(shards)))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    right = (asked.withColumn("part", F.pmod(mark, F.lit(groups)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))

    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out = {"query_id": [], "asked": [], "vec_id": [], "score": []}
        if held.num_rows and wanted.num_rows:
            index = Shard(held.column("vec_id").to_numpy(), matrix(held.column("embedding")))
            query_ids = wanted.column("vec_id").to_numpy()
            for q, (places, products) in enumerate(index.search(query_ids, matrix(wanted.column("embedding")), k)):
                out["query_id"].append(np.full(len(places), query_ids[q]))
                out["asked"].append(np.full(len(places), wanted.column("mark")[q].as_py()))
                out["vec_id"].append(index.ids[places])
                out["score"].append(products)
        kinds = {"score": np.float64}
        return pa.table({c: np.concatenate(v) if v else np.empty(0, kinds.get(c, np.int64)) for c, v in out.items()})

    keys = ["dims", "shard", "part"]
    found = left.groupBy(*keys).cogroup(right.withColumn("mark", mark).groupBy(*keys)).applyInArrow(
        run, "query_id long, asked long, vec_id long, score double")
    best = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
