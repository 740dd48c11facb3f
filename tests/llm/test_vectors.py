import numpy as np

from codeloom.llm import ann, egojoin
from codeloom.llm.components import components
from tests.llm.helpers import Groups

VECTORS = "vec_id long, embedding array<float>, label int, score int, rank int"
ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 8, 1), (9004, [float("nan")] + [1.0] * 7, 1), (9005, [float("inf")] + [1.0] * 7, 1),
       (9006, [None] + [1.0] * 7, 1), (9007, [1.0, 2.0], 1), (None, [1.0] * 8, 1)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], VECTORS)


def random_rows(n, seed, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    x = (centres[rng.integers(0, 12, n)] + 0.25 * rng.standard_normal((n, dims))).astype(np.float32)
    return [(i, x[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_nearest_neighbours_are_found(spark):
    rows = random_rows(900, 1, 24)
    rows += [(2000 + i, rows[0][1], 1) for i in range(30)]  # ties
    df = table(spark, rows)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=20, shard_rows=200).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = np.add.accumulate(x * x[ids == q][0], axis=1)[:, -1]  # one after the other; sum() would correct the rounding
        score[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -score))[:20]].tolist()
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r["score"] == score[ids == r["vec_id"]][0] for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits, total = hits + len({r["vec_id"] for r in mine} & set(want)), total + 20
    assert hits >= 0.9 * total


def recall(spark, x, k=20):
    df = table(spark, [(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))])
    x = x.astype(np.float32).astype(float)
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=k).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:k].tolist()))
    return hits / len(found) / k


def test_neighbours_of_uneven_lengths_are_found(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 32))
    x = centres[rng.integers(0, 12, 3000)] + 0.25 * rng.standard_normal((3000, 32))
    x /= np.sqrt((x ** 2).sum(axis=1))[:, None]
    outlier = x.copy()
    outlier[0] *= 10
    assert recall(spark, outlier) >= 0.95
    assert recall(spark, x * np.exp(rng.standard_normal(3000))[:, None]) >= 0.95
    assert recall(spark, rng.standard_normal((3000, 32))) >= 0.95  # no vector is much nearer than the next


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0] * 8, 1), (20, [2.0] * 8, 1), (21, [-1.0] * 8, None), (21, [-1.0] * 8, None), (40, [3.0, 4.0], 2)]
    df = table(spark, ODD + rows)
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (0, 1, 20, 16.0), (0, 2, 21, -8.0), (20, 1, 0, 16.0), (20, 2, 21, -16.0), (40, 1, 9007, 11.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def plain_groups(rows, least):
    fine = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and c is not None and v and None not in v
            and np.isfinite(v).all() and any(v)]
    groups, links = Groups(sorted({r[0] for r in rows if r[0] is not None})), {}
    for a, (i, v, c) in enumerate(fine):
        for j, w, d in fine[:a]:
            if c == d and len(v) == len(w) and i != j and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                groups.join(i, j)
    return {i: (links.get(i, 0), groups.find(i), groups.find(i) == i) for i in groups.up}


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "BLOCK", 40)
    monkeypatch.setattr(egojoin, "LEAF", 16)
    rows = random_rows(260, 2) + ODD + [(3000, [1.0] * 8, None)]
    rows += [(4000 + i, rows[7][1], rows[7][2]) for i in range(50)] + [(5000, [2 * x for x in rows[7][1]], rows[7][2])]
    got = egojoin.near_duplicates(table(spark, rows), 0.93).collect()
    assert {r["vec_id"]: tuple(r)[1:] for r in got if r["vec_id"] is not None} == plain_groups(rows, 0.93)
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)] and len(got) == len(rows)
    assert egojoin.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_components_of_long_and_wide_graphs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 300)] + [(7, 7), (1000, 999), (999, 1000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(101)} | {200 + i: 200 for i in range(300)} | {999: 999, 1000: 999}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
