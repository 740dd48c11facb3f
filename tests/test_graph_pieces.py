"""The graph view's edges are told apart in pieces whose number follows the rows."""

from codeloom.operators import rank
from codeloom.plans import graph_view

ROWS = {
    "region": [(0, "R")], "nation": [(0, "N", 0)], "supplier": [(s, f"S{s}", 0, 1.0) for s in range(3)],
    "customer": [(c, f"C{c}", 0, 1.0, "M") for c in range(4)], "part": [(p, f"P{p}", "B", "T", 1, 1.0) for p in range(5)],
    "orders": [(o, o % 4, "O", 1.0, None, "1") for o in range(30)],
    # every pair comes three times, and some ends are null
    "lineitem": [(o if o != 7 else None, (o + k) % 5, o % 3, k, 1.0, 1.0, 0.0, 0.0, "N", "O", None) for o in range(30) for k in (0, 1) for _ in range(3)],
}


def _folder(spark, tmp_path) -> str:
    for name, rows in ROWS.items():
        spark.createDataFrame(rows, graph_view.COLUMNS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _plain() -> set:
    found = {(1, 0, 2, 0, "contains")}
    found |= {(2, 0, 3, s, "contains") for s in range(3)} | {(2, 0, 4, c, "contains") for c in range(4)}
    found |= {(4, o % 4, 6, o, "calls") for o in range(30)} | {(5, p, 5, (p * 7 + 1) % 5, "inherits") for p in range(5)}
    for o, p, s, *_ in ROWS["lineitem"]:
        found |= {(6, o, 5, p, "depends_on"), (5, p, 3, s, "imports")}
    at = lambda table, key: None if key is None else table * graph_view.STEP + key
    return {(at(a, k), at(b, r), kind) for a, k, b, r, kind in found}


def test_more_rows_make_more_pieces_and_the_same_edges(spark, tmp_path, monkeypatch):
    folder = _folder(spark, tmp_path)
    for rows in (500_000, 3):
        monkeypatch.setattr(graph_view, "PIECE_ROWS", rows)
        edges = graph_view.graph_edges(spark, folder)
        found = [tuple(r) for r in edges.collect()]
        assert len(found) == len(set(found)) and set(found) == _plain()
    # 180 rows in pieces of 3, once for each of the two kinds of edges
    assert edges.rdd.getNumPartitions() >= 120


def test_degrees_do_not_depend_on_the_pieces(spark, tmp_path, monkeypatch):
    folder = _folder(spark, tmp_path)
    ranked = []
    for rows in (500_000, 3):
        monkeypatch.setattr(graph_view, "PIECE_ROWS", rows)
        joined = rank.with_degrees(graph_view.graph_nodes(spark, folder), graph_view.graph_edges(spark, folder))
        ranked.append(sorted(tuple(r) for r in joined.select("qualified_name", "in_degree", "out_degree").collect()))
    assert ranked[0] == ranked[1] and ("nation::0", 1, 7) in ranked[0]
