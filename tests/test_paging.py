import json

import pytest
from pyspark.sql import functions as F

from codeloom.api import respond
from codeloom.functions.text import compact_text
from codeloom.operators import paging


def test_pages_follow_each_other(spark):
    df = spark.range(5)
    mark = paging.call_mark("t", a=1)
    one, cursor = paging.page(df, ["id"], None, 2, mark)
    two, cursor2 = paging.page(df, ["id"], cursor, 2, mark)
    three, end = paging.page(df, ["id"], cursor2, 2, mark)
    assert [[r[0] for r in p.collect()] for p in (one, two, three)] == [[0, 1], [2, 3], [4]] and end is None
    rest, end = paging.page(df, ["id"], cursor, None, mark)
    assert [r[0] for r in rest.collect()] == [2, 3, 4] and end is None


def test_keys_with_nulls_and_both_directions(spark):
    rows = [(s, n, i) for i, (s, n) in enumerate([(a, b) for a in (None, 0.5, 0.1) for b in (None, "x", "y")])]
    df = spark.createDataFrame(rows, "score DOUBLE, name STRING, id INT")
    order, cursor, seen = ["-score", "name", "id"], None, []
    while True:
        page, cursor = paging.page(df, order, cursor, 2, "0" * 16)
        seen += [tuple(r) for r in page.collect()]
        if cursor is None:
            break
    assert seen == sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2]))


@pytest.mark.parametrize("cursor", ["", "junk", paging.write_cursor("f" * 16, [1]), "0" * 16 + "!!", paging.write_cursor("0" * 16, [1, 2])])
def test_bad_cursors(cursor):
    with pytest.raises(paging.InvalidCursor):
        paging.read_cursor(cursor, "0" * 16, 1)


def test_budget():
    result = {"items": [{"text": "x" * 200} for _ in range(10)], "few": [1]}
    out = paging.fit(result, 180)
    assert paging.estimate_tokens(out) <= 180 and out["truncated_items"] == 10 - len(out["items"]) and out["few"] == [1]
    assert len(out["items"]) == 2  # a third would not fit
    assert out["budget_remaining"] == 180 - out["budget_used"] and len(result["items"]) == 10
    assert out["actual_chars"] == len(paging.as_text(out)) and json.loads(paging.as_text(out)) == out
    assert paging.fit({"a": []}, 1)["truncated_items"] == 0
    assert paging.fit({"a": list(range(50)), "n": 3}, 1) | {} == paging.fit({"a": list(range(50)), "n": 3}, 1)


def test_rows_that_are_not_fetched_are_counted(spark):
    out = respond({"rows": spark.range(100_000).orderBy("id")}, token_budget=50)
    assert out["truncated_items"] == 100_000 - len(out["rows"]) and len(out["rows"]) > 0
    assert [r["id"] for r in out["rows"]] == list(range(len(out["rows"])))


def test_budget_cuts_lists_inside_others():
    result = {"groups": [{"path": p, "items": [{"id": i} for i in range(n)]} for p, n in (("a", 200), ("b", 3))], "tree": {"kept": [1, 2], "deep": {"x": ["y" * 9] * 90}}}
    out = paging.fit(result, 120)
    assert paging.estimate_tokens(out) <= 120 and json.loads(paging.as_text(out)) == out
    kept = [len(g["items"]) for g in out["groups"]] + [len(out["tree"]["deep"]["x"])]
    assert out["truncated_items"] == 200 + 3 + 90 - sum(kept) and kept[0] == kept[2] > 3 == kept[1] and out["tree"]["kept"] == [1, 2]
    more = paging.fit(result, 10_000)
    assert more["truncated_items"] == 0 and more["groups"] == result["groups"]


def test_budget_prefix_is_exact(spark):
    df = spark.createDataFrame([(i, 10) for i in range(20)], "id INT, n INT").repartition(5)
    assert [r["id"] for r in paging.budget_prefix(df, ["id"], F.col("n"), 45).orderBy("id").collect()] == [0, 1, 2, 3]
    small = spark.createDataFrame([(1, 0), (2, 0), (3, 5), (4, 1)], "id INT, n INT")
    assert [(r["id"], r["used"]) for r in paging.budget_prefix(small, ["id"], F.col("n"), 5).orderBy("id").collect()] == [
        (1, 0), (2, 0), (3, 5)]
    assert paging.budget_prefix(small.limit(0), ["id"], F.col("n"), 5).count() == 0


def test_compact_text(spark):
    df = spark.createDataFrame([("  a\n\tb  " + "c" * 200,), ("x",)], "a STRING")
    assert [r[0] for r in df.select(compact_text(F.col("a"))).collect()] == ["a b " + "c" * 155 + "…", "x"]
