import math
from collections import defaultdict

from codeloom.llm import mixing
from tests.llm.helpers import documents, rows_of, words


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Reshare the excess round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


ROWS = [(i, " ".join(["w"] * (i % 7)) if i % 11 else None, "abcd"[i % 4] if i % 9 else None) for i in range(200)] + [
    (500, "x " * 900, "b"), (501, "y", "z"), (501, "y", "z"), (None, "p q r", "a"), (502, " \t ", "a")]


def test_mix_meets_budgets_and_limits(spark):
    got = mixing.mix(documents(spark, ROWS), part_rows=10).collect()
    sizes = defaultdict(int)
    for _, text, source in ROWS:
        sizes[source] += len(words(text))
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(ROWS)
    assert {s: math.floor(t + 1e-9) for s, t in want.items()} == dict(taken)


def test_reruns_agree_whatever_the_parts(spark):
    docs = documents(spark, ROWS)
    first = rows_of(mixing.mix(docs, part_rows=7), "doc_id", "size", "taken")
    assert first == rows_of(mixing.mix(docs.repartition(5), part_rows=1000), "doc_id", "size", "taken")


def test_materialised_words_are_those_taken(spark):
    docs = documents(spark, ROWS).selectExpr("*", "1 as size", "2 as taken", "3 as mix_id", "4 as target")
    plan = mixing.mix(docs)
    mixed = mixing.materialise(docs, plan)
    assert mixed.columns == docs.columns
    counted, wanted = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        counted[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for r in plan.collect():
        wanted[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in wanted.items() if v} == dict(counted)


def test_empty_table_and_no_words(spark):
    assert mixing.mix(documents(spark, ROWS).limit(0)).count() == 0
    got = mixing.mix(documents(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
