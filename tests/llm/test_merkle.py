import hashlib
import random
import zlib

import pytest

from codeloom.llm import merkle
from tests.llm.helpers import SF, rows_of

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout):
    """(root, for each leaf the (left, right) siblings of its way)."""
    sides, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // fanout * fanout
            sides[k].append(("".join(level[run:i]), "".join(level[i + 1:run + fanout])))
            at[k] = i // fanout
        level = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], sides


def plain_manifest(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    grown = {k: plain_tree([x[2] for x in sorted(trees[k], key=lambda x: x[:3])], fanout) for k in names}
    root, upper = plain_tree([grown[k][0] for k in names], fanout) if names else (None, [])
    out = []
    for k, above in zip(names, upper):
        for (_, _, leaf, r), own in zip(sorted(trees[k], key=lambda x: x[:3]), grown[k][1]):
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = plain_leaf((*r[:3], r[3] + 1, r[4]))
            for left, right in own + above:
                node = sha(left + node + right)
            out.append((r[0], leaf, grown[k][0], root, sha("".join(a + b for a, b in own + above)), node, node == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fanout, levels", [(2, 1), (2, 3), (3, 1), (2, 12)])
def test_proofs_equal_a_plain_tree(spark, fanout, levels):
    rng = random.Random(fanout * levels)
    rows = [(rng.randrange(400), rng.choice(["a", "ß", None]), rng.choice(["en"] * 6 + ["de", "", "é", None]), rng.choice([3, None, 50]), f"text {i % 90}")
            for i in range(150)]
    rows += [(7, None, "xx", None, None), (8, "s", "yy", 1, "one"), (9, "s", "yy", 1, "two"), (10, "s", "yy", 1, "three"), (None, None, None, None, None), (None, "s", "en", 4, "")]
    rows += [(5, "s", "en", 4, "same row")] * 70  # a third of its tree under one id
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tree", "2 as nth", "3 as leaf", "4 as Row")
    got = merkle.documents_manifest(docs, fanout, levels)
    assert got.columns == COLUMNS
    want = plain_manifest(rows, fanout)
    assert rows_of(got, *COLUMNS) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(merkle.documents_manifest(docs, levels=4), *COLUMNS) == plain_manifest(rows)


def test_few_rows(spark):
    for rows in ([], [(1, "s", "en", 2, "ab")], [(7, None, None, None, "x" * 300_000), (3, "s", None, 1, "y")]):
        assert rows_of(merkle.documents_manifest(spark.createDataFrame(rows, SCHEMA)), *COLUMNS) == plain_manifest(rows)
