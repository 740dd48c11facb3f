import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from codeloom.llm import periodic
from tests.llm.helpers import SF, documents, rows_of, words


def plain_runs(w, least=6, periods=4):
    """Every period, every stretch."""
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("letters", ["a", "ab", "abc"])
def test_runs_equal_all_stretches(letters):
    rng = random.Random(len(letters))
    texts = [[c.encode() for c in "".join(rng.choice(letters) * rng.choice([1, 1, 1, 5, 9]) for _ in range(rng.randrange(0, 25)))] for _ in range(250)]
    texts += [[c.encode() for c in s] for s in ("ab" * 30 + "ba" * 20, "aab" * 9 + "b" + "aab" * 9, "x" + "abcab" * 7 + "abcabc" * 4, "a" * 64, "")]
    assert periodic.runs_of(texts) == [plain_runs(t) for t in texts]
    assert periodic.runs_of(texts, 3, 2) == [plain_runs(t, 3, 2) for t in texts]


def test_long_runs_take_no_square():
    begun = time.time()
    one = [b"x"] * 60_000
    comb = [w for i in range(3000) for w in (b"%d" % i, b"the", b"same", b"five", b"words", b"again")]
    nest = ([b"a", b"b"] * 6 + [b"c"]) * 1500
    got = periodic.runs_of([one, comb, nest])
    assert got[0] == [(0, 60_000, 1)] and got[1] == [] and (0, len(nest), 13) in got[2] and len(got[2]) == 1501
    assert time.time() - begun < 60


def test_sorted_suffixes_agree_as_told():
    rng = random.Random(3)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(30)]
    ids, bounds = np.array([x for t in texts for x in t]), np.cumsum([0, *map(len, texts)])
    places, lcp = periodic.sorted_suffixes(ids, bounds, 2)
    stop = [int(bounds[np.searchsorted(bounds, p, side="right")]) for p in places]
    for k in range(1, len(places)):
        a, b = (ids[places[i]:stop[i]].tolist() for i in (k - 1, k))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (n if stop[k] == stop[k - 1] and n >= 2 else 0)


def test_documents_as_the_plain_way(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periodic.digests(periodic.planted(docs))
    assert got.columns == columns
    want = [plain_row(*r) for r in rows_of(docs, "doc_id", "text")]
    assert rows_of(got, *columns) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > len(want) // 30


def test_odd_rows(spark):
    tail = "tick " * 30
    rows = [(1, None), (2, ""), (3, " \n"), (4, tail), (4, tail), (None, tail), (None, None), (5, "a b c " * 9 + "d"), (6, "\u00a0 " * 7), (7, "w " * 5)]
    rows += [(i, tail + "end") for i in range(100, 140)]
    docs = documents(spark, rows).selectExpr("*", "1 as words", "2 as n", "3 as crc", "4 as runs")
    changed = periodic.planted(docs)
    assert changed.columns == docs.columns
    assert rows_of(periodic.digests(changed), "doc_id", "n_runs", "runs_sha256", "collapsed_sha256") == sorted(
        [(r[0], r[1], r[6], r[7]) for r in (plain_row(*r) for r in rows)], key=repr)
    found = periodic.with_runs(docs)
    assert found.columns == [*docs.columns, "runs_"] and periodic.with_runs(docs.limit(0)).count() == 0
    assert {tuple(r["runs_"][0]) for r in found.where("doc_id = 4").collect()} == {(0, 30, 1)}
    texts = dict(rows_of(periodic.collapsed(docs), "doc_id", "text"))
    assert texts[1] is None and texts[2] == "" and texts[3] == " \n" and texts[4] == "tick" and texts[5] == "a b c d" and texts[7] == "w " * 5
