import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import bagminhash, recompression
from tests.llm.helpers import Groups, documents, rows_of, twins, words


def sentence(rng, n, letters="abcdefghijklmnopqrstuvwxyz"):
    return ["".join(rng.choices(letters, k=rng.randrange(1, 4))) for _ in range(n)]


def bag(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    common = sum((a & b).values())
    whole = sum(a.values()) + sum(b.values()) - common
    return common / whole if whole else 0.0


@pytest.mark.parametrize("times", [1, 2, 7])
def test_signatures_are_unbiased(times):
    rng = random.Random(times)
    agree, wanted = [], []
    for _ in range(12):
        a = sentence(rng, 60) * times
        b = list(a)
        for i in rng.sample(range(len(b)), len(b) // 12):
            b[i] = "zz"
        b += a[:30]
        texts = [" ".join(a), " ".join(b)]
        s = bagminhash.signatures(*bagminhash.counted(*bagminhash.shingles(texts)), 2)
        agree.append((s[0] == s[1]).mean())
        wanted.append(similarity(bag(texts[0]), bag(texts[1])))
    assert abs(np.mean(agree) - np.mean(wanted)) < 4 * 0.5 / np.sqrt(12 * bagminhash.SLOTS)


def near_rows(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = sentence(rng, rng.randrange(20, 300))
        for _ in range(rng.choice([1, 2, 6])):
            text = list(base)
            for i in rng.sample(range(len(text)), rng.randrange(1 + len(text) // 30)):
                text[i] = "changed"
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n + i, "one two") for i in range(3)] + [(n + 3, "one two three"), (n + 4, None), (n + 5, ""), (n + 6, " \n ")]
    rows += [(n + 7, "x y z " * 3000), (n + 8, "x y z " * 2990), (n + 7, "x y z " * 3000)]  # repeated row, very long texts
    return rows


def test_groups_are_those_of_all_pairs(spark):
    rows = near_rows(4)
    docs = documents(spark, rows).selectExpr("*", "1 as bag_a", "2 as kept", "3 as buckets")
    groups, bags = Groups(sorted({i for i, _ in rows})), [(i, bag(t)) for i, t in rows]
    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if i != j and similarity(a, b) >= 0.8:
                groups.join(i, j)
    want = sorted((i, groups.find(i)) for i, _ in rows)
    assert rows_of(bagminhash.labelled(docs), "doc_id", "group_id") == sorted(want, key=repr)
    kept = bagminhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in rows_of(kept, "doc_id")) == sorted({g for _, g in want})
    assert sorted(r[0] for r in rows_of(bagminhash.labelled(docs).where("kept"), "doc_id")) == sorted({g for _, g in want})


def test_a_family_about_the_threshold(spark):
    """Copies with up to a quarter of their words changed: some are linked to many others, some to few, some to none."""
    rng = random.Random(8)
    base = sentence(rng, 120)
    rows = []
    for n in range(150):
        text = list(base)
        for i in rng.sample(range(120), rng.randrange(0, 9)):
            text[i] = f"changed{rng.randrange(10**6)}"
        rows.append((n, " ".join(text)))
    groups, bags = Groups(range(150)), [bag(t) for _, t in rows]
    for i in range(150):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                groups.join(i, j)
    want = [(i, groups.find(i)) for i in range(150)]
    assert 5 < len({g for _, g in want}) < 140
    assert rows_of(bagminhash.labelled(documents(spark, rows)), "doc_id", "group_id") == sorted(want, key=repr)


def test_ids_may_be_missing_and_tables_empty(spark):
    text = " ".join(map(str, range(50)))
    docs = documents(spark, [(None, text), (5, text), (None, "other words here"), (None, "other words here")])
    assert rows_of(bagminhash.labelled(docs), "doc_id", "group_id", "kept") == sorted(
        [(5, 5, True), (None, 5, False), (None, None, False), (None, None, True)], key=repr)
    assert bagminhash.labelled(docs.limit(0)).count() == 0 and bagminhash.deduplicated(docs.limit(0)).count() == 0


def plain_removal(rows, length):
    split = [words(t) for _, t in rows]
    seen = Counter(tuple(w[p:p + length]) for w in split for p in range(len(w) - length + 1))
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p:p + length])] > 1:
                gone[p:p + length] = [True] * length
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("letters", "length"), [("ab", 35), ("abc", 12), ("abcdefghijklmnopqrstuvwxyz", 35)])
def test_repeated_windows_go(spark, letters, length):
    rng = random.Random(length)
    bases = [rng.choices(letters, k=300) for _ in range(5)]
    rows = []
    for i in range(70):
        start = rng.randrange(300)
        w = rng.choice(bases)[start:start + rng.randrange(120)]
        if rng.random() < 0.3:
            w = ["q"] * rng.randrange(80) + w + ["q"] * rng.randrange(50)
        if rng.random() < 0.3 and w:
            w[rng.randrange(len(w))] = "zzz"
        rows.append((i, " ".join(w * rng.choice([0, 1, 1, 1, 2, 3]))))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "w " * 20_000), (None, "é  ñ\x0b" * 3), (104, rows[3][1]), (104, rows[3][1])]
    docs = documents(spark, rows).repartition(3).selectExpr("*", "7 as batch", "8 as file", "9 as n_words")
    want = plain_removal(rows, length)
    digest = [(*w[:3], hashlib.sha256(w[3].encode()).hexdigest()) for w in want]
    assert rows_of(recompression.digests(docs, length), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(digest, key=repr)
    left = recompression.deduplicated(docs, length)
    assert left.columns == docs.columns
    texts = [(w[0], w[3] if w[2] else t) for w, (_, t) in zip(want, rows, strict=True)]
    assert rows_of(left, "doc_id", "text") == sorted(texts, key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in left.collect())


def test_no_texts(spark):
    assert recompression.digests(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    core = rng.choices("abcd", k=60)
    found = set()
    for _ in range(40):
        text = " ".join(rng.choices("abcd", k=rng.randrange(50)) + ["X"] + core + ["X"] + rng.choices("abcd", k=rng.randrange(50)))
        b = recompression.Batch([text], 35)
        at = text.split().index("X") + 1
        own = (b.starts >= at) & (b.starts <= at + 25)
        found.add(tuple(b.names[b.segment[own]].tolist()))
    assert len(found) == 1


def test_words_of_equal_polynomial_hashes_differ(spark):
    a, b = twins()
    side = [" ".join(f"{x}{i}" for i in range(17)) for x in "lr"]
    docs = documents(spark, [(1, f"{side[0]} {a} {side[1]}"), (2, f"{side[0]} {b} {side[1]}"), (3, a), (4, b), (5, a)])
    assert rows_of(recompression.digests(docs), "doc_id", "n_removed") == [(i, 0) for i in range(1, 6)]
    assert rows_of(bagminhash.labelled(docs), "doc_id", "group_id") == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 3)]


def test_hash_collisions_do_not_remove_words():
    one = np.array([5, 5, 5, 2, 5, 9], np.uint64)
    two = np.array([1, 2, 1, 1, 3, 9], np.uint64)
    first, times = recompression.distinct(one, two)
    assert sorted(zip(one[first].tolist(), two[first].tolist(), times.tolist())) == [(2, 1, 1), (5, 1, 2), (5, 2, 1), (5, 3, 1), (9, 9, 1)]
    wanted = [np.array([5, 5, 2], np.uint64), np.array([3, 1, 7], np.uint64)]
    assert recompression.among([one, two], wanted).tolist() == [True, False, True, False, True, False]
    assert not recompression.among([one, two], [one[:0], two[:0]]).any()
