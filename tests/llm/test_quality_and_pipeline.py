import math

import numpy as np

import corpus_pipeline
from codeloom.llm import weaklabel
from codeloom.session import written
from tests.llm.helpers import SF, documents, rows_of, words
from tests.llm.test_duplicates import bag, plain_removal, similarity
from tests.llm.test_tokens import library_ids


def test_held_out_accuracy(spark):
    """The labels are not used in the fit."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rated = weaklabel.scored(docs, weaklabel.fit(docs)).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = [(bool(r["quality"]), r["keep"]) for r in rated.collect()]
    assert sum(a == b for a, b in rows) >= 0.98 * len(rows)
    assert sum(a and not b for a, b in rows) <= 0.01 * len(rows)


def test_em_finds_accurate_labellers():
    good, bad = [1, 1, 1, 1, 1, 1], [2, 2, 1, 1, 1, 1]
    code = lambda votes: sum(v * 3 ** j for j, v in enumerate(votes))
    chance = weaklabel.bad_chance({code(good): 900, code(bad): 80, code([1, 1, 2, 2, 2, 1]): 60, code([0] * 6): 3})
    assert chance[code(good)] < 0.01 and chance[code(bad)] > 0.99
    assert weaklabel.bad_chance({}) == {}


def test_odd_documents(spark):
    good = "The quick brown fox jumps over the lazy dog while many other animals look on. "
    rows = [(i, good + str(i)) for i in range(30)] + [(i, "SPAM!! " * 40 + str(i)) for i in range(30, 40)]
    rows += [(50, None), (51, ""), (52, " \n"), (53, good * 5000), (None, good), (0, good + "0")]
    docs = documents(spark, rows).selectExpr("*", "1 as score", "2 as keep", "3 as votes")
    rated = weaklabel.scored(docs, weaklabel.fit(docs))
    got = {r["doc_id"]: r["keep_"] for r in rated.collect()}
    assert all(got[i] for i in range(30)) and not any(got[i] for i in range(30, 40)) and got[None]
    assert not got[50] and not got[51] and not got[52]
    assert weaklabel.accepted(docs).columns == docs.columns
    assert weaklabel.accepted(docs.limit(0)).count() == 0
    assert weaklabel.accepted(documents(spark, [(1, None)])).count() == 0


def plain_measures(text):
    """The six measures of a text, one symbol at a time."""
    raw, split = text.encode(), text.split()
    symbol = [chr(b) in "!#$%&*+<=>@[\\]^_`{|}~" for b in raw]
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
    n = max(len(split), 1)
    return [sum(symbol) / max(len(raw) - sum(chr(b) in " \t\n\x0b\x0c\r" for b in raw), 1),
            sum(a and b for a, b in zip(symbol, symbol[1:])) / n, sum(65 <= b <= 90 for b in raw) / max(letters, 1),
            sum(not any(c.isalnum() for c in w) for w in split) / n, 1 - len(set(split)) / n if split else 0,
            sum(a == b for a, b in zip(split, split[1:])) / n]


def plain_fit(texts, rounds):
    """Votes, EM over single documents and a scorer with one loop per feature, all with plain numbers."""
    spans = list(weaklabel.LABELLERS.values())
    votes = [[2 if m >= bad else 1 if m <= good else 0 for m, (bad, good) in zip(plain_measures(t), spans)] for t in texts]
    bad = [0.9 if 2 in v else 0.1 for v in votes]
    for _ in range(weaklabel.ROUNDS):
        logs = []
        for weight in ([1 - b for b in bad], bad):
            seen = [[0.5 + sum(w for w, v in zip(weight, votes) if v[j] == k) for k in range(3)] for j in range(len(spans))]
            first = math.log((sum(weight) + 1) / (len(texts) + 2))
            logs.append([first + sum(math.log(seen[j][v[j]] / sum(seen[j])) for j in range(len(spans))) for v in votes])
        bad = [1 / (1 + math.exp(max(-50, min(50, a - b)))) for a, b in zip(*logs)]
    rows = []
    for t in texts:
        raw, row = t.encode(), {}
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            h = a * 7919 + b * 104729 + c * 1299709
            h = (h ^ (h >> 15)) % weaklabel.TRIGRAMS
            row[h] = row.get(h, 0) + 10 / len(raw)
        for j, m in enumerate(plain_measures(t)):
            row[weaklabel.TRIGRAMS + j * (len(weaklabel.STEPS) + 1) + sum(m >= s for s in weaklabel.STEPS)] = 1.0
        rows.append(row)
    weight, bias, squares, bias_squares = {}, 0.0, {}, 1e-8
    for _ in range(rounds):
        error = [(1 / (1 + math.exp(-(sum(v * weight.get(f, 0.0) for f, v in r.items()) + bias))) - (1 - b)) / len(texts)
                 for r, b in zip(rows, bad)]
        slope = {f: 1e-6 * w for f, w in weight.items()}
        for r, e in zip(rows, error):
            for f, v in r.items():
                slope[f] = slope.get(f, 0.0) + v * e
        for f, s in slope.items():
            squares[f] = squares.get(f, 1e-8) + s * s
            weight[f] = weight.get(f, 0.0) - 0.3 * s / math.sqrt(squares[f])
        bias_squares += sum(error) ** 2
        bias -= 0.3 * sum(error) / math.sqrt(bias_squares)
    return votes, [1 / (1 + math.exp(-(sum(v * weight.get(f, 0.0) for f, v in r.items()) + bias))) for r in rows]


def test_votes_and_scores_equal_the_plain_way(spark):
    texts = [t for _, t in rows_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text") if t and t.split()]
    texts = sorted(set(t[:600] for t in texts))[:60] + ["WIN!! $$$ NOW!! " * 9, "aé B", "x", "## ** ##"]
    docs = documents(spark, list(enumerate(texts)) + [(7, texts[7])] * 3)  # repeated rows are learnt once
    votes, want = plain_fit(texts, weaklabel.EPOCHS)
    assert weaklabel.Measured(texts).votes().tolist() == votes
    # votes are counted over all rows, so the plain way gets the repeated ones by a fit without them
    got = {r["doc_id"]: r["score"] for r in weaklabel.scored(docs.limit(len(texts)), weaklabel.fit(documents(spark, list(enumerate(texts))))).collect()}
    assert all(abs(got[i] - w) < 1e-4 for i, w in enumerate(want))
    again = weaklabel.fit(docs)
    assert np.isfinite(again[0]).all()


def test_every_stage_against_the_plain_way(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "repeated passages", "mixture", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as size", "2 as batch")
    at = [docs]
    for name, stage in corpus_pipeline.STAGES:
        at.append(written(stage(spark, at[-1], SF), "test-stage"))
        if name != "tokens":
            assert at[-1].columns == docs.columns
    rated = weaklabel.scored(docs, weaklabel.fit(docs))
    assert rows_of(rated.where("score >= 0.5"), "doc_id", "text") == rows_of(at[1], "doc_id", "text")
    texts = [rows_of(d, "doc_id", "text") for d in at[:-1]]
    assert set(texts[1]) <= set(texts[0]) and len(texts[1]) < len(texts[0])
    bags = [(i, bag(t)) for i, t in texts[2]]
    assert all(similarity(a, b) < 0.8 for k, (_, a) in enumerate(bags) for _, b in bags[:k])
    gone = {i for i, _ in texts[1]} - {i for i, _ in texts[2]}
    first = dict(texts[1])
    assert all(any(similarity(bag(first[i]), bag(t)) >= 0.6 for j, t in texts[1] if j != i) for i in gone)
    want = [(w[0], w[3] if w[2] else t) for w, (_, t) in zip(plain_removal(texts[2], 35), texts[2], strict=True)]
    assert texts[3] == sorted(want, key=repr)
    whole = dict(texts[3])
    assert all(words(whole[i])[:len(words(t))] == words(t) for i, t in texts[4])
    assert abs(sum(len(words(t)) for _, t in texts[4]) - sum(len(words(t)) for _, t in texts[3])) <= 20
    ids = library_ids([t for _, t in texts[4]])[1]
    assert sorted((i, list(r)) for i, r in rows_of(at[-1], "doc_id", "ids")) == sorted((i, r) for (i, _), r in zip(texts[4], ids))


def test_pipeline_of_empty_and_repeated_rows(spark, tmp_path):
    for name, rows in (("empty", []), ("blank", [(1, None), (2, " ")]), ("repeated", [(3, "one good line of plain words here")] * 5)):
        folder = f"{tmp_path}/{name}"
        documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
        assert corpus_pipeline.run(spark, folder).count() <= 3
