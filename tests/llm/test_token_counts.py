import random

import numpy as np
import public_tokenizers
import pytest

from codeloom.llm import tokencount
from tests.llm.helpers import SF, documents, rows_of
from tests.llm.test_tokens import odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def lengths(tok, texts):
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_equals_the_library():
    counter, tok = tokencount.PrefixCounts(PATH), library()
    rng = random.Random(5)
    texts = odd_texts(150) + ["a   b \n\n c\n\nd  ", "they're we'll I've 'r 'l 're x'rest 's's", "a<|endoftext|>b", " <|endoftext|><|endoftext|>  <|endof",
                              "x'<|endoftext|>'re", "aaaaaaaaaaaaaaaaaaaaaaaa", "   ", "\t\t\n", "-" * 200, "ééé ß", ""]
    texts += ["".join(rng.choices("ab ", k=60)) for _ in range(30)] + ["".join(rng.choices("ehtrsn oi'", k=80)) for _ in range(30)]
    got = counter.counts(texts).to_pylist()
    for text, counts in zip(texts, got, strict=True):
        assert counts == lengths(tok, [text[:k] for k in range(len(text) + 1)]), text


def test_every_token_is_its_own_encoding():
    counter = tokencount.PrefixCounts(PATH)
    assert all(counter.merges.counts(t)[-1] == 1 for t in counter.merges.token)


@pytest.mark.parametrize("kept", [20, 10 ** 6])
def test_totals_of_whole_texts(spark, kept, monkeypatch):
    monkeypatch.setattr(tokencount, "MOST_KEPT", kept)
    texts = [t for _, t in rows_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")][:60]
    texts += ["w" * 20_000, "0123456789" * 3000, "word " * 40_000, "é" * 5000, " " * 5000]
    counter = tokencount.PrefixCounts(PATH)
    want = lengths(library(), [t or "" for t in texts])
    got = [r[-1] for i in range(0, len(texts), 9) for r in counter.counts(texts[i:i + 9]).to_pylist()]
    assert got == want


def test_columns_and_questions(spark):
    docs = documents(spark, [(1, "Hello world, hello tokens"), (2, None), (2, ""), (None, "it's  one"), (1, "Hello world, hello tokens")])
    docs = docs.selectExpr("*", "7 as counts", "'x' as Text2")
    counted = tokencount.prefix_counts(docs, PATH)
    assert counted.columns == [*docs.columns, "counts_"] and tokencount.prefix_counts(docs.limit(0), PATH).count() == 0
    tok = library()
    for budget in (0, 1, 3, 100):
        cut = tokencount.truncated(counted, budget, counts="counts_").select("doc_id", "text").collect()
        for (i, text), (j, whole) in zip(sorted(map(tuple, cut), key=repr), sorted(map(tuple, docs.select("doc_id", "text").collect()), key=repr)):
            assert i == j and (text is None) == (whole is None)
            fits = [k for k in range(len(whole or "") + 1) if lengths(tok, [(whole or "")[:k]])[0] <= budget]
            assert (text or "") == (whole or "")[:max(fits)]
    totals = counted.select("doc_id", tokencount.total(counted["counts_"]).alias("n"),
                            tokencount.within(counted["counts_"], np_lit(0), np_lit(0)).alias("none")).collect()
    assert sorted((r["n"], r["none"]) for r in totals) == sorted((n, 0) for n in lengths(tok, [t or "" for _, t in rows_of(docs, "doc_id", "text")]))


def np_lit(n):
    from pyspark.sql import functions as F

    return F.lit(int(np.int64(n)))
