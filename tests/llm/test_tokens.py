import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from codeloom.llm import bpe, rans
from codeloom.llm.common import file_system
from codeloom.llm.queries import vocabulary
from codeloom.llm.tokens import LibraryIds
from tests.llm.helpers import documents, twins

LETTERS = "aAbBzZ'sStT012 \t\n\x0b\x1c\x85\xa0ñÑéßİıŁǅſΣσςКиё中文🙂👍🏽́̀e​　 .,!?<|>-_#½²ªºǅﬁ가ᄀ\x00"


def odd_texts(n):
    random.seed(n)
    more = ["<|endoftext|>", "<|startoftext|>", "a" * 40, "abababab", "!!!!!!", "don't we're"]
    return ["".join(random.choices(LETTERS, k=random.randrange(30))) + random.choice(["", *more]) for _ in range(n)]


def library_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    return library, [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("kind", [bpe.MergeIds, LibraryIds])
def test_ids_equal_the_library(kind):
    texts = odd_texts(3000)
    library, want = library_ids(texts)
    encoder = kind(vocabulary())
    for part in (slice(0, 1000), slice(900, 3000)):  # some chunks are known by then
        ids, lengths = encoder.encode(texts[part])
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths))[:-1]] == want[part]
    if kind is bpe.MergeIds:
        assert all(encoder.decode(np.array(w)) == library.decode(w, skip_special_tokens=False) for w in want)


@pytest.mark.parametrize("kind", [bpe.MergeIds, LibraryIds])
def test_special_tokens_in_other_case_are_text(kind):
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "<|EndOfText|>", "x<|StartOfText|>y <|startoftext|>", "<|ENDOFTEXT|>" * 2,
             "<|endoftext|><|ENDOFTEXT|>", "É <|endofTEXT|> é", "\u4e2d <|ENDOFTEXT|>", "\u212a<|endoftext|>\u212a"]
    want = library_ids(texts)[1]
    assert want[0] == [320, 27, 347, 40786, 4160, 91, 285, 321]
    for order in (1, -1):  # whichever form is seen first
        encoder = kind(vocabulary())
        assert [encoder.encode([t])[0].tolist() for t in texts[::order]] == want[::order]
        ids, lengths = kind(vocabulary()).encode(texts[::order])
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths))[:-1]] == want[::order]


@pytest.mark.parametrize("kind", [bpe.MergeIds, LibraryIds])
def test_chunks_of_one_hash_stay_apart(kind, monkeypatch):
    texts = [" ".join(twins()), twins()[1], "word other", *odd_texts(40)]
    want = library_ids(texts)[1]
    ids, lengths = kind(vocabulary()).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths))[:-1]] == want
    # every word under one of five hashes
    monkeypatch.setattr("codeloom.llm.tokens.hash_words", lambda data, begins, ends: np.uint64(1) + (ends - begins).astype(np.uint64) % np.uint64(5))
    encoder = kind(vocabulary())
    for _ in range(2):
        ids, lengths = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths))[:-1]] == want


def test_a_full_table_starts_afresh(monkeypatch):
    monkeypatch.setattr("codeloom.llm.tokens.MOST_KEPT", 50)
    texts = odd_texts(200)
    encoder = bpe.MergeIds(vocabulary())
    got = [encoder.encode(texts[i:i + 5])[0].tolist() for i in range(0, 200, 5)]
    assert [i for g in got for i in g] == [i for w in library_ids(texts)[1] for i in w]


@pytest.mark.parametrize("kind", [bpe.MergeIds, LibraryIds])
def test_more_chunks_than_the_table_has_slots(kind, monkeypatch):
    monkeypatch.setattr("codeloom.llm.tokens.SLOT_BITS", 6)
    monkeypatch.setattr("codeloom.llm.tokens.MOST_KEPT", 50)
    monkeypatch.setattr("codeloom.llm.tokens.AT_ONCE", 70, raising=False)
    text = " ".join(f"{i * i:x} <|endoftext|>" for i in range(500))
    encoder = kind(vocabulary())
    for t in ("a few", text, "a few more", text):
        assert encoder.encode([t])[0].tolist() == library_ids([t])[1][0]


def test_encode_and_decode_columns(spark):
    texts = [None, "", "Hello, World", "x" * 70_000, "<|endoftext|>", "same", "same"]
    docs = documents(spark, list(enumerate(texts))).selectExpr("*", "'taken' as ids", "0 as decoded")
    got = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary(), "ids_").orderBy("doc_id").collect()
    library, want = library_ids(texts)
    assert [r["ids_"] for r in got] == want and [r["ids"] for r in got] == ["taken"] * 7
    assert [r["decoded_"] for r in got] == [library.decode(w, skip_special_tokens=False) for w in want]
    assert bpe.digests(docs.limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("n", [1, 31, 32, 33, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK + 1, 3 * rans.BLOCK + 77])
def test_group_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 1 << 17)
    assert (rans.decode_group(rans.encode_group(ids)) == ids).all()
    assert (rans.decode_group(rans.encode_group(np.full(n, 7))) == 7).all()


def test_damage_is_noticed():
    raw = bytearray(rans.encode_group(np.random.default_rng(0).integers(0, 1000, 5000)))
    raw[-100] ^= 1
    with pytest.raises(ValueError):
        rans.decode_group(bytes(raw))


def test_token_files(spark, monkeypatch):
    import zlib

    monkeypatch.setattr(rans, "GROUP", 1000)  # documents across groups
    texts = odd_texts(300) + [None, "", "long text " * 3000]
    rows = [(i * 7 % 1000 - 500, t) for i, t in enumerate(texts)]
    files = rans.write(documents(spark, rows + [(None, "no id")]).repartition(3), vocabulary())
    got = rans.read(files).collect()
    assert len(got) == len(rows) + 1
    start = len(library_ids(["no id"])[1][0]) + 1  # the one without id comes first
    for doc_id, text in sorted(rows):
        ids = library_ids([text])[1][0] + [1]
        row = next(r for r in got if r["doc_id"] == doc_id)
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rans.read(rans.write(documents(spark, rows).limit(0), vocabulary())).count() == 0
    file = files.first()["file"]
    system, path = file_system(file)
    raw = bytearray(system.open_input_file(path).read())
    raw[len(raw) // 3] ^= 255
    with system.open_output_stream(path, compression=None) as out:
        out.write(bytes(raw))
    with pytest.raises(PySparkException):
        rans.read(files).collect()
