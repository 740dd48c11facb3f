"""BPE encoding and decoding by merge rounds over batches of words.

The symbols of all new words of a batch lie in one flat array. A round looks up every pair of neighbours by binary search in
the sorted pair keys, takes each word's lowest rank, and merges its pairs of that rank from left to right; words without a
pair leave the array. Where a merged symbol could start a merge of lower rank than its own, only a word's leftmost pair is
merged in that round, so that the order of merges is always that of one pair at a time.

Null and empty texts have no ids and decode to the empty text. Repeated rows, and any extra columns, are kept as they are.
A very long text is one row; a batch is cut so that it holds about ``MOST_BYTES`` of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm.common import by_text, fresh, widened
from codeloom.llm.tokens import ChunkIds, gathered

MOST_BYTES = 2 << 20
NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others in
    order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class MergeIds(ChunkIds):
    """New chunks are encoded by merge rounds."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.config["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # the lowest rank of a merge that a symbol takes part in
        self.earliest = np.full(max(vocab.values()) + 1, NONE)
        np.minimum.at(self.earliest, left, np.arange(len(merges)))
        np.minimum.at(self.earliest, right, np.arange(len(merges)))
        self.tokens = [""] * (max([*vocab.values(), *self.special_ids.values()]) + 1)
        for token, i in (vocab | self.special_ids).items():
            self.tokens[i] = token

    def ids_of_chunks(self, chunks):
        pieces = [self.pieces(c) for c in chunks]
        words: dict[bytes, int] = {}
        which = np.array([words.setdefault(w, len(words)) for p in pieces for w in p], np.int64)
        return gathered(list(map(len, pieces)), *self.merge(list(words)), which)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, merged symbol) of pairs, by binary search."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE), self.made[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of words given as their bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)
        symbols[ends[sizes > 0] - 1] = self.last[raw[ends[sizes > 0] - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        # rank and product of each symbol with the next one of its word
        rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner], made[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            begins = np.concatenate([[True], owner[1:] != owner[:-1]])
            word = np.cumsum(begins) - 1
            lowest = np.minimum.reduceat(rank, np.flatnonzero(begins))[word]
            live = lowest < NONE
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
            place = np.flatnonzero(live & (rank == lowest))
            if len(place):
                # of overlapping pairs (a symbol repeated), every other one from the left
                start = np.concatenate([[True], place[1:] != place[:-1] + 1])
                run = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
                taken = (np.arange(len(place)) - run) % 2 == 0
                # a symbol that can merge earlier than its own rank goes on before the word's next pair
                early = self.earliest[made[place]] < rank[place]
                leftmost = np.concatenate([[True], word[place][1:] != word[place][:-1]])
                place = place[taken & (leftmost | ~early)]
                symbols[place] = made[place]
                live[place + 1] = False
            new = np.zeros(len(symbols), bool)
            new[place] = True
            symbols, owner, rank, made, new = symbols[live], owner[live], rank[live], made[live], new[live]
            # only pairs with a new symbol are looked up again
            changed = new.copy()
            changed[:-1] |= new[1:]
            changed = np.flatnonzero(changed)
            rank[changed] = NONE
            changed = changed[changed < len(owner) - 1]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed], made[changed] = self._ranks(symbols[changed], symbols[changed + 1])
        if not done_symbols:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return flat[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ids: array<int>."""
    name = fresh(docs, "ids")
    schema = widened(docs, f"{name} array<int>")

    def run(batches):
        bpe = MergeIds.kept(path)
        for batch in batches:
            for part in by_text(batch, text, MOST_BYTES):
                ids, lengths = bpe.encode(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, listed(ids, lengths)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column decoded: the text of the ids; null ids give the empty text."""
    name = fresh(encoded, "decoded")
    schema = widened(encoded, f"{name} string")

    def run(batches):
        bpe = MergeIds.kept(path)
        for batch in batches:
            texts = [bpe.decode(np.array(row or [], np.int64)) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of an encoding and the decoding of its ids, in one pass: the ids of a
    long corpus need not leave the task that made them to be decoded and hashed. ``with_ids`` adds them as a column ids."""
    def run(batches):
        bpe = MergeIds.kept(path)
        numbers = [str(i) for i in range(len(bpe.tokens))]
        for batch in batches:
            for part in by_text(batch, "text", MOST_BYTES):
                ids, lengths = bpe.encode(part.column("text").to_pylist())
                ends = np.cumsum(lengths)
                hashes, decoded = [], []
                for start, end in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
                    own = ids[start:end]
                    hashes.append(hashlib.sha256(" ".join(map(numbers.__getitem__, own.tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
                columns = [part.column("doc_id"), pa.array(lengths), pa.array(hashes), pa.array(decoded)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(listed(ids, lengths))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def listed(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
