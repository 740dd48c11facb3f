"""Token ids of whole texts, chunk by chunk.

A chunk is what stands between white space, or a special token of the vocabulary; no token spans two chunks, so a text's ids
are those of its chunks in order. A worker keeps the ids of chunks it has seen in flat arrays under the chunks' 64-bit hashes
(at most ``MOST_KEPT`` chunks and those of one batch, then it starts afresh); only new ones are looked at as text. A chunk
that is found by its hash is compared byte by byte with the one that was kept; one that differs is kept under its text.

Special tokens stand in the raw text, before it is lower-cased; their chunks are the byte ``MARK`` and their number. A chunk
that only looks like one after lower-casing is text.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from codeloom.llm.words import U, hash_words, heads, split_words

#: Chunks whose ids one worker keeps, the slots their table begins with, and new chunks that are encoded at once.
MOST_KEPT, SLOT_BITS, AT_ONCE = 1_000_000, 21, 1 << 18
#: Beyond these letters, normal forms and lower case are left to the library.
RARE = re.compile("[^\x00-ɏ]|İ")
#: Begins the chunk of a special token; no UTF-8 text has this byte.
MARK = b"\xff"
_LATIN = [chr(i) for i in range(0x250)]
_LETTERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
#: The split pattern of the vocabulary for texts up to U+024F without white space.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_kept: dict = {}


class HashTable:
    """Open addressing in two arrays: 64-bit keys to numbers. At most half of the slots are taken."""

    def __init__(self):
        self._clear(SLOT_BITS)

    def _clear(self, bits: int):
        self.bits, self.held = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slot(self, keys):
        return (keys >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            seen = self.keys[slot]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (seen != 0)
            open_, slot = open_[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray):
        """New, distinct keys."""
        bits = self.bits
        while 2 * (self.held + len(keys)) > 1 << bits:
            bits += 1
        if bits > self.bits:
            old = self.keys != 0
            old_keys, old_values = self.keys[old], self.values[old]
            self._clear(bits)
            self._put(old_keys, old_values)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray):
        self.held += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], values[free[first]]
            left = np.ones(len(keys), bool)
            left[free[first]] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)


class ChunkIds:
    """Ids of texts; ``ids_of_chunks`` says how new chunks are encoded: chunks -> (flat ids, ids per chunk)."""

    @classmethod
    def kept(cls, path: str):
        """This worker's encoder: one that an earlier task has filled is used again."""
        if (cls, path) not in _kept:
            _kept[cls, path] = cls(path)
        return _kept[cls, path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.config = json.load(file)
        specials = [t["content"] for t in self.config["added_tokens"]]
        # a chunk is text, whatever it looks like
        self.plain = Tokenizer.from_str(json.dumps(self.config | {"added_tokens": []}))
        self.special_ids = {t["content"]: t["id"] for t in self.config["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self._reset()

    def _reset(self):
        self.table = HashTable()
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        #: The chunks themselves: sizes, first eight bytes, and where the whole ones lie in ``texts``.
        self.sizes, self.heads, self.places = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.texts = np.empty(0, np.uint8)
        self.others: dict[bytes, int] = {}

    def ids_of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def normal(self, text: str) -> bytes:
        """The text in normal form, its chunks set apart by white space."""
        if self.special is not None and "<|" in text:
            return b" ".join(MARK + b"%d" % self.special_ids[part] if k % 2 else self._plain(part).encode()
                             for k, part in enumerate(self.special.split(text)))
        return self._plain(text).encode()

    def _plain(self, text: str) -> str:
        if RARE.search(text):
            return self.library.normalizer.normalize_str(text)
        if not text.isascii():
            text = text.replace("\x85", " ").replace("\xa0", " ")
        return text.lower()

    def pieces(self, chunk: str) -> list[bytes]:
        """The bytes of the words that a chunk is split into."""
        if not RARE.search(chunk):
            return [p.encode() for p in PIECES.findall(chunk)]
        # the library's pieces come in letters that stand for their bytes, one for each byte
        raw, at, found = chunk.encode(), 0, []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk):
            found.append(raw[at:at + len(piece)])
            at += len(piece)
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, ids per text); null counts as empty."""
        data, begins, ends, bounds = split_words([self.normal(t) if t else b"" for t in texts])
        keys = hash_words(data, begins, ends)
        keys[keys == 0] = 1
        codes = self.table.find(keys)
        if (codes < 0).any():
            new, at = self._new(keys, codes)
            if len(self.lengths) + len(new) > MOST_KEPT:
                self._reset()
                codes[:] = -1
                new, at = self._new(keys, codes)
            for i in range(0, len(new), AT_ONCE):
                own = at[i:i + AT_ONCE]
                self._learn(new[i:i + AT_ONCE], [bytes(data[a:b]) for a, b in zip(begins[own].tolist(), ends[own].tolist(), strict=True)])
            missing = np.flatnonzero(codes < 0)
            codes[missing] = self.table.find(keys[missing])
        for i in self._unlike(codes, data, begins, ends - begins).tolist():
            chunk = bytes(data[begins[i]:ends[i]])
            if chunk not in self.others:
                self.others[chunk] = len(self.lengths)
                self._learn(None, [chunk])
            codes[i] = self.others[chunk]
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(total)]
        return ids, np.diff(np.concatenate([[0], ends])[bounds])

    @staticmethod
    def _new(keys, codes):
        missing = np.flatnonzero(codes < 0)
        new, first = np.unique(keys[missing], return_index=True)
        return new, missing[first]

    def _unlike(self, codes, data, begins, sizes) -> np.ndarray:
        """The places of the chunks that are not the kept ones of their codes."""
        unlike = (self.sizes[codes] != sizes) | (self.heads[codes] != heads(data, begins, sizes))
        long = np.flatnonzero((sizes > 8) & ~unlike)
        if len(long):
            own = sizes[long]
            firsts = np.cumsum(own) - own
            within = np.arange(int(own.sum())) - np.repeat(firsts, own)
            differ = data[within + np.repeat(begins[long], own)] != self.texts[within + np.repeat(self.places[codes[long]], own)]
            unlike[long] = np.logical_or.reduceat(differ, firsts)
        return np.flatnonzero(unlike)

    def _learn(self, keys: np.ndarray | None, chunks: list[bytes]):
        """Keep the ids of new chunks, in the table if they have keys."""
        special = np.array([c.startswith(MARK) for c in chunks], bool)
        order = np.concatenate([np.flatnonzero(~special), np.flatnonzero(special)])
        n = int((~special).sum())
        flat, lengths = self.ids_of_chunks([chunks[i].decode() for i in order[:n]])
        flat = np.concatenate([flat, np.array([int(chunks[i][1:]) for i in order[n:]], flat.dtype)])
        lengths = np.concatenate([lengths, np.ones(len(order) - n, np.int64)])
        first, base = len(self.lengths), len(self.flat)
        if keys is not None:
            self.table.add(keys[order], np.arange(first, first + len(order), dtype=np.int32))
        sizes = np.array([len(chunks[i]) for i in order], np.int64)
        raw = np.frombuffer(b"".join(chunks[i] for i in order), np.uint8)
        places = np.cumsum(sizes) - sizes
        self.sizes, self.heads = np.concatenate([self.sizes, sizes]), np.concatenate([self.heads, heads(raw, places, sizes)])
        self.places, self.texts = np.concatenate([self.places, len(self.texts) + places]), np.concatenate([self.texts, raw])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])


def gathered(counts: list[int], flat: np.ndarray, lengths: np.ndarray, which: np.ndarray):
    """Lists made of other lists: (flat values, lengths), the n-th being the next ``counts[n]`` of ``which`` put together."""
    starts = np.cumsum(lengths) - lengths
    own = lengths[which]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    values = flat[np.repeat(starts[which] - (ends - own), own) + np.arange(total)]
    return values, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])


class LibraryIds(ChunkIds):
    """New chunks are encoded by the tokenizers library itself."""

    def ids_of_chunks(self, chunks):
        found = self.plain.encode_batch_fast(chunks, add_special_tokens=False)
        lists = [e.ids for e in found]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int32, int(lengths.sum())), lengths
