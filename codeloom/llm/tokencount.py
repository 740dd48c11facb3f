"""Exact token counts of every prefix of a text, by dynamic programming over its prefixes.

The encoding of a prefix ends in exactly one token: the one that can follow the last token of what is before it. Two tokens
can follow each other if no merge crosses their boundary, and only the symbols along the right edge of the first and the left
edge of the second can take part in one. So the last token and the number of tokens of each prefix follow from shorter
prefixes, and nothing is encoded twice. A worker keeps the counts of the pieces that it has seen (at most ``MOST_KEPT``);
a text's counts are put together from those of its pieces.

``counts[k]`` is the number of tokens that the library gives for the first k characters as a text of their own; it can fall
from one prefix to the next. Questions about truncation and budgets are answered from it by column functions.

A null text counts as empty: its counts are [0]. Repeated rows and extra columns are kept as they are, also a column named
counts. A very long text is one row with one number per character. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import byte_letters
from codeloom.llm.common import by_text, fresh, widened

MOST_BYTES, MOST_KEPT = 1 << 19, 500_000
#: How byte-level vocabularies split a text (a fixed value).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACE = regex.compile(r"\s")
#: Beyond these letters the library itself splits, as it may know other letters than ``regex``.
RARE = re.compile("[^\x00-ɏ]")
#: A prefix of these that is two pieces on its own.
SHORTENED = {"'re", "'ve", "'ll"}
NEVER = 1 << 40
_kept: dict = {}


def view(values: array, kind) -> np.ndarray:
    """The array's numbers, not copied; the view must be gone before the array grows."""
    return np.frombuffer(values, kind) if len(values) else np.empty(0, kind)


class Merges:
    """Which tokens can follow each other."""

    def __init__(self, vocab: dict[str, int], merges: list):
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        raw = {name: bytes(map(byte_of.__getitem__, name)) for name in vocab}
        self.token = {raw[name]: i for name, i in vocab.items()}
        # finds the tokens that end at each byte, the longest first
        self.found = ahocorasick.Automaton()
        for t, i in self.token.items():
            self.found.add_word(t.decode("latin-1"), (len(t), i))
        self.found.make_automaton()
        self.rank, self.parts = {}, {}
        for n, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a], vocab[b]] = n
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b]))
        self._edges: dict = {}
        #: Answers of ``follows``.
        self._known: dict = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that consumes it) along the left (0) or right (1) edge of a token."""
        found = self._edges.get((token, side))
        if found is None:
            found, end = [], NEVER
            while True:
                found.append((token, end))
                if token not in self.parts:
                    break
                pair = self.parts[token]
                end, token = self.rank[pair], pair[side]
            self._edges[found[0][0], side] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether no merge crosses the boundary of the tokens a and b. Of equal merges that overlap, the left one is first."""
        free = True
        for x, x_end in self.edge(a, 1):
            for y, y_end in self.edge(b, 0):
                rank = self.rank.get((x, y), NEVER)
                if rank < x_end and rank <= y_end and rank < NEVER:
                    free = False
        if len(self._known) > 4 * MOST_KEPT:
            self._known.clear()
        self._known[a, b] = free
        return free

    def counts(self, piece: bytes) -> list[int]:
        """The number of tokens of each prefix of a piece, from one byte on."""
        last, count = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        known, follows = self._known, self.follows
        for end, (size, token) in self.found.iter(piece.decode("latin-1")):
            end += 1
            if not count[end]:
                before = last[end - size]
                if before < 0 or (known[before, token] if (before, token) in known else follows(before, token)):
                    last[end], count[end] = token, count[end - size] + 1
        return count[1:]


class PrefixCounts:
    """Token counts of all prefixes of whole texts."""

    @classmethod
    def kept(cls, path: str) -> PrefixCounts:
        """This worker's counter: one that an earlier task has filled is used again."""
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.merges = Merges(config["model"]["vocab"], config["model"]["merges"])
        specials = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self._reset()

    def _reset(self):
        self.number: dict[str, int] = {}
        #: By piece: where its counts begin in ``flat``, its characters, its tokens, and whether it is or begins with white space.
        self.flat, self.starts, self.sizes, self.totals = array("i"), array("q"), array("q"), array("q")
        self.blank, self.opens = array("b"), array("b")

    def pieces(self, text: str) -> list[str]:
        if not RARE.search(text):
            return PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _learn(self, piece: str):
        """Keep the counts of a new piece, by character."""
        raw = piece.encode()
        counts = self.merges.counts(raw)
        if len(raw) != len(piece):
            ends = np.cumsum([len(c.encode()) for c in piece]) - 1
            counts = [counts[i] for i in ends.tolist()]
        if piece in SHORTENED:
            counts[1] = self.merges.counts(raw[:1])[0] + self.merges.counts(raw[1:2])[0]
        self.number[piece] = len(self.starts)
        self.starts.append(len(self.flat))
        self.sizes.append(len(piece))
        self.totals.append(counts[-1])
        # only white space ends in white space
        self.blank.append(SPACE.match(piece[-1]) is not None)
        self.opens.append(SPACE.match(piece) is not None)
        self.flat.extend(counts)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat counts of the prefixes of 1, 2, ... characters, characters per text) of texts without special tokens."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.number) > MOST_KEPT:
            self._reset()
        for pieces in split:
            for p in pieces:
                if p not in self.number:
                    self._learn(p)
        which = np.fromiter((self.number[p] for pieces in split for p in pieces), np.int64)
        bounds = np.cumsum([0, *map(len, split)])
        starts, sizes, totals = (view(a, np.int64)[which] for a in (self.starts, self.sizes, self.totals))
        ends = np.cumsum(sizes)
        before = np.concatenate([[0], np.cumsum(totals)])
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        base = before[:-1] - before[bounds[text_of]]  # tokens of the text before each piece
        place = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)
        counts = view(self.flat, np.int32)[np.repeat(starts, sizes) + place] + np.repeat(base, sizes).astype(np.int32)
        # white space of several characters is one piece as long as nothing follows it
        open_ = np.flatnonzero(view(self.blank, bool)[which][:-1] & view(self.opens, bool)[which][1:] & (text_of[:-1] == text_of[1:]))
        for i in open_.tolist():
            text, at = split[text_of[i]], i - bounds[text_of[i]]
            run = text[at] + text[at + 1][0]
            counts[ends[i]] = base[i] + self.merges.counts(run.encode())[-1]
        return counts, np.diff(np.concatenate([[0], ends])[bounds])

    def _special(self, text: str) -> np.ndarray:
        """The same for a text that holds special tokens: until one is complete, it is text."""
        parts = self.special.split(text)
        done, found = 0, []
        for i in range(0, len(parts), 2):
            own = self._plain([parts[i]])[0]
            found.append(done + own)
            if i + 1 < len(parts):
                both = self._plain([parts[i] + parts[i + 1][:-1]])[0]
                total = done + (int(own[-1]) if len(own) else 0) + 1
                found += [done + both[len(own):], np.array([total], np.int32)]
                done = total
        return np.concatenate(found)

    def counts(self, texts: list[str | None]) -> pa.ListArray:
        """counts[0], counts[1], ... of each text."""
        odd = {i for i, t in enumerate(texts) if t and self.special is not None and self.special.search(t)}
        flat, sizes = self._plain(["" if t is None or i in odd else t for i, t in enumerate(texts)])
        rows = np.split(flat, np.cumsum(sizes)[:-1]) if odd else None
        if odd:
            rows = [self._special(texts[i]) if i in odd else r for i, r in enumerate(rows)]
            flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        ends = np.cumsum(sizes + 1)
        values = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        inner = np.ones(len(values), bool)
        inner[ends - sizes - 1] = False
        values[inner] = flat
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def prefix_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with a column counts: array<int>, the number of tokens of every prefix of the text, by its characters."""
    name = fresh(docs, "counts")

    def run(batches):
        counter = PrefixCounts.kept(path)
        for batch in batches:
            for part in by_text(batch, text, MOST_BYTES):
                counts = counter.counts(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, counts], names=[*part.schema.names, name])

    return docs.mapInArrow(run, widened(docs, f"{name} array<int>"))


def total(counts: Column) -> Column:
    """The tokens of the whole text."""
    return F.element_at(counts, -1).cast("long")


def longest(counts: Column, budget: int | Column) -> Column:
    """The characters of the longest prefix that has at most ``budget`` tokens; null if ``budget`` is negative."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(counts, lambda n, k: F.when(n <= budget, k)))


def truncated(counted: DataFrame, budget: int, text: str = "text", counts: str = "counts") -> DataFrame:
    """``counted`` with its texts cut to the longest prefixes of at most ``budget`` tokens; null texts stay null."""
    return counted.withColumn(text, F.substring(F.col(text), F.lit(1), longest(F.col(counts), budget)))


def within(counts: Column, first: Column, last: Column) -> Column:
    """By how many tokens the prefix of ``last`` characters exceeds that of ``first``."""
    return F.get(counts, last) - F.get(counts, first)
