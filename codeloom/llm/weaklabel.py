"""A quality classifier from weak labels.

Heuristic labellers vote good or bad on every document, or abstain. All documents are counted by their votes (at most
3 ** 6 kinds), and expectation-maximisation over these counts estimates how often each labeller votes how on good and on bad
documents; that gives each kind of votes the probability of being bad. A linear scorer on hashed features, byte trigrams and
the labellers' measures in steps, learns these probabilities from a bounded sample (``SAMPLE_ROWS`` distinct documents with the
smallest hashes) and then scores every document, whole texts always.

A document without words (null, empty or blank text) has nothing to keep: score 0, rejected; it takes no part in the fit.
Repeated rows get the same score; ties do not matter. With no documents to learn from, all with words are kept. Null ids and
sources are allowed, and extra columns are carried along.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import by_text, fresh, row_key, small_batches, widened
from codeloom.session import written

MOST_BYTES = 1 << 19
SAMPLE_ROWS = 4000
TRIGRAMS = 1 << 15
#: (bad from, good up to) of each labeller's measure; between them it abstains.
LABELLERS = {
    "symbols": (0.08, 0.03),     # odd symbols among the bytes that are not white space
    "runs": (0.2, 0.03),         # pairs of symbols side by side, per word
    "capitals": (0.4, 0.1),      # capitals among the letters
    "bare": (0.2, 0.05),         # words without a letter or digit
    "sameness": (0.7, 0.55),     # one less the share of distinct words
    "repeats": (0.3, 0.05),      # words equal to the one before
}
STEPS = np.array([0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.55, 0.7, 0.85])
FEATURES = TRIGRAMS + len(LABELLERS) * (len(STEPS) + 1)
ROUNDS, EPOCHS = 50, 60


def _table(chosen: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chosen)] = True
    return found


SPACE = _table(b" \t\n\x0b\x0c\r")
SYMBOL = _table(b"!#$%&*+<=>@[\\]^_`{|}~")
CAPITAL = _table(bytes(range(65, 91)))
LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


class Measured:
    """The words and measures of a batch of texts, and the places of its trigrams."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        split = [t.split() if t else [] for t in texts]
        self.words = np.fromiter(map(len, split), np.int64, len(split))
        several = np.maximum(self.words, 1)
        distinct = np.fromiter((len(set(w)) for w in split), np.int64, len(split))
        repeats = np.fromiter((sum(map(eq, w, w[1:])) for w in split), np.int64, len(split))
        bare = np.fromiter((sum(1 for x in w if not x[0].isalnum() and not any(map(str.isalnum, x))) for w in split),
                           np.int64, len(split))
        symbol, letter = SYMBOL[self.bytes], LETTER[self.bytes]
        pairs = symbol.copy()
        pairs[:-1] &= symbol[1:]
        pairs[self.ends[self.sizes > 0] - 1] = False
        letters = self.total(letter)
        self.measures = np.stack([
            self.total(symbol) / np.maximum(self.sizes - self.total(SPACE[self.bytes]), 1), self.total(pairs) / several,
            self.total(CAPITAL[self.bytes]) / np.maximum(letters, 1), bare / several,
            np.where(self.words > 0, 1 - distinct / several, 0), repeats / several], axis=1)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums by text."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
        return sums[self.ends] - sums[self.starts]

    def votes(self) -> np.ndarray:
        """By text and labeller: 2 for bad, 1 for good, 0 for no vote; no labeller votes on a text without words."""
        bad, good = np.array(list(LABELLERS.values())).T
        found = np.where(self.measures >= bad, 2, np.where(self.measures <= good, 1, 0))
        return np.where(self.words[:, None] > 0, found, 0)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashed trigram that starts at each byte, and whether it is one (not across the end of a text)."""
        b = self.bytes.astype(np.int64)
        hashed = b * 7919
        hashed[:-1] += b[1:] * 104729
        hashed[:-2] += b[2:] * 1299709
        real = np.ones(len(b), bool)
        real[self.ends[self.sizes > 0] - 1] = False
        real[self.ends[self.sizes > 1] - 2] = False
        return (hashed ^ (hashed >> 15)) & (TRIGRAMS - 1), real

    def stepped(self) -> np.ndarray:
        """By text and labeller, the feature of its measure's step."""
        step = np.searchsorted(STEPS, self.measures, side="right")
        return TRIGRAMS + np.arange(len(LABELLERS)) * (len(STEPS) + 1) + step

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """The probability that a text is good."""
        hashed, real = self.trigrams()
        grams = self.total(np.where(real, weights[hashed], 0.0)) / np.maximum(self.sizes, 1)
        z = np.clip(grams * 10 + weights[self.stepped()].sum(axis=1) + bias, -50, 50)
        return np.where(self.words > 0, 1 / (1 + np.exp(-z)), 0.0)


def votes_of(docs: DataFrame) -> DataFrame:
    """A row per document with words: its ``row_key`` (a, b, c) and its votes, the labellers' digits in base 3."""
    def run(batches):
        for batch in batches:
            for part in by_text(batch, "text", MOST_BYTES):
                got = Measured(part.column("text").to_pylist())
                code = got.votes() @ (3 ** np.arange(len(LABELLERS)))
                whole = pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(code, pa.int32())], names=["a", "b", "c", "votes"])
                yield whole.filter(pa.array(got.words > 0))

    a, b, c = row_key(F.col("doc_id"), F.col("text"))
    return docs.select(a.alias("a"), b.alias("b"), c.alias("c"), "text").mapInArrow(run, "a string, b long, c int, votes int")


def bad_chance(counts: dict[int, int]) -> dict[int, float]:
    """Expectation-maximisation: for each kind of votes, the probability of being bad.

    It begins with the belief that an accusation is rarely wrong: kinds with a bad vote are bad with 0.9, others with 0.1."""
    if not counts:
        return {}
    kinds = sorted(counts)
    n = np.array([counts[k] for k in kinds], float)
    votes = np.array([[k // 3 ** j % 3 for j in range(len(LABELLERS))] for k in kinds]).reshape(-1, len(LABELLERS))
    bad = np.where((votes == 2).any(axis=1), 0.9, 0.1)
    for _ in range(ROUNDS):
        odds = np.zeros((2, len(kinds)))
        for c, weight in enumerate((n * (1 - bad), n * bad)):
            odds[c] = np.log((weight.sum() + 1) / (n.sum() + 2))
            for j in range(len(LABELLERS)):
                seen = np.bincount(votes[:, j], weight, 3) + 0.5
                odds[c] += np.log(seen / seen.sum())[votes[:, j]]
        bad = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -50, 50)))
    return dict(zip(kinds, bad.tolist(), strict=True))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's features, at most ``FEATURES``."""
    got = Measured([text])
    hashed, real = got.trigrams()
    found, times = np.unique(hashed[real], return_counts=True)
    return np.concatenate([found, got.stepped()[0]]), np.concatenate([times * 10 / max(got.sizes[0], 1), np.ones(len(LABELLERS))])


def train(texts: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer, by gradient steps of adaptive length over the features of all texts."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not texts:
        return weights, 1.0
    column, value = (np.concatenate(c) for c in zip(*texts, strict=True))
    length = np.array([len(t[0]) for t in texts])
    first = np.cumsum(length) - length
    squares, bias_squares = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = np.add.reduceat(value * weights[column], first) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good) / len(good)
        slope = np.bincount(column, value * np.repeat(error, length), FEATURES) + 1e-6 * weights
        squares += slope ** 2
        weights -= 0.3 * slope / np.sqrt(squares)
        bias_squares += error.sum() ** 2
        bias -= 0.3 * error.sum() / bias_squares ** 0.5
    return weights, float(bias)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """The scorer's weights and bias, learnt from the votes on all documents."""
    voted = written(votes_of(docs), "votes")
    counts = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}  # 3 ** 6 rows at most
    chance = bad_chance(counts)
    once = voted.groupBy("a", "b", "c").agg(F.first("votes").alias("votes"))
    sample = written(once.orderBy(F.xxhash64("a", "b", "c"), "a", "b", "c").limit(sample_rows), "sample")
    a, b, c = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(a.alias("a"), b.alias("b"), c.alias("c"), "text").join(F.broadcast(sample), ["a", "b", "c"])

    def run(batches):
        for batch in batches:
            for part in by_text(batch, "text", MOST_BYTES):
                found = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array([f[0].tolist() for f in found], pa.list_(pa.int32())),
                     pa.array([f[1].tolist() for f in found], pa.list_(pa.float32()))], names=["a", "b", "c", "votes", "places", "times"])

    seen = rows.select("a", "b", "c", "votes", "text").mapInArrow(
        run, "a string, b long, c int, votes int, places array<int>, times array<float>")
    # at most sample_rows rows of at most FEATURES numbers each, whatever the length of the texts; repeated rows once
    seen = seen.groupBy("a", "b", "c").agg(F.first(F.struct("votes", "places", "times")).alias("f")).select("a", "b", "c", "f.*")

    def learn(batches):
        table = pa.Table.from_batches(batches).sort_by([("a", "ascending"), ("b", "ascending"), ("c", "ascending")])
        good = [1 - chance[v] for v in table.column("votes").to_pylist()]
        places, times = (table.column(c).combine_chunks() for c in ("places", "times"))
        weights, bias = train([(places[i].values.to_numpy(), times[i].values.to_numpy().astype(float)) for i in range(len(good))], np.array(good))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    if not counts:
        return train([], np.empty(0))
    learnt = seen.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    return np.frombuffer(learnt["weights"]), learnt["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (the probability of being good) and keep; the names are lengthened if taken."""
    score = fresh(docs, "score")
    keep = fresh(docs, "keep")
    weights, bias = model

    def run(batches):
        for batch in batches:
            for part in by_text(batch, "text", MOST_BYTES):
                found = Measured(part.column("text").to_pylist()).scores(weights, bias)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array(found >= threshold)],
                                                 names=[*part.schema.names, score, keep])

    return docs.mapInArrow(run, widened(docs, f"{score} double, {keep} boolean"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a scorer fitted on them keeps, with its columns."""
    with small_batches(docs.sparkSession):
        model = fit(docs)
    rated = scored(docs, model)
    return rated.where(F.col(rated.columns[-1])).select(*docs.columns)
