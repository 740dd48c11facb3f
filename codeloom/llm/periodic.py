"""Periodic runs of words, by maximal pairs.

A run of period q and length L is a stretch of words whose words q apart are identical and that no neighbour extends. Its start
and the place q words on are then a maximal pair: the suffixes from both agree in exactly L - q words, and the words before
them differ. So runs are the maximal pairs whose distance is small against their agreement, and need not be extended.

The suffixes of all texts of a batch are sorted by prefix doubling, those of different texts apart, and only suffixes that
agree with another one in enough words stay. Their tree of LCP intervals is walked from the bottom up. A node holds its places
in order, and a list of them for each word before; where two children meet, the places of the smaller one look in the other
for places near enough, by the place or by the word before, whichever is less to look at. Two places of one word before make
no pair, so the inside of a long run is passed over. A run shows once for each multiple of its period; the smallest is taken.

A null text has no words. Empty and blank texts, and texts without runs, give empty lists. Repeated rows and extra columns are
kept as they are, ids are not looked at. A very long text is one row of one task; a text is never cut. Equal runs do not
occur; ties of the strongest run go to the smallest start, then period. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import WORD, by_text, fresh, widened

MOST_BYTES = 1 << 19
#: A run has at least so many words, and so many periods.
WORDS, PERIODS = 6, 4


def sorted_suffixes(ids: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lcp): the suffixes that agree with another of their text in at least ``least`` words, in order, and the number of
    words in which each agrees with the one before it (0 where that is less than ``least``). Text k has the words
    bounds[k]:bounds[k + 1]; ``ids`` are the words as numbers."""
    n = len(ids)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    stop = np.repeat(bounds[1:], np.diff(bounds))
    key = text * (int(ids.max()) + 1 if n else 1) + ids
    rank = np.zeros(n, np.int64)
    live, width, levels, chosen = np.arange(n), 1, [], np.arange(n)
    while True:
        # a group's rank is its first place in the order of all suffixes
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        old = rank[live]
        opens = np.concatenate([[True], old[1:] != old[:-1]]) if len(old) else np.zeros(0, bool)
        rank = rank.copy()
        rank[live] = old + first - np.flatnonzero(opens)[np.cumsum(opens) - 1]
        levels.append(rank)
        alone = new & np.append(new[1:], True)
        live = live[~alone]
        if width <= least:
            chosen = live
        if not len(live):
            break
        further = live + width
        key = rank[live] << 32 | np.where(further < stop[live], rank[np.minimum(further, n - 1)] + 1, 0)
        width *= 2
    places = chosen[np.argsort(rank[chosen], kind="stable")]
    a, b, lcp = places[:-1], places[1:], np.zeros(max(len(places) - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        same = (x < n) & (y < n) & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        lcp += same << k
    lcp = np.append(0, np.where(lcp >= least, lcp, 0))[:len(places)]
    # what agrees with neither neighbour is not looked at further
    kept = (lcp > 0) | (np.append(lcp[1:], 0) > 0)
    return places[kept], lcp[kept]


def maximal_pairs(places: list[int], lcp: list[int], before: dict[int, int], share: int):
    """(place, place, words of agreement) of the maximal pairs of one block of sorted suffixes whose distance is at most their
    agreement divided by ``share``. ``before`` names the word before each place."""
    found = []

    def met(one, other, common):
        """The node that two children make up; their pairs are told."""
        if len(one[0]) < len(other[0]):
            one, other = other, one
        (all_, by_word), reach = one, common // share
        for i in other[0]:
            word = before[i]
            low, high = bisect_left(all_, i - reach), bisect_right(all_, i + reach)
            if high - low <= len(by_word):
                found.extend((i, j, common) for j in all_[low:high] if before[j] != word)
            else:
                for w, own in by_word.items():
                    if w != word:
                        found.extend((i, j, common) for j in own[bisect_left(own, i - reach):bisect_right(own, i + reach)])
        if len(other[0]) < 8:
            for i in other[0]:
                insort(all_, i)
        else:
            all_ += other[0]
            all_.sort()
        for word, own in other[1].items():
            if word not in by_word:
                by_word[word] = own
            elif len(own) < 8:
                for i in own:
                    insort(by_word[word], i)
            else:
                by_word[word] += own
                by_word[word].sort()
        return one

    open_ = []  # (agreement, node) of the intervals that are not complete
    node = ([places[0]], {before[places[0]]: [places[0]]})
    for place, common in zip(places[1:], lcp[1:], strict=True):
        while open_ and open_[-1][0] > common:
            node = met(open_[-1][1], node, open_.pop()[0])
        if open_ and open_[-1][0] == common:
            node = met(open_.pop()[1], node, common)
        open_.append((common, node))
        node = ([place], {before[place]: [place]})
    while open_:
        common, other = open_.pop()
        node = met(other, node, common)
    return found


def runs_of(split: list[list[bytes]], words: int = WORDS, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, smallest period) of the runs of each text, given as its words, by start, then period."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for text in split for w in text), np.int64)
    bounds = np.cumsum([0, *map(len, split)])
    share = periods - 1
    # a run of period 1 agrees with itself in its length less one, any other in share * 2 words at least
    places, lcp = sorted_suffixes(ids, bounds, min(words - 1, 2 * share) if share else 1)
    out: list[dict] = [{} for _ in split]
    starts = np.flatnonzero(lcp == 0)
    if len(starts):
        # only blocks with two places near enough for their longest agreement
        block = np.cumsum(lcp == 0) - 1
        order = np.lexsort((places, block))
        gap = np.where(block[order][1:] == block[order][:-1], np.diff(places[order]), len(ids))
        nearest = np.full(len(starts), len(ids))
        np.minimum.at(nearest, block[1:], gap)
        able = np.flatnonzero(nearest * share <= np.maximum.reduceat(lcp, starts))
        text = np.searchsorted(bounds, places, side="right") - 1
        before = np.where(places > bounds[text], ids[np.maximum(places - 1, 0)], -1)
        ends = np.append(starts[1:], len(places))
        for k in able.tolist():
            own = slice(starts[k], ends[k])
            at, t = places[own].tolist(), int(text[starts[k]])
            for i, j, common in maximal_pairs(at, lcp[own].tolist(), dict(zip(at, before[own].tolist(), strict=True)), share):
                period = abs(i - j)
                if common + period >= words:
                    run = (min(i, j) - int(bounds[t]), common + period)
                    out[t][run] = min(period, out[t].get(run, period))
    return [sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2])) for found in out]


def kept(text: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return text
    edge = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(text, gone.tolist(), strict=True) if not g]


def strongest(runs: list[tuple[int, int, int]]):
    """The run with the most periods, exactly; None if there is none."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def split_texts(texts: list[str | None]) -> list[list[bytes]]:
    return [(t or "").encode().split() for t in texts]  # bytes are split at exactly the six signs that part words


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(docs: DataFrame, words: int = WORDS, periods: int = PERIODS) -> DataFrame:
    """``docs`` with a column runs: the runs of the text, by start, then period."""
    name = fresh(docs, "runs")

    def run(batches):
        for batch in batches:
            for part in by_text(batch, "text", MOST_BYTES):
                runs = runs_of(split_texts(part.column("text").to_pylist()), words, periods)
                listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], RUN)
                yield pa.RecordBatch.from_arrays([*part.columns, listed], names=[*part.schema.names, name])

    return docs.mapInArrow(run, widened(docs, f"{name} array<struct<start: long, length: long, period: long>>"))


def collapsed(docs: DataFrame, words: int = WORDS, periods: int = PERIODS) -> DataFrame:
    """``docs`` with each run in a text cut to its first period; texts without runs are unchanged."""
    def run(batches):
        for batch in batches:
            for part in by_text(batch, "text", MOST_BYTES):
                texts = part.column("text").to_pylist()
                split = split_texts(texts)
                done = [b" ".join(kept(w, r)).decode() if r else t for t, w, r in zip(texts, split, runs_of(split, words, periods), strict=True)]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field("text"), pa.array(done, part.schema.field("text").type))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, and digests of all runs and of the
    collapsed text."""
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]

    def run(batches):
        for batch in batches:
            for part in by_text(batch, "text", MOST_BYTES):
                split = split_texts(part.column("text").to_pylist())
                rows = []
                for words, runs in zip(split, runs_of(split), strict=True):
                    best = strongest(runs)
                    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    rows.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                                 hashlib.sha256(told).hexdigest(), hashlib.sha256(b" ".join(kept(words, runs))).hexdigest()))
                columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns],
                                                 names=["doc_id", *numbers, "runs_sha256", "collapsed_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'{n} long' for n in numbers)}, runs_sha256 string, collapsed_sha256 string")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in about one text of ten, chosen by the checksum of its id, to have known runs to find.
    Rows with a null id, and texts without words, stay as they are."""
    crc, list_, n_ = (fresh(docs, n) for n in ("crc", "words", "n"))
    g = F.floor(F.col(crc) / 10).cast("long")
    chosen = F.col(crc) % 10 == 0
    cut = docs.withColumn(crc, F.crc32(F.col("doc_id").cast("string"))).withColumn(
        list_, F.when(chosen, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})")))).withColumn(n_, F.size(list_).cast("long"))
    first = (g % F.col(n_)).cast("int")
    period = (1 + F.floor((F.col(n_) - first) / (3 + g % 8))).cast("int")
    tail: Column = F.flatten(F.array_repeat(F.slice(list_, first + 1, period), F.ceil((F.col(n_) - first) / period).cast("int")))
    whole = F.slice(F.concat(F.slice(list_, F.lit(1), first), tail), F.lit(1), F.col(n_).cast("int"))
    text = F.when(chosen & (F.col(n_) > 0), F.array_join(whole, " ")).otherwise(F.col("text"))
    return cut.withColumn("text", text).select(*docs.columns)
