"""Removal of repeated word sequences by recompression.

A text's words are names; a round replaces each run of equal names, and then each pair of a left and a right name (a bit of
the name's hash says which it is), by a name of its own: a hash of the round and the parts, so that all tasks of the corpus
give equal sequences equal names without asking each other. A symbol also knows its context, the words that decide how it was
formed. A window of ``length`` words decides all symbols whose context it contains, so equal windows hold the same such symbols,
and each window takes one of them as its anchor: of the highest level it has, the one of most words, and of those the
one with the smallest hash.

So a window can be repeated only if its anchor's name is shared. Spark counts the names of anchors (combined by batch before
they are shuffled) and sends the shared ones back to the batches of documents that have them. Neighbouring windows of one
anchor form a segment; segments of equal name and equal windows verify each other at once, which settles the inside of long
repeats. Where a name has several kinds of segments, each kind's windows are counted one by one, once per kind. Segments and
windows are compared by two 64-bit hashes that share nothing, from the words' bytes on. Batches are files in the shared folder, listed in a table; a task
reads one at a time, and rows between tasks name the batch, never the text.

A null text has no words and stays null; empty and blank texts have no words. A word that any repeated window covers goes,
also if both occurrences are in one text, overlapping or not; windows do not cross documents, and shorter texts stay whole.
Repeated rows repeat each other. A text that loses no word is unchanged, other texts are their kept words joined by one space.
An empty table gives no rows, and extra columns are carried along.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import by_text, file_system
from codeloom.llm.words import U, hash_words, mixed, split_words, windows
from codeloom.session import scratch_path, written

LENGTH, ROUNDS = 35, 3
MOST_BYTES = 3 << 20
#: Tasks that batches are dealt to, at most; a task takes its batches one after the other.
MOST_TASKS = 50_000


class Symbols:
    """The symbols of one level: names, the words first:last they stand for, and the context low:high that decides them, all
    as places in the batch's row of words. At a text's edge the context reaches beyond it, where no window goes."""

    def __init__(self, names, first, last, low, high, doc):
        self.names, self.first, self.last, self.low, self.high, self.doc = names, first, last, low, high, doc

    @classmethod
    def of_words(cls, hashes: np.ndarray, bounds: np.ndarray):
        place = np.arange(len(hashes))
        return cls(hashes, place, place + 1, place, place + 1, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))

    def _edges(self, begin: np.ndarray, end: np.ndarray, bounds: np.ndarray):
        """For symbols made of begin[i]..end[i]: the contexts of the symbols before and behind, or beyond the text's edge."""
        n = len(self.names)
        before, behind = np.maximum(begin - 1, 0), np.minimum(end + 1, n - 1)
        low = np.where((begin > 0) & (self.doc[before] == self.doc[begin]), self.low[before], bounds[self.doc[begin]] - 1)
        high = np.where((end < n - 1) & (self.doc[behind] == self.doc[end]), self.high[behind], bounds[self.doc[end] + 1] + 1)
        return low, high

    def compressed(self, level: int, bounds: np.ndarray) -> Symbols:
        if not len(self.names):
            return self
        salt = U((level * 0x9E3779B97F4A7C15) % (1 << 64))
        # runs of equal names
        same = (self.names[1:] == self.names[:-1]) & (self.doc[1:] == self.doc[:-1])
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        end = np.append(begin[1:], len(self.names)) - 1
        names = self.names[begin]
        long = np.flatnonzero(end > begin)
        names[long] = mixed(names[long] ^ mixed((end - begin)[long].astype(np.uint64) + salt))
        runs = Symbols(names, self.first[begin], self.last[end], *self._edges(begin, end, bounds), self.doc[begin])
        # pairs of a left and a right name
        right = (mixed(runs.names + salt) & U(1)).astype(bool)
        joins = np.append(~right[:-1] & right[1:] & (runs.doc[1:] == runs.doc[:-1]), False)
        begin = np.flatnonzero(~np.concatenate([[False], joins[:-1]]))
        pair = joins[begin]
        end = begin + pair
        names = np.where(pair, mixed(runs.names[begin] * U(0xD6E8FEB86659FD93) + mixed(runs.names[end] ^ salt)), runs.names[begin])
        low, high = runs._edges(begin, end, bounds)
        # a pair decides itself; a single left name must see what is behind it, a single right name what is before it
        low = np.where(pair | ~right[begin], runs.low[begin], low)
        high = np.where(pair | right[begin], runs.high[end], high)
        return Symbols(names, runs.first[begin], runs.last[end], low, high, runs.doc[begin])


def smallest(keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place of the smallest key of each range (not empty), the leftmost if several."""
    size = end - begin
    best = np.arange(len(keys))
    out = np.empty(len(begin), np.int64)
    step = 1
    while True:
        # best[i]: the smallest of the step keys from i on
        own = np.flatnonzero((size >= step) & (size < 2 * step))
        a, b = best[begin[own]], best[end[own] - step]
        out[own] = np.where(keys[b] < keys[a], b, a)
        if not (size >= 2 * step).any():
            return out
        further = best[np.minimum(np.arange(len(keys)) + step, len(keys) - 1)]
        best = np.where(keys[further] < keys[best], further, best)
        step *= 2


class Batch:
    """The words, windows and segments of one batch of texts."""

    def __init__(self, texts: list[str | None], length: int):
        self.length = length
        self.raw = [(t or "").encode() for t in texts]
        data, begins, ends, self.bounds = split_words(self.raw)
        self.hashes = hash_words(data, begins, ends)
        n = len(self.hashes)
        doc_end = np.repeat(self.bounds[1:], np.diff(self.bounds))
        #: first words of the windows that lie in one text
        self.starts = np.flatnonzero(np.arange(n) + length <= doc_end)
        anchor = np.full(len(self.starts), -1)  # first word of the anchor
        name = np.zeros(len(self.starts), np.uint64)
        levels = [Symbols.of_words(self.hashes, self.bounds)]
        for k in range(ROUNDS):
            levels.append(levels[-1].compressed(k + 1, self.bounds))
        open_ = np.arange(len(self.starts))
        for k in range(ROUNDS, -1, -1):
            s = levels[k]
            if not len(open_):
                break
            at = self.starts[open_]
            begin = np.cumsum(np.bincount(s.low + 1, minlength=n + 2))[at]  # symbols with low < at
            end = np.cumsum(np.bincount(s.high, minlength=n + 2))[at + length]  # symbols with high <= at + length
            has = end > begin
            # long symbols first: the more words a name stands for, the less it is shared by chance
            span = np.minimum(s.last - s.first, 15).astype(np.uint64)
            got = smallest((U(15) - span) << U(60) | mixed(s.names + U(k)) >> U(4), begin[has], end[has])
            anchor[open_[has]], name[open_[has]] = s.first[got], mixed(s.names[got] ^ U((k + 1) * 0x51ED270B7A93 + 1))
            open_ = open_[~has]
        # two hashes of each window that have nothing in common, from the words' bytes on
        self.one = windows(self.hashes, length)[self.starts]
        self.two = windows(hash_words(data, begins, ends, seed=1), length, seed=1)[self.starts]
        new = np.ones(len(self.starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)
        self.segment = np.cumsum(new) - 1  # of each window
        first = np.flatnonzero(new)
        self.names = name[first]
        place = mixed((self.starts - anchor).astype(np.uint64))
        self.kinds, self.others = (np.add.reduceat(mixed(w + place), first) if len(first) else np.empty(0, np.uint64)
                                   for w in (self.one, self.two))
        #: What tells segments apart.
        self.told = [self.names, self.kinds, self.others]


def distinct(first: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, times) of the different rows of some columns, in the order of ``first``."""
    order = np.argsort(first, kind="stable")
    tie = first[order][1:] == first[order][:-1]
    for o in others:
        if (tie & (o[order][1:] != o[order][:-1])).any():  # hardly ever: one hash for different things
            order = np.lexsort((*others[::-1], first))
            break
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (first, *others)])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def among(own: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Which rows of ``own`` are rows of ``wanted``, both given as columns."""
    found = np.zeros(len(own[0]), bool)
    order = np.argsort(wanted[0], kind="stable")
    wanted = [w[order] for w in wanted]
    at = np.searchsorted(wanted[0], own[0])
    open_ = np.flatnonzero(at < len(order))
    while len(open_):
        open_ = open_[wanted[0][at[open_]] == own[0][open_]]
        found[open_] = np.logical_and.reduce([w[at[open_]] == o[open_] for o, w in zip(own, wanted, strict=True)])
        open_ = open_[~found[open_]]
        at[open_] += 1
        open_ = open_[at[open_] < len(order)]
    return found


def spilled(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as files of about ``MOST_BYTES`` of text: batch, file, rows."""
    folder = scratch_path(docs.sparkSession, "repeat-batches")
    system, local = file_system(folder)
    system.create_dir(local)

    def run(batches):
        from pyspark import TaskContext

        system, local = file_system(folder)
        part, number = TaskContext.get().partitionId(), 0
        waiting, held = [], 0

        def save():
            nonlocal number
            # a name for every attempt: the list holds those of attempts that succeed
            name = f"batch-{part:06d}-{number:06d}-{uuid.uuid4().hex}.arrow"
            with system.open_output_stream(f"{local}/{name}", compression=None) as out, pa.ipc.new_file(
                    out, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                for w in waiting:
                    file.write_batch(w)
            number += 1
            return pa.RecordBatch.from_pylist([{"batch": part * (1 << 20) + number, "file": name}])

        for batch in batches:
            for piece in by_text(batch, "text", MOST_BYTES):
                size = sum(len(t) for t in piece.column("text").cast(pa.binary()).to_pylist() if t)
                if waiting and held + size > MOST_BYTES:
                    yield save()
                    waiting, held = [], 0
                waiting.append(piece)
                held += size
        if waiting:
            yield save()

    listed = written(docs.mapInArrow(run, "batch long, file string"), "repeat-batch-list")
    return listed.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def load(file: str) -> pa.Table:
    system, local = file_system(file)
    with system.open_input_file(local) as source, pa.ipc.open_file(source) as reader:
        return reader.read_all()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def unsigned(column, field: str) -> np.ndarray:
    """One field of a list of structs, as unsigned numbers; a null list is empty."""
    values = column.values.field(field) if column.is_valid else pa.array([], pa.int64())
    return values.to_numpy(zero_copy_only=False).view(np.uint64)


def per_batch(table: DataFrame, n: int) -> DataFrame:
    """Dealt to tasks by batch, without regard to the few bytes that name a batch."""
    return table.repartition(min(max(n, 1), MOST_TASKS), "batch")


def repeats(docs: DataFrame, length: int, finish, schema: T.StructType) -> DataFrame:
    """``finish(table, batch, gone)`` makes the result rows of each batch, gone telling for each word whether it goes."""
    listing = spilled(docs)
    n = listing.count()

    def names_of(batches):
        for rows in batches:
            for number, file in zip(rows.column("batch").to_pylist(), rows.column("file").to_pylist(), strict=True):
                b = Batch(load(file).column("text").to_pylist(), length)
                first, times = distinct(*b.told)
                yield pa.RecordBatch.from_arrays(
                    [*(signed(c[first]) for c in b.told), pa.array(np.full(len(first), number)),
                     pa.array(np.minimum(times, 2).astype(np.int32))], names=["name", "kind", "other", "batch", "n"])

    # A batch has one row of a kind, whatever the kind's number of copies in it, so the rows of one name are far fewer than
    # its occurrences; one shuffle by name serves the counts of names and of kinds.
    segments = per_batch(listing, n).mapInArrow(names_of, "name long, kind long, other long, batch long, n int")
    by_name, by_kind = Window.partitionBy("name"), Window.partitionBy("name", "kind", "other")
    told = segments.select(
        "*", F.sum("n").over(by_name).alias("of_name"),
        (F.min(F.struct("kind", "other")).over(by_name) < F.max(F.struct("kind", "other")).over(by_name)).alias("several"),
        F.sum("n").over(by_kind).alias("of_kind"), F.min("batch").over(by_kind).alias("speaker")).where("of_name > 1").select(
        "batch", "name", "kind", "other", (F.col("of_kind") > 1).alias("again"), (F.col("several") & (F.col("batch") == F.col("speaker"))).alias("speaks"))
    told = written(told.where("again or speaks"), "repeat-told")

    def packed(rows: DataFrame, *fields: str) -> DataFrame:
        # at most as many as a batch has words
        return rows.groupBy("batch").agg(F.collect_list(F.struct(*fields)).alias("_".join(fields)))

    asked = listing.join(packed(told.where("speaks"), "name", "kind", "other"), "batch")

    def windows_of(batches):
        for rows in batches:
            for i, (number, file) in enumerate(zip(rows.column("batch").to_pylist(), rows.column("file").to_pylist(), strict=True)):
                b = Batch(load(file).column("text").to_pylist(), length)
                want = rows.column("name_kind_other")[i]
                speaks = among(b.told, [unsigned(want, c) for c in ("name", "kind", "other")])
                # one segment of each kind
                once = np.zeros(len(speaks), bool)
                once[distinct(*b.told)[0]] = True
                own = np.flatnonzero((speaks & once)[b.segment])
                one, two = b.one[own], b.two[own]
                first, times = distinct(one, two)
                yield pa.RecordBatch.from_arrays(
                    [signed(one[first]), signed(two[first]), pa.array(np.full(len(first), number)),
                     pa.array(np.minimum(times, 2).astype(np.int32))], names=["one", "two", "batch", "n"])

    spoken = per_batch(asked, n).mapInArrow(windows_of, "one long, two long, batch long, n int")
    common = spoken.withColumn("total", F.sum("n").over(Window.partitionBy("one", "two"))).where("total > 1")
    heard = packed(common, "one", "two")
    known = packed(told.where("again"), "name", "kind", "other")

    def result(batches):
        for rows in batches:
            for i, file in enumerate(rows.column("file").to_pylist()):
                table = load(file)
                b = Batch(table.column("text").to_pylist(), length)
                want, seen = rows.column("name_kind_other")[i], rows.column("one_two")[i]
                again = among(b.told, [unsigned(want, c) for c in ("name", "kind", "other")])[b.segment]
                rest = np.flatnonzero(~again)
                if seen.is_valid and len(rest):
                    again[rest] = among([b.one[rest], b.two[rest]], [unsigned(seen, "one"), unsigned(seen, "two")])
                edge = np.zeros(len(b.hashes) + 1, np.int64)
                np.add.at(edge, b.starts[again], 1)
                np.add.at(edge, b.starts[again] + length, -1)
                yield finish(table, b, np.cumsum(edge[:-1]) > 0)

    whole = listing.join(known, "batch", "left").join(heard, "batch", "left").select("batch", "file", "name_kind_other", "one_two")
    return per_batch(whole, n).mapInArrow(result, schema)


def removed(b: Batch, gone: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(gone)])
    return sums[b.bounds[1:]] - sums[b.bounds[:-1]]


def kept_words(b: Batch, i: int, gone: np.ndarray) -> bytes:
    """The kept words of text i, joined by one space."""
    return b" ".join(compress(b.raw[i].split(), (~gone[b.bounds[i]:b.bounds[i + 1]]).tolist()))


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    def finish(table, b, gone):
        lost = removed(b, gone)
        hashes = [hashlib.sha256(kept_words(b, i, gone) if lost[i] else b" ".join(raw.split())).hexdigest()
                  for i, raw in enumerate(b.raw)]
        return pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks(), pa.array(np.diff(b.bounds)), pa.array(lost), pa.array(hashes)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeats(rows, length, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated words taken out of their texts; ``n_chars``, if there, follows the text."""
    def finish(table, b, gone):
        lost = removed(b, gone)
        texts = table.column("text").to_pylist()
        for i in np.flatnonzero(lost):
            texts[i] = kept_words(b, i, gone).decode()
        columns = dict(zip(table.schema.names, (c.combine_chunks() for c in table.columns), strict=True))
        columns["text"] = pa.array(texts, table.schema.field("text").type)
        if "n_chars" in columns:
            sizes = [None if t is None else len(t) for t in texts]
            columns["n_chars"] = pa.array([s if lost[i] else old for i, (s, old) in enumerate(zip(
                sizes, columns["n_chars"].to_pylist(), strict=True))], table.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    return repeats(docs, length, finish, schema)


SQL = r"""
with w as materialized (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as materialized (select r, unnest(ws) as word, generate_subscripts(ws, 1) as j from w),
wide as (select r, j, list(word) over (partition by r order by j rows between current row and 34 following) as l from words),
h as materialized (select r, j, md5(array_to_string(l, ' ')) as k from wide where len(l) = 35),
again as (select k from h group by k having count(*) > 1),
gone as materialized (select distinct r, unnest(range(j, j + 35)) as j from h where k in (select k from again)),
kept as (select a.r, count(b.j) as n_removed, string_agg(a.word, ' ' order by a.j) filter (b.j is null) as s
  from words a left join gone b on a.r = b.r and a.j = b.j group by a.r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from w left join kept using (r)
"""
