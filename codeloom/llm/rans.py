"""Token ids as entropy-coded files, and back.

The documents' ids, in ascending order of id, form one stream; a task writes its part of it as one file. A file is a row of
groups of at most ``GROUP`` ids. A group has one table of frequencies, scaled to a power of two, that all its blocks share; a
block of ``BLOCK`` ids is coded by ``LANES`` interleaved range-ANS states, independent of other blocks. The directory of a
group holds for each block its checkpoint (the states to begin with and the place of its first word) and a checksum of its
ids, so that blocks can be decoded alone, or all at once as here, each numpy step decoding one id in every lane of every
block. The footer holds the table of documents and the groups' places.

Null and empty texts have only the end id. Null document ids come first; documents with equal ids are ordered by their text's
hash. An empty table gives one file without documents, or none, and no rows. Extra columns are ignored. A very long text runs
over as many groups as it needs.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import by_text, file_system
from codeloom.llm.tokens import LibraryIds
from codeloom.session import scratch_path, shared_dir, written

MAGIC = b"LOOMANS1"
GROUP, BLOCK, LANES, BITS = 1 << 20, 1 << 14, 32, 20
LOWEST = np.uint64(1 << 31)
MOST_BYTES = 2 << 20


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2 ** BITS, each at least 1."""
    whole = 1 << BITS
    scaled = np.maximum(counts * whole // counts.sum(), 1)
    over = int(scaled.sum()) - whole
    for i in np.argsort(-scaled, kind="stable"):  # the largest give or take what is over
        if over == 0:
            break
        change = min(over, int(scaled[i]) - 1) if over > 0 else over
        scaled[i] -= change
        over -= change
    return scaled


def encode_group(ids: np.ndarray) -> bytes:
    times = np.bincount(ids)
    symbols = np.flatnonzero(times)
    counts = times[symbols]
    index = (np.cumsum(times > 0) - 1)[ids]
    freq = frequencies(counts.astype(np.int64))
    # past the symbols: one that leaves a state as it is, for lanes that have no id in a step
    f = np.append(freq, 1 << BITS).astype(np.uint64)
    c = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
    blocks = -(-len(ids) // BLOCK)
    steps = BLOCK // LANES if blocks > 1 else -(-len(ids) // LANES)
    padded = np.full(blocks * steps * LANES, len(symbols), np.int32)
    padded[:len(ids)] = index
    lanes = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    x = np.full(blocks * LANES, LOWEST)
    words, sent = np.empty(lanes.shape, np.uint32), np.empty(lanes.shape, bool)
    up, bits = np.uint64(63 - BITS), np.uint64(BITS)
    for t in range(steps - 1, -1, -1):
        own = f[lanes[t]]
        sent[t] = x >= own << up
        words[t] = x  # the low half
        x = np.where(sent[t], x >> np.uint64(32), x)
        times = x // own
        x = (times << bits) + (x - times * own) + c[lanes[t]]
    by_block = (blocks, steps * LANES)
    sent = sent.reshape(steps, blocks, LANES).transpose(1, 0, 2).reshape(by_block)
    payload = words.reshape(steps, blocks, LANES).transpose(1, 0, 2).reshape(by_block)[sent]
    raw = ids.astype("<u4")
    sums = np.array([zlib.crc32(raw[b * BLOCK:(b + 1) * BLOCK].tobytes()) for b in range(blocks)], "<u4")
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes())
    directory = sent.sum(axis=1).astype("<u4").tobytes() + sums.tobytes() + x.astype("<u8").tobytes()
    head = struct.pack("<IIII", len(ids), len(symbols), len(table), len(payload))
    return head + table + directory + payload.astype("<u4").tobytes()


def decode_group(raw: bytes) -> np.ndarray:
    """The ids of a group as unsigned 32-bit integers; raises if a block's checksum or last states are wrong."""
    n, kinds, table_size, n_words = struct.unpack_from("<IIII", raw)
    table = np.frombuffer(zlib.decompress(raw[16:16 + table_size]), "<u4")
    symbols, freq = np.cumsum(table[:kinds], dtype=np.uint32), table[kinds:]
    blocks = -(-n // BLOCK)
    steps = BLOCK // LANES if blocks > 1 else -(-n // LANES)
    at = 16 + table_size
    lengths = np.frombuffer(raw, "<u4", blocks, at).astype(np.int64)
    sums = np.frombuffer(raw, "<u4", blocks, at + 4 * blocks)
    x = np.frombuffer(raw, "<u8", blocks * LANES, at + 8 * blocks).astype(np.uint64).reshape(blocks, LANES)
    words = np.append(np.frombuffer(raw, "<u4", n_words, at + 8 * blocks + 8 * blocks * LANES), np.uint32(0))
    place = np.cumsum(lengths) - lengths
    f, c = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    slots = np.repeat(np.arange(kinds, dtype=np.int32), freq)
    mask, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    lane = np.arange(LANES)
    sizes = np.minimum(n - np.arange(blocks) * BLOCK, BLOCK)
    full = int(sizes.min()) // LANES  # steps in which every lane has an id
    out = np.zeros((steps, blocks, LANES), np.int32)
    for t in range(steps):
        slot = x & mask
        own = slots[slot]
        moved = f[own] * (x >> bits) + slot - c[own]
        x = moved if t < full else np.where(t * LANES + lane < sizes[:, None], moved, x)
        out[t] = own
        short = x < LOWEST
        rank = np.cumsum(short, axis=1)
        got = words[np.minimum(place[:, None] + rank - 1, n_words)]
        x = np.where(short, x << np.uint64(32) | got, x)
        place = place + rank[:, -1]
    ids = symbols[out.transpose(1, 0, 2).reshape(-1)[:n]]
    little = ids.astype("<u4")
    if not (x == LOWEST).all() or any(zlib.crc32(little[b * BLOCK:(b + 1) * BLOCK].tobytes()) != sums[b] for b in range(blocks)):
        raise ValueError("damaged block of token ids")
    return little


def write(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Files with the ids of all texts, each followed by ``end_id``. Returns a row per file: part (their order), file, n_docs,
    n_tokens, n_bytes."""
    folder = scratch_path(docs.sparkSession, "token-files")
    system, local = file_system(folder)
    system.create_dir(local)

    def run(batches):
        from pyspark import TaskContext

        system, local = file_system(folder)
        encoder = LibraryIds.kept(path)
        part = TaskContext.get().partitionId()
        # a name for every attempt: only the files of attempts that succeed are in the list
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ans"
        doc_ids, lengths, groups, waiting, held, total = [], [], [], [], 0, 0
        with system.open_output_stream(f"{local}/{name}", compression=None) as out:
            out.write(MAGIC)
            size = len(MAGIC)

            def flush(last: bool):
                nonlocal waiting, held, size
                stream = np.concatenate(waiting) if waiting else np.empty(0, np.int64)
                start = 0
                while len(stream) - start >= GROUP or last and start < len(stream):
                    raw = encode_group(stream[start:start + GROUP])
                    groups.append((size, len(raw)))
                    out.write(raw)
                    size += len(raw)
                    start += GROUP
                waiting = [stream[start:]]
                held = len(waiting[0])

            for batch in batches:
                for piece in by_text(batch, "text", MOST_BYTES):
                    ids, n = encoder.encode(piece.column("text").to_pylist())
                    ids = np.insert(ids, np.cumsum(n), end_id)
                    doc_ids += piece.column("doc_id").to_pylist()
                    lengths.append(n + 1)
                    waiting.append(ids)
                    held += len(ids)
                    total += len(ids)
                    if held >= GROUP:
                        flush(last=False)
            flush(last=True)
            known = np.array([i is not None for i in doc_ids], np.uint8)
            numbers = np.array([i or 0 for i in doc_ids], "<i8")
            counts = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
            table = zlib.compress(known.tobytes() + numbers.tobytes() + counts.astype("<i8").tobytes())
            tail = json.dumps({"docs": len(doc_ids), "groups": groups, "table": len(table)}).encode()
            out.write(table + tail + struct.pack("<Q", len(tail)) + MAGIC)
            size += len(table) + len(tail) + 16
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": len(doc_ids), "n_tokens": total, "n_bytes": size}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    listed = written(spread.mapInArrow(run, "part long, file string, n_docs long, n_tokens long, n_bytes long"), "token-files-list")
    return listed.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def groups_of(file: str):
    """(table of documents, then the ids of group after group) of a file; only one group is held at a time."""
    system, local = file_system(file)
    with system.open_input_file(local) as source:
        size = source.size()
        end = source.read_at(16, size - 16)
        if end[8:] != MAGIC:
            raise ValueError(f"not a file of token ids: {file}")
        tail_size = struct.unpack("<Q", end[:8])[0]
        tail = json.loads(source.read_at(tail_size, size - 16 - tail_size))
        raw = zlib.decompress(source.read_at(tail["table"], size - 16 - tail_size - tail["table"]))
        n = tail["docs"]
        known = np.frombuffer(raw, np.uint8, n).astype(bool)
        yield known, np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<i8", n, 9 * n)
        for at, length in tail["groups"]:
            yield decode_group(source.read_at(length, at))


def read(files: DataFrame) -> DataFrame:
    """A row per document, from the files alone: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    shared_dir(files.sparkSession)
    # one row per file, not per document
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                content = groups_of(file)
                known, doc_ids, lengths = next(content)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                sums = np.zeros(len(lengths), np.int64)
                at, doc = 0, 0
                for ids in content:
                    while doc < len(lengths):
                        stop = min(bounds[doc + 1], at + len(ids))
                        start = max(bounds[doc], at)
                        sums[doc] = zlib.crc32(ids[start - at:stop - at].tobytes(), int(sums[doc]))
                        if bounds[doc + 1] > at + len(ids):
                            break
                        doc += 1
                    at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=~known), pa.array(base + bounds[:-1]), pa.array(lengths), pa.array(sums)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n_files = max(1, files.count())
    return placed.repartition(n_files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
