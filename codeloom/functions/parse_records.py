"""Arrow batches of source texts to Arrow batches of parse records."""

from __future__ import annotations

import gc
import hashlib
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

from codeloom.functions.parse_python import parse as parse_python
from codeloom.functions.parse_tsjs import parse as parse_tsjs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = pa.schema([
    ("file_path", pa.string()), ("language", pa.string()), ("record", pa.string()), ("pos", pa.int32()),
    ("name", pa.string()), ("kind", pa.string()), ("qualified", pa.string()), ("start_line", pa.int32()),
    ("end_line", pa.int32()), ("content_hash", pa.string()), ("module_path", pa.string()),
    ("names", pa.list_(pa.string())), ("alias", pa.string()), ("is_relative", pa.bool_()),
    ("qualifier", pa.string()), ("scope", pa.string()), ("message", pa.string()),
])


#: The columns that a kind of record fills, besides file_path, language, record and pos; the others are null.
FILLED = {
    "file": ("content_hash",),
    "error": ("message",),
    "definition": ("name", "kind", "qualified", "start_line", "end_line", "content_hash"),
    "import": ("start_line", "module_path", "names", "alias", "is_relative"),
    "call": ("name", "start_line", "qualifier", "scope"),
}
MOST_ROWS = 10_000


def add_records(found: dict[str, list[tuple]], path: str, content: str, language: str, content_hash: str) -> int:
    """Adds the records of one text to the lists of their kinds, as (file_path, language, pos, what the kind fills): the file
    itself, then its definitions, imports and calls, or an error. Returns how many. Warnings are off."""
    found["file"].append((path, language, 0, content_hash))
    try:
        definitions, imports, calls = parse_python(content, quiet=True) if language == "python" else parse_tsjs(content)
    except Exception as exc:  # noqa: BLE001 - one bad text must not stop the others
        found["error"].append((path, language, 0, f"Parse error in {path}: {exc}"))
        return 2
    if definitions:
        lines = content.replace("\r\n", "\n").replace("\r", "\n").splitlines(keepends=True)
        found["definition"] += [
            (path, language, pos, name, kind, qualified, start, end, hashlib.sha256("".join(lines[start - 1:end]).encode()).hexdigest())
            for pos, (name, kind, qualified, start, end) in enumerate(definitions)]
    found["import"] += [(path, language, pos, line, module, names, alias, relative)
                        for pos, (module, names, alias, relative, line) in enumerate(imports)]
    found["call"] += [(path, language, pos, callee, line, qualifier, scope) for pos, (callee, qualifier, scope, line) in enumerate(calls)]
    return 1 + len(definitions) + len(imports) + len(calls)


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records come by kind, in batches of one kind each."""
    for batch in batches:
        texts = zip(*(batch[c].to_pylist() for c in ("file_path", "content", "language", "content_hash")), strict=True)
        while found := _records(texts):
            yield from (_batch(record, rows) for record, rows in found.items() if rows)
        if batch.num_rows == 0:
            yield pa.RecordBatch.from_pylist([], schema=SCHEMA)


def _records(texts: Iterator[tuple]) -> dict[str, list[tuple]] | None:
    """The records of the next texts, about ``MOST_ROWS``; None after the last. A syntax tree has no cycles, so nothing is lost by
    keeping the collector, which would go through each tree, out meanwhile."""
    found, rows, collects = {record: [] for record in FILLED}, 0, gc.isenabled()
    gc.disable()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for text in texts:
                rows += add_records(found, *text)
                if rows >= MOST_ROWS:
                    break
    finally:
        if collects:
            gc.enable()
    return found if rows else None


def _batch(record: str, rows: list[tuple]) -> pa.RecordBatch:
    names = ("file_path", "language", "pos", *FILLED[record])
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    arrays = [pa.repeat(record, len(rows)) if f.name == "record" else pa.array(columns[f.name], f.type) if f.name in columns
              else pa.nulls(len(rows), f.type) for f in SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)
