import gzip
import hashlib
import io
import json

import pytest

from codeloom.llm import warc
from codeloom.llm.common import file_system

PAGES = "page_id long, url string, html string, record string, bytes int"


def test_archives_and_back(spark):
    long = "é<p>" * 400
    rows = [(1, "http://a/x y", long, "c", 1), (2, "http://b", long, "c", 1), (5, None, long, "c", 1), (3, "u", "short", "c", 1),
            (4, "u", "short", "c", 1), (6, "u", None, "c", 1), (7, "u\r\nX: y", "a\r\n\r\nb\r\nWARC/1.1\r\n\r\n" * 90, "c", 1),
            (None, "u", long, "c", 1), (8, "u", "z" * 200_000, "c", 1)]
    folder = warc.write_monolithic(spark.createDataFrame(rows, PAGES).repartition(2))
    index = warc.normalise(spark, folder)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read(index).collect()}

    def full(html):
        raw = (html or "").encode()
        return len(raw), hashlib.sha1(raw).hexdigest()

    for page_id, _, html, *_ in rows:
        again = html == long and page_id != 5
        assert got[page_id] == (*full(html), "revisit" if again else "response", 5 if again else None)
    # a member for each record, found by the sidecar alone
    for archive in {r["archive"] for r in index.collect()}:
        system, path = file_system(archive)
        raw = system.open_input_file(path).read()
        sidecar = [json.loads(x) for x in system.open_input_file(path + ".idx").read().splitlines()]
        assert sum(r["length"] for r in sidecar) == len(raw)
        for r in sidecar:
            text = gzip.decompress(raw[r["at"]:r["at"] + r["length"]])
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and r["record_id"].encode() in text


def test_empty_table(spark):
    folder = warc.write_monolithic(spark.createDataFrame([], PAGES))
    assert warc.read(warc.normalise(spark, folder)).count() == 0


def test_streams_of_one_or_many_members():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for raw in (gzip.compress(record * 3), gzip.compress(record) * 3):
        found = list(warc.split_records(warc.inflated(io.BytesIO(raw))))
        assert [h + r for h, r in found] == [record] * 3
    with pytest.raises(ValueError):
        list(warc.split_records([record[:-6]]))
