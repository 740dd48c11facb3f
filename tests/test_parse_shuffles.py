"""How texts are dealt to the parser and how its records are written."""

import contextlib
import io

import pyarrow as pa
from codeloom.functions import parse_records
from codeloom.operators import parse
from codeloom.session import written

FILES = [
    ("src/a.py", "from b import C, run\nclass A:\n    def m(self):\n        self.n()\n        C.go(1)\n        run()\n        run()\n    def n(self):\n        return nowhere()\nrun()\n"),
    ("b.py", "class C:\n    def go(self):\n        pass\ndef run():\n    return C()\n"),
    ("src/b.py", "def run():\n    return run()\n"),
    ("w/x.ts", "import { y } from \"./y\";\nexport const x = () => { return y(); };\n"),
    ("w/y.ts", "export function y() { return 1; }\n"),
]


def _plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def _records(spark, files=FILES):
    return written(parse.parse_files(spark.createDataFrame(files, "file_path STRING, content STRING")), "records", by="record", packed=True)


def test_texts_are_dealt_without_sorting_them(spark):
    plan = _plan(parse.parse_files(spark.createDataFrame(FILES, "file_path STRING, content STRING")))
    assert "RoundRobin" not in plan and "Sort" not in plan
    dealt = plan[plan.index("Exchange"):]
    assert "sha2" not in dealt  # hashes are made where the texts arrive


def test_records_come_by_kind(spark):
    files = [{"file_path": p, "content": c, "language": "python" if p.endswith("py") else "typescript", "content_hash": "h"} for p, c in FILES]
    made = list(parse_records.parse_batches(iter([pa.RecordBatch.from_pylist(files)])))
    assert [b.column("record").unique().to_pylist() for b in made] == [["file"], ["definition"], ["import"], ["call"]]
    assert all(b.schema == parse_records.SCHEMA for b in made)


def test_a_setting_is_put_back(spark):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    assert _records(spark).where("record = 'file'").count() == len(FILES)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
