"""What resolving shuffles, and that rows of names that come more than once are kept by their order."""

import contextlib
import io

from codeloom.operators import joins, parse, resolve
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


def test_names_that_come_once_are_not_shuffled(spark):
    once = _records(spark, [f for f in FILES if f[0] != "b.py"])
    assert "Exchange" not in _plan(resolve.build_nodes(once)) and "Exchange" not in _plan(resolve.contains_edges(once))
    nodes = resolve.build_nodes(_records(spark))
    assert {r.file_path for r in nodes.where("qualified_name = 'b::run'").collect()} == {"src/b.py"}
    assert nodes.count() == nodes.select("qualified_name").distinct().count()


def test_few_repeats(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), (None, 1, "u"), (None, 2, "v"), ("c", None, "w")]
    df = spark.createDataFrame(rows, "k STRING, n INT, v STRING")
    for few, all_ in ((joins.keep_last_of_few, joins.keep_last), (joins.keep_first_of_few, joins.keep_first)):
        assert sorted(map(str, few(df, ["k"], ["n"]).collect())) == sorted(map(str, all_(df, ["k"], ["n"]).collect()))
    doubled = df.unionByName(df.limit(2))
    assert sorted(map(str, joins.distinct_of_few(doubled).collect())) == sorted(map(str, doubled.distinct().collect()))


def test_calls_find_their_targets(spark):
    records = _records(spark)
    found = {(r.source, r.target, r.confidence) for r in resolve.resolve_calls(records, written(resolve.resolve_imports(records), "imports")).collect()}
    assert found == {
        ("a::A::m", "a::A::n", "medium"), ("a::A::m", "b::run", "medium"), ("file::src/a.py", "b::run", "medium"),
        ("b::run", "b::run", "medium"), ("b::run", "b::C", "medium"), ("file::w/x.ts", "w.y::y", "medium")}
