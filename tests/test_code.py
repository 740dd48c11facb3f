"""Parsing and resolution: exact records, nodes and edges of small projects."""

import pytest

from codeloom.functions.parse_python import parse as parse_python
from codeloom.functions.parse_tsjs import parse as parse_tsjs
from codeloom.operators import parse, resolve
from codeloom.session import written

PROJECT = {
    "src/main.py": "from services.user_service import UserService\n\n\ndef main():\n    service = UserService()\n"
                   "    service.add_user('a')\n\n\nif __name__ == '__main__':\n    main()\n",
    "src/models/user.py": "from dataclasses import dataclass\n\n\n@dataclass\nclass User:\n    name: str\n\n"
                          "    def display_name(self):\n        return self.name\n",
    "src/services/user_service.py": "from models.user import User\n\n\nclass UserService:\n    def __init__(self):\n"
                                    "        self.users = []\n\n    def add_user(self, name):\n        user = User(name)\n"
                                    "        self.check(user)\n        return user\n\n    def check(self, user):\n        pass\n",
    "web/main.ts": "import { UserService } from './service';\nconst service = new UserService();\nservice.addUser({ id: '1' });\n",
    "web/service.ts": "import { User, UserID } from '../web/types';\n\nexport class UserService {\n  addUser(user: User): void {\n"
                      "    this.log(user);\n  }\n\n  log(user: User): void {}\n}\n",
    "web/types.ts": "export interface User {\n  id: UserID;\n}\n\ntype UserID = string;\n",
}
EDGES = {
    ("file::src/main.py", "main::main", "contains"),
    ("file::src/models/user.py", "models.user::User", "contains"),
    ("file::src/models/user.py", "models.user::User::display_name", "contains"),
    ("file::src/services/user_service.py", "services.user_service::UserService", "contains"),
    ("file::src/services/user_service.py", "services.user_service::UserService::__init__", "contains"),
    ("file::src/services/user_service.py", "services.user_service::UserService::add_user", "contains"),
    ("file::src/services/user_service.py", "services.user_service::UserService::check", "contains"),
    ("file::web/service.ts", "web.service::UserService", "contains"),
    ("file::web/service.ts", "web.service::UserService::addUser", "contains"),
    ("file::web/service.ts", "web.service::UserService::log", "contains"),
    ("file::web/types.ts", "web.types::User", "contains"),
    ("file::web/types.ts", "web.types::UserID", "contains"),
    ("file::src/main.py", "file::src/services/user_service.py", "imports"),
    ("file::src/services/user_service.py", "file::src/models/user.py", "imports"),
    ("file::web/main.ts", "file::web/service.ts", "imports"),
    ("file::web/service.ts", "file::web/types.ts", "imports"),
    ("main::main", "services.user_service::UserService", "calls"),
    ("file::src/main.py", "main::main", "calls"),
    ("services.user_service::UserService::add_user", "models.user::User", "calls"),
    ("services.user_service::UserService::add_user", "services.user_service::UserService::check", "calls"),
    ("file::web/main.ts", "web.service::UserService", "calls"),
    ("web.service::UserService::addUser", "web.service::UserService::log", "calls"),
}


def records(spark, files):
    df = spark.createDataFrame(list(files.items()), "file_path STRING, content STRING")
    return written(parse.parse_files(df), "records")


def test_python_records():
    definitions, imports, calls = parse_python(
        "import os.path as p\nfrom . import a\nfrom ..b import c as d\n\n@reg('x')\nasync def f():\n    class K:\n"
        "        def m(self):\n            def inner(): return g(1)\n            return self.m().n(p.join('a'))\n")
    assert definitions == [("f", "function", "f", 5, 10), ("K", "class", "K", 7, 10), ("m", "method", "K.m", 8, 10),
                           ("inner", "method", "K.inner", 9, 9)]
    assert imports == [("os.path", [], "p", False, 1), (".", ["a"], None, True, 2), ("..b", ["c"], None, True, 3)]
    assert calls == [("reg", None, "f", 5), ("g", None, "inner", 9), ("n", "self.m()", "m", 10), ("m", "self", "m", 10),
                     ("join", "p", "m", 10)]


@pytest.mark.parametrize("text", ["def ok():\n    return 1\n\ndef bad(:\n    x\n", "class A:\n    def ok(self):\n        pass\n  oops(\n"])
def test_broken_python_still_yields_definitions(text):
    assert "ok" in [d[0] for d in parse_python(text)[0]]


def test_tsjs_records():
    definitions, imports, calls = parse_tsjs(
        "import D, { a as b, type T } from './m';\nimport * as ns from \"x\";\n// function no() {}\n"
        "export abstract class B { abstract f(): void; g() { return 1 } }\nexport class C<T> extends B {\n"
        "  constructor(private x: X) { super(); }\n  static async h<U>(u: U): Promise<U> {\n    return ns.q(`a ${b(1)}`, /x(y/);\n"
        "  }\n}\nexport const arrow = async (n: number): Promise<void> => {\n  await new ns.K(n).run();\n};\n"
        "enum E { A, B }\nexport interface I { m(): void }\ntype U = 'a' | 'b';\nfunction plain({ x }) { return arrow(x); }\n")
    assert definitions == [
        ("g", "method", "g", 4, 4), ("C", "class", "C", 5, 10), ("constructor", "method", "C.constructor", 6, 6),
        ("h", "method", "C.h", 7, 9), ("arrow", "function", "arrow", 11, 13), ("E", "enum", "E", 14, 14),
        ("I", "interface", "I", 15, 15), ("U", "type_alias", "U", 16, 16), ("plain", "function", "plain", 17, 17)]
    assert imports == [("./m", ["D", "a", "T"], None, True, 1), ("x", ["ns"], None, False, 2)]
    assert set(calls) == {("super", None, "constructor", 6), ("q", "ns", "h", 8), ("b", None, "h", 8), ("K", "ns", None, 12),
                          ("run", "new ns.K(n)", None, 12), ("arrow", None, "plain", 17)}


def test_empty_and_unknown_files(spark):
    rows = records(spark, {"a.py": "", "b.ts": "", "c.txt": "def f(): pass"}).collect()
    assert sorted((r["file_path"], r["record"]) for r in rows) == [("a.py", "file"), ("b.ts", "file")]


def test_project(spark):
    recs = records(spark, PROJECT)
    nodes = {r["qualified_name"]: r for r in resolve.build_nodes(recs).collect()}
    assert (nodes["models.user::User"]["start_line"], nodes["models.user::User"]["end_line"]) == (4, 9)
    assert len(nodes) == 6 + 12
    edges = resolve.build_edges(recs).collect()
    assert {(r["source"], r["target"], r["kind"]) for r in edges} == EDGES and len(edges) == len(EDGES)
    assert {r["confidence"] for r in edges if r["kind"] == "calls"} == {"medium"}


def test_parity_keeps_upward_imports_unresolved(spark):
    recs = records(spark, PROJECT)
    found = {r["file_path"] for r in resolve.resolve_imports(recs, parity=True).collect()}
    assert "web/service.ts" not in found and "web/main.ts" in found


def test_resolution_order_and_hot_modules(spark):
    files = {f"pkg/m{i}.py": "from .util import log, fmt as f\nfrom . import util\nimport pkg.util\n\n\ndef go():\n    log()\n"
                             "    fmt()\n    util.log()\n    here()\n\n\ndef here():\n    pass\n" for i in range(12)}
    files |= {"pkg/util.py": "def log():\n    pass\n\n\nclass log:\n    def close(self):\n        self.open()\n\n"
                             "    def open(self):\n        pass\n\n\ndef fmt():\n    pass\n", "pkg/__init__.py": ""}
    recs = records(spark, files)
    imports = resolve.resolve_imports(recs, hot_rows=3)
    got = {(r["file_path"], r["pos"], r["target_file"]) for r in imports.collect()}
    assert got == {(f"pkg/m{i}.py", p, t) for i in range(12) for p, t in
                   [(0, "pkg/util.py"), (1, "pkg/__init__.py"), (2, "pkg/util.py")]}
    calls = {(r["source"], r["target"]) for r in resolve.resolve_calls(recs, written(imports, "i")).collect()}
    want = {("pkg.util::log::close", "pkg.util::log::open")}
    for i in range(12):
        # util is imported as a name of the package, where nothing is defined, so util.log() is dropped
        want |= {(f"pkg.m{i}::go", t) for t in ("pkg.util::log", "pkg.util::fmt", f"pkg.m{i}::here")}
    assert calls == want
    # Two definitions share a name: the later one is the node.
    assert {r["kind"] for r in resolve.build_nodes(recs).where("qualified_name = 'pkg.util::log'").collect()} == {"class"}


def test_no_bound_on_imports_and_type_lists(spark):
    many = ", ".join(f"n{i}" for i in range(1100))
    union = " | ".join(f"'{i}'" for i in range(120))
    text = f"import {{ {many} }} from './lib';\nconst go = <T extends {union}>(x: T) => run<{union}>(x);\n"
    recs = records(spark, {"a.ts": text, "lib.ts": "export function n1() {}\n"}).collect()
    imports = [r for r in recs if r["record"] == "import"]
    assert len(imports) == 1 and len(imports[0]["names"]) == 1100
    assert [r["name"] for r in recs if r["record"] == "definition" and r["file_path"] == "a.ts"] == ["go"]
    assert "run" in {r["name"] for r in recs if r["record"] == "call"}


def test_the_walk_over_a_python_text_leaves_plain_names_out():
    import ast

    from codeloom.functions import parse_python

    text = "import a\nx = y + z * 2 < 3 and not w\n@deco(1)\ndef f(p: g()) -> h():\n    return [k(q) for q in b.c(d)()]\n"
    definitions, imports, calls = parse_python.parse(text)
    assert [d[0] for d in definitions] == ["f"] and [i[0] for i in imports] == ["a"]
    assert sorted(c[0] for c in calls) == ["c", "deco", "g", "h", "k"]
    every = {type(n) for n in ast.walk(ast.parse(text))}
    assert {ast.Name, ast.Load, ast.Add, ast.Lt, ast.And, ast.Not, ast.Constant} <= every & parse_python._LEAVES
    assert not parse_python._LEAVES & {ast.Call, ast.FunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Attribute, ast.arg}


def test_records_are_whole_batches_of_the_schema():
    import pyarrow as pa

    from codeloom.functions import parse_records

    files = [{"file_path": f"f{i}.py", "content": "def g():\n    pass\n" if i % 2 else "def (:", "language": "python", "content_hash": "h"} for i in range(9000)]
    made = list(parse_records.parse_batches(iter([pa.RecordBatch.from_pylist(files), pa.RecordBatch.from_pylist(files[:0], pa.RecordBatch.from_pylist(files).schema)])))
    assert all(b.schema == parse_records.SCHEMA for b in made) and [b.num_rows for b in made][-1] == 0
    rows = [r for b in made for r in b.to_pylist()]
    assert sum(r["record"] == "file" for r in rows) == 9000 and sum(r["record"] == "definition" and r["name"] == "g" for r in rows) == 4500
