import pytest

from tagloom.sources import extract, folder
from tagloom.streaming import index

SNIPPETS = [
    ("python", "py", 'def add(a, b):\n    """Add two numbers."""\n    return a + b\n', "add"), ("javascript", "js", "function add(a, b) { return a + b; }\n", "add"), ("typescript", "ts", "export function add(a: number): number {\n  return a;\n}\n", "add"),
    ("c", "c", "int add(int a, int b) {\n  return a + b;\n}\n", "add"), ("cpp", "cpp", "class Calc {\n};\nint add(int a) {\n return a;\n}\n", "add"), ("java", "java", "class Calc {\n    public int add(int a, int b) { return a + b; }\n}\n", "add"),
    ("go", "go", "package p\nfunc add(a int, b int) int { return a + b }\n", "add"), ("rust", "rs", "fn add(a: i32, b: i32) -> i32 { a + b }\n", "add"), ("swift", "swift", "func add(a: Int) -> Int { return a }\n", "add"),
    ("csharp", "cs", "class Calc {\n    public int add(int a) { return a; }\n}\n", "add"), ("ruby", "rb", "def add(a, b)\n  a + b\nend\n", "add"),
]


@pytest.mark.parametrize(("language", "ext", "text", "name"), SNIPPETS)
def test_languages(language, ext, text, name):
    d = [r for r in extract.extract_text(f"x.{ext}", text) if r[3] == "def"]
    hit = next(r for r in d if r[2].split("::")[-1] == name)
    assert "add" in hit[5] and hit[1] >= hit[0]


def test_python_details_and_broken_files():
    got = extract.extract_text("a.py", "class A:\n    def run(self):\n        '''Doc.'''\n        helper(x)\n")
    assert ("A::run", "method", "Doc.") in [(r[2], r[4], r[6]) for r in got] and {(r[2], r[3]) for r in got} >= {("helper", "ref"), ("x", "ref")}
    assert [r[2] for r in extract.extract_text("a.py", "def ok(a):\n  return f(a)\ndef broken(:\n") if r[3] == "def"] == ["ok", "broken"]
    assert extract.extract_text("a.py", None) == extract.extract_text("a.py", "") == extract.extract_text("a.unknown", "x") == []


@pytest.mark.parametrize(("path", "text", "bound"), [
    ("a.py", "import os", [("os", "os")]), ("a.py", "from pathlib import Path", [("Path", "pathlib.Path")]), ("a.py", "import os.path as osp", [("osp", "os.path")]), ("a.py", "from collections import OrderedDict as OD", [("OD", "collections.OrderedDict")]),
    ("a.py", "import sys, json", [("sys", "sys"), ("json", "json")]), ("a.py", "from os import *", [("*", "os.*")]), ("a.py", "from .mod import x", [("x", "..x")]), ("a.js", "import { bar, baz as b } from './bar';", [("bar", "./bar.bar"), ("b", "./bar.baz")]),
    ("a.js", "import d, * as ns from 'm';", [("ns", "m"), ("d", "m.default")]), ("a.js", "const { x } = require('m')", [("x", "m.x")]), ("A.java", "import static a.b.C;", [("C", "a.b.C")]), ("A.java", "import a.b.*;", [("*", "a.b")]),
    ("a.c", "#include <stdio.h>", [("stdio", "stdio.h")]), ("a.go", 'package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\n', [("fmt", "fmt"), ("x", "a/b")]), ("a.go", 'import "fmt"', []), ("a.rs", "use a::b::{c, d as e};", [("c", "a::b::c"), ("e", "a::b::d")]), ("a.rs", "use a::*;", [("*", "a::*")]),
])
def test_imports(path, text, bound):
    assert [(r[0], r[1]) for r in extract.imports_of(path, text)] == bound


def test_tables(spark):
    f = spark.createDataFrame([("a.py", "import os\ndef f():\n    g()\n", 1), (None, "x", 2), ("b.py", None, 3)], "rel_file string, text string, line int")
    assert {(r.rel_file, r.name, r.kind) for r in extract.tags(f).collect()} == {("a.py", "f", "def"), ("a.py", "g", "ref")}
    assert extract.symbols(f).first().end_line == 3 and extract.imports(f).count() == 1 and extract.tags(f.limit(0)).count() == 0


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\n\xff")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "b.py").write_text("y")
    got = folder.scan(spark, str(tmp_path)).collect()
    assert [(r.rel_file, r.size) for r in got] == [("src/a.py", 7)] and got[0].text.startswith("x = 1") and got[0].mtime_ns > 10**18
    assert folder.ignored_folders(["dist/", "#c", "!keep", "*.log", "a.b", "out", ""]) == ["dist", "out"]


def test_stream(spark, tmp_path):
    land, root = str(tmp_path / "land"), str(tmp_path / "index")
    put = lambda *rows: spark.createDataFrame(list(rows), index.SCHEMA).write.mode("append").parquet(land)
    put(("a.py", "def one():\n    pass\n", 1, 1), ("b.py", "def two():\n    pass\n", 1, 1))
    index.start(spark, land, root).awaitTermination()
    put(("a.py", "def three():\n    pass\n", 2, 2))
    index.start(spark, land, root).awaitTermination()
    assert sorted(r.name for r in index.current_tags(spark, root).filter("kind = 'def'").collect()) == ["three", "two"]


def test_imports_of_all_languages_are_resolved(spark, tmp_path):
    from tagloom.plans import catalog

    docs = [
        ("r/a.py", "import os.path as osp\nfrom m import (x)  # why\n    from n import y, z as w\nfrom k import *\n"), ("r/a.js", "import d, { e as f } from 'm';\n"), ("r/a.ts", "import { e as f } from './other';\n"),
        ("r/A.java", "import a.b.C;\nimport a.b.*;\n"), ("r/a.go", 'import (\n\tg "a/h"\n)\n'), ("r/a.rs", "use a::{b, c as i};\n"), ("r/a.c", "#include <stdio.h>\n"), ("r/none.py", ""), ("r/null.py", None), (None, "import os\n"),
    ]
    spark.createDataFrame(docs, "rel_file string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bound = [(p, r[0], r[1]) for p, t in docs if p for r in extract.imports_of(p, t) if not r[4]]
    own, every = {}, {}
    for p, name, q in bound:
        own.setdefault((p, name), set()).add(q)
        every.setdefault(name, set()).add(q)
    names = set(own) | {(p, "window") for p, t in docs if p and t is not None}
    expected = {(p, n, *((min(own[p, n]), 1.0) if len(own.get((p, n), ())) == 1 else (n, 0.0))) for p, n in names}
    assert {tuple(r) for r in catalog.QUERIES["import_resolve"](spark, str(tmp_path)).collect()} == expected
    assert {("r/a.js", "f", "m.e", 1.0), ("r/A.java", "C", "a.b.C", 1.0), ("r/a.rs", "i", "a::c", 1.0), ("r/a.go", "g", "a/h", 1.0), ("r/a.py", "w", "n.z", 1.0), ("r/a.c", "window", "window", 0.0)} <= expected
    fanned = {(p, x) for (p, n), qs in own.items() if len(qs) == 1 for x in (n, *qs)}
    assert {tuple(r) for r in catalog.QUERIES["qualified_fanout"](spark, str(tmp_path)).collect()} == fanned


@pytest.mark.parametrize(("path", "text", "bound"), [
    ("a.py", "from m import (\n    x,  # why\n    y as z,\n)\nimport os\n", [("x", "m.x", 1), ("z", "m.y", 1), ("os", "os", 5)]), ("a.py", "from m import x, \\\n    y\n", [("x", "m.x", 1), ("y", "m.y", 1)]),
    ("a.js", "import {\n  a,\n  b as c, // why\n} from 'm';\nimport d from 'n';\n", [("a", "m.a", 1), ("c", "m.b", 1), ("d", "n.default", 5)]), ("a.ts", "import type {\n  A,\n} from \"m\";\n", [("A", "m.A", 1)]),
    ("a.js", "const {\n  x,\n} = require('m');\n", [("x", "m.x", 1)]), ("a.rs", "use a::{\n    b,\n    c as d,\n};\nuse e::f;\n", [("b", "a::b", 1), ("d", "a::c", 1), ("f", "e::f", 5)]),
])
def test_imports_over_several_lines(path, text, bound):
    assert [(r[0], r[1], r[6]) for r in extract.imports_of(path, text)] == bound


def test_rust_groups_within_groups():
    got = extract.imports_of("a.rs", "use a::{b::{c, d as e}, f, self};\nuse g::*;\n")
    assert [r[:3] for r in got] == [("c", "a::b::c", "a::b"), ("e", "a::b::d", "a::b"), ("f", "a::f", "a"), ("a", "a", ""), ("*", "g::*", "g")] and [r[4] for r in got] == [False] * 4 + [True]
