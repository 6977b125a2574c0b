import pytest

from tagloom.llm import docpairs as D
from tagloom.llm.functions import functions_of
from tagloom.llm.gll import Grammar


def test_gll_takes_ambiguous_and_left_recursive_grammars():
    g = Grammar({"E": [["E", "+", "E"], ["n"]], "A": [["A", "a"], []]})
    assert ("E", 0, 5) in g.spans("E", "n+n+n") and ("E", 0, 3) in g.spans("E", "n+n+") and ("A", 0, 3) in g.spans("A", "aaab")
    assert g.longest("E", "n+n") == 3 and g.longest("E", "n+") == 1 and g.longest("E", "+") is None


@pytest.mark.parametrize(("language", "text", "found"), [
    ("python", "x = 1\n# Doc one.\n# Doc two.\n@dec(1)\ndef f():\n", {5: "# Doc one.\n# Doc two."}), ("python", "# Far.\n\ndef f():\n", {}), ("python", "@dec\ndef f():\n", {}),
    ("java", "    /**\n     * Doc.\n     */\n    @Override\n    public void f() {\n", {5: "    /**\n     * Doc.\n     */"}), ("java", "    @A\n    // Doc.\n    void f() {\n", {3: "    // Doc."}),
    ("go", "// License\n\n// Doc.\nfunc f() {\n", {4: "// Doc."}), ("rust", "/// Doc.\n#[inline]\nfn f() {}\n", {3: "/// Doc."}), ("c", "int a; // tail\nint f(void) {\n", {}), ("c", "(((\n/* Doc. */\nint f(void) {\n", {3: "/* Doc. */"}), ("ruby", "# Doc.\r\ndef f\r\nend\r\n", {2: "# Doc."}), ("python", "", {}),
])
def test_comments_above(language, text, found):
    assert {f.line: f.above for f in functions_of(text, language)[0] if f.above} == found


BROKEN = [
    ("python", "def f(a:\n    x = (1\n\ndef g(b):\n    '''Doc.'''\n    return [b]\n", {"f": False, "g": True}), ("java", "class A {\n  int f(int a) {\n    if (a) {\n  }\n  /** Doc. */\n  int g(int b) {\n    return b;\n  }\n", {"f": False, "g": True}),
    ("go", "func f() {\n<<<<<<< HEAD\n\tx(\n}\n\n// Doc.\nfunc (t *T) g(a int) (int, error) {\n\treturn 1\n}\n", {"f": False, "g": True}), ("ruby", "def f(a)\n  if a\nend\n# Doc.\ndef g(b)\n  b.map do |x|\n    x\n  end\nend\n", {"f": False, "g": True}),
    ("rust", "pub fn g<T: Into<u8>>(x: &'a str) -> bool\nwhere T: Copy {\n    let c = '{';\n}\n", {"g": True}), ("typescript", "export const g = async (a: string, { b } = {}): Promise<void> => {\n  h(a);\n};\n", {"g": True}), ("c", "static int\ng(const char *a)\n{\n    return f(a, \"}\");\n}\n", {"g": True}),
]


@pytest.mark.parametrize(("language", "text", "functions"), BROKEN)
def test_functions_of_broken_files(language, text, functions):
    assert {f.name: f.complete for f in functions_of(text, language)[0]} == functions


def test_signatures_over_many_lines_and_comments_inside_bodies():
    params = ",\n".join(f"    int a{i}" for i in range(12))
    (f,), inner = functions_of(f"int f(\n{params}) {{\n    // Opens.\n    g();\n    // Within.\n    h(); // tail\n}}\n", "c")
    assert f.opening.strip() == "// Opens." and f.complete and f.end_line == 18 and [x.strip() for x in inner] == ["// Within."]
    assert functions_of(None, "c") == functions_of("", "c") == functions_of("int f() {}", "cobol") == ([], [])


@pytest.mark.parametrize(("language", "body", "doc"), [
    ("python", "def f(a, b={}):\n    '''Tells.'''\n    return 1", "Tells."), ("python", "def f(a):\n    # Tells.\n    # More.\n    x = 1", "Tells.\nMore."), ("python", "def f(a):\n    x = 1\n    # no", ""), ("python", "async def f(\n    a,\n):\n    r\"\"\"Tells\n    more", "Tells\nmore"),
    ("java", "    int f(int a) {\n        /* Tells. */\n        return a;", "Tells."), ("go", "func f(a int) {\n\t// Tells.\n\t// More.\n\tx()\n}", "Tells.\nMore."), ("ruby", "def f(a)\n  # Tells.\n  x\nend", "Tells."), ("c", "int f(int a)\n{\n    return a; // no\n}", ""), ("javascript", "f(a) {", ""),
])
def test_doc_in_body(language, body, doc):
    assert D.plain(D.opening_of(body, language)[0] or "") == doc


@pytest.mark.parametrize("text", ["...", "???", "--------", "TODO", "todo: document", "FIXME write docs", "XXX -", "TBD", "n/a", "None.", "docstring", "No description provided", "Missing description.", "Description goes here", "Documentation pending.", "Undocumented.", "Auto-generated method stub!", "AUTO-GENERATED METHOD STUB", "nolint", "noqa: E501", "type: ignore", "eslint-disable-next-line", "@internal", "[inline]",
                                  "See above.", "See base class.", "{@inheritDoc}", "@inheritdoc", ":param a: :param b: :returns:", "@param a @param b @return", "Args: a, b", "load_page", "load_page()", "Load page.", "Function load page..", "The load page.", "loads the page", "load page method (todo)", "return load_page(a, b)", "x = load_page(x)", "load_page(a);", "\xa0"])
def test_trivial(text):
    assert D.trivial(D.plain(text), "load_page", "def load_page(a, b)")


@pytest.mark.parametrize("text", ["Caller must hold the edge lock.", "Returns -1 when the queue runs dry.", "古い page を捨ててから、新しい順に並べ替えた一覧を返す。", "load_page loads unread rows into the cache.", "Loads the page lazily.\n\n:param a: the table", "Reads it twice. TODO: cover the empty cursor.", "Liest den nächsten Block ein.", "Tells nothing to callers"])
def test_telling(text):
    assert not D.trivial(D.plain(text), "load_page", "def load_page(a, b)")


@pytest.mark.parametrize(("doc", "plain"), [("/**\n * A b.\n * @x\n */", "A b.\n@x"), ("// a\n// b", "a\nb"), ("/// a", "a"), ("# a", "a"), ('"""a"""', "a"), ("/* a */", "a"), ("a\r\nb", "a\nb"), ("// \xa0", ""), ("", "")])
def test_marks(doc, plain):
    assert D.plain(doc) == plain


SYMBOLS = "file string, line int, name string, type string, signature string, docstring string, language string, body string, doc string"


def symbols(spark, *rows):
    full = [(f, n, name, t, f"def {name}(a)", d, lang, b, "clash") for f, n, name, t, d, lang, b in rows]
    return spark.createDataFrame(full, SYMBOLS)


def test_symbols(spark):
    good, body = "Caller must hold the lock.", "def x(a):\n    return 1"
    s = symbols(
        spark, ("/srv/mirror/r/a.py", 1, "own", "function", good, "python", body), ("/srv/mirror/r/a.py", 1, "own", "function", "TODO", None, None), ("/srv/mirror/r/a.py", 9, "class_", "class", good, "python", body), ("/srv/mirror/r/a.py", 3, "above", "method", " \n", "Python", body),
        ("/srv/mirror/r/a.py", 7, "far", "function", None, "py", body), ("/srv/mirror/r/a.py", 20, "inside", "function", None, None, f"def inside(a):\n    '''{good}'''\n    pass"), ("/srv/mirror/r/a.py", 30, "nobody", "function", good, "python", " \n"), ("/srv/mirror/r/a.py", 40, "trivial", "function", "TODO", "python", f"def trivial(a):\n    '''{good}'''"),
        (None, None, None, "function", good, None, body), (None, None, None, "function", good, None, body), ("/srv/mirror/r/a.py", 50, "two", "function", None, "python", body), ("/srv/mirror/r/a.py", 50, "two", "function", good, "python", None),
    )
    docs = spark.createDataFrame([("r/a.py", "\n# Guards against loops.\ndef above(a):\n    pass\n# Far away it stands.\n\ndef far(a):\n", 1)] * 2 + [(None, "# x\ndef f():", 2), ("r/b.py", None, 3)], "rel_file string, text string, line int")
    got = {(r.file and r.file[-4:], r.line, r.name) for r in D.described_symbols(s, docs).collect()}
    assert got == {("a.py", 1, "own"), ("a.py", 3, "above"), ("a.py", 20, "inside"), ("a.py", 50, "two"), (None, None, None)}
    p = {r.name: r for r in D.pairs(s, docs).collect()}
    assert len(p) == 5 and p["above"].doc == "Guards against loops." and p["own"].body == body and p["inside"].language == "python"
    assert D.described_symbols(s.limit(0), docs).count() == 0 and D.described_symbols(s, docs.limit(0)).count() == 4


def test_templates_of_any_length_are_dropped_by_their_share_of_symbols(spark):
    row = lambda repo, i, doc, name=None: (f"/srv/mirror/{repo}/f{i}.py", 1, name or f"{repo}{i}", "function", doc, "python", "def x():\n  pass")
    repeated = [row("q", 0, "Drops stale rows.", "one")] * 40
    shared = [row("r", i, f"r{i} handles all the things that the caller of this code may want to have handled.") for i in range(25)]
    others = [row("z", i, f"Frees what {''.join('abcdefghij'[int(c)] for c in str(i))} left behind.") for i in range(4_000)]
    none = spark.createDataFrame([], "rel_file string, text string")
    found = lambda *rows: {r.name for r in D.described_symbols(symbols(spark, *rows), none).collect()}
    assert found(*repeated, *shared) == {"one"}
    assert {n for n in found(*repeated, *shared, *others) if n[0] != "z"} == {"one"}
    assert len(found(*repeated, *shared[:12], *others)) == 4_013


def test_remarks_on_statements_are_no_documentation(spark):
    body = lambda i, word: f"def f{i}(a):\n    # older {word} come first\n    return a"
    s = symbols(spark, ("/srv/mirror/r/a.py", 2, "f0", "function", None, "python", body(0, "rows")), ("/srv/mirror/r/b.py", 1, "f1", "function", None, "python", body(1, "pages")), ("/srv/mirror/r/c.py", 1, "f2", "function", None, "python", "def f2(a):\n    # Rows must be sorted by size.\n    return a"))
    inside = "".join(f"def g{w}(a):\n    a()\n    # older {w} come first\n    a()\n" for w in ("x", "y", "z"))
    docs = spark.createDataFrame([("r/a.py", "# Keeps what the caller asked for.\n" + body(0, "rows")), ("r/d.py", inside)], "rel_file string, text string")
    assert {r.name: r.doc for r in D.described_symbols(s, docs).collect()} == {"f0": "Keeps what the caller asked for.", "f2": "Rows must be sorted by size."}
    assert len(D.described_symbols(s, docs.limit(0)).collect()) == 3
