import warnings

import pytest

from tagloom.llm.syntax import broken_files, broken_rates, reason_of

warnings.simplefilter("ignore")
GOOD = [
    ("python", "# =======\nx = '''<<<<<<< a\n>>>>>>> b'''\ndef f(a):\n    return {'k': \")\"}\n"), ("python", "\ufeffx = 1\r\n"), ("python", "# only a comment"),
    ("javascript", "import { a } from './b';\nconst re = /[)'\"]+/g;\nconst t = `x ${a ? `y` : '}'} z`;\nexport default class A extends B { get x() { return typeof this; } async *gen() {} }\nfor (const k of y) { label: while (true) break label; }\n"),
    ("javascript", "const s = 'it\\'s'; // don't }\n/* ( */ let a = b / c / d, o = { a: 1, 'b': 2 };\n"), ("typescript", "export function f(a: string, b?: number): Map<string, number[]> { return x as any; }\ninterface I { readonly a: string; }\ntype T = keyof I;\nabstract class C { private x: number = 1; }\ndeclare module 'x';\n"),
    ("go", "// c\npackage p\n\nimport (\n\t\"a/b\"\n)\n\nfunc f(a string, b int) (int, error) {\n\tr := '\\''\n\ts := `raw \" {`\n\treturn 1, nil\n}\n"), ("java", "package a.b;\n@Ann(\"x\")\npublic class A<T> { char c = '\\''; String t = \"\"\"\n a \" b }\n\"\"\"; int f(int a) { return a; } }\n"),
    ("rust", "use a::b;\nfn f<'a>(x: &'a str) -> char { let r = r#\"a \" }\"#; 'x' }\n/* a /* nested */ b */\n#[test]\nimpl<'b> T for U {}\n"), ("c", "#include <stdio.h>\n#define Q '\"'\nstatic const char *s = \"}\";\n#ifdef A\nint f(void) {\n#else\nint g(void) {\n#endif\n  return 0;\n}\n#error don't\n"),
    ("ruby", "require 'x'\nclass A < B\n  def f(a, b: 1)\n    return 1 unless a\n    x = if a then 1 else 2 end\n    while x do x -= 1 end\n    a.each do |y| puts \"#{y[\"k\"]}\" end\n    y = <<~EOS\n      end }\n    EOS\n    self.class.end\n  end\n  def g = 1\n  def ok? = true\nend\n"),
    ("ruby", "def f(a)\n" + " " * 40 + "if a\n" + " " * 40 + "a\n" + " " * 40 + "end\nend\n"), ("c", "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint a;\n#ifdef __cplusplus\n}\n#endif\n"), ("c", "int f(void) {\n#if A\n  if (x) {\n#elif B\n#if C\n  while (y) {\n#else\n  {\n#endif\n#else\n  {\n#endif\n  }\n}\n"), ("c", "#ifdef A\n  int f(void) {\n#else\n  int b;\n#endif\n#ifdef A\n  }\n#endif\n#define X(a) {\n"),
    ("c", "char *f(int *, char *);\nint a = (int *) b + -1, c = *d++;\n"), ("java", "import a.*;\nclass A { List<String> f(int a) { a++; return (b) -> a-- ; } }\n"),
    ("ruby", "x = %w[a b]\nputs x if x\nbegin\n  a\nrescue E => e\n  b\nend until c\ncase x\nwhen 1 then 2\nend\n"), ("java", ""), ("c", "  \n"),
]
BAD = [
    ("python", "def f(:\n", None), ("python", "def f():\n    x = g(\n", "ends-early"), ("python", "def f():\n    a\n   b\n", "grammar"), ("python", "<<<<<<< ours\na = 1\n=======\na = 2\n>>>>>>> theirs\n", "merge-conflict"), ("python", "x = 'a\n", "unterminated"), ("python", "print 'x'\n", "grammar"), ("python", "int f(int a) {\n}\n", None),
    ("javascript", "function f() {\n  return g(a;\n}\n", "unbalanced"), ("javascript", "let a = \"x;\n", "unterminated"), ("javascript", "function f(a: string) { return a; }\n", "other-language"), ("javascript", "def f(a):\n    return a\n", "other-language"), ("javascript", "name: x\nsteps:\n  - run: x\n", "other-language"), ("javascript", "if (a) {\n}\n}\n", "unbalanced"), ("javascript", "let a \ufffd = 1;\n", "stray-character"),
    ("typescript", "package a.b;\npublic class A { }\n", "other-language"), ("go", "import x\ndef f(a):\n", "other-language"), ("go", "package p\nfunc f() {\n", "ends-early"), ("java", "<html>\n</html>\n", "other-language"), ("java", "class A { void f() { /* x }\n", "unterminated"), ("java", "00000000: d4 0d 66\n", "other-language"),
    ("rust", "package p\nfunc f() {}\n", "other-language"), ("rust", "fn f() { (] }\n", "unbalanced"), ("c", "package a;\n", "other-language"), ("c", "int f( {\n}\n", "ends-early"), ("c", "#if A\nint a;\n#else\n{{{\n#endif\n", "unbalanced"), ("c", "#if A\nint a;\n#else\n<<<<<<< x\n#endif\n", "merge-conflict"), ("c", "#if A\n#if B\n#else\n(\n#endif\n#endif\nint b;\n", "unbalanced"), ("c", "#if A\nint a;\n", "ends-early"), ("c", "#endif\n", "unbalanced"), ("c", "int = 3;\n", "grammar"), ("go", "package p\nfunc f() {\n\tx := ;\n}\n", "grammar"), ("java", "class A { int f() { return + ; } }\n", "grammar"), ("c", "00000000: d4 10 66 11\n", "other-language"), ("ruby", "def f(a)\n  a\n", "ends-early"), ("ruby", "def f\nend\nend\n", "unbalanced"), ("ruby", "def f(a):\n    return a\n", "other-language"), ("ruby", "if x {\n}\n", "ends-early"), ("ruby", "// c\nx = 1\n", "other-language"),
]


@pytest.mark.parametrize(("language", "text"), GOOD)
def test_valid(language, text):
    assert reason_of(text, language) is None


@pytest.mark.parametrize(("language", "text", "reason"), BAD)
def test_invalid(language, text, reason):
    got = reason_of(text, language)
    assert got is not None and (reason is None or got == reason)


def test_truncation_is_seen_wherever_code_is_open():
    text = "package p\n\nfunc f(a int) int {\n\treturn g(a, \"x\")\n}\n"
    assert reason_of(text, "go") is None
    assert all(reason_of(text[:n], "go") for n in range(text.index("{") + 1, len(text) - 1))


def test_tables(spark):
    d = spark.createDataFrame([("r/a.py", "x = 1", "j"), ("r/a.py", "x = (", "j"), ("r/b.PY", "x = (", "j"), ("r/c.js", "let a = 1;", "j"), ("r/d.txt", "(((", "j"), (None, "(", "j"), ("r/e.go", None, "j"), ("r/f.go", "", "j"), ("q/a.py", "y = 2", "j")], "rel_file string, text string, reason string")
    assert sorted(r.rel_file for r in broken_files(d).collect()) == ["r/a.py", "r/b.PY"]
    assert {(r.repo, r.language): (r.files, r.broken, r.rate) for r in broken_rates(d).collect()} == {("r", "python"): (2, 2, 1.0), ("r", "javascript"): (1, 0, 0.0), ("q", "python"): (1, 0, 0.0)}
    assert broken_files(d.limit(0)).count() == 0


def test_very_long_texts():
    assert reason_of("x = [" + "1, " * 400_000 + "]", "python") is None
    assert reason_of("(" * 100_000 + ")" * 100_000, "javascript") is None and reason_of("{" * 300_000, "c") == "ends-early"
