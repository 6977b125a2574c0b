"""Tags, symbols and imports of source texts: Python by its own parser, other languages by patterns of their declarations."""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.functions.text import EXTENSIONS
from tagloom.session import ship

_NAME = r"[A-Za-z_$][\w$]*"
#: Per language (pattern, symbol type); the group is the name.
_DECLARATIONS = {
    "javascript": [(rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*({_NAME})", "function"), (rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+({_NAME})", "class"),
                   (rf"^[ \t]+(?:static[ \t]+|async[ \t]+|get[ \t]+|set[ \t]+|public[ \t]+|private[ \t]+|protected[ \t]+|readonly[ \t]+)*(?!(?:if|for|while|switch|catch|return|function|new|await|typeof)\b)({_NAME})[ \t]*\([^;{{}}]*\)[^;{{}}=]*\{{", "method"),
                   (rf"^(?:export[ \t]+)?const[ \t]+({_NAME})[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^)\n]*\)|{_NAME})[ \t]*=>", "function"), (rf"^(?:export[ \t]+)?(?:const|let|var)[ \t]+({_NAME})\b(?![^\n]*=>)", "variable"),
                   (rf"^[ \t]*(?:export[ \t]+)?interface[ \t]+({_NAME})", "interface"), (rf"^[ \t]*(?:export[ \t]+)?enum[ \t]+({_NAME})", "enum"), (rf"^[ \t]*(?:export[ \t]+)?type[ \t]+({_NAME})[^=\n]*=", "type")],
    "go": [(rf"^func[ \t]+\([^)\n]*\)[ \t]*({_NAME})", "method"), (rf"^func[ \t]+({_NAME})", "function"), (rf"^type[ \t]+({_NAME})[ \t]+struct\b", "class"), (rf"^type[ \t]+({_NAME})[ \t]+interface\b", "interface"), (rf"^type[ \t]+({_NAME})[ \t]+(?!struct\b|interface\b)", "type"), (rf"^(?:var|const)[ \t]+({_NAME})", "variable")],
    "java": [(rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)[ \t]+)*(?:class|record)[ \t]+({_NAME})", "class"), (rf"^[ \t]*(?:(?:public|private|protected|static)[ \t]+)*interface[ \t]+({_NAME})", "interface"), (rf"^[ \t]*(?:(?:public|private|protected|static)[ \t]+)*enum[ \t]+({_NAME})", "enum"),
             (rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*(?!(?:return|new|else|throw|if|for|while|switch|catch)\b)[\w<>\[\].,? ]+[ \t]+({_NAME})[ \t]*\([^;{{}}]*\)[^;{{}}]*\{{", "method")],
    "rust": [(rf"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:const[ \t]+|async[ \t]+|unsafe[ \t]+|extern[ \t]+\"[^\"\n]*\"[ \t]+)*fn[ \t]+({_NAME})", "function"), (rf"^[ \t]*(?:pub[ \t]+)?struct[ \t]+({_NAME})", "class"), (rf"^[ \t]*(?:pub[ \t]+)?enum[ \t]+({_NAME})", "enum"), (rf"^[ \t]*(?:pub[ \t]+)?trait[ \t]+({_NAME})", "interface"), (rf"^[ \t]*(?:pub[ \t]+)?(?:const|static)[ \t]+({_NAME})[ \t]*:", "variable"), (rf"^[ \t]*(?:pub[ \t]+)?mod[ \t]+({_NAME})", "module")],
    "c": [(rf"^(?!(?:return|else|typedef|if|for|while|switch)\b)[A-Za-z_][\w \t*]*?[ \t*]({_NAME})[ \t]*\([^;{{}}]*\)[ \t\n]*\{{", "function"), (rf"^(?:typedef[ \t]+)?(?:struct|union|class)[ \t]+({_NAME})[ \t\n]*[:{{]", "class"), (rf"^(?:typedef[ \t]+)?enum[ \t]+({_NAME})", "enum"), (rf"^#[ \t]*define[ \t]+({_NAME})", "variable")],
    "ruby": [(r"^[ \t]*def[ \t]+(?:self\.)?([A-Za-z_]\w*[?!=]?)", "function"), (r"^[ \t]*class[ \t]+([A-Z]\w*)", "class"), (r"^[ \t]*module[ \t]+([A-Z]\w*)", "module"), (r"^([A-Z][A-Z0-9_]*)[ \t]*=", "variable")],
    "php": [(rf"^[ \t]*(?:(?:public|private|protected|static|abstract|final)[ \t]+)*function[ \t]+&?({_NAME})", "function"), (rf"^[ \t]*(?:abstract[ \t]+|final[ \t]+)?class[ \t]+({_NAME})", "class")],
    "csharp": [(rf"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)[ \t]+)*(?:class|struct|record)[ \t]+({_NAME})", "class"), (rf"^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|async|abstract)[ \t]+)+[\w<>\[\].,? ]+[ \t]+({_NAME})[ \t]*\([^;{{}}]*\)[^;{{}}]*\{{", "method"), (rf"^[ \t]*(?:public[ \t]+)?interface[ \t]+({_NAME})", "interface")],
    "swift": [(rf"^[ \t]*(?:(?:public|private|internal|open|static|override|mutating)[ \t]+)*func[ \t]+({_NAME})", "function"), (rf"^[ \t]*(?:(?:public|final|open)[ \t]+)*(?:class|struct)[ \t]+({_NAME})", "class"), (rf"^[ \t]*(?:public[ \t]+)?protocol[ \t]+({_NAME})", "interface")],
    "kotlin": [(rf"^[ \t]*(?:(?:public|private|internal|override|suspend|inline|open)[ \t]+)*fun[ \t]+(?:<[^>\n]*>[ \t]*)?(?:[\w.]+\.)?({_NAME})", "function"), (rf"^[ \t]*(?:(?:data|sealed|open|abstract|inner)[ \t]+)*class[ \t]+({_NAME})", "class")],
    "scala": [(rf"^[ \t]*(?:(?:override|private|protected|final|implicit)[ \t]+)*def[ \t]+({_NAME})", "function"), (rf"^[ \t]*(?:case[ \t]+)?(?:class|object)[ \t]+({_NAME})", "class"), (rf"^[ \t]*trait[ \t]+({_NAME})", "interface")],
    "bash": [(rf"^[ \t]*(?:function[ \t]+)?({_NAME})[ \t]*\(\)", "function")],
    "lua": [(r"^[ \t]*(?:local[ \t]+)?function[ \t]+([\w.:]+)", "function")],
    "sql": [(r"^[ \t]*create[ \t]+(?:or[ \t]+replace[ \t]+)?(?:function|procedure)[ \t]+([\w.]+)", "function"), (r"^[ \t]*create[ \t]+(?:table|view)[ \t]+(?:if[ \t]+not[ \t]+exists[ \t]+)?([\w.]+)", "class")],
}
_DECLARATIONS["typescript"] = _DECLARATIONS["javascript"]
_DECLARATIONS["cpp"] = _DECLARATIONS["c"]
_COMPILED = {lang: [(re.compile(p, re.M | (re.I if lang == "sql" else 0)), t) for p, t in ps] for lang, ps in _DECLARATIONS.items()}
_TEXT = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`")
_HASH_TEXT = re.compile(r"#[^\n]*|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'")
_CALL = re.compile(rf"(?<![\w$])({_NAME})[ \t]*\(")
_WORDS = frozenset("if for while switch catch return function sizeof new await typeof def class elif else do in of and or not fn func struct type import print".split()) - {"print"}


def language_of(path: str | None) -> str | None:
    return EXTENSIONS.get((path or "").rpartition(".")[2].lower())


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def _python(text: str):
    """(line, end line, name, kind, type, signature, docstring) of definitions and references; None where the text does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines, out = text.split("\n"), []
    todo = [(tree, None)]
    while todo:
        node, cls = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = cls
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                is_class = isinstance(child, ast.ClassDef)
                name = f"{cls}::{child.name}" if cls and not is_class else child.name
                sig = lines[child.lineno - 1].strip().rstrip(":")
                out.append((child.lineno, child.end_lineno, name, "def", "class" if is_class else "method" if cls else "function", sig, ast.get_docstring(child)))
                inner = child.name if is_class else None
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.append((f.end_lineno, f.end_lineno, name, "ref", "call", None, None))
                out += [(a.lineno, a.lineno, a.id, "ref", "argument", None, None) for a in child.args if isinstance(a, ast.Name)]
            elif isinstance(child, ast.Assign) and isinstance(node, ast.Module):
                out += [(child.lineno, child.end_lineno, t.id, "def", "variable", lines[child.lineno - 1].strip(), None) for t in child.targets if isinstance(t, ast.Name)]
            todo.append((child, inner))
    return out


def _patterns(text: str, language: str):
    find = _HASH_TEXT if language in ("python", "ruby", "bash") else _TEXT
    code = find.sub(_blank, text)
    starts = [0]
    for m in re.finditer("\n", code):
        starts.append(m.end())
    from bisect import bisect_right

    out, named = [], set()
    for pattern, kind in _COMPILED.get(language, []):
        for m in pattern.finditer(code):
            line = bisect_right(starts, m.start(1))
            if m.start(1) not in named:
                named.add(m.start(1))
                sig = text[starts[line - 1] : (text + "\n").index("\n", starts[line - 1])].strip().rstrip("{ ").rstrip()
                out.append([line, None, m[1], "def", kind, sig, None])
    defs = sorted(out)
    for a, b in zip(defs, [*defs[1:], [len(starts) + 1]]):
        a[1] = max(a[0], b[0] - 1)
    for m in _CALL.finditer(code):
        if m.start(1) not in named and m[1] not in _WORDS:
            line = bisect_right(starts, m.start(1))
            out.append((line, line, m[1], "ref", "call", None, None))
    return [tuple(x) for x in out]


def extract_text(path: str, text: str | None) -> list[tuple]:
    """All definitions and references of a text, once each, by line; none for unknown languages, null and empty texts."""
    language = language_of(path)
    if not text or not language:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    found = _python(text) if language == "python" else None
    if found is None:
        found = _patterns(text, language) if language in _COMPILED else _patterns(text, "ruby") if language == "python" else []
    return sorted(set(found), key=lambda r: (r[0], r[3], r[2]))


_SCHEMA = pa.schema([("rel_file", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("type", pa.string()), ("signature", pa.string()), ("docstring", pa.string())])


def extract(files: DataFrame) -> DataFrame:
    """``rel_file, line, end_line, name, kind, type, signature, docstring`` of every definition and reference in ``files(rel_file, text)``."""

    def run(batches):
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if p for r in extract_text(p, t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)

    ship(files.sparkSession)
    return files.select("rel_file", "text").mapInArrow(run, "rel_file string, line int, end_line int, name string, kind string, type string, signature string, docstring string")


def tags(files: DataFrame, root: str = "/srv/mirror") -> DataFrame:
    """The tag table of ``files``."""
    return extract(files).select(F.concat_ws("/", F.lit(root), "rel_file").alias("file"), "rel_file", "line", "name", "kind")


def symbols(files: DataFrame, root: str = "/srv/mirror") -> DataFrame:
    return extract(files).filter("kind = 'def'").select("name", "type", F.concat_ws("/", F.lit(root), "rel_file").alias("file"), "line", "end_line", "signature", "docstring")


def _row(local, qualified, module, from_, star, static, line):
    return (local, qualified, module, from_, star, static, line)


#: Statements that may go over several lines: their braces or brackets, to the end of the last line.
_OVER_LINES = {
    "python": re.compile(r"^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]*\([^)]*\)[^\n]*|^[ \t]*(?:from|import)\b[^\n]*\\\n(?:[^\n]*\\\n)*[^\n]*", re.M),
    "javascript": re.compile(r"^[ \t]*import\b[^;'\"{}()]*\{[^}]*\}[^;'\"{}()]*['\"][^\n]*|^[ \t]*(?:const|let|var)\s*\{[^}]*\}\s*=\s*require\b[^\n]*", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub[ \t]+)?use\b[^;{]*\{[^;]*\}[ \t]*;[^\n]*", re.M),
}
_OVER_LINES["typescript"] = _OVER_LINES["javascript"]


def _on_one_line(text: str, language: str) -> str:
    """``text`` with each import statement on its first line; the lines after it keep their numbers."""

    def join(m):
        n = m[0].count("\n")
        if not n:
            return m[0]
        mark = r"#[^\n]*" if language == "python" else r"//[^\n]*|/\*[\s\S]*?\*/"
        one = re.sub(r"\\?\n", " ", re.sub(mark, "", m[0]))
        return re.sub(r",?\s*\)", ")", re.sub(r"\(\s*", "(", one)) + "\n" * n

    return _OVER_LINES[language].sub(join, text) if language in _OVER_LINES else text


def _use_tree(text: str, prefix: str = "") -> list[str]:
    """The paths of a Rust import, groups within groups taken apart."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(text[last:i].strip())
            last = i + 1
    out = []
    for part in filter(None, parts):
        head, brace, rest = part.partition("{")
        out += _use_tree(rest.rstrip()[:-1], prefix + head.strip()) if brace else [prefix + part]
    return out


def imports_of(path: str, text: str | None) -> list[tuple]:
    """(local name, qualified name, module, from-import, star, static, line) of each import of a text."""
    language = language_of(path)
    if not text or not language:
        return []
    out = []
    for n, l in enumerate(_on_one_line(text.replace("\r\n", "\n").replace("\r", "\n"), language).split("\n"), 1):
        s = l.strip()
        if language == "python":
            if m := re.fullmatch(r"import\s+(.+?)(?:\s*#.*)?", s):
                for part in m[1].split(","):
                    mod, _, alias = (x.strip() for x in part.partition(" as "))
                    out.append(_row(alias or mod, mod, mod, False, False, False, n))
            elif m := re.fullmatch(r"from\s+(\.*)([\w.]*)\s+import\s+\(?(.+?)\)?(?:\s*#.*)?", s):
                for part in filter(None, (x.strip() for x in m[3].split(","))):
                    name, _, alias = (x.strip() for x in part.partition(" as "))
                    mod = m[1] or m[2]  # a relative import keeps its dots only
                    out.append(_row("*" if name == "*" else alias or name, f"{mod}.{name}", mod, True, name == "*", False, n))
        elif language in ("javascript", "typescript"):
            if m := re.match(r"import\s+(?:type\s+)?(.+?)\s+from\s+['\"]([^'\"]+)['\"]", s):
                what, mod = m[1], m[2]
                if star := re.search(r"\*\s+as\s+([\w$]+)", what):
                    out.append(_row(star[1], mod, mod, True, True, False, n))
                if named := re.search(r"\{(.*)\}", what):
                    for part in filter(None, (x.strip() for x in named[1].split(","))):
                        name, _, alias = (x.strip() for x in part.partition(" as "))
                        out.append(_row(alias or name, f"{mod}.{name}", mod, True, False, False, n))
                if default := re.match(r"([\w$]+)\s*(?:,|$)", what):
                    out.append(_row(default[1], f"{mod}.default", mod, False, False, False, n))
            elif m := re.match(r"(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", s):
                for name in re.findall(r"[\w$]+", m[1]):
                    out.append(_row(name, m[2] if m[1][0] != "{" else f"{m[2]}.{name}", m[2], m[1][0] == "{", False, False, n))
        elif language == "java":
            if m := re.match(r"import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", s):
                mod, _, last = m[2].rpartition(".")
                out.append(_row("*" if m[3] else last, m[2], mod, True, bool(m[3]), bool(m[1]), n))
        elif language in ("c", "cpp"):
            if m := re.match(r"#\s*include\s*[<\"]([^>\"]+)[>\"]", s):
                out.append(_row(m[1].rpartition("/")[2].split(".")[0], m[1], m[1], False, False, False, n))
            elif m := re.match(r"using\s+namespace\s+([\w:]+)\s*;", s):
                out.append(_row("*", m[1], m[1], True, True, False, n))
            elif m := re.match(r"using\s+(\w+)\s*=\s*([\w:<>]+)\s*;|using\s+([\w:]+)\s*;", s):
                full = m[2] or m[3]
                out.append(_row(m[1] or full.rpartition("::")[2], full, full.rpartition("::")[0], True, False, False, n))
        elif language == "rust":
            if m := re.match(r"(?:pub\s+)?use\s+(.+?);", s):
                for path in _use_tree(m[1]):
                    full, _, alias = (x.strip() for x in path.partition(" as "))
                    full = full.removesuffix("::self")
                    last = full.rpartition("::")[2]
                    out.append(_row(alias or last, full, full.rpartition("::")[0], True, last == "*", False, n))
        elif language == "ruby":
            if m := re.match(r"require(?:_relative)?\s+['\"]([^'\"]+)['\"]", s):
                out.append(_row(m[1].rpartition("/")[2], m[1], m[1], False, False, False, n))
    if language == "go":
        for block in re.finditer(r"^import\s*\(([\s\S]*?)\)", text, re.M):
            at = text.count("\n", 0, block.start(1)) + 1
            for k, l in enumerate(block[1].split("\n")):
                if m := re.match(r"\s*([\w.]+\s+)?\"([^\"]+)\"", l):
                    alias = (m[1] or "").strip()
                    out.append(_row(alias or m[2].rpartition("/")[2], m[2], m[2], False, alias == ".", False, at + k))
    return out


def imports(files: DataFrame) -> DataFrame:
    """``source_file, local_name, qualified_name, source_module, is_from_import, is_star, is_static, line`` of ``files(rel_file, text)``."""
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32()]
    names = ["source_file", "local_name", "qualified_name", "source_module", "is_from_import", "is_star", "is_static", "line"]

    def run(batches):
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if p for r in imports_of(p, t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)

    ship(files.sparkSession)
    return files.select("rel_file", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, "string string string string boolean boolean boolean int".split())))
