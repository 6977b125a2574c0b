"""Scalar functions on names and paths, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Verb synonyms, the first of a group being canonical; and the extra groups of content search (fixed values).
SYNONYMS = [
    "get fetch load retrieve read", "set store write save put", "create make build new", "delete remove drop clear",
    "find search lookup locate", "pack dump serialize", "unpack parse deserialize",
]
CONTENT_SYNONYMS = [
    "args argument arguments", "params parameter parameters",
    "depend dependency dependencies dependant dependants dependent dependents", "dict dictionary dictionaries",
]
CODE_STOPWORDS = frozenset("func fn def class var const type struct interface".split())
STOPWORDS = frozenset(
    "a an the and or as at by for from in into of on to with is are was were be been being do does did done have has had that this these those it its which what when"
    " where how why then than so such no nor own same too very can will just shall may i me my we our you your he him his she her they them their s t ve re ll d m".split()
)
#: Test paths, as the globs */tests/* */test/* */__tests__/* test_* *_test.* *.test.* *_spec.* on full path, "/" + path and base name.
TEST_PATH = r"(^|/)(tests|test|__tests__)/|^test_|/test_[^/]*$|_test\.|\.test\.|_spec\."

#: Extension -> language of the probe (fixed values).
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "rs": "rust", "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "cs": "csharp",
    "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "sql": "sql", "lua": "lua", "r": "r", "jl": "julia", "ex": "elixir", "erl": "erlang",
    "hs": "haskell", "ml": "ocaml", "dart": "dart", "zig": "zig", "pl": "perl", "html": "html", "css": "css",
}

_SEP = "\u0001"


def camel_split(word: Column) -> Column:
    """``HTTPServerName`` -> [HTTP, Server, Name]."""
    return F.split(F.regexp_replace(F.regexp_replace(word, "(?<=[a-z0-9])(?=[A-Z])", _SEP), "(?<=[A-Z])(?=[A-Z][a-z])", _SEP), _SEP)


def tokens(name: Column) -> Column:
    """Lower-case parts of an identifier at ``_ - . /``, white space and humps; ``::`` and brackets part nothing."""
    marked = F.regexp_replace(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", _SEP), "(?<=[A-Z])(?=[A-Z][a-z])", _SEP)
    return F.transform(F.filter(F.split(marked, f"[{_SEP}_\\-\\s./]+"), lambda x: x != ""), F.lower)


def tokens_of(name: str) -> list[str]:
    """The same on the driver, for a query."""
    out = []
    for part in re.split(r"[_\-\s./]+", name):
        out += re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", part)
    return [x.lower() for x in out if x]


def qual(name: Column) -> Column:
    """The name without its parameter list."""
    return F.regexp_replace(name, r"\([\s\S]*$", "")


def base(name: Column) -> Column:
    """What follows the first ``::``, without parameter list."""
    return qual(F.regexp_replace(name, r"^[\s\S]*?::", ""))


def scope(name: Column) -> Column:
    """What stands before the last ``::``; null if there is none."""
    return F.nullif(F.regexp_extract(qual(name), r"^([\s\S]*)::", 1), F.lit(""))


def boundary_rank(name: Column, query: str) -> Column:
    """0 if name is the query, 1 if one of its segments is, else 2; case aside."""
    q = query.lower()
    return F.when(F.lower(name) == q, 0).when(F.array_contains(F.split(F.lower(name), r"::|[._\-/\s#]"), q), 1).otherwise(2)


def is_test(path: Column) -> Column:
    return F.coalesce(path.rlike(TEST_PATH), F.lit(False))


def edit_distance(a: Column, b: Column | str) -> Column:
    """The Levenshtein distance, 3 meaning 3 or more."""
    return F.least(F.levenshtein(a, b if isinstance(b, Column) else F.lit(b)), F.lit(3))


def _groups(extra: bool) -> dict[str, str]:
    return {w: g.split()[0] for g in SYNONYMS + (CONTENT_SYNONYMS if extra else []) for w in g.split()}


def canonical(token: Column) -> Column:
    """The head of the token's synonym group; of the group of its singular, if only that is in one; else the token."""
    known = F.create_map(*(F.lit(x) for kv in _groups(True).items() for x in kv))
    single = F.when((token != "news") & token.endswith("s"), F.regexp_replace(token, "s$", ""))
    return F.coalesce(F.try_element_at(known, token), F.try_element_at(known, single), token)


def canonical_of(token: str) -> str:
    known = _groups(True)
    return known.get(token) or (known.get(token[:-1]) if token.endswith("s") and token != "news" else None) or token


def query_variants(query: str) -> list[str]:
    """Spellings under which a queried identifier may be written: separators, case, and synonyms of one part, in this order."""
    q = re.sub(r"<[^>]*>|\(.*\)", "", query).strip()
    last = q.rsplit("::", 1)[-1]
    parts = tokens_of(last)
    if not parts:
        return []
    known = _groups(False)

    def spellings(ws: list[str]) -> list[str]:
        return ["_".join(ws), "".join(ws), "-".join(ws), ".".join(ws)]

    out = spellings(parts)
    if "." in q:
        out.append(q.replace(".", "::").lower())
    swaps = [[*parts[:i], other, *parts[i + 1 :]] for i, w in enumerate(parts) if w in known for g in SYNONYMS if w in g.split() for other in g.split() if other != w]
    for s in swaps[:20]:
        out += spellings(s)
    return [v for v in dict.fromkeys(out) if len(v) >= 2]


def rescue_tokens(query: str) -> list[str]:
    """The parts of a query without code keywords; all parts if nothing else is left."""
    parts = tokens_of(query)
    return [t for t in parts if t not in CODE_STOPWORDS] or parts


def glob_regex(glob: str) -> str:
    """A file-name pattern as an anchored regular expression; ``*`` also crosses ``/``."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return F.coalesce(path.rlike("|".join(map(glob_regex, globs))), F.lit(False)) if globs else F.lit(False)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of the extension, null if there is none."""
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.try_element_at(known, extension(path))


def token_estimate(text: Column) -> Column:
    """Tokens of a text where no vocabulary is given: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def default_budget(files: Column) -> Column:
    """The token budget of a map over so many files."""
    return F.greatest(F.lit(2048), F.ceil(files * 0.5)).cast("long")


def compact(col: Column) -> Column:
    """White space folded; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(col, r"\s+", " ")), F.lit(""))


def doc_head(doc: Column, most: int = 200) -> Column:
    """At most ``most`` characters, cut at a word, with an ellipsis where something was cut."""
    return F.when(F.length(doc) <= most, doc).otherwise(F.concat(F.regexp_replace(F.left(doc, F.lit(most)), r" [^ ]*$", ""), F.lit("…")))


def escape_label(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, '"', "'"), r"[\[\]{}|<>]", " ")
