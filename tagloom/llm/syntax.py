"""Source files that do not parse: language lexers with a pushdown stack, and Python's own parser as a last word on Python."""

from __future__ import annotations

import re
import sys
import warnings
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import spread

#: The language that an extension stands for.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "rs": "rust", "c": "c", "rb": "ruby"}

_DQ, _SQ = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
_SLASHES = r"//[^\n]*|/\*[\s\S]*?\*/"
_TRIPLE = r'"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""' + r"|'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''"
_RUBY_DQ = r'"[^"\\#]*(?:(?:\\[\s\S]|#\{[^{}]*\}|#)[^"\\#]*)*"'
#: A slash that begins a regular expression: what stands before it ends no operand.
_RE_LITERAL = r"(?<=[=(,:\[!&|?{};+\n~^])[ \t]*/(?![*/ ])[^/\\\n\[]*(?:(?:\\.|\[[^\]\\\n]*(?:\\.[^\]\\\n]*)*\])[^/\\\n\[]*)*/\w*"

#: Per language: what is text (comments, strings) rather than code; then what can only be the start of text that never ends.
_TEXT = {
    "python": (r"#[^\n]*|" + _TRIPLE + "|" + _DQ + "|" + _SQ, r"[\"']"),
    "javascript": (_SLASHES + "|" + _DQ + "|" + _SQ + r"|`[^`\\$]*(?:(?:\\[\s\S]|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\}|\$)[^`\\$]*)*`|" + _RE_LITERAL, r"[\"'`]|/\*"),
    "go": (_SLASHES + "|" + _DQ + r"|'(?:[^'\\\n]|\\[^\n]+?)'|`[^`]*`", r"[\"'`]|/\*"),
    "java": (_SLASHES + r'|"""[\s\S]*?(?<!\\)"""|' + _DQ + r"|'(?:[^'\\\n]|\\[^'\n]+|\\')'", r"[\"']|/\*"),
    "rust": (r"//[^\n]*|/\*(?:[^/*]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*\*/" + r'|\bb?r(?P<h>#*)"[\s\S]*?"(?P=h)|"[^"\\]*(?:\\[\s\S][^"\\]*)*"' + r"|'(?:[^'\\\n]|\\[^'\n]+|\\')'|'[A-Za-z_]\w*", r"[\"']|/\*"),
    "c": (_SLASHES + r"|^[ \t]*#[ \t]*(?:error|warning|pragma|include)[^\n]*|" + _DQ + "|" + _SQ, r"[\"']|/\*"),
    "ruby": (
        r"^=begin\b[\s\S]*?^=end[^\n]*|^__END__\n[\s\S]*|<<[~-]?(?P<q>['\"]?)(?P<tag>[A-Z_]\w*)(?P=q)[^\n]*\n[\s\S]*?^[ \t]*(?P=tag)$|#[^\n]*|" + _RUBY_DQ + r"|'[^'\\]*(?:\\[\s\S][^'\\]*)*'|`[^`]*`"
        r"|(?<![\w)\]])%[wWiIqQr]?(?:\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\|[^|]*\|)|" + _RE_LITERAL + r"|(?<=[\s(,=])\?[^\s\w](?=[\s),])|[\w)\]]\?(?=[\s.)])|\$[\"'`/]", r"[\"'`]"),
}
_TEXT["typescript"] = _TEXT["javascript"]

_MARKS = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: [^\n]*)?$|^={7}$", re.M)
_BRACKETS = re.compile(r"[][(){}]").findall
#: Delimiters and the directives that part a C text into branches.
_BRANCHES = re.compile(r"^[ \t]*#[ \t]*(?P<d>if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b[^\n]*|^[ \t]*#[^\n]*|(?P<b>[][(){}])", re.M)
#: More different stacks than branches of any real text leave open.
MOST_STACKS = 256
_PAIR = {")": "(", "]": "[", "}": "{"}
#: No language here has these outside of strings and comments: symbols, controls and characters that stand for lost bytes.
_STRAY = re.compile(r"[^\w\s\x20-\x7e‌‍﻿]|[\x00-\x08\x0e-\x1b\x7f]")
_STRAY_ASCII = {"go": "[#$?@\\\\]", "java": r"[#\\`]", "rust": r"[\\`]", "c": r"[@`$]", "javascript": r"\\(?!u)", "typescript": r"\\(?!u)"}

_JS_BEFORE = "var let const function class new return typeof delete void throw case async await yield export default import from as get set static extends in of instanceof else do super break continue debugger accessor using".split()
_TS_BEFORE = _JS_BEFORE + "public private protected readonly abstract declare type interface enum namespace module keyof infer is unique asserts override implements satisfies global require out".split()
_AFTER = "instanceof in of as is satisfies extends implements from else while catch finally if".split()


def _adjacent(before: list[str], after: list[str]):
    """Two names in a row on one line, of which neither is a word that may stand so: no such expression exists."""
    return re.compile(rf"(?<![\w$.#@])(?!(?:{'|'.join(before)})\b)[A-Za-z_$][\w$]*[ \t]+(?!(?:{'|'.join(after)})\b)[A-Za-z_$]")


#: What shows that a text is in another language than its name says.
_FOREIGN = {
    "javascript": [_adjacent(_JS_BEFORE, _AFTER), re.compile(r"\b(?:const|let|var)\s+[\w$]+\s*:|\bfunction\s*[\w$]*\s*\([^(){}]*[\w$]\s*\??\s*:|\)\s*:\s*[\w$<>\[\]|. ]+\{|^[ \t]*#[ \t]*(?:include|define|if|endif)\b", re.M), re.compile(r"\A\s*<")],
    "typescript": [_adjacent(_TS_BEFORE, _AFTER), re.compile(r"^[ \t]*#[ \t]*(?:include|define|if|endif)\b|^[ \t]*(?:public|private|protected)[ \t]+class\b", re.M), re.compile(r"\A\s*<")],
    "go": [re.compile(r"\A(?!\s*package[ \t]+\w+[ \t]*(?:[;\n\r]|\Z))")],
    "java": [re.compile(r"\A(?!\s*(?:\Z|;|package\s+[\w.]+\s*;|import\s+(?:static\s+)?[\w.]+(?:\.\*)?\s*;|@|(?:public|private|protected|abstract|final|static|strictfp|sealed|non-sealed|class|interface|enum|record|open|module)\s+[\w.]))"),
             re.compile(r"^(?:func|fn|def|function|export|use|pub|impl|let|const|static[ \t]+const)\b[ \t]", re.M)],
    "rust": [re.compile(r"\A(?!\s*(?:\Z|#!?\[|#!|(?:pub|use|mod|fn|impl|struct|enum|trait|type|extern|unsafe|async\s+fn|union|default)\b|const\s+(?:fn\b|unsafe\b|\w+\s*:)|static\s+(?:mut\s+)?\w+\s*:|\w+(?:::\w+)*!|;))"),
             re.compile(r"^(?:import|package|export|def|func|function|class|public|private)\b[ \t]|^[ \t]*#[ \t]*(?:include|define)\b", re.M)],
    "c": [re.compile(r"^(?:package|import|export|use|def|class|func|fn|pub|impl|let|function|require|from|public|private|protected|mod|trait|var|interface|module)\b[ \t]+[\w{\"(*]", re.M), re.compile(r"\A\s*<|::|:=|\A\s*\w+\s*:"), re.compile(r"^(?:else|elif|for|while|if|with|try)\b[^\n;{]*:[ \t]*$", re.M)],
    "ruby": [re.compile(r"^[ \t]*(?://|/\*|\*/)|\A\s*<|\A\s*\w+:[ \t\n]|\bdef\s+\w+[^\n]*\)[ \t]*(?:->[^\n]*)?:[ \t]*$|^import[ \t]*[{(]|^(?:package|import)[ \t]+[\w.]+;|^[ \t]*(?:func|fn|function)[ \t]+\w+[ \t]*\([^\n]*\{[ \t]*$|^[ \t]*\}[ \t]*else\b", re.M)],
}

#: Two numbers in a row on one line, or list items of a data format: no statement of any of these languages.
_DATA = re.compile(r"(?<![\w.$#])\d[\w.]*[ \t]+\d[\w.]*(?=[ \t\n]|\Z)|^[ \t]*-[ \t]+\w+:(?:[ \t]|$)", re.M)

_RUBY_WORD = re.compile(
    r"(?<![.:@$\w])(?P<loop>while|until|for)\b(?![?!:(=]|\s*=)|(?<![.:@$\w])(?P<cond>if|unless)\b(?![?!:]|\s*=[^=~])|(?<![.:@$\w])(?P<open>class|module|def|begin|case|do)\b(?![?!:=])|(?<![.:@$\w])(?P<end>end)\b(?![?!:=])|(?P<nl>\n)|(?P<semi>;)")
_RUBY_ENDLESS = re.compile(r"[ \t]+(?:self\.)?\w+[?!]?[ \t]*(?:\([^()\n]*\))?[ \t]*=[ \t]")
_RUBY_BEFORE = re.compile(r"(?:\A|[\n=(\[{;,|&!?:<>+*-]|\b(?:return|and|or|not|then|do|else|begin|ensure|elsif|when|in|unless|if|while|until))\Z")
_RUBY_REACH = 8  # longer than any of these words; blanks before the word looked at are skipped first, however many

#: Operators without an operand behind them, and keywords that are assigned to: no expression of these languages.
_LOST_OPERAND = re.compile(r"([-+=%^])[ \t\n]*[;)\]]")
_ASSIGNED_WORD = re.compile(r"(?<=[a-z])[ \t]+=(?![=>])")
_RESERVED = re.compile(r"(?<![\w$.])(?:int|char|float|double|void|return|struct|const|var|func)\Z")
_LOST_IN = {"c", "java", "go", "javascript", "typescript"}


def _ruby_blocks(code: str) -> str | None:
    """The pushdown of Ruby's words: what opens a block, and its end."""
    stack: list[str] = []
    awaits_do = False  # the do of a loop's own line opens no further block
    for m in _RUBY_WORD.finditer(code):
        kind = m.lastgroup
        if kind in ("nl", "semi"):
            awaits_do = False
        elif kind == "end":
            if not stack:
                return "unbalanced"
            stack.pop()
        elif kind in ("cond", "loop"):
            at = m.start()
            while at and code[at - 1] in " \t":
                at -= 1
            if _RUBY_BEFORE.search(code, max(0, at - _RUBY_REACH), at):
                stack.append(m.group())
                awaits_do = kind == "loop"
        elif m.group() == "do" and awaits_do:
            awaits_do = False
        elif not (m.group() == "def" and _RUBY_ENDLESS.match(code, m.end())):
            stack.append(m.group())
    return "ends-early" if stack else None


def _loses_operand(code: str) -> bool:
    for m in _LOST_OPERAND.finditer(code):
        before = code[m.start() - 1 : m.start()]
        if not (m[1] in "+-" and before == m[1] or m[1] == "=" and before in ("=", "!", "<", ">") or m[1] == "%" and before == "%"):
            return True
    return any(_RESERVED.search(code, max(0, m.start() - 8), m.start()) for m in _ASSIGNED_WORD.finditer(code))


def _balance(code: str) -> str | None:
    """The pushdown of delimiters."""
    stack: list[str] = []
    push, pop = stack.append, stack.pop
    for b in _BRACKETS(code):
        if b in "([{":
            push(b)
        elif not stack or pop() != _PAIR[b]:
            return "unbalanced"
    return "ends-early" if stack else None


def _balance_of_branches(code: str) -> str | None:
    """The same where a preprocessor keeps one of several branches: each branch starts from the stacks at its ``#if``, and has to lie on a way to the end that leaves nothing open.

    Stacks are linked pairs (delimiter, rest), each with a mark for every branch that some way to it passed; ways that come to the same stack are one.
    """
    now: dict = {None: 0}  # stack -> branches on the ways to it
    open_: list[list] = []  # [stacks at the #if, stacks that the branches so far left, whether there was an #else]
    branch = 0

    def joined(a: dict, b: dict) -> dict:
        out = dict(a)
        for k, v in b.items():
            out[k] = out.get(k, 0) | v
        return out

    for m in _BRANCHES.finditer(code):
        b, d = m["b"], m["d"]
        if b:
            if b in "([{":
                now = {(b, k): v for k, v in now.items()}
            else:
                now = {k[1]: v for k, v in now.items() if k and k[0] == _PAIR[b]}
            if not now:
                return "unbalanced"
        elif d and d.startswith("if"):
            branch += 1
            open_.append([now, {}, False])
            now = {k: v | 1 << branch for k, v in now.items()}
        elif d:
            if not open_:
                return "unbalanced"
            before, left, had_else = open_[-1]
            left = joined(left, now)
            if d == "endif":
                open_.pop()
                now = left if had_else else joined(left, before)
                if len(now) > MOST_STACKS:
                    return "unbalanced"
            else:
                branch += 1
                open_[-1] = [before, left, had_else or d == "else"]
                now = {k: v | 1 << branch for k, v in before.items()}
    if open_ or None not in now:
        return "ends-early"
    return None if now[None] == (1 << branch + 1) - 2 else "unbalanced"


def _python_says(text: str) -> str | None:
    try:
        compile(text, "text", "exec", 0x400, True)  # the flag of ast.parse: grammar only
    except (SyntaxError, ValueError):
        return "grammar"
    except (RecursionError, MemoryError):
        return None  # nested too deep for this parser; the lexer found nothing
    return None


@lru_cache(maxsize=None)
def _compiled(language: str):
    text, open_ = _TEXT[language]
    stray = _STRAY_ASCII.get(language)
    return re.compile(f"(?P<text>{text})|(?P<open>{open_})", re.M), stray and re.compile(stray)


def reason_of(text: str | None, language: str) -> str | None:
    """Why ``text`` is not valid in ``language``, or None.

    ``merge-conflict``, ``unterminated`` (string or comment), ``unbalanced`` (a closing delimiter that nothing or another one
    opened), ``ends-early`` (something is open at the end), ``stray-character``, ``other-language`` or ``grammar``. A null or blank
    text, or one of comments only, is valid.
    """
    if not text or language not in _TEXT:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text[0] == "﻿":
        text = text[1:]
    if text.startswith("#!") and language in ("javascript", "typescript", "ruby", "python"):
        text = "\n" + text.partition("\n")[2]
    find, stray = _compiled(language)
    opened = False

    def mask(m: re.Match) -> str:
        nonlocal opened
        if m.lastgroup == "open":
            opened = True
            return " "
        s = m.group()
        t = s.lstrip(" \t")
        c = t[:1]
        if c == "/" or c == "#":
            if t[1:2] in ("/", "*") or c == "#":
                return "\n" if "\n" in s else " "
        if c == "'" and language == "rust" and not s.endswith("'"):
            return " "
        if language == "ruby" and c not in "\"'`/%":
            return s[:1] + " " if s.endswith("?") else "\n" if s.startswith(("=begin", "__END__")) else '""\n' if c == "<" else " 0 "
        return '""'

    code = find.sub(mask, text)
    if _MARKS.search(code):
        return "merge-conflict"
    if opened:
        return "unterminated"
    wrong = _balance_of_branches(code) if language == "c" and "#" in code else _balance(code)
    if wrong:
        return wrong
    if not code.isascii() and _STRAY.search(code) or stray and stray.search(code):
        return "stray-character"
    if language != "python" and _DATA.search(code if language != "c" else re.sub(r"^[ \t]*#[^\n]*", "", code, flags=re.M)):
        return "other-language"
    for foreign in _FOREIGN.get(language, ()):
        if code.strip() and foreign.search(code):
            return "other-language"
    if language in _LOST_IN and _loses_operand(code):
        return "grammar"
    if language == "ruby":
        return _ruby_blocks(code)
    return _python_says(text) if language == "python" else None


def file_flags(docs: DataFrame) -> DataFrame:
    """``rel_file, repo, language, reason`` of each file of ``docs(rel_file, text)`` in a known language; ``reason`` null if valid.

    The language is that of the extension (any case); files with other extensions, null names, and null or empty texts are left out. A file
    that was delivered several times is one row, with the first of its reasons if any delivery is invalid.
    """

    def run(batches):
        warnings.simplefilter("ignore")
        sys.setrecursionlimit(max(3000, sys.getrecursionlimit()))
        for batch in batches:
            reasons = [reason_of(t, lang) for t, lang in zip(batch.column("text").to_pylist(), batch.column("language").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("rel_file"), batch.column("language"), pa.array(reasons, pa.string())], names=["rel_file", "language", "reason"])

    ext = F.lower(F.regexp_extract("rel_file", r"\.([^./]+)$", 1))
    language = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[ext]
    code = docs.select("rel_file", language.alias("language"), "text").filter("language is not null and text is not null and text != ''")
    found = spread(code).mapInArrow(run, "rel_file string, language string, reason string")
    return found.groupBy("rel_file", "language").agg(F.min("reason").alias("reason")).select("rel_file", F.substring_index("rel_file", "/", 1).alias("repo"), "language", "reason")


def broken_files(docs: DataFrame) -> DataFrame:
    return file_flags(docs).filter("reason is not null")


def broken_rates(docs: DataFrame) -> DataFrame:
    """``repo, language, files, broken, rate``: how many files of a repository and language are invalid."""
    out = file_flags(docs).groupBy("repo", "language").agg(F.count("*").alias("files"), F.count("reason").alias("broken"))
    return out.withColumn("rate", F.col("broken") / F.col("files"))
