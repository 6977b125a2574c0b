"""Functions of source texts by island grammars: lexers give tokens by class, a generalised LL parser finds declarations, their documentation and their extent.

A text is read as islands (documentation, annotations, head, parameters, what opens the body) in water (all else). Where a derivation breaks off, the longest part
that was completed counts and the search goes on behind it, so a text that is broken in one place still gives the functions of all others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

from tagloom.llm.gll import Grammar

_DQ, _SQ = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"', r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
_BLANK = r"(?P<B>\n[ \t]*(?=\n))"
_SLASH_COMMENT = r"(?P<l>^[ \t]*//[^\n]*)|(?P<o>^[ \t]*/\*[\s\S]*?\*/)|(?P<t>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_HASH_COMMENT = r"(?P<l>^[ \t]*#[^\n]*)|(?P<t>#[^\n]*)"
_CONTROL = "if|for|while|switch|catch|else|do|return|try|case|throw|new|await|delete|typeof|go|defer|match|loop|select|yield|finally|synchronized|import|package|use|goto"
_BRACES = (
    r"{blank}|{comment}|(?P<x>{strings})|(?P<a>^[ \t]*(?:@[A-Za-z_][\w.]*(?:\((?:[^()]|\([^()]*\))*\))?|#!?\[[^\n]*\])[ \t]*$)|(?P<P>^[ \t]*\#[ \t]*[a-z][^\n]*)|(?P<K>^[ \t]*(?:{control})\b)|(?P<w2>^[ \t]*(?:where|throws)\b)"
    r"|(?P<t2>(?<=\w)<[^<>;{{}}()\n]*(?:<[^<>;{{}}()\n]*>[^<>;{{}}()\n]*)*>)|(?P<F>^[ \t]*(?:(?:@\w+|#\[[^\]\n]*\])[ \t]+)*(?:func|function|fn)\b)|(?P<f>\b(?:func|function|fn)\b)|(?P<W>^[ \t]*(?:(?:@\w+|#\[[^\]\n]*\])[ \t]+)*[A-Za-z_$~][\w$]*)|(?P<w>[A-Za-z_$][\w$]*)|(?P<g>[](){{}}[;])|(?P<r>=>)|(?P<e>(?<![=!<>+*/%&|^-])=(?!=))"
)
_STRINGS = {
    "javascript": _DQ + "|" + _SQ + r"|`[^`\\]*(?:\\[\s\S][^`\\]*)*`|(?<=[=(,:\[!&|?;+])[ \t]*/(?![*/ ])(?:[^/\\\n\[]|\\.|\[[^\]\n]*\])+/\w*",
    "go": _DQ + r"|'(?:[^'\\\n]|\\[^\n]+?)'|`[^`]*`",
    "java": r'"""[\s\S]*?(?<!\\)"""|' + _DQ + r"|'(?:[^'\\\n]|\\[^'\n]+|\\')'",
    "rust": r'\bb?r(?P<h>#*)"[\s\S]*?"(?P=h)|"[^"\\]*(?:\\[\s\S][^"\\]*)*"' + r"|'(?:[^'\\\n]|\\[^'\n]+|\\')'|'[A-Za-z_]\w*",
    "c": _DQ + "|" + _SQ,
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_LEXERS = {k: re.compile(_BRACES.format(blank=_BLANK, comment=_SLASH_COMMENT, strings=s, control=_CONTROL), re.M) for k, s in _STRINGS.items()}
_PY_STRINGS = r'"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*(?:"""|\Z)|' + r"'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*(?:'''|\Z)|" + _DQ + "|" + _SQ
_LEXERS["python"] = re.compile(
    rf"{_BLANK}|{_HASH_COMMENT}|(?P<S>^[ \t]*[rRuUbB]{{0,2}}(?:{_PY_STRINGS})(?=[ \t]*(?:#[^\n]*)?(?:\n|\Z)))|(?P<s>{_PY_STRINGS})|(?P<a>^[ \t]*@[^\n(]*(?:\((?:[^()]|\([^()]*\))*\))?[^\n]*)"
    r"|(?P<f>^[ \t]*(?:async[ \t]+)?def[ \t]+\w*)|(?P<C>^[ \t]*\w+)|(?P<g>[](){}[:])|(?P<i>^[ \t]*(?=[^\s\w]))|(?P<w>\w+)", re.M)  # fmt: skip
_LEXERS["ruby"] = re.compile(
    rf"{_BLANK}|(?P<t0>^=begin\b[\s\S]*?(?:^=end[^\n]*|\Z))|{_HASH_COMMENT}|(?P<x><<[~-]?(?P<q>['\"]?)(?P<tag>[A-Z_]\w*)(?P=q)[^\n]*\n[\s\S]*?^[ \t]*(?P=tag)$"
    r'|"[^"\\#]*(?:(?:\\[\s\S]|#\{[^{}]*\}|#)[^"\\#]*)*"|' + r"'[^'\\]*(?:\\[\s\S][^'\\]*)*'|`[^`]*`)"
    r"|(?P<f>^[ \t]*(?:private[ \t]+|protected[ \t]+)?def[ \t]+(?:self\.)?[^\s(;]+(?:[ \t]+[^\n(;#=]+(?=\n))?)|(?P<b>^[ \t]*(?:class|module|begin|case|if|unless|while|until|for)\b|(?<==)[ \t]*(?:if|case|begin|unless)\b|\bdo\b)"
    r"|(?P<e>^[ \t]*end\b(?![?!:=])|(?<![.:\w])end\b(?![?!:=]))|(?P<W>^[ \t]*[A-Za-z_@$]\w*[?!]?)|(?P<g>[](){}[;])", re.M)  # fmt: skip

_DOC = {"Lead": [[], ["Lead", "a"], ["Lead", "Doc"]], "Doc": [["l"], ["o"], ["Doc", "l"], ["Doc", "o"]]}
_ANY = {"Params": [["(", "Any", ")"]], "Group": [["(", "Any", ")"]], "Index": [["[", "Any", "]"]], "Curly": [["{", "Any", "}"]]}
#: Declarations of languages with braces: l o comments, a annotation, w word, f function keyword, = and r (an arrow) of assigned functions. "Fn" also completes before its body, which recovers heads whose body is lost.
_BRACE_HEAD = Grammar(_DOC | _ANY | {
    "Unit": [["Lead", "Fn"]],
    "Fn": [["Head", "Params", "Tail"], ["Head", "Params", "Tail", "{", "Open"]],
    "Head": [["Name"], ["Pre", "Name"], ["Name", "=", "Pre"], ["Pre", "Name", "=", "Pre"], ["Name", "="], ["Pre", "Name", "="]],
    "Name": [["w"]],
    "Pre": [["w"], ["f"], ["Group"], ["Index"], ["Pre", "w"], ["Pre", "f"], ["Pre", "Group"], ["Pre", "Index"]],
    "Tail": [[], ["Tail", "w"], ["Tail", "r"], ["Tail", "Group"], ["Tail", "Index"]],
    "Any": [[], *([x, "Any"] for x in ("w", "f", "k", "l", "o", "a", "p", "=", "r", ";", "b", "x", "Group", "Index", "Curly"))],
    "Open": [["Remark"], []],
    "Remark": [["l"], ["o"], ["l", "Remark"], ["o", "Remark"]],
})
#: Python: f stands for "def name", S for a string that is a statement, < and > for indent and dedent.
_PYTHON_HEAD = Grammar(_DOC | _ANY | {
    "Unit": [["Lead", "Fn"]],
    "Fn": [["f"], ["f", "Params", "Tail", ":"], ["f", "Params", "Tail", ":", "<", "Open"]],
    "Tail": [[], ["Tail", "w"], ["Tail", "s"], ["Tail", "Group"], ["Tail", "Index"]],
    "Any": [[], *([x, "Any"] for x in ("w", "l", "s", "S", "a", ":", "b", "Group", "Index", "Curly"))],
    "Open": [["Remark"], ["Text"], ["Remark", "Text"], []],
    "Text": [["S"]],
    "Remark": [["l"], ["l", "Remark"]],
})
_RUBY_HEAD = Grammar(_DOC | _ANY | {
    "Unit": [["Lead", "Fn"]],
    "Fn": [["f", "Open"], ["f", "Params", "Open"]],
    "Any": [[], *([x, "Any"] for x in ("w", "l", "x", "f", "d", "e", "b", ";", "Group", "Index", "Curly"))],
    "Open": [["Remark"], []],
    "Remark": [["l"], ["l", "Remark"]],
})
_NEST = {"Items": [[], ["Item", "Items"]], "Item": [["(", "Items", ")"], ["[", "Items", "]"], ["{", "Items", "}"]]}
_BODY = {
    "brace": Grammar(_NEST | {"Body": [["{", "Items", "}"]]}),
    "python": Grammar(_NEST | {"Item": [*_NEST["Item"], ["<", "Items", ">"]], "Body": [["<", "Items", ">"]]}),
    "ruby": Grammar(_NEST | {"Item": [*_NEST["Item"], ["d", "Items", "e"]], "Body": [["d", "Items", "e"]]}),
}
_BRACE_ANCHOR = re.compile(r"[WF](?:[wf=r\[\]]|W(?=\()|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\{[lo]*")
_BRACE_BROKEN = re.compile(r"[WF][wf\[\]]*\((?:[^(){};]|\([^(){};]*\))*\)")
_PYTHON_ANCHOR = re.compile(r"f(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[wsl()\[\]]*:(?:<l*S?)?)?")
_RUBY_ANCHOR = re.compile(r"f(?:\((?:[^()]|\([^()]*\))*\))?l*")
_LEAD = re.compile(r"[loa]*\Z")
#: Brackets and blocks; pairs without others inside are water.
_QUOTES = re.compile(r"^[rRuUbB]{0,2}(?:\"\"\"|'''|[\"'])|(?:\"\"\"|'''|[\"'])$")
_STRUCTURE = {k: re.compile(rf"\([^](){{}}[{m}]*\)|\[[^](){{}}[{m}]*\]|([](){{}}[{m}])") for k, m in (("brace", ""), ("python", "<>"), ("ruby", "fde"))}


class Function(NamedTuple):
    """A declaration: its first line and the line of its end, its name, whether its end was found, and the texts of its head, of the comment above and of the string or comment that opens its body."""

    line: int
    end_line: int
    name: str
    complete: bool
    signature: str
    above: str | None
    opening: str | None
    is_string: bool


def _kind(language: str) -> str:
    return language if language in ("python", "ruby") else "brace"


def _lex_braces(text: str, language: str):
    out, ends, depth = [], [], 0
    add, put = out.append, ends.append
    for m in _LEXERS[language].finditer(text):
        k = m.lastgroup
        if k == "g":
            k = m.group()
            if k in "([":
                depth += 1
            elif k in ")]":
                depth -= depth > 0
            else:
                depth = 0
        elif k == "t" or k == "t2":
            continue
        elif k == "l" or k == "o":
            depth = 0  # brackets that were never closed end here at the latest
        elif k == "e":
            k = "="
        elif k == "w2":
            k = "w"
        elif k == "x":
            if not depth:
                continue
        elif depth and k in "WFKPB":
            k = k.lower()
        add(k)
        put(m.span())
    return "".join(out), ends


def _lex_python(text: str):
    out, ends, depth, stack, fresh = [], [], 0, [0], True
    add, put = out.append, ends.append
    for m in _LEXERS["python"].finditer(text):
        k = m.lastgroup
        if k == "g":
            k = m.group()
            if k in "([{":
                depth += 1
            elif k in ")]}":
                depth -= depth > 0
        elif k in "faCSil":
            if k == "f" or k == "a" and depth:
                depth = 0  # a declaration within brackets: they were never closed
            if depth:
                k = "w" if k in "Ci" else k
            else:
                s = m.group()
                at = len(s) - len(s.lstrip(" \t"))
                if at > stack[-1] and k != "l":
                    stack.append(at)
                    i = len(out)
                    while i and out[i - 1] in "lB":
                        i -= 1  # comments before the first statement stand within the block
                    out.insert(i, "<")
                    ends.insert(i, (m.start(), m.start()))
                while at < stack[-1]:
                    stack.pop()
                    add(">")
                    put((m.start(), m.start()))
                if k in "Ci":
                    k = "C"
        elif k == "t":
            continue
        elif k == "B" and depth:
            continue
        add(k)
        put(m.span())
    while len(stack) > 1:
        stack.pop()
        add(">")
        put((len(text), len(text)))
    return "".join(out), ends


def _lex_ruby(text: str):
    out, ends, loop = [], [], -1
    for m in _LEXERS["ruby"].finditer(text):
        k = m.lastgroup
        if k == "g":
            k = m.group()
        elif k in ("t", "t0"):
            continue
        elif k == "b":
            word = m.group().strip()
            if word == "do" and loop >= 0 and "\n" not in text[loop : m.start()]:
                loop = -1
                continue  # the do of a loop's own line
            loop = m.end() if word in ("while", "until", "for") else -1
            k = "d"
        elif k == "W":
            k = "w"
        out.append(k)
        ends.append(m.span())
    return "".join(out), ends


class _Head(NamedTuple):
    """What a parse of the tokens before and at the begin of a function says, as token ranges: its begin and end, name, comment above, start of the body, what opens it."""

    begin: int
    end: int
    name: int | None
    above: tuple[int, int] | None
    body: int | None
    remark: tuple[int, int] | None
    string: tuple[int, int] | None


@lru_cache(maxsize=200_000)
def _head(kind: str, tokens: str) -> _Head | None:
    """The derivation of ``tokens`` that reaches furthest."""
    spans = {"brace": _BRACE_HEAD, "python": _PYTHON_HEAD, "ruby": _RUBY_HEAD}[kind].spans("Unit", tokens)
    by: dict[str, list[tuple[int, int]]] = {}
    for n, b, e in spans:
        by.setdefault(n, []).append((b, e))
    if "Unit" not in by:
        return None
    end = max(e for _, e in by["Unit"])
    begin = max(b for b, e in by["Fn"] if e == end)
    docs = [(b, e) for b, e in by.get("Doc", ()) if e <= begin and set(tokens[e:begin]) <= {"a"}]
    above = max(docs, key=lambda s: (s[1], s[1] - s[0]), default=None)
    opens = [(b, e) for b, e in by.get("Open", ()) if kind == "ruby" or tokens[b - 1] in "{<"]
    body = (max(opens, key=lambda s: s[1])[0] if opens else None) if kind == "ruby" else max((b - 1 for b, _ in opens), default=None)
    pick = lambda n: max(((b, e) for b, e in by.get(n, ()) if body is not None and b > begin), key=lambda s: s[1] - s[0], default=None)
    if kind == "brace":
        groups = {b for b, _ in by.get("Params", ())}
        names = sorted(b for b, e in by.get("Name", ()) if b >= begin and (e in groups or tokens[e : e + 1] == "="))
        name = next((b for b in names if b + 1 in groups), names[0] if names else None)
        if any(tokens[b + 1 : b + 2] == "=" for b in names):
            name = next(b for b in names if tokens[b + 1 : b + 2] == "=")
    else:
        name = begin
    return _Head(begin, end, name, above, body, pick("Remark"), pick("Text"))


def _anchors(kind: str, tokens: str, fragment: bool) -> list[tuple[int, int]]:
    """Token ranges where functions may begin: up to what opens their bodies."""
    if kind != "brace":
        return [m.span() for m in (_PYTHON_ANCHOR if kind == "python" else _RUBY_ANCHOR).finditer(tokens)]
    whole = {m.start(): m.end() for m in _BRACE_ANCHOR.finditer(tokens) if "(" in m.group()}
    for m in _BRACE_BROKEN.finditer(tokens):  # heads without a body count where something documents them
        if fragment or tokens[max(0, m.start() - 1) : m.start()] in ("l", "o", "a"):
            whole.setdefault(m.start(), m.end())
    return sorted(whole.items())


def functions_of(text: str | None, language: str | None, fragment: bool = False) -> tuple[list[Function], list[str]]:
    """The functions of a text by line, and the comments that stand inside their bodies elsewhere than at the opening.

    Unknown languages, null and empty texts give none. A head whose body is missing or never closes is a function that is not ``complete``.
    Of a ``fragment``, a body that begins with its signature, only the first function comes out.
    """
    if not text or language not in _LEXERS:
        return [], []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    kind = _kind(language)
    tokens, at = _lex_python(text) if kind == "python" else _lex_ruby(text) if kind == "ruby" else _lex_braces(text, language)
    anchors = _anchors(kind, tokens, fragment)
    if not anchors:
        return [], []
    if fragment:
        anchors = anchors[:1]
    places = [m.start() for m in _STRUCTURE[kind].finditer(tokens) if m.lastindex] if not fragment else []
    coarse = "".join([tokens[i] for i in places]).replace("f", "d")
    found, told, covered, line, seen, inside = [], set(), [], 1, 0, 0
    for n, (a, b) in enumerate(anchors):
        if a < inside and tokens[b - 1] == ")":
            continue  # a call within a body, not a head that lost its own
        lead = _LEAD.search(tokens, 0, a).start() if a and tokens[a - 1] in "loa" else a
        part = tokens[lead:b]
        h = _head(kind, part.lower() if kind == "brace" else part)
        if h is None:
            continue
        start = at[a][0]
        start += len(text[start : at[a][1]]) - len(text[start : at[a][1]].lstrip())
        line += text.count("\n", seen, start)
        seen = start
        span = lambda s: text[at[lead + s[0]][0] : at[lead + s[1] - 1][1]] if s else None
        stop, complete, opened = at[lead + h.end - 1][1], False, h.body is not None
        for s in (h.above, h.remark):
            if s:
                told.update(range(lead + s[0], lead + s[1]))
        if opened:
            head_end = at[lead + h.body - 1][1] if kind != "python" else at[lead + h.body - 1][0]
            begin = lead + h.begin if kind == "ruby" else lead + h.body
            end = None if fragment else _BODY[kind].longest("Body", coarse, bisect_left(places, begin))
            complete = end is not None
            last = places[end - 1] if complete else anchors[n + 1][0] if n + 1 < len(anchors) else len(tokens)
            stop = at[last][1] if last < len(tokens) else len(text)
            if kind == "python" and complete:
                stop = at[last - 1][1]
            covered.append((begin + 1, last))
            inside = max(inside, last) if complete else inside
        else:
            head_end = stop
            complete = part[h.end - 1 : h.end] == ":" and bool(text[stop : (text + "\n").index("\n", stop)].strip())  # a body on the line of its head
        name = text[slice(*at[lead + h.name])].strip() if h.name is not None else ""
        if kind != "brace":
            name = re.split(r"\bdef[ \t]+", name)[-1].removeprefix("self.").split()[0] if "def" in name else name
        opening = _QUOTES.sub("", span(h.string).strip()) if h.string else span(h.remark)
        found.append(Function(line, line + text.count("\n", start, stop), name, complete, text[start:head_end].strip(), span(h.above), opening, h.string is not None))
    return found, _inner_comments(text, tokens, at, told, covered) if not fragment else []


def _inner_comments(text: str, tokens: str, at: list, told: set, covered: list) -> list[str]:
    """Runs of comments within bodies that document no function there."""
    out, k, reach = [], 0, 0
    for m in re.finditer("[lo]+", tokens):
        i = m.start()
        while k < len(covered) and covered[k][0] <= i:
            reach = max(reach, covered[k][1])
            k += 1
        if i < reach and i not in told and m.end() - 1 not in told:
            out.append(text[at[i][0] : at[m.end() - 1][1]])
    return out
