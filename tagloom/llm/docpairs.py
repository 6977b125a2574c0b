"""Functions paired with their documentation."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import spread
from tagloom.llm.functions import functions_of
from tagloom.llm.minhash import TokenIds
from tagloom.llm.syntax import LANGUAGES
from tagloom.session import cut
from tagloom.tables import rel_of

_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|//[/!]?|#+|--+(?=[ \t])|\"\"\"|'''|<!--|=begin|=end)?[ \t]?|[ \t]*(?:\*+/|\"\"\"|'''|-->)[ \t]*$", re.M)


def plain(doc: str) -> str:
    """A documentation text without its comment marks."""
    doc = doc.replace("\r\n", "\n").replace("\r", "\n")
    return _MARKS.sub("", _MARKS.sub("", doc) if doc.lstrip()[:2] in ("/*", '""', "''") else doc).replace("\xa0", " ").strip()


_LETTER = re.compile(r"[^\W\d_]")
_PLACEHOLDER = re.compile(
    r"(?:todo|fixme|xxx|tbd|tba|hack|wip)\b.*|(?:n/?a|none|nil|null|nothing|empty|doc ?strings?|docs?|documentation|description|comment|summary|placeholder|undocumented|untitled|self[- ]explanatory|obvious|stub|dummy|test|foo|bar|blah|lorem ipsum.*)"
    r"|(?:no|missing|add|needs?|insert|write|put|enter|your|short|brief) (?:\w+ )?(?:description|documentation|docs?|comments?|docstring|summary)(?: \w+){0,2}|(?:description|documentation|docs?|comments?|docstring|summary) (?:goes|go|comes?|pending|missing|needed|to come|here|tbd|todo)(?: \w+){0,2}"
    r"|auto-?\s?generated(?: (?:method|function|constructor|catch|class|by|code))?(?: (?:stub|block))?|(?:method|function) stub", re.I | re.S)
_DIRECTIVE = re.compile(
    r"@?(?:nolint|noqa|type:|eslint|jslint|jshint|tslint|pylint|flake8|mypy|pyright|ruff|isort|fmt:|yapf|black|pragma|prettier|clang-format|ts-\w+|istanbul|c8|v8|rubocop|standard:|sorbet|typed:|go:\w+|nosec|nosonar|codecov|coverage|suppress\w*|internal|private|public|protected|api|hide|hidden|ignore|override|"
    r"deprecated|export|async|static|nodoc|:nodoc:|inline|noinline|frozen_string_literal|encoding|coding|vim:|region|endregion|swift-format|ktlint|lint|checkstyle|formatter|cspell|spell\w*|global|jsx|flow|ts)[-\w:.,/= \[\]()]*", re.I)
_POINTER = re.compile(r"(?:@see\b|see\b|cf\.?\s|refer(?:s)? to\b|same as\b|as above|ditto|like above|idem\b|\{?@inherit_?doc\}?|inherit(?:s|ed|doc)?\b|(?:documented|described|explained|defined) (?:in|at|by|on|above|below|elsewhere)\b|copied from\b|https?://\S+$).*", re.I | re.S)
_PARAM_LINE = re.compile(r"^[ \t]*(?:[:@\\](?:params?|arguments?|args?|type|returns?|rtype|raises?|throws?|yields?|tparam|exception)\b[^\n]*|(?:args?|arguments?|params?|parameters?|returns?|raises?|yields?|throws?|inputs?|outputs?)[ \t]*:[^\n]*(?:\n[ \t]+[^\n]+)*|-{3,}[ \t]*$)", re.I | re.M)
_CODE = re.compile(
    r"(?:(?:return|await|yield|throw|raise|print|echo|del|delete|new)\b[ \t]+)?[\w.:$&*!]+(?:\[[^\n]*\])?[ \t]*(?:\([^\n]*\)|(?:[-+*/|&%^]|<<|>>)?=(?!=)[ \t]*\S[^\n]*|\+\+|--)[ \t]*;?|(?:if|for|while|switch|else|elif|try|def|fn|func|function|class|var|let|const|int|end|import|from|use)\b[^\n]*[{:;(]|[{}\[\]();,]+|(?:return|break|continue|pass|end)(?: [\w.]+)?;?|[^\n]*;", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_")
_LATER = re.compile(r"[ \t]*[(\[](?:todo|tbd|fixme|wip)[)\]][ \t.!]*$", re.I)
#: Words that add nothing to a name (fixed value).
_EMPTY_WORDS = frozenset(
    "a an the this that it its is are be of for to in on at by with from and or as function functions method methods func fn def procedure routine constructor destructor getter setter property class object operation implementation impl"
    " does do helper utility util main entry called named which given returns return gets sets value values result results here some".split()
) - {"main", "entry"}


@lru_cache(maxsize=200_000)
def _stem(word: str) -> str:
    w = word.lower()
    for end in ("ing", "ies", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def _parts(identifier: str) -> list[str]:
    return [w for x in _WORD.findall(_HUMP.sub(" ", identifier)) for w in (x, x.lower())]


def trivial(text: str, name: str | None, signature: str | None) -> bool:
    """Whether a plain documentation text tells nothing beyond the name and the parameters of its symbol."""
    if not _LETTER.search(text):
        return True
    bare = text.strip(" \t\n.,;:!?-=~*#<>|_+/…\"'`")
    text = _LATER.sub("", text)
    bare = _LATER.sub("", bare).strip(" .,;:!?-=~*#_…")
    if not _LETTER.search(bare) or _PLACEHOLDER.fullmatch(bare) or _DIRECTIVE.fullmatch(bare.strip("[]{}")) or _POINTER.fullmatch(text.strip(" *-{[(")) or _POINTER.fullmatch(bare):
        return True
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if all(_CODE.fullmatch(x) or _CODE.fullmatch(x.rstrip(" .!-?")) for x in lines):
        return True
    rest = _PARAM_LINE.sub("", text)
    if not _LETTER.search(rest):
        return True
    said = {_stem(w) for w in _WORD.findall(_HUMP.sub(" ", rest)) if w.lower() not in _EMPTY_WORDS}
    known = {_stem(w) for x in (name, signature) if x for w in _parts(x)}
    return said <= known or name is not None and rest.strip(" .()").lower() == name.lower()


_SPACES = re.compile(r"[\W\d_]+")


_IDS = TokenIds()
#: A description with one word left open is a template of its own if that many words stay.
SLOT_WORDS = 3
#: A description is a template of the corpus if so many of all documented symbols share it, three standard deviations of its count allowed for.
TEMPLATE_SHARE, DEVIATIONS = 0.002, 3.0


def template_of(text: str, name: str | None) -> str:
    """What repeated descriptions have in common: case, marks, digits and the symbol's own name aside."""
    low = text.lower()
    if name:
        low = low.replace(name.lower(), " ")
    return _SPACES.sub(" ", low).strip()


def template_hashes(template: str) -> list[int]:
    """The hash of a template, and those of it with each of its words left open."""
    words = template.split(" ")
    open_ = [" ".join([*words[:i], "*", *words[i + 1 :]]) for i in range(len(words))] if len(words) > SLOT_WORDS else []
    return [_IDS[x] - (1 << 63) for x in (template, *open_)]


def _language(path: str | None, said: str | None) -> str | None:
    known = LANGUAGES.get((path or "").rpartition(".")[2].lower())
    low = (said or "").strip().lower()
    return known or LANGUAGES.get(low) or (low if low in LANGUAGES.values() else None)


def opening_of(body: str, language: str | None) -> tuple[str | None, bool]:
    """The documentation string or comment that opens a body, whose first line is the signature, and whether it is a string; None if it opens with code."""
    found, _ = functions_of(body, language, fragment=True)
    return (found[0].opening, found[0].is_string) if found else (None, False)


_COLUMNS = {"file": pa.string(), "line": pa.int32(), "name": pa.string(), "language": pa.string(), "has_body": pa.bool_(), "doc": pa.string(), "trivial": pa.bool_(), "template": pa.int64()}
_ROW = "file string, line int, name string, language string, has_body boolean, doc string, trivial boolean, template long"


def _judged(doc, name, signature):
    return (doc, trivial(doc, name, signature), template_hashes(template_of(doc, name))[0]) if doc else (None, None, None)


def _batch(rows, **more):
    types = _COLUMNS | more
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _own(batches):
    """Symbols -> what their own row says of their documentation; ``doc`` null where only their file can tell, ``slots`` set where an opening comment may be a remark."""
    for batch in batches:
        rows = []
        for file, line, name, signature, docstring, said, body in zip(*(batch.column(i).to_pylist() for i in range(7))):
            language = _language(file, said)
            has_body, slots = bool(body and body.strip()), None
            doc = plain(docstring) if docstring else ""
            if not doc and has_body:
                opening, string = opening_of(body, language)
                doc = plain(opening or "")
                slots = template_hashes(template_of(doc, None)) if doc and not string else None
            rows.append((file, line, name, language, has_body, *_judged(doc or None, name, signature), signature, slots))
        yield _batch(rows, signature=pa.string(), slots=pa.list_(pa.int64()))


_PARSED = {"rel_file": pa.string(), "line": pa.int32(), "end_line": pa.int32(), "name": pa.string(), "signature": pa.string(), "complete": pa.bool_(), "above": pa.string(), "opening": pa.string(), "h": pa.int64(), "n": pa.int64()}


def _parse(all_: bool):
    """Files -> their functions (those with a comment above, or all of them), and how often a template stands as a remark inside bodies (rows without file)."""

    def run(batches):
        for batch in batches:
            rows, remarks = [], Counter()
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, inner = functions_of(text, _language(path, None))
                rows += [(path, f.line, f.end_line, f.name, f.signature if all_ else None, f.complete, f.above, f.opening if all_ else None, None, None) for f in found if all_ or f.above]
                for r in () if all_ else inner:
                    remarks.update(template_hashes(template_of(plain(r), None)))
            rows += [(None,) * 8 + x for x in remarks.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_PARSED), _PARSED.values())], names=list(_PARSED))

    return run


def parsed(docs: DataFrame, all_: bool = True) -> DataFrame:
    """``rel_file, line, end_line, name, signature, complete, above, opening`` of the functions of each file: see ``functions_of``; remarks in ``h, n`` unless ``all_``."""
    code = docs.select("rel_file", "text").filter("rel_file is not null and text is not null and text != ''")
    return spread(code).mapInArrow(_parse(all_), "rel_file string, line int, end_line int, name string, signature string, complete boolean, above string, opening string, h long, n long")


def _judge_above(batches):
    for batch in batches:
        yield _batch([(f, n, name, lang, b, *_judged(plain(c) or None, name, sig)) for f, n, name, lang, b, sig, c in zip(*(batch.column(i).to_pylist() for i in range(7)))])


def _remarks(opened: DataFrame, inner: DataFrame) -> DataFrame:
    """``rid`` of the opening comments that are remarks on the statement below: their template stands more often elsewhere in bodies than it opens one."""
    slots = opened.select("rid", F.explode("slots").alias("h"))
    opens = slots.groupBy("h").agg(F.count("*").alias("opens"))
    often = inner.groupBy("h").agg(F.sum("n").alias("inside")).join(opens, "h").filter("inside > opens").select("h")
    return slots.join(often, "h", "left_semi").select("rid").distinct()


def documentation(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Each row of ``symbols`` of type function or method with its documentation, judged; see ``_ROW``.

    ``doc`` is the docstring; where that is blank, the documentation string or comment that opens the body; where there is none, the comment directly above the
    symbol's line in the text of its file, null if there is none either. Bodies and files are parsed by the grammars of ``functions``, so a file that is broken in one place
    still gives its other functions; comments above come in by a join on (file, line). A comment at the opening of a body whose template (any one word open) stands
    more often elsewhere inside bodies is a remark on the next statement, no documentation.
    """
    f = symbols.filter(F.col("type").isin("function", "method")).select("file", F.col("line").cast("int").alias("line"), "name", "signature", "docstring", "language", "body")
    own = cut(spread(f).mapInArrow(_own, _ROW + ", signature string, slots array<long>")).withColumn("rid", F.xxhash64("file", "line", "name", "doc"))
    read = cut(parsed(docs, all_=False))
    opened = own.filter("slots is not null")
    remark = _remarks(opened, read.filter("h is not null").select("h", "n"))
    above = read.filter("rel_file is not null").select("rel_file", F.col("line").alias("at"), F.col("above").alias("comment")).distinct()
    rest = opened.join(remark, "rid", "left_semi").unionByName(own.filter("doc is null")).withColumn("rel_file", rel_of(F.col("file")))
    joined = rest.join(above, (rest["rel_file"] == above["rel_file"]) & (rest["line"] == above["at"]), "left").select("file", "line", "name", "language", "has_body", "signature", "comment")
    heard = joined.filter("comment is not null").mapInArrow(_judge_above, _ROW)
    mute = joined.filter("comment is null").select("file", "line", "name", "language", "has_body", *(F.lit(None).cast(t).alias(n) for n, t in (("doc", "string"), ("trivial", "boolean"), ("template", "long"))))
    said = own.filter("doc is not null and slots is null").unionByName(opened.join(remark, "rid", "left_anti"))
    return said.drop("signature", "slots", "rid").unionByName(heard).unionByName(mute)


def corpus_templates(rows: DataFrame) -> DataFrame:
    """``template, n`` of the descriptions that a share of all documented symbols have, each symbol counted once; at most 1 / TEMPLATE_SHARE of them.

    One rule for every size: the count less three standard deviations has to reach the share, so what some few symbols of a small table have in common is none.
    """
    of = rows.filter("template is not null").select("template", F.xxhash64("file", "line", "name").alias("k")).distinct()
    counts = cut(of.groupBy("template").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.filter(F.col("n") - F.lit(DEVIATIONS) * F.sqrt("n") >= F.lit(TEMPLATE_SHARE * total))


def described_symbols(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """``file, line, name, language, doc`` of each symbol with code and telling documentation; one row a key (file, line, name).

    A key has code if any of its rows has a body that is not blank, and documentation if that of any of its rows is not trivial. Trivial is what ``trivial``
    says, and what ``corpus_templates`` finds by hash counts. Where several rows of a key have
    telling documentation, the longest, then the first by text, comes out. Null parts of a key are equal to each other. Empty tables give no rows; without documents
    only docstrings and bodies speak.
    """
    rows = cut(documentation(symbols, docs))
    common = corpus_templates(rows).select("template", F.lit(True).alias("common"))
    marked = rows.join(F.broadcast(common), "template", "left")  # bounded: each of them holds a share of all symbols
    ok = F.coalesce(~F.col("trivial") & F.col("common").isNull(), F.lit(False))
    best = marked.groupBy("file", "line", "name").agg(
        F.bool_or("has_body").alias("has_body"), F.max_by(F.when(ok, F.col("doc")), F.when(ok, F.struct(F.length("doc"), F.col("doc")))).alias("doc"), F.max("language").alias("language")
    )
    return best.filter("has_body and doc is not null").select("file", "line", "name", "language", "doc")


def pairs(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """``file, line, name, language, signature, doc, body``: each described symbol once with its longest body."""
    found = described_symbols(symbols, docs)
    code = symbols.filter(F.col("type").isin("function", "method") & (F.trim("body") != ""))
    one = code.groupBy("file", F.col("line").cast("int").alias("line"), "name").agg(F.max(F.struct(F.length("body").alias("n"), "body", "signature")).alias("c"))
    o = one.select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("name").alias("_n"), "c")
    same = F.col("file").eqNullSafe(F.col("_f")) & F.col("line").eqNullSafe(F.col("_l")) & F.col("name").eqNullSafe(F.col("_n"))
    return found.join(o, same).select("file", "line", "name", "language", F.col("c.signature").alias("signature"), "doc", F.col("c.body").alias("body"))
