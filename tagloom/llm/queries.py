"""Queries of the llm problems over the tables of the code map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import docpairs, encode, heavy, mixing, provenance, repetition, syntax
from tagloom.tables import load


SYMBOL = ("file", "line", "name", "type", "signature", "docstring", "language", "body")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods with code and telling documentation."""
    return docpairs.described_symbols(load(spark, d, "symbols", *SYMBOL), load(spark, d, "documents", "rel_file", "text")).select("file", "line", "name")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Those with their documentation, signature, body and language."""
    return docpairs.pairs(load(spark, d, "symbols", *SYMBOL), load(spark, d, "documents", "rel_file", "text"))


def p1_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions of every file, those of broken files too, with extent, head and comments."""
    return docpairs.parsed(load(spark, d, "documents", "rel_file", "text")).drop("h", "n")


#: The share of all rows that a pair must hold to come out.
SUPPORT = 0.003


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs (name, kind) with a name that hold at least 0.3 % of all rows of tags."""
    found = heavy.frequent_exact(load(spark, d, "tags", "name", "kind"), ["name", "kind"], SUPPORT)
    return found.filter("name is not null").select("name", "kind")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of p2_found with their guaranteed count intervals."""
    found, _ = heavy.frequent_items(load(spark, d, "tags", "name", "kind"), ["name", "kind"], SUPPORT)
    return found.filter("name is not null")


def _not_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(load(spark, d, "documents", "rel_file", "text"), load(spark, d, "lib_files", "lib_id", "file_name", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that nobody in their repository wrote by hand."""
    return _not_handwritten(spark, d).select("rel_file")


def p4_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Those files with their reasons, size, tags and rank."""
    more = (load(spark, d, "file_state", "rel_file", "size", "scan_id", "received_at"), load(spark, d, "tags", "rel_file"), load(spark, d, "file_ranks"))
    return provenance.with_records(_not_handwritten(spark, d), *more)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files whose text is not valid in the language of their extension."""
    return syntax.broken_files(load(spark, d, "documents", "rel_file", "text")).select("rel_file")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """Those files with the reason."""
    return syntax.broken_files(load(spark, d, "documents", "rel_file", "text"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files by repository and language."""
    return syntax.broken_rates(load(spark, d, "documents", "rel_file", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode.encode(load(spark, d, "documents", "doc_id", "text"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their copies."""
    return mixing.mix(load(spark, d, "documents", "doc_id", "source", "text"), load(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    targets = load(spark, d, "mix_targets")
    return mixing.shares(p8_mix(spark, d), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a repeated share of 0.4 or more."""
    return repetition.repeated_documents(load(spark, d, "documents", "doc_id", "text"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Repetition statistics and anomaly scores of every document."""
    return repetition.repetition(load(spark, d, "documents", "doc_id", "text"))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p1_functions": p1_functions, "p2_found": p2_found, "p2_counts": p2_counts, "p4_found": p4_found, "p4_evidence": p4_evidence, "p5_found": p5_found, "p5_flags": p5_flags, "p5_rates": p5_rates, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_scores": p9_scores}

SQL: dict[str, str] = {
    "p2_found": """
        SELECT name, kind FROM tags GROUP BY name, kind
        HAVING name IS NOT NULL AND count(*) >= 0.003 * (SELECT count(*) FROM tags)""",
    "p9_found": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents WHERE text IS NOT NULL),
        g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
        again AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id)
        SELECT c.doc_id FROM covered c JOIN w ON c.doc_id = w.doc_id WHERE c.n >= 0.4 * len(w.ws)""",
}
