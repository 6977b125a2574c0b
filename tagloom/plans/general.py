"""Queries of the general problems over the tables of the code map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.operators.incremental import files_to_process
from tagloom.operators.skewed import name_totals
from tagloom.tables import load


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that the next run has to process."""
    return files_to_process(load(spark, d, "file_state"), load(spark, d, "indexed_files"), load(spark, d, "index_runs")).select("rel_file")


def p6_names(spark: SparkSession, d: str) -> DataFrame:
    """Definitions, references, files, edges and stop-name facts of every name."""
    return name_totals(load(spark, d, "tags", "name", "rel_file", "kind"), load(spark, d, "refs", "name", "from_file"), load(spark, d, "stop_names", "name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Names that more than 50 files define."""
    return p6_names(spark, d).filter("belongs").select("name")


QUERIES = {"p3_found": p3_found, "p6_found": p6_found, "p6_names": p6_names}

SQL = {
    "p3_found": """
        WITH now AS (
            SELECT rel_file, size, mtime_ns FROM file_state WHERE rel_file IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY rel_file ORDER BY scan_id DESC, received_at DESC) = 1),
        done AS (
            SELECT f.rel_file, f.size, f.mtime_ns FROM indexed_files f JOIN index_runs r ON f.run_id = r.run_id AND r.status = 'ok'
            QUALIFY row_number() OVER (PARTITION BY f.rel_file ORDER BY f.run_id DESC) = 1)
        SELECT n.rel_file FROM now n LEFT JOIN done d ON n.rel_file = d.rel_file
        WHERE (n.size IS NOT NULL OR n.mtime_ns IS NOT NULL)
          AND (d.rel_file IS NULL OR n.size IS DISTINCT FROM d.size OR n.mtime_ns IS DISTINCT FROM d.mtime_ns)""",
    "p6_found": """
        SELECT name FROM tags WHERE kind = 'def' AND name IS NOT NULL GROUP BY name HAVING count(DISTINCT rel_file) > 50""",
    "p6_names": """
        WITH t AS (
            SELECT name, count(*) FILTER (WHERE kind = 'def') AS n_defs, count(*) FILTER (WHERE kind = 'ref') AS n_refs,
                   count(DISTINCT rel_file) FILTER (WHERE kind = 'def') AS def_files, count(DISTINCT rel_file) AS files
            FROM tags WHERE name IS NOT NULL GROUP BY name),
        e AS (SELECT name, count(*) AS edges FROM refs WHERE name IS NOT NULL GROUP BY name)
        SELECT coalesce(t.name, e.name) AS name, CAST(coalesce(n_defs, 0) AS BIGINT) AS n_defs, CAST(coalesce(n_refs, 0) AS BIGINT) AS n_refs,
               CAST(coalesce(def_files, 0) AS BIGINT) AS def_files, CAST(coalesce(files, 0) AS BIGINT) AS files,
               CAST(coalesce(edges, 0) AS BIGINT) AS edges, coalesce(def_files, 0) > 50 AS belongs,
               coalesce(t.name, e.name) IN (SELECT name FROM stop_names WHERE name IS NOT NULL) AS listed
        FROM t FULL JOIN e ON t.name = e.name""",
}
