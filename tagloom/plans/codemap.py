"""Queries of the code map over its tables, each with the SQL that says what it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.functions import text as T
from tagloom.operators import content, edges, files, rank, render, resolve, search, serving, snapshot, spans, traverse
from tagloom.sources import extract
from tagloom.tables import load, nth, rel_of

ITERATIONS = 10
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _tags(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "tags")


def _files(s: SparkSession, d: str) -> DataFrame:
    """The files of documents with their size, one row a delivery."""
    return load(s, d, "documents", "rel_file", "text").filter("rel_file is not null").select("rel_file", F.octet_length("text").cast("long").alias("size"), "text")


def _refs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "refs")


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "tags", "rel_file").filter("rel_file is not null").distinct()


def _calls(s: SparkSession, d: str) -> DataFrame:
    return spans.call_edges(load(s, d, "tags", "file", "line", "name", "kind"), load(s, d, "symbols", "file", "line", "name", "type", "end_line"))


# --- sources and files -------------------------------------------------------------------------------------------------------

_BAD = "(" + "|".join(s.replace(".", r"\.") for s in files.SKIP_SUFFIXES) + ")$"
_DIRS = "|".join(f.replace(".", r"\.") for f in files.SKIP_DIRS)


@query("scan_discover", rf"""
    SELECT DISTINCT rel_file FROM documents WHERE rel_file IS NOT NULL AND text IS NOT NULL AND strlen(text) <= 1048576
      AND NOT regexp_matches(rel_file, '(^|/)({_DIRS})/') AND NOT regexp_matches(rel_file, '(^|/)\.[^/]*')
      AND NOT regexp_matches(lower(rel_file), '{_BAD}') AND NOT regexp_matches(lower(rel_file), '-[0-9a-f]{{8,64}}\.(js|css)$')
      AND len(string_split(rel_file, '/')) <= 25
      AND NOT coalesce(regexp_matches(lower(rel_file), '\.(js|css)$') AND length(text) > 2000
        AND list_max(list_transform(string_split(text[:65536], chr(10)), lambda x: length(x))) > 2000
        AND list_avg(list_transform(string_split(text[:65536], chr(10)), lambda x: length(x))) > 500, false)""")
def scan_discover(s, d):
    return files.discover(_files(s, d)).select("rel_file").distinct()


@query("scan_size_prefix", """
    WITH f AS (SELECT rel_file, max(strlen(text)) AS size FROM documents WHERE rel_file IS NOT NULL GROUP BY rel_file HAVING max(strlen(text)) IS NOT NULL),
    r AS (SELECT rel_file, CAST(size AS BIGINT) AS size, CAST(sum(size) OVER (ORDER BY rel_file) AS BIGINT) AS upto FROM f)
    SELECT * FROM r WHERE upto <= 500000""")
def scan_size_prefix(s, d):
    return files.size_prefix(_files(s, d).select("rel_file", "size"), 500_000)


@query("scan_depth_filter", "SELECT DISTINCT rel_file FROM documents WHERE rel_file IS NOT NULL AND len(string_split(rel_file, '/')) <= 3")
def scan_depth_filter(s, d):
    f = load(s, d, "documents", "rel_file").filter("rel_file is not null")
    return f.filter(F.size(F.split("rel_file", "/")) <= 3).distinct()


@query("lines_explode", r"""
    SELECT rel_file, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(l)) AS BIGINT) AS chars, CAST(count(*) FILTER (WHERE trim(l) = '') AS BIGINT) AS blank
    FROM (SELECT rel_file, unnest(string_split(text, chr(10))) AS l FROM documents WHERE rel_file IS NOT NULL AND text IS NOT NULL) GROUP BY rel_file""")
def lines_explode(s, d):
    e = load(s, d, "documents", "rel_file", "text").filter("rel_file is not null and text is not null").select("rel_file", F.explode(F.split("text", "\n")).alias("l"))
    return e.groupBy("rel_file").agg(F.count("*").alias("lines"), F.sum(F.length("l")).alias("chars"), F.count_if(F.trim("l") == "").alias("blank"))


@query("tags_count_by_kind", "SELECT kind, count(*) AS n FROM tags GROUP BY kind")
def tags_count_by_kind(s, d):
    return load(s, d, "tags", "kind").groupBy("kind").agg(F.count("*").alias("n"))


@query("tags_membership_count", "SELECT kind, count(*) AS n FROM tags WHERE rel_file IN (SELECT rel_file FROM file_flags) GROUP BY kind")
def tags_membership_count(s, d):
    few = load(s, d, "file_flags", "rel_file").filter("rel_file is not null").distinct()
    return load(s, d, "tags", "rel_file", "kind").join(few, "rel_file", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


_LANG = "CASE regexp_extract(lower(rel_file), '\\.([^./]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in T.EXTENSIONS.items()) + " END"


@query("lang_detect_join", f"SELECT DISTINCT rel_file, {_LANG} AS language FROM documents WHERE rel_file IS NOT NULL")
def lang_detect_join(s, d):
    f = load(s, d, "documents", "rel_file").filter("rel_file is not null").distinct().withColumn("extension", T.extension(F.col("rel_file")))
    return f.join(files.extension_table(s), "extension", "left").select("rel_file", "language")


_TALLY = f"""
    WITH f AS (SELECT rel_file, max(strlen(text)) AS size FROM documents WHERE rel_file IS NOT NULL GROUP BY rel_file),
    t AS (SELECT {_LANG} AS language, count(*) AS files, CAST(floor(coalesce(sum(size), 0) / 40) AS BIGINT) AS est_lines FROM f GROUP BY 1)"""


@query("lang_tally", _TALLY + " SELECT * FROM t")
def lang_tally(s, d):
    return files.language_tally(_files(s, d))


@query("lang_tally_top3", _TALLY + " SELECT language, files FROM t WHERE language IS NOT NULL ORDER BY files DESC, language LIMIT 3")
def lang_tally_top3(s, d):
    return lang_tally(s, d).filter("language is not null").orderBy(F.desc("files"), "language").limit(3).select("language", "files")


@query("probe_digest", _TALLY + """
    SELECT CAST(sum(files) AS BIGINT) AS total_files, CAST(sum(est_lines) AS BIGINT) AS est_lines,
      (SELECT string_agg(language, ',' ORDER BY files DESC, language) FROM (SELECT * FROM t WHERE language IS NOT NULL ORDER BY files DESC, language LIMIT 3)) AS top FROM t""")
def probe_digest(s, d):
    return files.probe_digest(_files(s, d))


_UNTAGGED = f"""
    SELECT rel_file, CASE WHEN regexp_matches(lower(rel_file), '{_BAD}') THEN 'skip-ext' WHEN text IS NULL THEN 'missing' WHEN trim(text, ' ') = '' THEN 'empty'
      WHEN {_LANG} IS NULL THEN 'no-grammar' ELSE 'parsed-zero-tags' END AS reason
    FROM (SELECT rel_file, max(text) AS text FROM documents WHERE rel_file IS NOT NULL GROUP BY rel_file)
    WHERE rel_file NOT IN (SELECT rel_file FROM tags WHERE rel_file IS NOT NULL)"""


@query("untagged_reason", _UNTAGGED)
def untagged_reason(s, d):
    return files.untagged_reason(_files(s, d), load(s, d, "tags", "rel_file"))


@query("file_flags_sync", f"""
    WITH n AS ({_UNTAGGED}), o AS (SELECT rel_file, max(reason) AS reason FROM file_flags WHERE rel_file IS NOT NULL AND reason IS NOT NULL GROUP BY rel_file)
    SELECT rel_file, reason FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE rel_file NOT IN (SELECT rel_file FROM n))
    WHERE rel_file NOT IN (SELECT rel_file FROM tags WHERE rel_file IS NOT NULL)""")
def file_flags_sync(s, d):
    t = load(s, d, "tags", "rel_file")
    return snapshot.sync_flags(load(s, d, "file_flags"), files.untagged_reason(_files(s, d), t), t)


@query("glob_exclude", "SELECT DISTINCT rel_file FROM tags WHERE rel_file IS NOT NULL AND NOT regexp_matches(rel_file, '^.*/tests/.*$|^.*\\.min\\.js$')")
def glob_exclude(s, d):
    return search.filter_paths(load(s, d, "tags", "rel_file"), exclude=["*/tests/*", "*.min.js"]).distinct()


@query("glob_include", "SELECT DISTINCT rel_file FROM tags WHERE regexp_matches(rel_file, '^.*/src/.*\\.[jt]s$')")
def glob_include(s, d):
    return search.filter_paths(load(s, d, "tags", "rel_file"), include=["*/src/*.[jt]s"]).distinct()


@query("test_path_flag", f"SELECT DISTINCT rel_file, regexp_matches(rel_file, '{T.TEST_PATH}') AS is_test FROM tags WHERE rel_file IS NOT NULL")
def test_path_flag(s, d):
    return files.test_files(load(s, d, "tags", "rel_file"))


@query("important_files", f"SELECT DISTINCT rel_file, regexp_matches(lower(rel_file), '{files.IMPORTANT}') AS important FROM documents WHERE rel_file IS NOT NULL")
def important_files(s, d):
    f = load(s, d, "documents", "rel_file").filter("rel_file is not null").distinct()
    return f.select("rel_file", F.lower("rel_file").rlike(files.IMPORTANT).alias("important"))


@query("minified_sniff", r"""
    SELECT DISTINCT rel_file FROM documents WHERE regexp_matches(lower(rel_file), '\.(js|css)$') AND length(text) > 2000
      AND list_max(list_transform(string_split(text[:65536], chr(10)), lambda x: length(x))) > 2000
      AND list_avg(list_transform(string_split(text[:65536], chr(10)), lambda x: length(x))) > 500""")
def minified_sniff(s, d):
    f = load(s, d, "documents", "rel_file", "text")
    return f.filter(files.minified_sniff(F.col("rel_file"), F.col("text"))).select("rel_file").distinct()


# --- names -------------------------------------------------------------------------------------------------------------------

_MARK = r"regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1' || chr(1) || '\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1' || chr(1) || '\2', 'g')"
_TOKENS = rf"list_transform(list_filter(regexp_split_to_array({_MARK}, '[\x01_\-\s./]+'), lambda x: x <> ''), lambda x: lower(x))"
_NAMES = "(SELECT DISTINCT name FROM tags WHERE name IS NOT NULL)"
_CANON = {w: T.canonical_of(w) for g in T.SYNONYMS + T.CONTENT_SYNONYMS for w in g.split()}


def _names(s, d):
    return load(s, d, "tags", "name").filter("name is not null").distinct()


@query("camel_tokens", f"SELECT name, array_to_string({_TOKENS}, ' ') AS tokens FROM {_NAMES}")
def camel_tokens(s, d):
    return _names(s, d).select("name", F.array_join(T.tokens(F.col("name")), " ").alias("tokens"))


@query("base_qual_scope", rf"""
    SELECT name, regexp_replace(regexp_replace(name, '(?s)^.*?::', ''), '(?s)\(.*$', '') AS base, regexp_replace(name, '(?s)\(.*$', '') AS qual,
      nullif(regexp_extract(regexp_replace(name, '(?s)\(.*$', ''), '(?s)^(.*)::', 1), '') AS scope FROM {_NAMES}""")
def base_qual_scope(s, d):
    n = F.col("name")
    return _names(s, d).select("name", T.base(n).alias("base"), T.qual(n).alias("qual"), T.scope(n).alias("scope"))


@query("boundary_rank", rf"""
    SELECT name, CASE WHEN lower(name) = 'page' THEN 0 WHEN list_contains(regexp_split_to_array(lower(name), '::|[._\-/\s#]'), 'page') THEN 1 ELSE 2 END AS rank FROM {_NAMES}""")
def boundary_rank(s, d):
    return _names(s, d).select("name", T.boundary_rank(F.col("name"), "page").alias("rank"))


@query("canonical_tokens", rf"""
    SELECT token, CASE token {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _CANON.items())} ELSE
      CASE WHEN token LIKE '%s' AND token <> 'news' THEN CASE token[:-2] {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _CANON.items())} ELSE token END ELSE token END END AS canonical
    FROM (SELECT DISTINCT unnest({_TOKENS}) AS token FROM {_NAMES})""")
def canonical_tokens(s, d):
    t = _names(s, d).select(F.explode(T.tokens(F.col("name"))).alias("token")).distinct()
    return t.select("token", T.canonical(F.col("token")).alias("canonical"))


@query("edit_distances", rf"""
    SELECT name, CAST(least(levenshtein(lower(regexp_replace(regexp_replace(name, '(?s)^.*?::', ''), '(?s)\(.*$', '')), 'update'), 3) AS INTEGER) AS d FROM {_NAMES}""")
def edit_distances(s, d):
    return _names(s, d).select("name", T.edit_distance(F.lower(T.base(F.col("name"))), "update").alias("d"))


@query("token_overlap_majority", f"""
    SELECT name, CAST(len(list_intersect(list_distinct({_TOKENS}), ['load', 'page', 'token'])) AS BIGINT) AS overlap FROM {_NAMES}
    WHERE len(list_intersect(list_distinct({_TOKENS}), ['load', 'page', 'token'])) * 2 > 3""")
def token_overlap_majority(s, d):
    return search.overlap_counts(load(s, d, "tags", "name"), "load_page_token").filter("overlap * 2 > 3")


@query("long_names", """
    SELECT CAST(coalesce(max(length(name)), 0) AS BIGINT) AS longest, count(*) FILTER (WHERE length(name) > 200) AS over_200,
      count(*) FILTER (WHERE length(name) > 500) AS over_500, count(*) FILTER (WHERE length(name) > 2000) AS over_2000 FROM tags""")
def long_names(s, d):
    return files.long_names(load(s, d, "tags", "name"))


# --- search ------------------------------------------------------------------------------------------------------------------


def _detect_sql(where: str, at: str, limit: int, kinds: str = "'def', 'ref'") -> str:
    return f"""
    WITH h AS (SELECT DISTINCT rel_file, line, name, kind FROM tags WHERE name IS NOT NULL AND rel_file IS NOT NULL AND kind IN ({kinds}) AND {where}),
    p AS (SELECT *, row_number() OVER (ORDER BY CAST(regexp_matches(rel_file, '{T.TEST_PATH}') AS INT), CAST(kind <> 'def' AS INT), {at}, rel_file, line NULLS FIRST, name, kind) AS pos FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY rel_file ORDER BY pos) AS round, min(pos) OVER (PARTITION BY rel_file) AS first FROM p)
    SELECT rel_file, line, name, kind, round FROM r ORDER BY round, first LIMIT {limit}"""


@query("detect_exact", _detect_sql("lower(name) = 'init'", "0", 50))
def detect_exact(s, d):
    return search.detect(_tags(s, d), "init", "exact", 50)


@query("detect_substring", _detect_sql("contains(lower(name), 'page')", "strpos(lower(name), 'page')", 100))
def detect_substring(s, d):
    return search.detect(_tags(s, d), "page", "substring", 100)


@query("detect_regex", _detect_sql("regexp_matches(name, '(?i)^(load|store)_.*_(page|token)$')", "0", 40))
def detect_regex(s, d):
    return search.detect(_tags(s, d), "^(load|store)_.*_(page|token)$", "regex", 40)


@query("detect_defs_only", _detect_sql("contains(lower(name), 'set')", "strpos(lower(name), 'set')", 60, "'def'"))
def detect_defs_only(s, d):
    return search.detect(_tags(s, d), "set", "substring", 60, references=False)


@query("detect_refs_only", _detect_sql("contains(lower(name), 'set')", "strpos(lower(name), 'set')", 60, "'ref'"))
def detect_refs_only(s, d):
    return search.detect(_tags(s, d), "set", "substring", 60, definitions=False)


_VARIANTS = T.query_variants("mapItems")
_WHICH = "CASE " + " ".join(f"WHEN contains(lower(name), '{v}') THEN {i}" for i, v in enumerate(_VARIANTS)) + " END"


@query("detect_variants", f"""
    WITH h AS (SELECT DISTINCT rel_file, line, name, kind, {_WHICH} AS variant FROM tags WHERE name IS NOT NULL AND rel_file IS NOT NULL AND {_WHICH} IS NOT NULL),
    p AS (SELECT *, row_number() OVER (ORDER BY variant, CAST(regexp_matches(rel_file, '{T.TEST_PATH}') AS INT), CAST(kind <> 'def' AS INT), rel_file, line NULLS FIRST, name, kind) AS pos FROM h),
    r AS (SELECT *, row_number() OVER (PARTITION BY rel_file ORDER BY pos) AS round, min(pos) OVER (PARTITION BY rel_file) AS first FROM p)
    SELECT rel_file, line, name, kind, CAST(variant AS BIGINT) AS variant, round FROM r ORDER BY round, first LIMIT 50""")
def detect_variants(s, d):
    return search.variants(_tags(s, d), "mapItems", 50)


_BASE = r"regexp_replace(regexp_replace(name, '(?s)^.*?::', ''), '(?s)\(.*$', '')"


@query("detect_fuzzy", rf"""
    WITH n AS (SELECT name, CAST(least(levenshtein(lower({_BASE}), 'updte'), 3) AS BIGINT) AS d, CAST(len(list_intersect(list_distinct({_TOKENS}), ['updte'])) AS BIGINT) AS overlap FROM {_NAMES}),
    h AS (SELECT DISTINCT t.rel_file, t.line, t.name, t.kind, n.d, n.overlap FROM tags t JOIN n ON t.name = n.name WHERE (n.d <= 2 OR n.overlap * 2 > 1) AND t.kind IN ('def', 'ref') AND t.rel_file IS NOT NULL),
    p AS (SELECT * FROM h ORDER BY d, overlap DESC, CAST(kind <> 'def' AS INT), name, rel_file, line LIMIT 80)
    SELECT * FROM p ORDER BY d, CAST(kind <> 'def' AS INT), name, rel_file, line LIMIT 40""")
def detect_fuzzy(s, d):
    return search.fuzzy(_tags(s, d), "updte", 40)


@query("detect_tiered", _detect_sql("contains(lower(name), 'walk')", "strpos(lower(name), 'walk')", 20).replace("SELECT rel_file, line, name, kind, round FROM", "SELECT rel_file, line, name, kind, round, 'exact' AS quality FROM"))
def detect_tiered(s, d):
    return search.tiered(_tags(s, d), "walk", limit=20)


@query("locate_best", """
    SELECT * FROM (SELECT DISTINCT rel_file, line, name, kind FROM tags WHERE contains(lower(name), 'walk') AND kind IN ('def', 'ref') AND rel_file IS NOT NULL) ORDER BY CAST(kind <> 'def' AS INT), CAST(name <> 'walk' AS INT), rel_file, line, name, kind LIMIT 1""")
def locate_best(s, d):
    return search.best_location(_tags(s, d), "walk")


_SYMBOL_ROWS = "SELECT file, line, name, type, max(signature) AS signature, max(docstring) AS docstring FROM symbols WHERE name IS NOT NULL AND file IS NOT NULL {} GROUP BY file, line, name, type"
_SYMBOL_COLS = r"""file, line, name, type, nullif(trim(regexp_replace(signature, '\s+', ' ', 'g'), ' '), '') AS signature,
      CASE WHEN length(docstring) <= 200 THEN docstring ELSE regexp_replace(docstring[:200], ' [^ ]*$', '') || '…' END AS docstring, CAST(greatest(0, coalesce(length(docstring), 0) - 200) AS BIGINT) AS docstring_omitted"""
_BOUND = r"CASE WHEN lower(name) = 'page' THEN 0 WHEN list_contains(regexp_split_to_array(lower(name), '::|[._\-/\s#]'), 'page') THEN 1 ELSE 2 END"


@query("symbols_ranked", f"""
    SELECT {_SYMBOL_COLS} FROM ({_SYMBOL_ROWS.format("AND contains(lower(name), 'page')")})
    ORDER BY {_BOUND}, CAST(regexp_matches(file, '{T.TEST_PATH}') AS INT), type, name, file, line LIMIT 100""")
def symbols_ranked(s, d):
    return search.symbols(load(s, d, "symbols"), "page", limit=100)


@query("symbols_type_filter", f"SELECT {_SYMBOL_COLS} FROM ({_SYMBOL_ROWS.format(chr(65) + 'ND type = ' + chr(39) + 'class' + chr(39) + ' AND contains(lower(file), ' + chr(39) + '/src/' + chr(39) + ')')}) ORDER BY type, name, file, line LIMIT 100")
def symbols_type_filter(s, d):
    return search.symbols(load(s, d, "symbols"), "", "class", "/src/", 100)


_SPELL = " OR ".join(f"contains(lower(name), '{v}')" for v in T.query_variants("closed"))


@query("symbols_rescue", rf"""
    WITH n AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL AND file IS NOT NULL AND type = 'function'),
    k AS (SELECT name, min(d) AS d FROM (
      SELECT name, CAST(least(levenshtein(lower({_BASE}), 'closed'), 3) AS BIGINT) AS d FROM n
        WHERE least(levenshtein(lower({_BASE}), 'closed'), 3) <= 2 OR len(list_intersect(list_distinct({_TOKENS}), ['closed'])) * 2 > 1
      UNION ALL SELECT name, 3 FROM n WHERE {_SPELL}) GROUP BY name)
    SELECT * FROM (SELECT DISTINCT s.file, s.line, s.name, s.type, k.d FROM symbols s JOIN k ON s.name = k.name WHERE s.file IS NOT NULL AND s.type = 'function')
    ORDER BY {_BOUND.replace("'page'", "'closed'")}, CAST(regexp_matches(file, '{T.TEST_PATH}') AS INT), d, type, name, file, line LIMIT 60""")
def symbols_rescue(s, d):
    return search.symbols_rescue(load(s, d, "symbols"), "closed", "function", 60)


@query("docstring_cap", f"SELECT {_SYMBOL_COLS} FROM ({_SYMBOL_ROWS.format('')}) WHERE length(docstring) > 200")
def docstring_cap(s, d):
    t = load(s, d, "symbols").filter("name is not null and file is not null").groupBy("file", "line", "name", "type").agg(F.max("signature").alias("signature"), F.max("docstring").alias("docstring"))
    doc = F.col("docstring")
    return t.filter(F.length(doc) > 200).select("file", "line", "name", "type", T.compact(F.col("signature")).alias("signature"), T.doc_head(doc).alias("docstring"), F.greatest(F.lit(0), F.length(doc) - 200).cast("long").alias("docstring_omitted"))


# --- edges and ranks ---------------------------------------------------------------------------------------------------------

_STOP = "SELECT name FROM tags WHERE kind = 'def' AND name IS NOT NULL GROUP BY name HAVING count(DISTINCT rel_file) > 50"
_BAG = f"""
    SELECT r.rel_file AS from_file, d.rel_file AS to_file, r.name FROM tags r JOIN tags d ON r.name = d.name
    WHERE r.kind = 'ref' AND d.kind = 'def' AND r.rel_file <> d.rel_file AND r.name NOT IN ({_STOP})"""


@query("stop_names_today", _STOP)
def stop_names_today(s, d):
    return edges.stop_names(_tags(s, d))


@query("stop_names_stale", f"""
    WITH n AS ({_STOP}), o AS (SELECT DISTINCT name FROM stop_names WHERE name IS NOT NULL)
    SELECT coalesce(n.name, o.name) AS name, CASE WHEN o.name IS NULL THEN 'missing' ELSE 'obsolete' END AS status FROM n FULL JOIN o ON n.name = o.name WHERE n.name IS NULL OR o.name IS NULL""")
def stop_names_stale(s, d):
    n = edges.stop_names(_tags(s, d)).withColumn("n", F.lit(1))
    o = load(s, d, "stop_names").select("name").filter("name is not null").distinct().withColumn("o", F.lit(1))
    return n.join(o, "name", "full").filter("n is null or o is null").select("name", F.when(F.col("o").isNull(), "missing").otherwise("obsolete").alias("status"))


@query("edges_bag", f"SELECT from_file, to_file, name, count(*) AS n FROM ({_BAG}) GROUP BY ALL")
def edges_bag(s, d):
    return edges.weighted_edges(_tags(s, d))


@query("edges_bag_rows", _BAG)
def edges_bag_rows(s, d):
    return edges.bag_edges(_tags(s, d))


@query("edges_set", f"SELECT DISTINCT from_file, to_file, name, CAST(1 AS BIGINT) AS n FROM ({_BAG})")
def edges_set(s, d):
    return edges.weighted_edges(_tags(s, d), distinct=True)


@query("refs_obsolete", f"SELECT from_file, to_file, name, count(*) AS n FROM refs WHERE name IN ({_STOP}) GROUP BY ALL")
def refs_obsolete(s, d):
    return _refs(s, d).join(edges.stop_names(_tags(s, d)), "name", "left_semi").groupBy("from_file", "to_file", "name").agg(F.count("*").alias("n"))


_DEG = "SELECT n.rel_file, CAST(coalesce(d.degree, 0) AS BIGINT) AS degree FROM (SELECT DISTINCT rel_file FROM tags WHERE rel_file IS NOT NULL) n LEFT JOIN (SELECT from_file, count(*) AS degree FROM refs GROUP BY 1) d ON n.rel_file = d.from_file"


@query("out_degree", _DEG)
def out_degree(s, d):
    return edges.out_degree(_refs(s, d), _nodes(s, d))


@query("dangling_nodes", f"SELECT rel_file FROM ({_DEG}) WHERE degree = 0")
def dangling_nodes(s, d):
    return out_degree(s, d).filter("degree = 0").select("rel_file")


def _rank_sql(iterations: int, jump: str = "1.0 / n.n", spread: str = "1.0 / n.n", start: str = "1.0 / n.n") -> str:
    parts = [f"""
    WITH nodes AS MATERIALIZED (SELECT DISTINCT rel_file FROM tags WHERE rel_file IS NOT NULL), n AS (SELECT count(*) AS n FROM nodes),
    e AS MATERIALIZED (SELECT from_file, to_file, count(*) AS c FROM refs WHERE from_file IS NOT NULL GROUP BY 1, 2), deg AS MATERIALIZED (SELECT from_file, sum(c) AS deg FROM e GROUP BY 1),
    w AS MATERIALIZED (SELECT e.from_file, e.to_file, e.c / deg.deg AS w FROM e JOIN deg ON e.from_file = deg.from_file WHERE e.to_file IN (SELECT rel_file FROM nodes)),
    r0 AS MATERIALIZED (SELECT rel_file, {start} AS rank FROM nodes, n)"""]
    for i in range(iterations):
        parts.append(f"""m{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS m FROM r{i} WHERE rel_file NOT IN (SELECT from_file FROM deg)),
    a{i} AS MATERIALIZED (SELECT x.rel_file, 0.15 * ({jump}) + 0.85 * (coalesce(c.came, 0) + m{i}.m * ({spread})) AS raw FROM nodes x CROSS JOIN n CROSS JOIN m{i}
        LEFT JOIN (SELECT w.to_file, sum(r.rank * w.w) AS came FROM w JOIN r{i} r ON w.from_file = r.rel_file GROUP BY 1) c ON x.rel_file = c.to_file),
    r{i + 1} AS MATERIALIZED (SELECT rel_file, raw / (SELECT sum(raw) FROM a{i}) AS rank FROM a{i})""")  # fmt: skip
    return ",\n".join(parts)


@query("pagerank_files", _rank_sql(ITERATIONS) + f" SELECT rel_file, round(rank, 9) AS rank FROM r{ITERATIONS}")
def pagerank_files(s, d):
    return rank.pagerank(_refs(s, d), _nodes(s, d), iterations=ITERATIONS).select("rel_file", F.round("rank", 9).alias("rank"))


_JUMP = "CASE WHEN x.rel_file LIKE 'quillstone/%' THEN 1.0 ELSE 0.0 END / (SELECT count(*) FROM nodes WHERE rel_file LIKE 'quillstone/%')"


@query("pagerank_personalized", _rank_sql(5, _JUMP, _JUMP) + " SELECT rel_file, round(rank, 9) AS rank FROM r5")
def pagerank_personalized(s, d):
    n = _nodes(s, d)
    return rank.pagerank(_refs(s, d), n, iterations=5, teleport=n.filter("rel_file like 'quillstone/%'").withColumn("weight", F.lit(1.0))).select("rel_file", F.round("rank", 9).alias("rank"))


def _settled_sql(most: int) -> str:
    """Steps until one changes less than the tolerance; the vector is frozen from then on."""
    parts = [_rank_sql(0), "d0 AS (SELECT false AS done)"]
    for i in range(most):
        parts.append(f"""m{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS m FROM r{i} WHERE rel_file NOT IN (SELECT from_file FROM deg)),
    a{i} AS MATERIALIZED (SELECT x.rel_file, x.rank AS old, 0.15 / n.n + 0.85 * (coalesce(c.came, 0) + m{i}.m / n.n) AS raw FROM r{i} x CROSS JOIN n CROSS JOIN m{i}
        LEFT JOIN (SELECT w.to_file, sum(r.rank * w.w) AS came FROM w JOIN r{i} r ON w.from_file = r.rel_file GROUP BY 1) c ON x.rel_file = c.to_file),
    r{i + 1} AS MATERIALIZED (SELECT rel_file, CASE WHEN (SELECT done FROM d{i}) THEN old ELSE raw / (SELECT sum(raw) FROM a{i}) END AS rank FROM a{i}),
    d{i + 1} AS MATERIALIZED (SELECT (SELECT done FROM d{i}) OR sum(abs(y.rank - x.rank)) < 1e-6 AS done FROM r{i} x JOIN r{i + 1} y ON x.rel_file = y.rel_file)""")  # fmt: skip
    return ",\n".join(parts)


@query("pagerank_converged", _settled_sql(30) + " SELECT rel_file, round(rank, 9) AS rank FROM r30")
def pagerank_converged(s, d):
    return rank.pagerank(_refs(s, d), _nodes(s, d), most=30).select("rel_file", F.round("rank", 9).alias("rank"))


_RANKS = "SELECT rel_file, max(rank) AS rank FROM file_ranks WHERE rel_file IS NOT NULL AND rank IS NOT NULL GROUP BY rel_file"
_RANKED = f"SELECT k.rank, t.rel_file, t.line, t.name, t.kind FROM (SELECT DISTINCT rel_file, line, name, kind FROM tags WHERE kind = 'def' AND name IS NOT NULL) t JOIN ({_RANKS}) k ON t.rel_file = k.rel_file"


def _stored_ranks(s, d):
    return load(s, d, "file_ranks").filter("rel_file is not null and rank is not null").groupBy("rel_file").agg(F.max("rank").alias("rank"))


@query("ranked_tags", _RANKED + " ORDER BY rank DESC, rel_file, line, name LIMIT 500")
def ranked_tags(s, d):
    return rank.boosted(_stored_ranks(s, d), _tags(s, d)).orderBy(F.desc("rank"), "rel_file", "line", "name").limit(500)


_BOOST = "k.rank * CASE WHEN t.name IN ('init', 'close') THEN 10.0 ELSE 1.0 END * CASE WHEN t.rel_file LIKE 'quillstone/tools/%' THEN 20.0 ELSE 1.0 END"


@query("ranked_tags_boosted", f"SELECT round({_BOOST}, 9) AS rank, t.rel_file, t.line, t.name, t.kind FROM (SELECT DISTINCT rel_file, line, name, kind FROM tags WHERE kind = 'def' AND name IS NOT NULL) t JOIN ({_RANKS}) k ON t.rel_file = k.rel_file ORDER BY {_BOOST} DESC, t.rel_file, t.line, t.name LIMIT 500")
def ranked_tags_boosted(s, d):
    b = rank.boosted(_stored_ranks(s, d), _tags(s, d), idents=["init", "close"], chat=F.col("rel_file").like("quillstone/tools/%"))
    return b.orderBy(F.desc("rank"), "rel_file", "line", "name").limit(500).withColumn("rank", F.round("rank", 9))


@query("exclude_unranked", f"SELECT rel_file, rank FROM ({_RANKS}) WHERE rank > 0.0001")
def exclude_unranked(s, d):
    return _stored_ranks(s, d).filter("rank > 0.0001")


@query("dedupe_keep_first", "SELECT rel_file, line, name, kind, count(*) AS copies FROM tags GROUP BY ALL HAVING count(*) > 1")
def dedupe_keep_first(s, d):
    return load(s, d, "tags", "rel_file", "line", "name", "kind").groupBy("rel_file", "line", "name", "kind").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("map_budget_prefix", f"""
    WITH o AS (SELECT *, row_number() OVER (ORDER BY rank DESC, rel_file, line, name) AS position, greatest(1, CAST(ceil(length(rel_file || name) / 4) AS BIGINT)) AS cost FROM ({_RANKED})),
    c AS (SELECT *, CAST(sum(cost) OVER (ORDER BY position) AS BIGINT) AS spent FROM o)
    SELECT rank, rel_file, line, name, kind, position, spent FROM c WHERE spent <= 2048 OR position = 1""")
def map_budget_prefix(s, d):
    r = rank.boosted(_stored_ranks(s, d), _tags(s, d))
    cost = F.ceil(F.length(F.concat("rel_file", "name")) / 4)
    return rank.budget_prefix(r, [F.desc("rank"), "rel_file", "line", "name"], cost, 2048)


@query("map_ranked_live", _settled_sql(30).replace("FROM refs WHERE from_file IS NOT NULL GROUP BY 1, 2", f"FROM ({_BAG}) GROUP BY 1, 2") + """,
    o AS (SELECT *, row_number() OVER (ORDER BY rank DESC, rel_file, line, name) AS position, greatest(1, CAST(ceil(length(rel_file || name) / 4) AS BIGINT)) AS cost
      FROM (SELECT round(k.rank, 9) AS rank, t.rel_file, t.line, t.name, t.kind FROM (SELECT DISTINCT rel_file, line, name, kind FROM tags WHERE kind = 'def' AND name IS NOT NULL) t JOIN r30 k ON t.rel_file = k.rel_file)),
    c AS (SELECT *, CAST(sum(cost) OVER (ORDER BY position) AS BIGINT) AS spent FROM o)
    SELECT rank, rel_file, line, name, kind, position, spent FROM c WHERE spent <= 2048 OR position = 1""")
def map_ranked_live(s, d):
    ranks = rank.pagerank(edges.weighted_edges(_tags(s, d)), _nodes(s, d), most=30).withColumn("rank", F.round("rank", 9))
    r = rank.boosted(ranks, _tags(s, d))
    return rank.budget_prefix(r, [F.desc("rank"), "rel_file", "line", "name"], F.ceil(F.length(F.concat("rel_file", "name")) / 4), 2048)


@query("map_json_prefix")
def map_json_prefix(s, d):
    return render.json_prefix(map_budget_prefix(s, d), 2048)


@query("map_text", f"""
    WITH o AS (SELECT *, row_number() OVER (ORDER BY rank DESC, rel_file, line, name) AS position, greatest(1, CAST(ceil(length(rel_file || name) / 4) AS BIGINT)) AS cost FROM ({_RANKED})),
    c AS (SELECT *, sum(cost) OVER (ORDER BY position) AS spent FROM o)
    SELECT rel_file, rel_file || chr(10) || string_agg(line || ': ' || name, chr(10) ORDER BY line, name) AS block FROM c WHERE spent <= 2048 OR position = 1 GROUP BY rel_file""")
def map_text(s, d):
    return render.map_text(map_budget_prefix(s, d))


_TOP = f"(SELECT rel_file, row_number() OVER (ORDER BY rank DESC, rel_file) - 1 AS id FROM ({_RANKS}) ORDER BY rank DESC, rel_file LIMIT 20)"


@query("induced_subgraph_topn", f"SELECT from_file, to_file, count(*) AS n FROM refs WHERE from_file IN (SELECT rel_file FROM {_TOP}) AND to_file IN (SELECT rel_file FROM {_TOP}) GROUP BY 1, 2")
def induced_subgraph_topn(s, d):
    return rank.top_subgraph(_stored_ranks(s, d), _refs(s, d), 20)


@query("mermaid_edges", f"""
    WITH t AS {_TOP}, l AS (
      SELECT 0 AS part, 0 AS a, 0 AS b, 'graph LR' AS text UNION ALL SELECT 1, id, 0, '  N' || id || '["' || rel_file || '"]' FROM t
      UNION ALL SELECT DISTINCT 2, x.id, y.id, '  N' || x.id || ' --> N' || y.id FROM refs r JOIN t x ON r.from_file = x.rel_file JOIN t y ON r.to_file = y.rel_file)
    SELECT row_number() OVER (ORDER BY part, a, b) - 1 AS position, text FROM l""")
def mermaid_edges(s, d):
    return render.mermaid(_stored_ranks(s, d), _refs(s, d))


@query("rank_parity", f"""
    WITH o AS (SELECT rel_file, row_number() OVER (ORDER BY rank DESC, rel_file) AS p FROM ({_RANKS}) ORDER BY p LIMIT 100),
    n AS (SELECT to_file AS rel_file, row_number() OVER (ORDER BY c DESC, to_file) AS p FROM (SELECT to_file, count(*) AS c FROM refs GROUP BY 1) ORDER BY p LIMIT 100)
    SELECT coalesce(o.rel_file, n.rel_file) AS rel_file, o.p AS stored, n.p AS by_edges FROM o FULL JOIN n ON o.rel_file = n.rel_file""")
def rank_parity(s, d):
    from pyspark.sql import Window

    top = lambda df, c, a: df.orderBy(F.desc(c), "rel_file").limit(100).withColumn(a, F.row_number().over(Window.orderBy(F.desc(c), "rel_file")).cast("long")).select("rel_file", a)
    e = _refs(s, d).groupBy(F.col("to_file").alias("rel_file")).agg(F.count("*").alias("c"))
    return top(_stored_ranks(s, d), "rank", "stored").join(top(e, "c", "by_edges"), "rel_file", "full")


# --- budgets -----------------------------------------------------------------------------------------------------------------


@query("token_total", "SELECT source, count(*) AS docs, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_total(s, d):
    return load(s, d, "documents", "source", "text").groupBy("source").agg(F.count("*").alias("docs"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query("token_sampled", r"""
    WITH l AS (SELECT doc_id, length(text) AS n, string_split(text, chr(10)) AS ls FROM documents WHERE length(text) >= 200),
    x AS (SELECT doc_id, n, list_filter(ls, lambda v, i: (i - 1) % greatest(1, len(ls) // 100) = 0) AS picked FROM l),
    c AS (SELECT doc_id, n, list_sum(list_transform(picked, lambda v: length(v) + 1)) AS chars, list_sum(list_transform(picked, lambda v: ceil((length(v) + 1) / 4))) AS tokens FROM x)
    SELECT doc_id, CAST(round(tokens * n / chars) AS BIGINT) AS tokens FROM c
    UNION ALL SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) FROM documents WHERE length(text) < 200""")
def token_sampled(s, d):
    t = load(s, d, "documents", "doc_id", "text").filter("text is not null")
    ls = F.split("text", "\n")
    step = F.greatest(F.lit(1), F.floor(F.size(ls) / 100))
    picked = t.filter(F.length("text") >= 200).select("doc_id", F.length("text").alias("n"), F.filter(ls, lambda v, i: i % step == 0).alias("p"))
    total = lambda f: F.aggregate(F.transform("p", f), F.lit(0.0), lambda a, x: a + x)
    long = picked.select("doc_id", F.round(total(lambda v: F.ceil((F.length(v) + 1) / 4).cast("double")) * F.col("n") / total(lambda v: (F.length(v) + 1).cast("double"))).cast("long").alias("tokens"))
    return long.unionByName(t.filter(F.length("text") < 200).select("doc_id", T.token_estimate(F.col("text")).alias("tokens")))


@query("coverage_pct", """
    WITH f AS (SELECT DISTINCT rel_file FROM documents WHERE rel_file IS NOT NULL), c AS (SELECT count(*) AS considered, count(*) FILTER (WHERE rel_file IN (SELECT rel_file FROM tags WHERE kind = 'def')) AS covered FROM f)
    SELECT considered, covered, round(100.0 * covered / considered, 1) AS coverage_pct, round(100.0 * covered / considered, 1) < 60 AS low FROM c""")
def coverage_pct(s, d):
    return files.coverage(load(s, d, "documents", "rel_file"), _tags(s, d))


@query("savings_pct", """
    SELECT source, CAST(sum(ceil(length(text) / 4)) AS BIGINT) AS full_tokens, CAST(round(greatest(0.0, 1 - 2048.0 / sum(ceil(length(text) / 4))) * 100, 1) AS DOUBLE) AS savings_pct
    FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY source""")
def savings_pct(s, d):
    t = load(s, d, "documents", "source", "text").filter("text is not null and text != ''").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("full_tokens"))
    return t.withColumn("savings_pct", F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2048.0) / F.col("full_tokens")) * 100, 1))


@query("dry_run_estimate", f"""
    WITH t AS (SELECT * FROM ({_RANKED}) ORDER BY rank DESC, rel_file, line, name LIMIT 10)
    SELECT round(avg(ceil(length(rel_file || name) / 4)), 6) AS tokens_per_tag, CAST(floor(2048 / avg(ceil(length(rel_file || name) / 4))) AS BIGINT) AS tags_at_budget FROM t""")
def dry_run_estimate(s, d):
    t = rank.boosted(_stored_ranks(s, d), _tags(s, d)).orderBy(F.desc("rank"), "rel_file", "line", "name").limit(10)
    per = F.avg(F.ceil(F.length(F.concat("rel_file", "name")) / 4))
    return t.agg(F.round(per, 6).alias("tokens_per_tag"), F.floor(F.lit(2048) / per).cast("long").alias("tags_at_budget"))


@query("default_budget", "SELECT repo, count(DISTINCT rel_file) AS files, CAST(greatest(2048, ceil(count(DISTINCT rel_file) * 0.5)) AS BIGINT) AS budget FROM documents WHERE rel_file IS NOT NULL GROUP BY repo")
def default_budget(s, d):
    f = load(s, d, "documents", "repo", "rel_file").filter("rel_file is not null").distinct().groupBy("repo").agg(F.count("*").alias("files"))
    return f.withColumn("budget", T.default_budget(F.col("files")))


@query("scan_advisory", """
    WITH f AS (SELECT repo, count(DISTINCT rel_file) AS files FROM documents WHERE rel_file IS NOT NULL GROUP BY repo)
    SELECT repo, files, round(greatest(5.0, 50.6 / 6046 * files), 6) AS est_seconds, CASE WHEN files < 200 THEN 'search text' ELSE 'index' END AS advice,
      CAST(greatest(1, round(greatest(5.0, 50.6 / 6046 * files) / 225)) AS BIGINT) AS break_even FROM f""")
def scan_advisory(s, d):
    f = load(s, d, "documents", "repo", "rel_file").filter("rel_file is not null").distinct().groupBy("repo").agg(F.count("*").alias("files"))
    sec = F.greatest(F.lit(5.0), F.lit(50.6 / 6046) * F.col("files"))
    return f.select("repo", "files", F.round(sec, 6).alias("est_seconds"), F.when(F.col("files") < 200, "search text").otherwise("index").alias("advice"), F.greatest(F.lit(1), F.round(sec / 225)).cast("long").alias("break_even"))


# --- spans and calls ---------------------------------------------------------------------------------------------------------

_SPANS = """
    WITH l AS (SELECT rel_file, max(len(string_split(text, chr(10)))) AS n FROM documents WHERE rel_file IS NOT NULL AND text IS NOT NULL GROUP BY 1),
    d AS (SELECT DISTINCT rel_file, name, line FROM tags WHERE kind = 'def' AND name IS NOT NULL AND rel_file IS NOT NULL AND line IS NOT NULL),
    x AS (SELECT *, lead(line) OVER (PARTITION BY rel_file ORDER BY line, name) AS nx FROM d)
    SELECT x.rel_file, x.name, x.line, CAST(least(coalesce(nx - 1, l.n, x.line + 79), x.line + 79) AS INTEGER) AS end_line FROM x LEFT JOIN l ON x.rel_file = l.rel_file"""


@query("def_spans", _SPANS)
def def_spans(s, d):
    return spans.def_spans(_tags(s, d), load(s, d, "documents", "rel_file", "text"))


@query("class_carry_forward", """
    WITH s AS (SELECT DISTINCT file, line, name, type FROM symbols WHERE file IS NOT NULL AND line IS NOT NULL AND name IS NOT NULL),
    c AS (SELECT *, last_value(CASE WHEN type = 'class' THEN name END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line, name, type NULLS FIRST ROWS UNBOUNDED PRECEDING) AS cls FROM s)
    SELECT file, line, name, CASE WHEN cls IS NOT NULL AND NOT contains(name, '::') THEN cls || '::' || name ELSE name END AS qualified FROM c WHERE type = 'method'""")
def class_carry_forward(s, d):
    return spans.carry_class(load(s, d, "symbols", "file", "line", "name", "type"))


_SYM = "SELECT file, line, name, max(type) AS type, CASE WHEN max(end_line) > line THEN max(end_line) ELSE line + 10 END AS e FROM symbols WHERE file IS NOT NULL AND line IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2, 3"
_POINTS = "SELECT DISTINCT file, line AS at, name FROM tags WHERE kind = 'ref' AND name IS NOT NULL AND file IS NOT NULL AND line IS NOT NULL"


def _inner(where: str) -> str:
    return f"""SELECT p.file, p.at, p.name, s.name AS caller, s.line AS caller_line, s.type AS caller_type FROM ({_POINTS}) p JOIN ({_SYM}) s ON p.file = s.file AND p.at BETWEEN s.line AND s.e {where}
        QUALIFY row_number() OVER (PARTITION BY p.file, p.at, p.name ORDER BY s.e - s.line, s.line, s.name) = 1"""


_CALLS = _inner("AND s.type IN ('function', 'method')")


@query("innermost_symbol", _CALLS)
def innermost_symbol(s, d):
    return _calls(s, d)


@query("innermost_class", _inner("AND s.type = 'class'").replace("caller_type", "caller_type"))
def innermost_class(s, d):
    c = spans.symbol_spans(load(s, d, "symbols", "file", "line", "name", "type", "end_line")).filter("type = 'class'")
    return spans.innermost(spans.ref_points(load(s, d, "tags", "file", "line", "name", "kind")), c).select("file", "at", "name", F.col("in_name").alias("caller"), F.col("in_line").alias("caller_line"), F.col("in_type").alias("caller_type"))


@query("callers_top8", f"""
    SELECT name, caller, file, line, nth FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, line, caller) AS nth FROM (SELECT DISTINCT name, caller, file, caller_line AS line FROM ({_CALLS}))) WHERE nth <= 8""")
def callers_top8(s, d):
    return spans.top_callers(_calls(s, d))


@query("callees_top4", f"""
    SELECT file, caller, caller_line, name, "at", nth FROM (SELECT *, row_number() OVER (PARTITION BY file, caller, caller_line ORDER BY "at", name) AS nth
      FROM (SELECT file, caller, caller_line, name, min("at") AS "at" FROM ({_CALLS}) GROUP BY 1, 2, 3, 4)) WHERE nth <= 4""")
def callees_top4(s, d):
    return spans.top_callees(_calls(s, d))


@query("callees_in_span", f"""
    WITH s AS ({_SPANS}) SELECT s.rel_file, s.name, s.line, count(*) AS refs FROM s JOIN (SELECT DISTINCT rel_file, line, name FROM tags WHERE kind = 'ref' AND name IS NOT NULL) r
      ON s.rel_file = r.rel_file AND r.line BETWEEN s.line AND s.end_line GROUP BY 1, 2, 3""")
def callees_in_span(s, d):
    t = _tags(s, d)
    r = t.filter("kind = 'ref' and name is not null and rel_file is not null").select("rel_file", F.col("line").alias("at"), "name").distinct()
    sp = spans.def_spans(t, load(s, d, "documents", "rel_file", "text"))
    b = sp.filter("end_line >= line").withColumn("_b", F.explode(F.sequence(F.floor(F.col("line") / spans.BUCKET), F.floor(F.col("end_line") / spans.BUCKET))))
    hit = b.join(r.select("rel_file", "at", F.floor(F.col("at") / spans.BUCKET).alias("_b")), ["rel_file", "_b"]).filter(F.col("at").between(F.col("line"), F.col("end_line")))
    return hit.groupBy("rel_file", "name", "line").agg(F.count("*").alias("refs"))


@query("first_def_resolution", """
    WITH d AS (SELECT rel_file, name, line FROM tags WHERE kind = 'def' AND name IS NOT NULL AND rel_file IS NOT NULL AND line IS NOT NULL),
    own AS (SELECT rel_file, name, min(line) AS line FROM d GROUP BY 1, 2), any_ AS (SELECT name, rel_file, line FROM d QUALIFY row_number() OVER (PARTITION BY name ORDER BY rel_file, line) = 1),
    r AS (SELECT DISTINCT rel_file, name FROM tags WHERE kind = 'ref' AND name IS NOT NULL)
    SELECT r.rel_file, r.name, CASE WHEN own.line IS NOT NULL THEN r.rel_file ELSE any_.rel_file END AS def_file, coalesce(own.line, any_.line) AS def_line, own.line IS NOT NULL AS local
    FROM r LEFT JOIN own ON r.rel_file = own.rel_file AND r.name = own.name LEFT JOIN any_ ON r.name = any_.name""")
def first_def_resolution(s, d):
    t = _tags(s, d)
    return spans.resolve_definitions(t.filter("kind = 'ref'"), t)


@query("first_name_index", "SELECT file, name, min(line) AS line FROM symbols WHERE file IS NOT NULL AND line IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2")
def first_name_index(s, d):
    return spans.first_name(load(s, d, "symbols", "file", "name", "line"))


@query("self_references", f"SELECT file, \"at\", name, caller_line FROM ({_CALLS}) WHERE regexp_replace(regexp_replace(caller, '(?s)^.*?::', ''), '(?s)\\(.*$', '') = name")
def self_references(s, d):
    return spans.self_references(_calls(s, d))


@query("call_graph_per_file", f"SELECT file, count(*) AS calls, count(DISTINCT caller) AS callers, count(DISTINCT name) AS callees FROM ({_CALLS}) GROUP BY file")
def call_graph_per_file(s, d):
    return _calls(s, d).groupBy("file").agg(F.count("*").alias("calls"), F.count_distinct("caller").alias("callers"), F.count_distinct("name").alias("callees"))


# --- traversal ---------------------------------------------------------------------------------------------------------------


_WALK = ["hop", "from_name", "from_file", "from_line", "to_name", "to_file", "to_line"]


def _up(depth: int, seed: str, extra: str = "true") -> str:
    out = [f"WITH c AS MATERIALIZED (SELECT DISTINCT caller, file, caller_line, name FROM ({_CALLS}) WHERE {extra})", f"f0 AS (SELECT CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line, '{seed}' AS name)", "v0 AS (SELECT * FROM f0)"]
    for h in range(1, depth + 2):
        out.append(f"k{h} AS (SELECT * FROM (SELECT *, {_BASE} AS key FROM f{h - 1}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY file NULLS FIRST, line NULLS FIRST, name) = 1)")
        out.append(f"e{h} AS MATERIALIZED (SELECT DISTINCT {h} AS hop, c.caller AS from_name, c.file AS from_file, c.caller_line AS from_line, k.name AS to_name, k.file AS to_file, k.line AS to_line FROM c JOIN k{h} k ON c.name = k.key)")
        out.append(f"f{h} AS MATERIALIZED (SELECT DISTINCT from_file AS file, from_line AS line, from_name AS name FROM e{h} EXCEPT SELECT * FROM v{h - 1})")
        out.append(f"v{h} AS (SELECT * FROM v{h - 1} UNION SELECT * FROM f{h})")
    return ",\n".join(out) + "\nSELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM e{h}" for h in range(1, depth + 2)) + ")"


def _down(depth: int, start: str, calls: str = _CALLS) -> str:
    d = f"SELECT DISTINCT file, line, name, {_BASE} AS key FROM tags WHERE kind = 'def' AND name IS NOT NULL AND file IS NOT NULL AND line IS NOT NULL"
    out = [f"WITH c AS MATERIALIZED (SELECT DISTINCT caller, file, caller_line, name FROM ({calls}))", f"d AS MATERIALIZED ({d})", f"f0 AS MATERIALIZED ({start})", "v0 AS (SELECT * FROM f0)"]
    for h in range(1, depth + 2):
        out.append(f"e{h} AS MATERIALIZED (SELECT DISTINCT {h} AS hop, f.name AS from_name, f.file AS from_file, f.line AS from_line, d.name AS to_name, d.file AS to_file, d.line AS to_line FROM f{h - 1} f JOIN c ON c.file = f.file AND c.caller_line = f.line JOIN d ON c.name = d.key)")
        out.append(f"f{h} AS MATERIALIZED (SELECT DISTINCT to_file AS file, to_line AS line, to_name AS name FROM e{h} EXCEPT SELECT * FROM v{h - 1})")
        out.append(f"v{h} AS (SELECT * FROM v{h - 1} UNION SELECT * FROM f{h})")
    return ",\n".join(out) + "\nSELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM e{h}" for h in range(1, depth + 2)) + ")"


def _walk(s, d, text):
    return traverse.run(text, load(s, d, "tags", "file", "rel_file", "line", "name", "kind"), symbols=load(s, d, "symbols", "file", "line", "name", "type", "end_line"))


@query("bfs_callers_depth1", _up(1, "fetch_vabomu_batch"))
def bfs_callers_depth1(s, d):
    return _walk(s, d, "callers('fetch_vabomu_batch') depth=1 limit=1000000")[1].select(*_WALK)


@query("bfs_callers_depth2", _up(2, "fetch_vabomu_batch"))
def bfs_callers_depth2(s, d):
    return _walk(s, d, "callers('fetch_vabomu_batch') depth=2 limit=1000000")[1].select(*_WALK)


@query("tests_for", _up(1, "drain_vabomu_budget", f"regexp_matches(file, '{T.TEST_PATH}')"))
def tests_for(s, d):
    return _walk(s, d, "tests_for('drain_vabomu_budget') limit=1000000")[1].select(*_WALK)


_START = f"SELECT DISTINCT file, line, name FROM tags WHERE kind = 'def' AND {_BASE} = 'fetch_vabomu_batch' AND file IS NOT NULL AND line IS NOT NULL"


@query("bfs_callees", _down(1, _START))
def bfs_callees(s, d):
    return _walk(s, d, "callees('fetch_vabomu_batch') limit=none")[1].select(*_WALK)


@query("chained_query", _down(1, "SELECT DISTINCT file, line, name FROM (SELECT CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line, 'fetch_vabomu_batch' AS name UNION SELECT file, caller_line, caller FROM (" + _CALLS + ") WHERE name = 'fetch_vabomu_batch' AND NOT regexp_matches(file, '^.*/tests/.*$'))"))
def chained_query(s, d):
    e = _walk(s, d, "callers('fetch_vabomu_batch') exclude='*/tests/*' limit=none | callees('x') limit=none")[1]
    return e.filter("step = 1").select(*_WALK)


def _site_sql(name: str, kind: str, limit: int) -> str:
    return f"SELECT DISTINCT rel_file, line, name FROM tags WHERE kind = '{kind}' AND rel_file IS NOT NULL AND {_BASE} = '{name}' ORDER BY rel_file, line, name LIMIT {limit}"


@query("refs_of", _site_sql("update", "ref", 200))
def refs_of(s, d):
    return traverse.references(traverse.Step("refs", "update", limit=200), _tags(s, d))


@query("defs_of", _site_sql("update", "def", 200))
def defs_of(s, d):
    return traverse.definitions(traverse.Step("defs", "update", limit=200), _tags(s, d))


@query("scope_filter", rf"""SELECT DISTINCT rel_file, line, name FROM tags WHERE kind = 'def' AND rel_file IS NOT NULL AND {_BASE} = 'clip_ricupra_cache'
    AND (nullif(regexp_extract(regexp_replace(name, '(?s)\(.*$', ''), '(?s)^(.*)::', 1), '') = 'Ricupra' OR (NOT contains(name, '::') AND regexp_extract(rel_file, '([^/]+?)(?:\.[^./]+)?$', 1) = 'Ricupra'))""")
def scope_filter(s, d):
    return traverse.definitions(traverse.Step("defs", "Ricupra::clip_ricupra_cache", limit=200), _tags(s, d))


# --- resolution --------------------------------------------------------------------------------------------------------------

#: Import statements of one line, per language: extension, pattern, local name, qualified name, module, whether from-import.
_FORMS = [
    ("py", r"^import (\S+)$", "{1}", "{1}", "{1}", "false"), ("py", r"^from ([\w.]+) import (\w+)$", "{2}", "{1} || '.' || {2}", "{1}", "true"),
    ("js|ts", r'^import \{ (\w+) \} from "([^"]+)";$', "{1}", "{2} || '.' || {1}", "{2}", "true"), ("go", r'^"([^"]+/)?([^"/]+)"$', "{2}", "{1} || {2}", "{1} || {2}", "false"),
    ("java", r"^import ([\w.]+)\.(\w+);$", "{2}", "{1} || '.' || {2}", "{1}", "true"), ("rs", r"^use ([\w:]+)::(\w+);$", "{2}", "{1} || '::' || {2}", "{1}", "true"),
    ("c", r'^#include [<"](\w+)(\.\w+)[>"]$', "{1}", "{1} || {2}", "{1} || {2}", "false"), ("rb", r'^require "(\w+)"$', "{1}", "{1}", "{1}", "false"),
]


def _form_sql(ext: str, pattern: str, local: str, name: str, module: str, from_: str) -> str:
    parts = ["", *(f"regexp_extract(l, '{pattern}', {i})" for i in (1, 2))]
    local, name, module = (x.replace("{1}", parts[1]).replace("{2}", parts[2]) for x in (local, name, module))
    return f"SELECT DISTINCT rel_file AS source_file, {local} AS local_name, {name} AS qualified_name, {module} AS source_module, {from_} AS is_from_import, false AS is_star, false AS is_static, line FROM lines WHERE regexp_matches(rel_file, '\\.({ext})$') AND regexp_matches(l, '{pattern}')"


_IMPORTS = " UNION ALL ".join(_form_sql(*x) for x in _FORMS)
_LINES = "lines AS (SELECT rel_file, CAST(line AS INTEGER) AS line, trim(ls[line], ' ' || chr(9)) AS l FROM (SELECT rel_file, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT rel_file, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents WHERE rel_file IS NOT NULL AND text IS NOT NULL)))"


@query("imports_extract", f"WITH {_LINES} {_IMPORTS}")
def imports_extract(s, d):
    return extract.imports(_texts(s, d)).distinct()


@query("import_resolve", f"""
    WITH {_LINES}, b AS MATERIALIZED (SELECT DISTINCT source_file, local_name, qualified_name, is_from_import FROM ({_IMPORTS})),
    own AS (SELECT source_file, local_name, count(DISTINCT qualified_name) AS n, min(qualified_name) AS one, first(qualified_name ORDER BY length(qualified_name), qualified_name) AS short,
      count(DISTINCT qualified_name) FILTER (WHERE is_from_import) AS fn, min(qualified_name) FILTER (WHERE is_from_import) AS fone FROM b GROUP BY 1, 2),
    al AS (SELECT local_name, count(DISTINCT qualified_name) AS n, min(qualified_name) AS one, first(qualified_name ORDER BY length(qualified_name), qualified_name) AS short FROM b GROUP BY 1),
    r AS (SELECT DISTINCT source_file, local_name AS name FROM b UNION SELECT DISTINCT rel_file, 'window' FROM lines)
    SELECT r.source_file, r.name, CASE WHEN own.n = 1 THEN own.one WHEN al.n = 1 THEN al.one WHEN own.fn = 1 THEN own.fone WHEN own.n > 1 THEN own.short WHEN al.n > 1 THEN al.short ELSE r.name END AS qualified_name,
      CAST(CASE WHEN own.n = 1 OR al.n = 1 THEN 1.0 WHEN own.fn = 1 THEN 0.8 WHEN own.n > 1 OR al.n > 1 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS confidence
    FROM r LEFT JOIN own ON r.source_file = own.source_file AND r.name = own.local_name LEFT JOIN al ON r.name = al.local_name""")
def import_resolve(s, d):
    b = imports_extract(s, d).filter("not is_star")
    every = _texts(s, d).select(F.col("rel_file").alias("source_file"), F.lit("window").alias("name"))
    return resolve.resolve_imports(b.select("source_file", F.col("local_name").alias("name")).unionByName(every), b)


@query("qualified_fanout", f"""
    WITH {_LINES}, b AS ({_IMPORTS}), o AS (SELECT source_file, local_name AS name, min(qualified_name) AS q FROM b GROUP BY 1, 2 HAVING count(DISTINCT qualified_name) = 1)
    SELECT source_file, name FROM o UNION SELECT source_file, q FROM o""")
def qualified_fanout(s, d):
    o = imports_extract(s, d).filter("not is_star").groupBy("source_file", F.col("local_name").alias("name")).agg(F.min("qualified_name").alias("qualified_name"), F.count_distinct("qualified_name").alias("n")).filter("n = 1")
    return resolve.qualified_fanout(o)


@query("bare_name_fallback", f"""
    WITH q AS (SELECT DISTINCT name AS query FROM tags WHERE name LIKE '%::%'), t AS (SELECT DISTINCT name, rel_file, line FROM tags WHERE kind = 'ref' AND name IS NOT NULL),
    e AS (SELECT q.query, t.name, t.rel_file, t.line, false AS fallback FROM q JOIN t ON q.query = t.name)
    SELECT * FROM e UNION ALL
    SELECT q.query, t.name, t.rel_file, t.line, true FROM q JOIN t ON {_BASE.replace('name', 'q.query')} = {_BASE.replace('name', 't.name')} WHERE q.query NOT IN (SELECT name FROM t)""")
def bare_name_fallback(s, d):
    t = _tags(s, d)
    return resolve.lookup(t.filter("name like '%::%'").select(F.col("name").alias("query")), t.filter("kind = 'ref'"))


@query("symbol_ladder", f"""
    SELECT file, line, name, type, CAST(CASE WHEN name = 'Close' THEN 0 WHEN {_BASE} = 'Close' THEN 1 ELSE 2 END AS BIGINT) AS tier FROM symbols
    WHERE name <> '' AND (name = 'Close' OR {_BASE} = 'Close' OR contains(lower(name), 'close') OR contains('close', lower(name))) GROUP BY ALL ORDER BY tier, file NULLS FIRST, line, name, type LIMIT 1""")
def symbol_ladder(s, d):
    return resolve.symbol_ladder(load(s, d, "symbols", "file", "line", "name", "type"), "Close")


# --- content -----------------------------------------------------------------------------------------------------------------


@query("content_idf", rf"""
    WITH d AS (SELECT DISTINCT rel_file, line, name FROM tags WHERE kind = 'def' AND name IS NOT NULL), n AS (SELECT count(*) AS n FROM d),
    t AS (SELECT DISTINCT rel_file, line, name, unnest(list_distinct({_TOKENS})) AS token FROM d),
    c AS (SELECT DISTINCT rel_file, line, name, CASE token {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _CANON.items())} ELSE token END AS token FROM t)
    SELECT token, count(*) AS df, round(ln((n.n + 1.0) / (count(*) + 1.0)) + 1.0, 9) AS idf FROM c, n WHERE token IN ('get', 'page', 'token', 'window') GROUP BY token, n.n""")
def content_idf(s, d):
    return content.token_frequencies(_tags(s, d), ["get", "page", "token", "window"])


@query("content_search")
def content_search(s, d):
    return content.content_search(_tags(s, d), load(s, d, "documents", "rel_file", "text"), _calls(s, d), "where is the window of a cached page loaded", 20)


@query("detect_by_content")
def detect_by_content(s, d):
    """All four tiers of a search: nothing is named like this question, so what code does has to answer."""
    q = "where is the window of a cached page loaded"
    return search.tiered(_tags(s, d), q, limit=20, content=lambda: content.content_search(_tags(s, d), load(s, d, "documents", "rel_file", "text"), _calls(s, d), q, 20))


# --- snapshots ---------------------------------------------------------------------------------------------------------------

_NOW = "SELECT rel_file, size, mtime_ns FROM (SELECT * FROM file_state WHERE rel_file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rel_file ORDER BY scan_id DESC, received_at DESC) = 1) WHERE size IS NOT NULL OR mtime_ns IS NOT NULL"
_WAS = "SELECT rel_file, size, mtime_ns FROM indexed_files WHERE rel_file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rel_file ORDER BY run_id DESC) = 1"
_DIFF = f"""
    SELECT coalesce(n.rel_file, w.rel_file) AS rel_file, CASE WHEN w.rel_file IS NULL THEN 'added' WHEN n.rel_file IS NULL THEN 'deleted' ELSE 'modified' END AS status
    FROM ({_NOW}) n FULL JOIN ({_WAS}) w ON n.rel_file = w.rel_file
    WHERE w.rel_file IS NULL OR n.rel_file IS NULL OR n.size IS DISTINCT FROM w.size OR n.mtime_ns IS DISTINCT FROM w.mtime_ns"""


def _now(s, d):
    return snapshot.latest(load(s, d, "file_state"))


def _was(s, d):
    return snapshot.stored(load(s, d, "indexed_files"))


@query("snapshot_diff", _DIFF)
def snapshot_diff(s, d):
    return snapshot.diff(_now(s, d), _was(s, d))


@query("dirty_set", f"SELECT n.rel_file FROM ({_NOW}) n LEFT JOIN ({_WAS}) w ON n.rel_file = w.rel_file WHERE w.rel_file IS NULL OR n.size IS DISTINCT FROM w.size OR n.mtime_ns IS DISTINCT FROM w.mtime_ns")
def dirty_set(s, d):
    return snapshot.dirty(_now(s, d), _was(s, d))


@query("drop_mapped", "SELECT DISTINCT rel_file FROM documents WHERE rel_file IS NOT NULL AND lower(rel_file) NOT IN (SELECT lower(rel_file) FROM file_ranks WHERE rel_file IS NOT NULL)")
def drop_mapped(s, d):
    return snapshot.unmapped(load(s, d, "documents", "rel_file"), load(s, d, "file_ranks", "rel_file"))


@query("subset_check", f"SELECT (SELECT count(*) FROM ({_NOW}) WHERE rel_file NOT IN (SELECT rel_file FROM ({_WAS}))) = 0 AS is_subset")
def subset_check(s, d):
    return _now(s, d).join(_was(s, d), "rel_file", "left_anti").agg((F.count("*") == 0).alias("is_subset"))


@query("diff_tag_heads", f"""
    WITH c AS (SELECT * FROM ({_DIFF}) WHERE status <> 'deleted'), t AS (SELECT DISTINCT rel_file, line, name, kind FROM tags WHERE name IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY rel_file ORDER BY line, name, kind) AS k FROM t)
    SELECT c.rel_file, c.status, count(r.name) AS tag_count, greatest(0, count(r.name) - 50) AS tags_omitted, coalesce(string_agg(r.line || ':' || r.name || ':' || r.kind, ',' ORDER BY k) FILTER (WHERE k <= 50), '') AS tags
    FROM c LEFT JOIN r ON c.rel_file = r.rel_file GROUP BY 1, 2""")
def diff_tag_heads(s, d):
    return snapshot.tag_heads(snapshot_diff(s, d), _tags(s, d))


_SIG = f"""
    WITH x AS (SELECT md5(rel_file || ':' || coalesce(CAST(size AS VARCHAR), '') || ':' || coalesce(CAST(mtime_ns AS VARCHAR), '')) AS h FROM ({_NOW})),
    p AS (SELECT count(*) AS files, {', '.join(f"sum(CAST('0x' || h[{1 + 8 * i}:{8 + 8 * i}] AS BIGINT)) AS p{i}" for i in range(4))} FROM x)
    SELECT files, left(sha256('3:' || p0 || ':' || p1 || ':' || p2 || ':' || p3), 16) AS signature FROM p"""


@query("corpus_signature", _SIG)
def corpus_signature(s, d):
    return snapshot.signature(_now(s, d))


@query("rank_freshness", f"SELECT (SELECT signature FROM ({_SIG})) = (SELECT signature FROM ({_SIG.replace(_NOW, _WAS)})) AS fresh")
def rank_freshness(s, d):
    return snapshot.is_fresh(snapshot.signature(_was(s, d)), snapshot.signature(_now(s, d)))


@query("chunk_resume_plan", """
    WITH n AS (SELECT count(DISTINCT rel_file) AS n FROM documents WHERE rel_file IS NOT NULL)
    SELECT CAST(i AS BIGINT) AS chunk, CAST(least(n, 100 * i) AS BIGINT) AS cap, CAST(least(n, 100 * i) - least(n, 100 * (i - 1)) AS BIGINT) AS new_files FROM n, range(1, 51) t(i) WHERE 100 * (i - 1) < n""")
def chunk_resume_plan(s, d):
    n = load(s, d, "documents", "rel_file").filter("rel_file is not null").distinct().count()
    caps = snapshot.chunk_caps(n, 100, 100)
    return s.createDataFrame([(i + 1, c, c - ([0] + caps)[i]) for i, c in enumerate(caps)], "chunk long, cap long, new_files long")


@query("chunk_resume_plan_all", """
    WITH n AS (SELECT count(DISTINCT rel_file) AS n FROM documents WHERE rel_file IS NOT NULL), c AS (SELECT n, unnest(range(1, (n + 99) // 100 + 1)) AS i FROM n)
    SELECT CAST(i AS BIGINT) AS chunk, CAST(least(n, 100 * i) AS BIGINT) AS cap, CAST(least(n, 100 * i) - 100 * (i - 1) AS BIGINT) AS new_files FROM c""")
def chunk_resume_plan_all(s, d):
    """``chunk_resume_plan`` to the last file; that one, as its SQL, ends at 50 chunks."""
    return snapshot.chunk_plan(load(s, d, "documents", "rel_file"), 100)


@query("coverage_audit", """
    WITH f AS (SELECT DISTINCT rel_file FROM documents WHERE rel_file IS NOT NULL), t AS (SELECT DISTINCT rel_file FROM tags WHERE rel_file IS NOT NULL), r AS (SELECT DISTINCT rel_file FROM file_ranks WHERE rel_file IS NOT NULL AND rank IS NOT NULL)
    SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM t) AS tagged, (SELECT count(*) FROM f ANTI JOIN t USING (rel_file)) AS unscanned, (SELECT count(*) FROM t ANTI JOIN f USING (rel_file)) AS stale,
      (SELECT count(*) FROM t ANTI JOIN r USING (rel_file)) AS unranked, (SELECT count(*) = 0 FROM refs) AS no_refs""")
def coverage_audit(s, d):
    return files.audit(load(s, d, "documents", "rel_file"), load(s, d, "tags", "rel_file"), _refs(s, d), load(s, d, "file_ranks"))


@query("file_report", """
    SELECT count(*) FILTER (WHERE kind = 'def') AS definitions, count(*) FILTER (WHERE kind = 'ref') AS "references", (SELECT count(DISTINCT rel_file) FROM documents) AS considered,
      (SELECT count(DISTINCT rel_file) FROM documents WHERE rel_file IS NOT NULL AND rel_file NOT IN (SELECT rel_file FROM tags WHERE kind = 'def')) AS untagged FROM tags""")
def file_report(s, d):
    return files.report(load(s, d, "documents", "rel_file"), load(s, d, "tags", "rel_file", "kind"))


@query("ground_truth_presence", f"""
    WITH g AS (SELECT unnest(['close', 'update', 'map_items', 'no_such_name']) AS ident), m AS (SELECT DISTINCT name FROM ({_RANKED}))
    SELECT ident, ident IN (SELECT name FROM m) AS in_map, (SELECT count(DISTINCT rel_file) FROM tags WHERE name = ident) AS files FROM g""")
def ground_truth_presence(s, d):
    g = s.createDataFrame([(x,) for x in ("close", "update", "map_items", "no_such_name")], "ident string")
    m = rank.boosted(_stored_ranks(s, d), _tags(s, d)).select(F.col("name").alias("ident")).distinct().withColumn("m", F.lit(True))
    n = load(s, d, "tags", "name", "rel_file").groupBy(F.col("name").alias("ident")).agg(F.count_distinct("rel_file").alias("files"))
    return g.join(m, "ident", "left").join(n, "ident", "left").select("ident", F.coalesce("m", F.lit(False)).alias("in_map"), F.coalesce("files", F.lit(0)).cast("long").alias("files"))


# --- detail and contexts -----------------------------------------------------------------------------------------------------


@query("render_context_lines", rf"""
    WITH h AS ({_detect_sql("lower(name) = 'init'", "0", 50, "'def'")}), w AS (SELECT rel_file, line, unnest(range(line - 1, line + 2)) AS at FROM h),
    f AS (SELECT rel_file, max(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1), l AS (SELECT rel_file, string_split(text, chr(10)) AS ls FROM f)
    SELECT DISTINCT w.rel_file, w.line, CAST(w.at AS INTEGER) AS at, regexp_replace(l.ls[w.at], '\r$', '') AS text, w.at = w.line AS is_hit FROM w JOIN l ON w.rel_file = l.rel_file
    WHERE w.at BETWEEN 1 AND len(l.ls) AND (trim(regexp_replace(l.ls[w.at], '\r$', ''), ' ') <> '' OR w.at = w.line)""")
def render_context_lines(s, d):
    hits = search.detect(_tags(s, d), "init", "exact", 50, references=False)
    return render.context_lines(hits, load(s, d, "documents", "rel_file", "text"))


@query("detail_record")
def detail_record(s, d):
    return render.detail(load(s, d, "symbols"), _calls(s, d), "update")


@query("symbols_by_file_rel", "SELECT CASE WHEN starts_with(file, '/srv/mirror/') THEN file[13:] ELSE file END AS rel_file, count(*) AS n FROM symbols GROUP BY 1")
def symbols_by_file_rel(s, d):
    return load(s, d, "symbols", "file").groupBy(rel_of(F.col("file")).alias("rel_file")).agg(F.count("*").alias("n"))


# --- extraction --------------------------------------------------------------------------------------------------------------


def _texts(s, d):
    """The texts of files, on one partition a core at least: what follows is Python work."""
    t = load(s, d, "documents", "rel_file", "text").filter("rel_file is not null and text is not null")
    return nth(t, s.sparkContext.defaultParallelism)


@query("tags_extract")
def tags_extract(s, d):
    return extract.tags(_texts(s, d)).distinct()


@query("symbols_extract")
def symbols_extract(s, d):
    return extract.symbols(_texts(s, d)).distinct()


# --- serving -----------------------------------------------------------------------------------------------------------------


@query("path_containment", "SELECT DISTINCT file, starts_with(file, '/srv/mirror/quillstone/') AND NOT regexp_matches(file, '(^|/)[.][.](/|$)') AS inside FROM tags WHERE file IS NOT NULL")
def path_containment(s, d):
    return load(s, d, "tags", "file").filter("file is not null").distinct().select("file", serving.within(F.col("file"), "/srv/mirror/quillstone").alias("inside"))


@query("candidate_shapes", f"SELECT name, regexp_full_match(name, '[_A-Za-z][_0-9A-Za-z]*(::[_A-Za-z][_0-9A-Za-z]*)*([.][_A-Za-z][_0-9A-Za-z]*)*') AS candidate FROM {_NAMES}")
def candidate_shapes(s, d):
    return _names(s, d).select("name", serving.is_candidate(F.col("name")).alias("candidate"))


@query("plural_matches", f"SELECT name FROM {_NAMES} WHERE list_has_any({_TOKENS}, ['item', 'items'])")
def plural_matches(s, d):
    return _names(s, d).filter(serving.matches_word(T.tokens(F.col("name")), "item")).select("name")


@query("state_ages", """
    WITH m AS (SELECT rel_file, max(received_at) AS got FROM file_state WHERE rel_file IS NOT NULL GROUP BY 1), s AS (SELECT rel_file, epoch((SELECT max(got) FROM m)) - epoch(got) AS sec FROM m)
    SELECT rel_file, CASE WHEN sec IS NULL THEN 'unknown' WHEN floor(sec) < 60 THEN CAST(floor(sec) AS BIGINT) || 's' WHEN floor(sec) < 3600 THEN CAST(floor(floor(sec) / 60) AS BIGINT) || 'm'
      WHEN floor(sec) < 86400 THEN CAST(floor(floor(sec) / 3600) AS BIGINT) || 'h' ELSE CAST(floor(floor(sec) / 86400) AS BIGINT) || 'd' END AS age FROM s""")
def state_ages(s, d):
    m = load(s, d, "file_state", "rel_file", "received_at").filter("rel_file is not null").groupBy("rel_file").agg(F.unix_micros(F.max(F.col("received_at").cast("timestamp"))).alias("at"))
    newest = m.agg(F.max("at")).first()[0]
    return m.select("rel_file", serving.age((F.lit(newest) - F.col("at")) / 1_000_000).alias("age"))


@query("lookup_hints", f"""
    WITH q AS (SELECT unnest(['init', 'updte', 'no_such_name_here']) AS q), n AS (SELECT q, (SELECT count(*) FROM tags WHERE lower(name) = q) AS hits, (SELECT count(*) FROM {_NAMES} WHERE levenshtein(lower(name), q) <= 2) AS near FROM q)
    SELECT q, CASE WHEN hits + near = 0 THEN 'symbols' WHEN hits = 0 THEN 'detail' END AS next_rung, CASE WHEN hits + near = 0 THEN 'empty' WHEN hits = 0 THEN 'fuzzy_verify' END AS reason FROM n""")
def lookup_hints(s, d):
    names = _names(s, d)
    qs = ["init", "updte", "no_such_name_here"]
    n = names.agg(*(F.count_if(F.lower("name") == q).alias(f"h{i}") for i, q in enumerate(qs)), *(F.count_if(F.levenshtein(F.lower("name"), F.lit(q)) <= 2).alias(f"n{i}") for i, q in enumerate(qs)))
    rows = n.select(F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"h{i}").alias("hits"), F.col(f"n{i}").alias("near")) for i, q in enumerate(qs)))).alias("r")).select("r.*")
    h = serving.hint(F.lit("detect"), F.col("hits") + F.col("near"), F.when((F.col("hits") == 0) & (F.col("near") > 0), F.lit("fuzzy")))
    return rows.select("q", h["next_rung"].alias("next_rung"), h["reason"].alias("reason"))


@query("texts_cut", rf"""
    SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE regexp_replace(CASE WHEN contains(text[:{400 - len(serving.CUT_MARK)}], chr(10)) THEN regexp_replace(text[:{400 - len(serving.CUT_MARK)}], '\n[^\n]*$', '') ELSE text[:{400 - len(serving.CUT_MARK)}] END, '[ \t\n\f\r\v]+$', '') || chr(10) || '... [truncated to fit max_tokens]' END AS text
    FROM documents WHERE text IS NOT NULL""")
def texts_cut(s, d):
    return load(s, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", serving.cut_text(F.col("text"), 100).alias("text"))


@query("tags_keep_first", f"SELECT rank, rel_file, line, name FROM (SELECT k.rank, t.rel_file, t.line, t.name, t.kind FROM tags t JOIN ({_RANKS}) k ON t.rel_file = k.rel_file WHERE t.name IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY rel_file, name ORDER BY line, kind) = 1")
def tags_keep_first(s, d):
    t = _tags(s, d).filter("name is not null").join(_stored_ranks(s, d), "rel_file")
    return serving.keep_first(t, ["rel_file", "name"], ["line", "kind"]).select("rank", "rel_file", "line", "name")


@query("files_of_interest", "SELECT rel_file, bool_or(chat) AS chat FROM (SELECT rel_file, true AS chat FROM file_flags UNION ALL SELECT rel_file, false FROM tags) WHERE rel_file IS NOT NULL GROUP BY rel_file")
def files_of_interest(s, d):
    return serving.files_of_interest(load(s, d, "file_flags", "rel_file"), load(s, d, "tags", "rel_file"))


@query("index_line", f"SELECT (SELECT count(DISTINCT rel_file) FROM ({_NOW})) || ' files, ' || (SELECT count(*) FROM tags) || ' tags, sig ' || (SELECT left(signature, 8) FROM ({_SIG})) AS line")
def index_line(s, d):
    return serving.index_line(_now(s, d), load(s, d, "tags", "kind"), snapshot.signature(_now(s, d)))


@query("walk_in_budget")
def walk_in_budget(s, d):
    return serving.fit_walk(*_walk(s, d, "callers('fetch_vabomu_batch') depth=2 limit=1000"), 2048)[1].select(*_WALK, "cut")


@query("symbols_lookup", rf"""
    WITH n AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL AND file IS NOT NULL),
    k AS (SELECT name, CAST(least(levenshtein(lower({_BASE}), 'updte'), 3) AS BIGINT) AS d FROM n WHERE least(levenshtein(lower({_BASE}), 'updte'), 3) <= 2)
    SELECT file, line, name, type, 'fuzzy' AS quality FROM (SELECT DISTINCT s.file, s.line, s.name, s.type, k.d FROM symbols s JOIN k ON s.name = k.name WHERE s.file IS NOT NULL)
    ORDER BY {_BOUND.replace("'page'", "'updte'")}, CAST(regexp_matches(file, '{T.TEST_PATH}') AS INT), d, type, name, file, line LIMIT 60""")
def symbols_lookup(s, d):
    return search.symbols_lookup(load(s, d, "symbols"), "updte", limit=60)
