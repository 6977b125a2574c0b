"""Which files count: discovery filters, reasons for files without tags, language tallies, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tagloom.functions.text import EXTENSIONS, extension, is_test, language_of

#: Folder and suffix lists of discovery (fixed values).
SKIP_DIRS = "node_modules __pycache__ venv env build dist .tox .eggs vendor fixtures __fixtures__ testdata".split()
SKIP_SUFFIXES = (
    ".frag .vert .inc .icns .plist .entitlements .cmake.in .h.in .cpp.in .hpp.in .png .jpg .jpeg .gif .webp .bmp .ico .tif .tiff .mp4 .mov .mkv .avi .webm .mp3 .wav .flac .ogg .pdf .svg"
    " .tar .gz .zip .bz2 .xz .7z .rar .tgz .tbz2 .db .sqlite .sqlite3 .db3 .milk .json .xml .yaml .yml .toml .ini .cfg .config .csv .tsv .md .txt .rst .min.js .min.css .slim.js .bundle.js"
).split()
DEPTH, FILE_BYTES = 25, 1 << 20
_HASH_ASSET = r"-[0-9a-f]{8,64}\.(js|css)$"
IMPORTANT = r"(^|/)(readme|license|makefile|dockerfile|pyproject\.toml|setup\.py|setup\.cfg|package\.json|cargo\.toml|go\.mod|pom\.xml|build\.gradle|gemfile|requirements\.txt|tsconfig\.json)(\.[a-z]+)?$|^\.github/workflows/[^/]*\.ya?ml$|^docs/[^/]*\.(md|rst|txt)$"


def folders(path) -> F.Column:
    return F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))


def minified_sniff(path, text) -> F.Column:
    """A script or style sheet of more than 2000 characters with a line above 2000 and a mean line above 500, in its first 64 KiB."""
    lines = F.transform(F.split(F.left(text, F.lit(65536)), "\n"), F.length)
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + x) / F.size(lines)
    return F.coalesce(extension(path).isin("js", "css") & (F.length(text) > 2000) & (F.array_max(lines) > 2000) & (mean > 500), F.lit(False))


def discover(files: DataFrame, exclude: list[str] = (), ignored_dirs: list[str] = ()) -> DataFrame:
    """The rows of ``files(rel_file, size, text)`` that a scan takes in: no hidden or skipped folders, suffixes by deny list, 1 MiB a file, 25 folders deep, no hashed assets or minified blobs."""
    from tagloom.functions.text import matches_any

    path, low = F.col("rel_file"), F.lower("rel_file")
    dirs = folders(path)
    skip = F.array(*map(F.lit, [*SKIP_DIRS, *ignored_dirs]))
    bad_suffix = F.lit(False)
    for s in SKIP_SUFFIXES:
        bad_suffix = bad_suffix | low.endswith(s)
    name = F.substring_index(path, "/", -1)
    kept = files.filter(path.isNotNull() & F.col("size").isNotNull() & (F.col("size") <= FILE_BYTES))
    kept = kept.filter(~F.arrays_overlap(dirs, skip) & ~F.exists(dirs, lambda d: d.startswith(".")) & ~name.startswith(".") & ~bad_suffix)
    kept = kept.filter((F.size(F.split(path, "/")) <= DEPTH) & ~low.rlike(_HASH_ASSET) & ~minified_sniff(path, F.col("text")))
    return kept.filter(~matches_any(path, list(exclude)))


def size_prefix(files: DataFrame, budget: int) -> DataFrame:
    """The files in path order whose summed size stays within ``budget``, with ``upto``.

    A running sum over all files without one task seeing them all: sizes are summed by range of paths first, the ranges are few (one a partition), and each
    range then sums on from what came before it.
    """
    from tagloom.session import cut, shuffle_partitions

    n = shuffle_partitions(files.sparkSession)
    f = files.groupBy("rel_file").agg(F.max("size").alias("size")).filter("rel_file is not null and size is not null")
    ranged = cut(f.repartitionByRange(n, "rel_file").withColumn("part", F.spark_partition_id()))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(w), F.lit(0))).select("part", "before")
    inside = ranged.withColumn("in", F.sum("size").over(Window.partitionBy("part").orderBy("rel_file").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(F.broadcast(before), "part").select("rel_file", "size", (F.col("before") + F.col("in")).cast("long").alias("upto")).filter(F.col("upto") <= budget)


def untagged_reason(files: DataFrame, tags: DataFrame) -> DataFrame:
    """``rel_file, reason`` of each of ``files(rel_file, text)`` without tags: skip-ext, missing, empty, no-grammar or parsed-zero-tags, the first that holds."""
    low = F.lower("rel_file")
    bad = F.lit(False)
    for s in SKIP_SUFFIXES:
        bad = bad | low.endswith(s)
    reason = F.when(bad, "skip-ext").when(~F.col("there"), "missing").when(~F.col("filled"), "empty").when(language_of(F.col("rel_file")).isNull(), "no-grammar").otherwise("parsed-zero-tags")
    f = files.filter("rel_file is not null").groupBy("rel_file").agg(F.bool_or(F.col("text").isNotNull()).alias("there"), F.bool_or(F.coalesce(F.trim("text") != "", F.lit(False))).alias("filled"))
    return f.join(tags.filter("rel_file is not null").select("rel_file").distinct(), "rel_file", "left_anti").select("rel_file", reason.alias("reason"))


def language_tally(files: DataFrame) -> DataFrame:
    """``language, files, est_lines`` by extension, lines at 40 bytes each; null for unknown extensions."""
    f = files.filter("rel_file is not null").groupBy("rel_file").agg(F.max("size").alias("size"))
    return f.groupBy(language_of(F.col("rel_file")).alias("language")).agg(F.count("*").alias("files"), F.floor(F.coalesce(F.sum("size"), F.lit(0)) / 40).cast("long").alias("est_lines"))


def probe_digest(files: DataFrame) -> DataFrame:
    """One row: ``total_files, est_lines, top`` (the three commonest known languages)."""
    t = language_tally(files)
    known = t.filter("language is not null")
    top = known.orderBy(F.desc("files"), "language").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("n"), "language"))), lambda x: x["language"]), ",").alias("top"))
    return t.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("est_lines"), F.lit(0)).alias("est_lines")).withColumn("k", F.lit(1)).join(top.withColumn("k", F.lit(1)), "k").drop("k")


def extension_table(spark) -> DataFrame:
    return spark.createDataFrame(sorted(EXTENSIONS.items()), "extension string, language string")


def coverage(files: DataFrame, tags: DataFrame) -> DataFrame:
    """One row ``considered, covered, coverage_pct, low``: files with definitions among all; 100 % of none."""
    f = files.filter("rel_file is not null").select("rel_file").distinct()
    d = tags.filter("kind = 'def' and rel_file is not null").select("rel_file").distinct().withColumn("has", F.lit(1))
    s = f.join(d, "rel_file", "left").agg(F.count("*").alias("considered"), F.coalesce(F.sum("has"), F.lit(0)).cast("long").alias("covered"))
    pct = F.when(F.col("considered") > 0, F.round(100.0 * F.col("covered") / F.col("considered"), 1)).otherwise(100.0)
    return s.withColumn("coverage_pct", pct).withColumn("low", pct < 60.0)


def audit(files: DataFrame, tags: DataFrame, refs: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row of counts: files, tagged, unscanned (on disk, no tags), stale (tagged, not on disk), unranked, and whether there are no edges."""
    key = lambda t, c="rel_file": t.select(F.col(c).alias("rel_file")).filter("rel_file is not null").distinct()
    marks = key(files).withColumn("f", F.lit(1)).join(key(tags).withColumn("t", F.lit(1)), "rel_file", "full").join(key(ranks.filter("rank is not null")).withColumn("r", F.lit(1)), "rel_file", "full")
    one = lambda cond: F.count_if(cond)
    s = marks.agg(
        F.count("f").alias("files"), F.count("t").alias("tagged"), one(F.col("f").isNotNull() & F.col("t").isNull()).alias("unscanned"),
        one(F.col("f").isNull() & F.col("t").isNotNull()).alias("stale"), one(F.col("t").isNotNull() & F.col("r").isNull()).alias("unranked"))
    e = refs.agg((F.count("*") == 0).alias("no_refs"))
    return s.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k")


def report(files: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: definition rows, reference rows, files considered, files without definitions."""
    f = files.filter("rel_file is not null").select("rel_file").distinct()
    d = tags.filter("kind = 'def'").select("rel_file").distinct()
    n = f.join(d, "rel_file", "left_anti").agg(F.count("*").alias("untagged")).withColumn("k", F.lit(1))
    c = tags.agg(F.count_if(F.col("kind") == "def").alias("definitions"), F.count_if(F.col("kind") == "ref").alias("references")).withColumn("k", F.lit(1))
    return c.join(f.agg(F.count("*").alias("considered")).withColumn("k", F.lit(1)), "k").join(n, "k").drop("k")


def long_names(tags: DataFrame) -> DataFrame:
    """One row: the longest name, and how many rows have names above 200, 500 and 2000 characters."""
    n = F.length("name")
    return tags.agg(F.coalesce(F.max(n), F.lit(0)).cast("long").alias("longest"), *(F.count_if(n > k).alias(f"over_{k}") for k in (200, 500, 2000)))


def test_files(table: DataFrame) -> DataFrame:
    return table.filter("rel_file is not null").select("rel_file", is_test(F.col("rel_file")).alias("is_test")).distinct()
