"""Import graphs and test maps of repositories: what a file imports, resolved to files of its repo, and which tests reach it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.common import cut, lookup
from kelpie.functions.paths import extension, folder, normal, one_line_end, stem
from kelpie.operators import outline

# Patterns of test files, folders left out of the graph, suffixes tried for a module, and relative imports.
TEST_FILES = [r"test_.*\.py$", r".*_test\.py$", r".*_spec\.py$", r".*Test\.java$", r".*Spec\.java$", r".*\.test\.(js|ts)$", r".*\.spec\.(js|ts)$"]
SKIPPED = ["__pycache__", ".git", "node_modules", "venv", ".venv", "dist", "build", ".eggs"]
PYTHON_SUFFIXES = [".py", "/__init__.py", ".pyi"]
SCRIPT_SUFFIXES = ["", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts"]
SCRIPT_IMPORT = r"""(?:import\s+(?:.*?\s+from\s+)?|require\s*\()\s*['"](\..*?)['"]\s*\)?"""
PREFIXES = ["test_", "test"]  # a test test_x is tried as x and as _x


def is_test(path: Column | str) -> Column:
    """Whether a path matches one of the patterns of test files."""
    c = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for p in TEST_FILES:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))


def test_files(files: DataFrame) -> DataFrame:
    """repo, file_path of the test files."""
    return files.filter(is_test("file_path")).select("repo", "file_path").distinct()


def named_like_tests(files: DataFrame) -> DataFrame:
    """repo, file_path of files with test or spec anywhere in their path, in any case; latest.py is among them."""
    low = F.lower("file_path")
    return files.filter(low.contains("test") | low.contains("spec")).select("repo", "file_path").distinct()


def _best(asked: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """``asked`` (distinct) with ``imported``: the first of its candidate paths that is a file of its repo; others are left out."""
    have = files.select("repo", F.col("file_path").alias("path")).distinct()
    keys = asked.columns
    tried = asked.select(*keys, F.posexplode(candidates).alias("rank", "path")).filter("path IS NOT NULL")
    hit = lookup(tried, have, ["repo", "path"], "inner")
    return hit.groupBy(*keys).agg(F.min_by("path", "rank").alias("imported"))


def python_edges(files: DataFrame) -> DataFrame:
    """(repo, importer, imported): what Python files import of their repo.

    An absolute module is the longest dotted prefix that is a file, plain before package before stub; a relative one counts
    levels up from the importing file's folder and must be met whole. ``from . import x`` names no module. Every distinct
    module of a repo is resolved once, so one that every file imports costs as much as one.
    """
    src = files.select(F.col("file_id").cast("long").alias("file_id"), "repo", "file_path")
    rows = outline.outlines(files).select("file_id", F.inline("imports")).filter("module <> ''").join(src, "file_id")
    rows = rows.select("repo", "file_path", "module", "level", F.when(F.col("level") > 0, folder("file_path")).alias("folder"))
    rows = cut(rows)
    parts = F.split("module", r"\.")
    count = F.size(parts)
    prefixes = F.flatten(F.transform(F.sequence(count, F.lit(1), F.lit(-1)), lambda i: F.transform(F.array(*[F.lit(s) for s in PYTHON_SUFFIXES]), lambda s: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), s))))
    base = F.concat_ws("/", "folder", F.repeat(F.lit("../"), F.col("level") - 1), F.array_join(parts, "/"))
    whole = F.array(*[F.concat(normal(base), F.lit(s)) for s in PYTHON_SUFFIXES[:2]])
    asked = rows.select("repo", "module", "level", "folder").distinct()
    near = _best(asked.filter("level > 0"), whole, files).select("repo", "module", "folder", "imported")
    far = _best(asked.filter("level = 0").select("repo", "module"), prefixes, files)
    a = lookup(rows.filter("level > 0").select("repo", "file_path", "module", "folder"), near, ["repo", "module", "folder"], "inner")
    b = lookup(rows.filter("level = 0").select("repo", "file_path", "module"), far, ["repo", "module"], "inner")
    return a.select("repo", F.col("file_path").alias("importer"), "imported").union(b.select("repo", "file_path", "imported")).distinct()


def script_requires(files: DataFrame) -> DataFrame:
    """(repo, file_path, spec, path): relative modules that JavaScript and TypeScript files import, and the path they lead to."""
    js = files.filter(extension("file_path").isin("js", "mjs", "ts", "jsx", "tsx"))
    t = one_line_end(F.coalesce("source_text", F.lit("")))
    rows = js.select("repo", "file_path", F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit("(?md)" + SCRIPT_IMPORT), F.lit(1)))).alias("spec"))
    return rows.select("repo", "file_path", "spec", normal(F.concat_ws("/", folder("file_path"), "spec")).alias("path"))


def script_edges(files: DataFrame) -> DataFrame:
    """(repo, importer, imported): relative imports resolved with the suffixes in order; paths outside the root lead nowhere."""
    r = script_requires(files).filter("path IS NOT NULL")
    hit = _best(r.select("repo", F.col("path").alias("target")).distinct(), F.array(*[F.concat("target", F.lit(s)) for s in SCRIPT_SUFFIXES]), files)
    j = lookup(r.withColumnRenamed("path", "target"), hit, ["repo", "target"], "inner")
    return j.select("repo", F.col("file_path").alias("importer"), "imported").distinct()


def graph(files: DataFrame) -> DataFrame:
    """(repo, importer, imported) of all files but those in skipped folders."""
    kept = files.filter(~F.arrays_overlap(F.split("file_path", "/"), F.array(*[F.lit(s) for s in SKIPPED])))
    return python_edges(kept).union(script_edges(kept))


def by_name(files: DataFrame) -> DataFrame:
    """(repo, module, test): Python files that a test file is named after, in any folder of the repo."""
    s = stem("file_path")
    t = test_files(files).select("repo", F.col("file_path").alias("test"), s.alias("s"))
    names = F.array(*[F.when(F.startswith("s", F.lit(p)), F.substr("s", F.lit(len(p) + 1))) for p in PREFIXES])
    t = t.select("repo", "test", F.explode(F.array_compact(names)).alias("name"))
    m = files.filter((extension("file_path") == "py") & ~is_test("file_path")).select("repo", F.regexp_extract("file_path", r"([^/]*)\.py$", 1).alias("name"), F.col("file_path").alias("module")).distinct()
    return t.join(m, ["repo", "name"]).select("repo", "module", "test").distinct()


def by_import(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, module, test): files other than tests that Python test files import."""
    hit = edges.filter(is_test("importer") & F.endswith("importer", F.lit(".py")) & ~is_test("imported"))
    return hit.select("repo", F.col("imported").alias("module"), F.col("importer").alias("test")).distinct()


def test_map(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, module, test): tests of each module by name and by import."""
    return by_name(files).union(by_import(files, edges)).distinct()


def graph_stats(files: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Per repo: modules that import, edges, and modules with tests."""
    e = edges.groupBy("repo").agg(F.countDistinct("importer").alias("n_modules"), F.count("*").alias("n_edges"))
    t = tests.groupBy("repo").agg(F.countDistinct("module").alias("n_covered"))
    return files.select("repo").distinct().join(e, "repo", "left").join(t, "repo", "left").fillna(0, ["n_modules", "n_edges", "n_covered"])


def test_sources(names: DataFrame, files: DataFrame) -> DataFrame:
    """(test_name, file_path): the source file a recorded test name points to, null if none.

    A dotted name is read as a class below src and wins if src/a/b/C.java is a file; else the first word of the name is
    looked for as word.py in any folder, the smallest path first. A leading //package is dropped.
    """
    clean = F.trim(F.regexp_replace("test_name", r"^//[\w/]+\s+", ""), F.lit(" \t\r\n"))
    n = names.select("test_name").filter("test_name IS NOT NULL").distinct()
    dotted = F.regexp_extract(clean, r"(\w+(?:\.\w+)+)", 1)
    n = n.select("test_name", F.when(dotted != "", F.concat(F.lit("src/"), F.replace(dotted, F.lit("."), F.lit("/")), F.lit(".java"))).alias("java"), F.regexp_extract(clean, r"(\w+)", 1).alias("word"))
    paths = files.select("file_path").distinct()
    j = lookup(n, paths.select(F.col("file_path").alias("java"), F.lit(True).alias("found")), "java")
    py = paths.filter(extension("file_path") == "py").groupBy(F.regexp_extract("file_path", r"([^/]*)\.py$", 1).alias("word")).agg(F.min("file_path").alias("py"))
    j = lookup(j, py, "word")
    return j.select("test_name", F.when(F.col("found"), F.col("java")).otherwise(F.col("py")).alias("file_path"))
