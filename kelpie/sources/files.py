"""File sources and sinks: delimited files, source trees, diffs, graphs, run logs, reports and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.paths import extension
from kelpie.operators import badrows

SKIP_DIRS = ["node_modules", "__pycache__", "dist", "build", "target", "venv"]


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw_id, source_file, line_no, raw_line of the lines of all files under ``path``; line_no is 1 for each file's first line, else null.

    Files are read in blocks; the first line is that of the least number in the block that begins the file.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("raw_id"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("raw_line"))
    first = lines.filter("at = 0").groupBy("source_file").agg(F.min("raw_id").alias("raw_id"), F.lit(1).alias("line_no"))
    return lines.join(first.select("raw_id", "line_no"), "raw_id", "left").select("raw_id", "source_file", "line_no", "raw_line")


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """The records of presubmit files under ``path``, typed, and reasons for those that do not load (see ``badrows.load``).

    Every file has its own header, in any order, and its own separator of comma, | and tab. No line is dropped; one record
    takes one line.
    """
    return badrows.load(raw_lines(spark, path))


def source_tree(spark: SparkSession, root: str, extensions: list[str], most: int | None = None) -> DataFrame:
    """(file_path, source_text) of a folder's source files, paths relative to ``root``; hidden and build folders below it are skipped.

    ``most`` keeps the first files in order of their paths.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substr("path", F.lit(len(base) + 2))
    f = f.select(rel.alias("file_path"), "content")
    skipped = F.col("file_path").rlike(r"(?:^|/)(?:\.[^/]+|" + "|".join(SKIP_DIRS) + r")/")
    f = f.filter(extension("file_path").isin(extensions) & ~skipped)
    if most is not None:
        f = f.orderBy("file_path").limit(most)
    return f.select("file_path", F.decode("content", "UTF-8").alias("source_text"))


def diff_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, diff): whole diff files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("diff"))


def graph_json(spark: SparkSession, path: str) -> DataFrame:
    """Edges (importer, imported) of a JSON object that maps a module to its imports."""
    m = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return m.select(F.explode("m").alias("importer", "to")).select("importer", F.explode("to").alias("imported"))


def saved_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(importer, imported) and (module, test) of a JSON object with the maps module_graph and test_map; a missing map is empty."""
    kind = "struct<module_graph map<string, array<string>>, test_map map<string, array<string>>>"
    g = spark.read.option("wholetext", True).text(path).select(F.from_json("value", kind).alias("g"))
    pairs = lambda key, a, b: g.select(F.explode(f"g.{key}").alias(a, "to")).select(a, F.explode("to").alias(b))
    return pairs("module_graph", "importer", "imported"), pairs("test_map", "module", "test")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, line: Column, path: str) -> None:
    """One text line per row, such as the tests to run."""
    df.select(line.cast("string").alias("value")).write.mode("overwrite").text(path)


def save_vectors(df: DataFrame, path: str) -> None:
    """Identifiers, vectors and what else describes them, as one table."""
    df.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_runs(df: DataFrame, path: str) -> None:
    """Append to a run log; readers keep the last row of each run_id (``registry.runs_once``)."""
    df.write.mode("append").parquet(path)
