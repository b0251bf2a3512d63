"""Rows that fail to parse: load the valid lines of delimited files, give a reason for the others.

Structure (quoting, line breaks, column count) is judged per line with array functions over the pieces between
quotes, so no regular expression has to walk a long field. Values are judged once per distinct value and column:
the distinct values are cast, those that fail form a dictionary of invalid values with reasons, and the dictionary is
joined back to the lines. Hot values are pre-aggregated before the shuffle; the dictionary and the headers of the files are
measured and broadcast if they are small, and joined with salt if not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.common import attach, blanks, cut

FIELDS = ("test_duration", "build", "test_name", "test_result")
SEPARATORS = (",", "|", "\t")


def headers(lines: DataFrame) -> DataFrame:
    """(source_file, sep, names) of each file whose first line names the four columns under one separator."""
    first = lines.filter("line_no = 1").groupBy("source_file").agg(F.min_by("raw_line", F.struct("raw_id", "raw_line")).alias("h"))
    want = F.array_sort(F.array(*[F.lit(f) for f in FIELDS]))
    sep, names = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for s in SEPARATORS:
        cols = F.transform(F.split(F.regexp_replace("h", "^﻿", ""), "[" + s + "]", -1), lambda c: F.lower(blanks(F.replace(c, F.lit('"'), F.lit("")))))
        hit = F.array_sort(cols) == want
        sep, names = F.when(hit, F.lit(s)).otherwise(sep), F.when(hit, cols).otherwise(names)
    return first.select("source_file", sep.alias("sep"), names.alias("names")).filter("sep IS NOT NULL")


def split_lines(lines: DataFrame) -> DataFrame:
    """raw_id, source_file, line_no, fault (null if the structure is sound), fields (map of column to raw value)."""
    body = lines.filter("line_no IS NULL OR line_no <> 1")
    joined = attach(body, headers(lines), "source_file")
    esc = F.replace(F.replace("raw_line", F.lit("\u0002"), F.lit("\u0002b")), F.lit("\u0001"), F.lit("\u0002a"))
    parts = joined.withColumn("p", F.split(esc, '"', -1)).withColumn("n", F.size("p"))
    sound = F.expr(
        "forall(transform(p, (s, i) -> CASE WHEN i % 2 = 1 THEN true WHEN n = 1 THEN true"
        " WHEN i = 0 THEN s = '' OR endswith(s, sep) WHEN i = n - 1 THEN s = '' OR startswith(s, sep)"
        " ELSE s = '' OR (startswith(s, sep) AND endswith(s, sep)) END), x -> x)"
    )
    broken = F.expr(r"exists(transform(p, (s, i) -> i % 2 = 0 AND (contains(s, '\n') OR contains(s, '\r'))), x -> x)")
    whole = F.expr(
        "array_join(transform(p, (s, i) -> CASE WHEN i % 2 = 1 THEN s WHEN s = '' AND i > 0 AND i < n - 1 THEN '\"' ELSE replace(s, sep, '\u0001') END), '')"
    )
    cells = F.transform(F.split(whole, "\u0001", -1), lambda c: F.replace(F.replace(c, F.lit("\u0002a"), F.lit("\u0001")), F.lit("\u0002b"), F.lit("\u0002")))
    got = parts.withColumn("cells", cells)
    fault = (
        F.when(F.col("raw_line").isNull(), "line is null")
        .when(F.col("sep").isNull(), "file has no usable header")
        .when(F.col("n") % 2 == 0, "quote is not closed")
        .when(~sound, "quote inside an unquoted field or text after a closing quote")
        .when(broken, "line break outside quotes")
        .when(F.size("cells") != len(FIELDS), F.concat(F.lit("has "), F.size("cells"), F.lit(" columns, not 4")))
    )
    return got.withColumn("fault", fault).select(
        "raw_id", "source_file", "line_no", "fault", F.when(F.col("fault").isNull(), F.map_from_arrays("names", F.transform("cells", blanks))).alias("fields")
    )


def value_reason(column: str = "column", value: str = "value"):
    """Why a value cannot be cast to its column's type; null if it can."""
    c, v = F.col(column), F.col(value)
    return (
        F.when((c == "test_duration") & (v != "") & ~v.rlike(r"^(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), "test_duration is not an unsigned decimal number")
        .when((c == "build") & ~v.rlike("^[0-9a-fA-F]{10}(?:[/_][0-9a-fA-F]{10})*$"), "build is not made of ten-digit hex segments")
        .when((c == "test_name") & (v == ""), "test_name is empty")
        .when((c == "test_result") & ~v.rlike("^(?i:passed|failed|skipped)$"), "test_result is none of PASSED, FAILED, SKIPPED")
    )


def invalid_values(cells: DataFrame) -> DataFrame:
    """The dictionary (column, value, reason) of the distinct values that do not cast."""
    return cells.select("column", "value").distinct().withColumn("reason", value_reason()).filter("reason IS NOT NULL")


def _judged(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = cut(split_lines(lines.select("raw_id", "source_file", "line_no", "raw_line")))  # lines are taken apart once
    cells = split.filter("fault IS NULL").select("raw_id", F.explode("fields").alias("column", "value"))
    bad = attach(cells, invalid_values(cells), ["column", "value"], "inner").select("raw_id", "reason")
    return split, bad


def load(lines: DataFrame) -> DataFrame:
    """All lines after each file's first, typed, with the reasons why a line cannot be loaded.

    Output: raw_id, source_file, line_no, test_duration double, build, test_name, test_result (upper case) and
    ``reasons`` (sorted array, empty for a line that loads; the typed columns are then set, else null). A null line, a
    file without a usable header, an empty line, a repeated raw_id (judged once per row; reasons of one raw_id are
    shared) and empty tables all have that form; extra columns of the input are ignored. An empty duration is null.
    """
    split, bad = _judged(lines)
    why = bad.groupBy("raw_id").agg(F.sort_array(F.collect_set("reason")).alias("value_reasons"))
    out = split.join(why, "raw_id", "left")
    reasons = F.when(F.col("fault").isNotNull(), F.array("fault")).otherwise(F.coalesce("value_reasons", F.array().cast("array<string>")))
    ok = F.size("reasons") == 0
    get = lambda f: F.when(ok, F.col("fields")[f])
    return out.withColumn("reasons", reasons).select(
        "raw_id", "source_file", "line_no", F.expr("try_cast(IF(size(reasons) = 0, fields['test_duration'], null) AS DOUBLE)").alias("test_duration"),
        get("build").alias("build"), get("test_name").alias("test_name"), F.upper(get("test_result")).alias("test_result"), "reasons",
    )


def found(lines: DataFrame) -> DataFrame:
    """raw_id of each line after a file's first that does not load; each once."""
    split, bad = _judged(lines)
    return split.filter("fault IS NOT NULL").select("raw_id").union(bad.select("raw_id")).distinct()


def report(lines: DataFrame) -> DataFrame:
    """Per source file: lines, loaded, rejected and the rejected share."""
    bad = F.size("reasons") > 0
    return load(lines).groupBy("source_file").agg(
        F.count("*").alias("n_lines"), F.count_if(~bad).alias("n_loaded"), F.count_if(bad).alias("n_rejected"), F.avg(bad.cast("double")).alias("rejected_share")
    )
