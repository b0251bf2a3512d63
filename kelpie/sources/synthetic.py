"""Made-up telemetry for demonstrations: the same rows for the same seed, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tests of the made-up project; the one on the database is slow and fails more often.
TESTS = ["test_database_connection", "test_login", "test_checkout", "test_search", "test_mail", "test_upload", "test_cache", "test_report", "test_profile"]


def pull_requests(spark: SparkSession, n: int = 100) -> DataFrame:
    """(pr, sha, title) of ``n`` pull requests whose hashes come from their numbers."""
    return spark.range(n).select(F.col("id").alias("pr"), F.sha1(F.col("id").cast("string")).alias("sha"), F.concat(F.lit("change "), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(40)).cast("int"))).alias("title"))


def _draw(seed: int, *of: str) -> Column:
    """A number in [0, 1) that depends on the seed and on the columns only."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) / float(1 << 30)


def telemetry(prs: DataFrame, seed: int = 42) -> DataFrame:
    """(phase, build, test_name, test_duration, test_result) of 3 to 9 tests per pull request, before and after it.

    A test fails with 5 % plus half a percent per character of the title, the database test with 20 % more and 15 s longer.
    Of the tests that pass, 15 % fail afterwards; a fifth of all get slower by a factor of 1.2 to 3.
    """
    t = prs.crossJoin(F.broadcast(prs.sparkSession.createDataFrame([(x,) for x in TESTS], "test_name string")))  # nine rows
    t = t.withColumn("k", 3 + F.floor(_draw(seed, "sha") * 7)).withColumn("place", F.sum(F.lit(1)).over(_by_draw(seed)))
    t = t.filter("place <= k")
    churn, db = F.length("title"), F.col("test_name") == TESTS[0]
    slow = 0.5 + 11.5 * _draw(seed + 1, "sha", "test_name") + F.when(db, 15.0).otherwise(0.0) + 0.1 * churn
    fails = _draw(seed + 2, "sha", "test_name") < 0.05 + 0.005 * churn + F.when(db, 0.2).otherwise(0.0)
    t = t.select("sha", "test_name", F.round(slow, 2).alias("d"), fails.alias("f"))
    breaks = ~F.col("f") & (_draw(seed + 3, "sha", "test_name") < 0.15)
    later = F.when(_draw(seed + 4, "sha", "test_name") < 0.2, F.round(F.col("d") * (1.2 + 1.8 * _draw(seed + 5, "sha", "test_name")), 2)).otherwise(F.col("d"))
    row = lambda phase, d, f: F.struct(F.lit(phase).alias("phase"), F.col("sha").alias("build"), F.col("test_name").alias("test_name"), d.alias("test_duration"), F.when(f, "FAILED").otherwise("PASSED").alias("test_result"))
    return t.select(F.inline(F.array(row("pre", F.col("d"), F.col("f")), row("post", later, F.col("f") | breaks))))


def _by_draw(seed: int):
    from pyspark.sql.window import Window

    return Window.partitionBy("sha").orderBy(_draw(seed + 6, "sha", "test_name"), "test_name")  # nine rows a pull request
