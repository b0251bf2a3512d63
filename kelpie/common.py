"""Session, lineage and skew helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session(app: str = "kelpie", cores: str | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of the session's ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; on a cluster it is an error, as no machine's own disk
    outlives its executors. The result starts with fresh statistics: a checkpoint carries on the size that the optimizer
    estimated for its plan, and a join multiplies sizes, so in an iteration they would double their digits every round.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(?:\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kelpie-"))
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def lookup(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", salts: int = 8) -> DataFrame:
    """Join ``left`` to ``right``, which holds one row per key, with hot keys of ``left`` spread over ``salts`` tasks.

    The right side is repeated once per salt (a constant factor), so a key that holds a third of the left rows is
    read by ``salts`` tasks instead of one. Spark still broadcasts the right side where its size allows.
    """
    keys = [on] if isinstance(on, str) else list(on)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    wide = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(wide, [*keys, "__salt"], how).drop("__salt")


MOST_ROWS, MOST_BYTES = 100_000, 8 << 20


def attach(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", written: bool = False) -> DataFrame:
    """``lookup`` for a right side that is usually small: it is written (unless it is ``written``) and measured, and broadcast if it is.

    Up to ``MOST_ROWS`` rows and ``MOST_BYTES`` (as JSON) are sent to all executors, so that the left side is not shuffled;
    anything larger is joined with salt.
    """
    keys = [on] if isinstance(on, str) else list(on)
    held = right if written else cut(right)
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    if size.n <= MOST_ROWS and size.b <= MOST_BYTES:
        return left.join(F.broadcast(held), keys, how)
    return lookup(left, held, keys, how)


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of ``order`` of about equal size, with the range's number in ``__p``, as a written table.

    Ranges are numbered in order and equal values lie in one, so global ranks and running totals need only the sizes of
    the ranges and work inside each; no task sees all rows.
    """
    return cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))


def ranked(df: DataFrame, by: str, *order: str) -> DataFrame:
    """``df`` with ``rank``: 1, 2, ... within ``by`` (not null) in ascending order of ``order``, from ranges of both.

    A key that holds most rows is spread over many ranges, so no task sorts it alone.
    """
    r = in_ranges(df, by, *order)
    own = r.groupBy(by, "__p").agg(F.count("*").alias("__n"))
    base = own.select(by, "__p", (F.sum("__n").over(Window.partitionBy(by).orderBy("__p")) - F.col("__n")).alias("__b"))
    at = F.row_number().over(Window.partitionBy(by, "__p").orderBy(*order)) + F.col("__b")
    return r.join(base, [by, "__p"]).withColumn("rank", at).drop("__p", "__b")


def join_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join by keys that may be null, null meeting null; ``small`` says that the right side has a proven bound."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") if k in on else F.col(k) for k in right.columns])
    meet = F.lit(True)
    for k in on:
        meet = meet & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(F.broadcast(r) if small else r, meet, how).drop(*[f"__r_{k}" for k in on])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], weight: str | None = None) -> DataFrame:
    """``keys``, n and q (array): exact quantiles of ``value`` per key with linear interpolation, nulls left out.

    Rows are counted per distinct value first, then ranked by running totals inside ranges of (keys, value), so neither a
    key with most of the rows nor one with very many values is held by one task. ``weight`` counts rows for it.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("__c"))
    r = in_ranges(c, *keys, value)
    own = r.groupBy(*keys, "__p").agg(F.sum("__c").alias("__s"))
    key = Window.partitionBy(*keys)
    base = own.select(*keys, "__p", (F.sum("__s").over(key.orderBy("__p")) - F.col("__s")).alias("__b"), F.sum("__s").over(key).alias("__n"))
    at = join_safe(r, base, [*keys, "__p"])
    hi = F.sum("__c").over(Window.partitionBy(*keys, "__p").orderBy(value)) + F.col("__b")
    at = at.withColumn("__hi", hi).withColumn("__lo", F.col("__hi") - F.col("__c"))
    holds = lambda k: (F.col("__lo") <= k) & (F.col("__hi") > k)
    picks = []
    for p in probs:
        h = (F.col("__n") - 1) * F.lit(float(p))
        k = F.floor(h)
        picks.append(F.struct(F.max(F.when(holds(k), F.col(value))).alias("a"), F.max(F.when(holds(k + 1), F.col(value))).alias("b"), F.max(h - k).alias("f")))
    g = at.groupBy(*keys).agg(F.max("__n").alias("n"), F.array(*picks).alias("__q"))
    return g.select(*keys, "n", F.transform("__q", lambda x: x["a"] + F.coalesce((x["b"] - x["a"]) * x["f"], F.lit(0.0))).alias("q"))


def blanks(c: Column) -> Column:
    """The value without outer blanks (spaces, tabs, line ends)."""
    return F.trim(c, F.lit(" \t\r\n"))


def even(c: Column, digits: int = 6) -> Column:
    """Round for comparison across engines: a small offset keeps exact decimal ties off the rounding edge."""
    return F.round(c + F.lit(1.234567e-9), digits)
