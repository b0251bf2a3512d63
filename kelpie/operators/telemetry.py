"""CI telemetry: cleaning, feature windows, pre/post deltas and summaries of test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import blanks, cut, in_ranges, join_safe, lookup, quantiles

# Flags of a test name and the pattern that sets each (letter case counts).
NAME_FLAGS = {
    "is_unit": "unit|Unit",
    "is_integration": "integrat|Integration|IT",
    "is_e2e": "e2e|E2E|end.to.end",
    "is_perf": "perf|Perf|benchmark|Benchmark|load|Load",
    "is_smoke": "smoke|Smoke|sanity|Sanity",
}
# Flags of a training row and the words in its test name that set each (letter case does not count).
TRAINING_FLAGS = {
    "is_shared_db": "db|database|sql",
    "is_frontend_contract": "contract|api|frontend",
    "is_shared_utility": "util|helper|common",
    "is_kafka_consumer": "consumer|kafka|stream",
    "is_kafka_producer": "producer|publisher|emit",
}


def typed(runs: DataFrame) -> DataFrame:
    """phase, build, test_name, duration, result: values trimmed, results as 1, 0 or null, NaN durations null; distinct rows."""
    d = F.col("test_duration")
    r = F.upper(blanks("test_result"))
    return runs.select(
        "phase", blanks("build").alias("build"), blanks("test_name").alias("test_name"), F.when(~F.isnan(d), d).alias("duration"), r.alias("r"),
    ).distinct().filter("build IS NOT NULL OR test_name IS NOT NULL").select(
        "phase", "build", "test_name", F.when(F.col("duration") >= 0, F.col("duration")).alias("duration"), F.when(F.col("r") == "PASSED", 1).when(F.col("r") == "FAILED", 0).alias("result"),
    )


def clean(runs: DataFrame) -> DataFrame:
    """Typed runs with durations imputed (median of the test, then of the phase), an outlier flag (3 x IQR), and a result.

    Statistics are kept per phase and taken before rows without a result are dropped. Runs are read once; medians and
    quartiles come from counts per distinct value (``quantiles``), and medians are joined back with salt, so neither a
    phase nor a test that holds most rows is gathered in one task. Phases and tests may be null; empty tables stay empty.
    """
    n = cut(typed(runs).withColumn("key", F.concat_ws("\x1f", F.coalesce("phase", F.lit("\x1e")), F.coalesce("test_name", F.lit("\x1e")))))
    median = quantiles(n.filter("duration IS NOT NULL"), ["key"], "duration", [0.5]).select("key", F.col("q")[0].alias("tm"))
    m = cut(lookup(n, median, "key").select("phase", "build", "test_name", "result", F.coalesce("duration", "tm").alias("duration")))
    counts = cut(m.groupBy("phase", "duration").agg(F.count("*").alias("c")))
    gm = quantiles(counts, ["phase"], "duration", [0.5], "c").select("phase", F.col("q")[0].alias("gm"))
    filled = join_safe(counts, gm, ["phase"], "left", small=True).select("phase", F.coalesce("duration", "gm").alias("duration"), "c")  # two phases
    q = quantiles(filled, ["phase"], "duration", [0.25, 0.75], "c").select("phase", F.col("q").alias("q"))
    facts = join_safe(gm, q, ["phase"])
    span = 3 * (F.col("q")[1] - F.col("q")[0])
    out = (F.col("duration") < F.col("q")[0] - span) | (F.col("duration") > F.col("q")[1] + span)
    i = join_safe(m.filter("result IS NOT NULL"), facts, ["phase"], "left", small=True)
    i = i.select("phase", "build", "test_name", F.coalesce("duration", "gm").alias("duration"), "result", "q")
    return i.select("phase", "build", "test_name", "duration", "result", F.coalesce(out, F.lit(False)).cast("int").alias("is_outlier"))


def per_key(cleaned: DataFrame) -> DataFrame:
    """Mean and sample deviation of durations, pass rate, failures and runs of each phase, build and test."""
    return cleaned.groupBy("phase", "build", "test_name").agg(
        F.avg("duration").alias("duration_mean"), F.stddev_samp("duration").alias("duration_std"), F.avg("result").alias("pass_rate"),
        F.count_if(F.col("result") == 0).alias("failure_count"), F.count("*").alias("total_runs"),
    )


def combined(runs: DataFrame) -> DataFrame:
    """Pre and post figures side by side (full outer), deltas, regression label (pre >= 0.8, post < 0.5), one-sided flags."""
    k = per_key(clean(runs).filter("build IS NOT NULL AND test_name IS NOT NULL"))
    measures = ["duration_mean", "duration_std", "pass_rate", "failure_count", "total_runs"]
    side = lambda p: k.filter(F.col("phase") == p).select("build", "test_name", *[F.col(m).alias(f"{m}_{p}") for m in measures])
    j = side("pre").join(side("post"), ["build", "test_name"], "full")
    reg = F.coalesce((F.col("pass_rate_pre") >= 0.8) & (F.col("pass_rate_post") < 0.5), F.lit(False))
    j = j.withColumns({
        "delta_pass_rate": F.col("pass_rate_post") - F.col("pass_rate_pre"), "delta_duration": F.col("duration_mean_post") - F.col("duration_mean_pre"),
        "regression_detected": reg.cast("int"), "only_in_pre": F.col("total_runs_post").isNull().cast("int"), "only_in_post": F.col("total_runs_pre").isNull().cast("int"),
    })
    return j.fillna(0, ["failure_count_pre", "failure_count_post", "total_runs_pre", "total_runs_post"])


def duration_features(cleaned: DataFrame) -> DataFrame:
    """Log, z-score and min-max of durations per phase, and mean, deviation and ratio per test; runs without a test are left out."""
    cleaned = cut(cleaned)
    p = cleaned.groupBy("phase").agg(F.avg("duration").alias("m"), F.stddev_samp("duration").alias("s"), F.min("duration").alias("lo"), F.max("duration").alias("hi"))
    named = cleaned.filter("test_name IS NOT NULL AND phase IS NOT NULL")
    t = named.groupBy("phase", "test_name").agg(F.avg("duration").alias("test_mean"), F.coalesce(F.stddev_samp("duration"), F.lit(0.0)).alias("test_std"))
    d = F.col("duration")
    span = F.col("hi") - F.col("lo")
    return lookup(named.join(F.broadcast(p), "phase"), t, ["phase", "test_name"], "inner").select(
        "phase", "build", "test_name", "duration", F.log1p(d).alias("log_duration"), ((d - F.col("m")) / (F.col("s") + 1e-8)).alias("z"),
        F.when(span > 0, (d - F.col("lo")) / span).otherwise(0.0).alias("scaled"), "test_mean", "test_std", (d / (F.col("test_mean") + 1e-8)).alias("ratio"),
    )


def history(cleaned: DataFrame) -> DataFrame:
    """Pass and failure rate, runs, failures and flakiness of each test per phase."""
    p = F.avg("result")
    return cleaned.groupBy("phase", "test_name").agg(
        p.alias("pass_rate"), (1 - p).alias("failure_rate"), F.count("*").alias("n_runs"), F.count_if(F.col("result") == 0).alias("n_failures"), (1 - 2 * F.abs(p - 0.5)).alias("flakiness")
    )


def build_stats(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("phase", "build").agg(
        F.avg("result").alias("pass_rate"), F.count("*").alias("n_runs"), F.count_if(F.col("result") == 0).alias("n_failures"), F.max(1 - F.col("result")).alias("has_failure")
    )


def _name_columns(c: Column) -> list[Column]:
    depth = F.size(F.filter(F.split(c, r"[./:#_\-]"), lambda x: x != ""))
    flags = [c.rlike(p).cast("int").alias(k) for k, p in NAME_FLAGS.items()]
    return [*flags, F.length(c).alias("name_length"), depth.alias("name_depth"), F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long").alias("name_hash")]


def name_features(runs: DataFrame) -> DataFrame:
    """Flags, length, depth and a stable hash of each distinct test name."""
    names = runs.select(blanks("test_name").alias("test_name")).filter("test_name <> ''").distinct()
    return names.select("test_name", *_name_columns(F.col("test_name")))


def _segments(build: Column) -> list[Column]:
    parts = F.split(build, "[/_]")
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f"segment_{i + 1}") for i in range(4)] + [F.size(parts).alias("depth")]


def dense_codes(values: DataFrame, column: str) -> DataFrame:
    """0-based rank of each distinct value in code-point order: row numbers inside ranges, after the sizes of the ranges before."""
    v = in_ranges(values.select(column).filter(F.col(column).isNotNull()).distinct(), column)
    sizes = v.groupBy("__p").agg(F.count("*").alias("__n"))
    base = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"))  # a row per range
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(column)) - 1 + F.col("__base")
    return v.join(F.broadcast(base), "__p").select(column, rank.cast("long").alias("code"))


def build_segments(runs: DataFrame) -> DataFrame:
    """Four segments and depth of each distinct build, and the codes of the build and of each segment among all builds."""
    b = cut(runs.select(blanks("build").alias("build")).filter("build <> ''").distinct().select("build", *_segments(F.col("build"))))
    long = b.select("build", F.posexplode(F.array(*[f"segment_{i}" for i in range(1, 5)])).alias("at", "value"))
    v = in_ranges(long.select("at", "value").distinct(), "at", "value")
    sizes = v.groupBy("__p", "at").agg(F.count("*").alias("n"))  # ranges and four positions
    base = sizes.select("__p", "at", (F.sum("n").over(Window.partitionBy("at").orderBy("__p")) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("__p", "at").orderBy("value")) - 1 + F.col("base")
    codes = v.join(F.broadcast(base), ["__p", "at"]).select("at", "value", rank.cast("long").alias("c"))
    wide = lookup(long, codes, ["at", "value"], "inner").groupBy("build").agg(*[F.max(F.when(F.col("at") == i, F.col("c"))).alias(f"segment_{i + 1}_code") for i in range(4)])
    return b.join(wide, "build").join(dense_codes(b, "build"), "build")


def engineered(cleaned: DataFrame) -> DataFrame:
    """Every cleaned run with all features beside it: of its duration, its test's and build's history, its names.

    Statistics are per phase; they are joined with salt, so a test or build that holds a third of the runs is no
    bottleneck. A null test or build has null features of its own, and its history is that of all such runs.
    """
    cleaned = cut(cleaned)
    p = cleaned.groupBy("phase").agg(F.avg("duration").alias("m"), F.stddev_samp("duration").alias("s"), F.min("duration").alias("lo"), F.max("duration").alias("hi"))
    key = lambda c: F.concat_ws("\x1f", F.coalesce("phase", F.lit("\x1e")), F.coalesce(c, F.lit("\x1e")))
    rows = cleaned.withColumns({"tk": key("test_name"), "bk": key("build")})
    rate = F.avg("result")
    failed = F.count_if(F.col("result") == 0)
    t = rows.groupBy("tk").agg(F.avg("duration").alias("test_mean"), F.coalesce(F.stddev_samp("duration"), F.lit(0.0)).alias("test_std"), rate.alias("test_pass_rate"), F.count("*").alias("test_runs"), failed.alias("test_failures"))
    b = rows.groupBy("bk").agg(rate.alias("build_pass_rate"), F.count("*").alias("build_runs"), failed.alias("build_failures"))
    j = lookup(lookup(rows, t, "tk", "inner"), b, "bk", "inner")
    j = join_safe(j, p, ["phase"], small=True)
    d, span = F.col("duration"), F.col("hi") - F.col("lo")
    return j.select(
        "phase", "build", "test_name", "duration", "result", "is_outlier", F.log1p(d).alias("duration_log"), ((d - F.col("m")) / (F.col("s") + 1e-8)).alias("duration_zscore"),
        F.when(span > 0, (d - F.col("lo")) / span).otherwise(0.0).alias("duration_normalized"), "test_mean", "test_std", (d / (F.col("test_mean") + 1e-8)).alias("duration_ratio"),
        "test_pass_rate", (1 - F.col("test_pass_rate")).alias("test_failure_rate"), "test_runs", "test_failures", (1 - 2 * F.abs(F.col("test_pass_rate") - 0.5)).alias("test_flakiness"),
        "build_pass_rate", "build_runs", "build_failures", (F.col("build_failures") > 0).cast("int").alias("build_has_failure"), *_name_columns(F.col("test_name")), *_segments(F.col("build")),
    )


def totals(combined_table: DataFrame) -> DataFrame:
    """Records, regressions, and records of one phase only, as one row; null flags count as 0."""
    s = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    return combined_table.agg(F.count("*").alias("n_records"), s("regression_detected"), s("only_in_pre"), s("only_in_post"))


def history_of(tests: DataFrame, combined_table: DataFrame) -> DataFrame:
    """(test, failure_rate, duration) of each test path or name: by the stem of its last part, else by its full name, else 0 and 30 s.

    ``tests`` has a column test. History is keyed by the stem of the recorded test name and by the name itself; where
    several records share a key the last in order of build, name and record wins. Both lookups are salted.
    """
    stem = lambda c: F.regexp_extract(F.element_at(F.split(c, "/"), -1), r"^(.+?)(?:\.[^.]*)?$", 1)
    num = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rate = F.coalesce(num("failure_count_pre") / F.greatest(F.coalesce(num("total_runs_pre"), F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    c = combined_table.filter("build IS NOT NULL AND test_name IS NOT NULL").select(
        F.struct("build", "test_name", "record_id").alias("o"), F.explode(F.array_distinct(F.array(F.struct(F.lit("s").alias("by"), stem("test_name").alias("key")), F.struct(F.lit("n").alias("by"), F.col("test_name").alias("key"))))).alias("k"),
        F.struct(rate.alias("rate"), F.coalesce(num("duration_mean_pre"), F.lit(30.0)).alias("duration")).alias("v"),
    )
    last = c.filter("k.key <> ''").groupBy("k").agg(F.max_by("v", "o").alias("v"))
    asked = tests.select("test").distinct().select("test", F.struct(F.lit("s").alias("by"), stem("test").alias("key")).alias("k"), F.struct(F.lit("n").alias("by"), F.col("test").alias("key")).alias("k2"))
    one = lookup(asked, last.withColumnRenamed("v", "v1"), "k")
    two = lookup(one, last.select(F.col("k").alias("k2"), F.col("v").alias("v2")), "k2")
    v = F.coalesce("v1", "v2")
    return two.select("test", F.coalesce(v["rate"], F.lit(0.0)).alias("failure_rate"), F.coalesce(v["duration"], F.lit(30.0)).alias("duration"))


def summary(runs: DataFrame) -> DataFrame:
    """Distinct builds and tests, mean duration and null counts per phase, before cleaning."""
    t = typed(runs)
    return t.groupBy("phase").agg(
        F.count("*").alias("n_rows"), F.countDistinct("build").alias("n_builds"), F.countDistinct("test_name").alias("n_tests"),
        F.avg("duration").alias("mean_duration"), F.count_if(F.col("duration").isNull()).alias("null_durations"), F.count_if(F.col("result").isNull()).alias("null_results"),
    )


def describe(cleaned: DataFrame) -> DataFrame:
    """Eight figures of the durations of each phase."""
    cleaned = cut(cleaned.select("phase", "duration"))
    a = cleaned.groupBy("phase").agg(F.count("duration").alias("n"), F.avg("duration").alias("mean"), F.stddev_samp("duration").alias("std"), F.min("duration").alias("least"), F.max("duration").alias("most"))
    j = join_safe(a, quantiles(cleaned, ["phase"], "duration", [0.25, 0.5, 0.75]).select("phase", "q"), ["phase"], "left")
    return j.select("phase", "n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "most")


def top_failing(cleaned: DataFrame, k: int = 10) -> DataFrame:
    """The k tests with the most failures of each phase; ties by name."""
    f = cleaned.filter("result = 0 AND test_name IS NOT NULL").groupBy("phase", "test_name").agg(F.count("*").alias("n_failures"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("n_failures"), "test_name"))).filter(F.col("rank") <= k)


def class_balance(cleaned: DataFrame) -> DataFrame:
    """Counts and shares of results per phase, and the larger class over the smaller."""
    c = cleaned.groupBy("phase", "result").agg(F.count("*").alias("n"))
    w = Window.partitionBy("phase")
    return c.select("phase", "result", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.max("n").over(w) / F.min("n").over(w)).alias("imbalance"))


def last_rates(combined_table: DataFrame) -> DataFrame:
    """Failure rate by stem of the test name; the last row in order of build and test wins."""
    stem = F.regexp_extract(F.element_at(F.split("test_name", "/"), -1), r"^(.+?)(?:\.[^.]*)?$", 1)
    c = combined_table.filter("build IS NOT NULL AND test_name IS NOT NULL AND test_name NOT LIKE '%/'").withColumn("stem", stem)
    rate = F.coalesce(F.try_divide("failure_count_pre", F.greatest("total_runs_pre", F.lit(1))), F.lit(0.0))
    return c.groupBy("stem").agg(F.max_by(rate, F.struct("build", "test_name", "record_id")).alias("failure_rate"))


def training_matrix(combined_table: DataFrame) -> DataFrame:
    """The sixteen features of a (module, test) pair and the label, as far as a combined record tells; missing figures by default.

    Null and NaN figures count as missing. What only a change shows is constant: no direct dependency, depth 1, hash
    changed, no functions, no test file. Similarity and flakiness are read where the table has them, else 0.5 and 0.
    """
    has = set(combined_table.columns)
    num = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    low = F.lower(F.coalesce("test_name", F.lit("")))
    flag = {k: low.rlike(p).cast("int") for k, p in TRAINING_FLAGS.items()}
    some = lambda c, missing: F.coalesce(num(c), F.lit(missing)) if c in has else F.lit(missing)
    zero = F.lit(0.0)
    least_one = lambda c: F.when(num(c) < 1, 1.0).otherwise(num(c))
    return combined_table.select(
        "record_id", some("similarity_score", 0.5).alias("cosine_similarity"), F.coalesce(F.abs(num("delta_duration")) / 500, zero).alias("change_size"),
        F.coalesce(1 - num("pass_rate_pre"), zero).alias("module_impact_score"), F.lit(0).alias("is_direct_dependency"), F.lit(1).alias("transitive_depth"),
        *[flag[k].alias(k) for k in TRAINING_FLAGS],
        F.coalesce(num("failure_count_pre") / least_one("total_runs_pre"), zero).alias("historical_failure_rate"), some("test_flakiness_score", 0.0).alias("test_flakiness_score"),
        F.coalesce(F.ln(least_one("duration_mean_pre") + 1), zero).alias("duration_log"),
        F.lit(1).alias("hash_changed"), F.lit(0).alias("num_functions_changed"), F.lit(0).alias("is_test_file"), F.coalesce("regression_detected", F.lit(0)).alias("label"),
    )
