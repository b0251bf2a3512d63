"""Models trained here: failure prediction by boosted trees, with held-out figures, and a content embedding."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, Normalizer, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import cut, in_ranges, lookup
from kelpie.functions.paths import stem

FEATURES = [
    "cosine_similarity", "change_size", "module_impact_score", "is_direct_dependency", "transitive_depth", "is_shared_db", "is_frontend_contract", "is_shared_utility",
    "is_kafka_consumer", "is_kafka_producer", "historical_failure_rate", "test_flakiness_score", "duration_log", "hash_changed", "num_functions_changed", "is_test_file",
]
SMALL_FEATURES = ["cosine_similarity", "change_size", "module_impact_score", "is_kafka_consumer", "is_kafka_producer", "is_shared_db", "is_frontend_contract", "is_shared_utility", "transitive_depth"]
TREES, DEPTH, STEP = 300, 6, 0.05
_GRAM = 6  # characters of the pieces by which stems and names are compared
LEAST_ROWS = 10  # of run history and of labelled rows, below which nothing is retrained

# Prior rows of the sixteen features and the label, ten that fail and ten that pass.
PRIOR = [
    (0.92, 0.08, 0.90, 1, 0.17, 0, 0, 0, 0, 0, 0.80, 0.30, 3.4, 1, 0.15, 0, 1),
    (0.88, 0.10, 0.85, 1, 0.17, 0, 0, 0, 0, 0, 0.70, 0.20, 2.8, 1, 0.10, 0, 1),
    (0.78, 0.15, 0.75, 1, 0.33, 1, 0, 0, 0, 0, 0.50, 0.15, 3.0, 1, 0.05, 0, 1),
    (0.65, 0.20, 0.60, 0, 0.50, 0, 1, 0, 0, 0, 0.40, 0.40, 2.5, 1, 0.10, 0, 1),
    (0.72, 0.12, 0.70, 1, 0.17, 0, 0, 1, 0, 0, 0.60, 0.25, 3.2, 1, 0.20, 1, 1),
    (0.85, 0.30, 0.80, 0, 0.33, 0, 0, 0, 1, 0, 0.55, 0.10, 4.0, 1, 0.25, 0, 1),
    (0.60, 0.40, 0.55, 0, 0.50, 1, 1, 0, 0, 1, 0.45, 0.35, 2.0, 1, 0.30, 0, 1),
    (0.95, 0.05, 0.95, 1, 0.17, 0, 0, 0, 0, 0, 0.90, 0.10, 2.5, 1, 0.05, 0, 1),
    (0.50, 0.50, 0.50, 0, 0.67, 0, 0, 1, 0, 0, 0.35, 0.45, 3.5, 1, 0.35, 0, 1),
    (0.70, 0.25, 0.65, 1, 0.33, 0, 0, 0, 1, 1, 0.65, 0.20, 3.8, 0, 0.20, 0, 1),
    (0.15, 0.06, 0.10, 0, 0.83, 0, 0, 0, 0, 0, 0.05, 0.05, 2.0, 0, 0.00, 0, 0),
    (0.20, 0.04, 0.12, 0, 1.00, 0, 0, 0, 0, 0, 0.08, 0.08, 1.5, 0, 0.00, 0, 0),
    (0.10, 0.02, 0.05, 0, 1.00, 0, 0, 0, 0, 0, 0.02, 0.03, 3.0, 0, 0.00, 0, 0),
    (0.25, 0.05, 0.15, 0, 0.83, 0, 0, 0, 0, 0, 0.10, 0.12, 2.2, 0, 0.00, 0, 0),
    (0.18, 0.03, 0.08, 0, 1.00, 0, 0, 0, 0, 0, 0.04, 0.06, 1.8, 0, 0.00, 0, 0),
    (0.30, 0.08, 0.20, 0, 0.67, 0, 0, 0, 0, 0, 0.12, 0.15, 2.5, 0, 0.05, 0, 0),
    (0.22, 0.06, 0.14, 0, 0.83, 0, 0, 0, 0, 0, 0.06, 0.07, 2.0, 0, 0.00, 0, 0),
    (0.12, 0.04, 0.07, 0, 1.00, 0, 0, 0, 0, 0, 0.03, 0.04, 2.8, 0, 0.00, 0, 0),
    (0.35, 0.10, 0.25, 0, 0.67, 0, 0, 0, 0, 0, 0.15, 0.18, 3.0, 0, 0.05, 0, 0),
    (0.28, 0.07, 0.18, 0, 0.83, 0, 0, 0, 0, 0, 0.09, 0.11, 2.3, 0, 0.00, 0, 0),
]
# Rows of the nine features and the label, for want of any data.
SMALL_PRIOR = [
    (0.9, 10, 0.95, 0, 0, 0, 0, 0, 1, 0),
    (0.2, 50, 0.10, 1, 0, 1, 0, 0, 2, 1),
    (0.7, 20, 0.80, 0, 0, 0, 1, 0, 1, 0),
    (0.1, 80, 0.05, 0, 1, 1, 0, 0, 3, 1),
    (0.5, 30, 0.60, 1, 1, 0, 0, 1, 2, 1),
    (0.8, 15, 0.90, 0, 0, 0, 0, 0, 1, 0),
    (0.3, 60, 0.20, 1, 0, 1, 1, 0, 2, 1),
]


def prior(spark: SparkSession, seed: int = 42) -> DataFrame:
    """The prior rows, each once as it is and once with noise (sigma 0.03, then held within [0, 1])."""
    names = [*FEATURES, "label"]
    base = spark.createDataFrame([tuple(float(x) for x in r[:-1]) + (int(r[-1]), i) for i, r in enumerate(PRIOR)], ", ".join(f"{c} double" for c in FEATURES) + ", label int, record_id long")
    noisy = base.select(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) + 0.03 * F.randn(seed + i))).alias(c) for i, c in enumerate(FEATURES)], "label", (F.col("record_id") + len(PRIOR)).alias("record_id"))
    return base.union(noisy).select("record_id", *names)


def small_prior(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) for x in r[:-1]) + (int(r[-1]), i) for i, r in enumerate(SMALL_PRIOR)], ", ".join(f"{c} double" for c in SMALL_FEATURES) + ", label int, record_id long").select("record_id", *SMALL_FEATURES, "label")


def stratified(matrix: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``matrix`` with ``held_out``: of each label the first ``share`` in the order of a hash of record_id, to the row.

    Ranks come from ranges of (label, hash), so no task sees all rows of a label.
    """
    h = matrix.withColumn("__h", F.xxhash64("record_id", F.lit(seed)))
    r = in_ranges(h, "label", "__h", "record_id")
    own = r.groupBy("label", "__p").agg(F.count("*").alias("c"))
    key = Window.partitionBy("label")
    base = own.select("label", "__p", (F.sum("c").over(key.orderBy("__p")) - F.col("c")).alias("b"), F.sum("c").over(key).alias("n"))  # a row per range and label
    at = F.row_number().over(Window.partitionBy("label", "__p").orderBy("__h", "record_id")) + F.col("b")
    return r.join(F.broadcast(base), ["label", "__p"]).withColumn("held_out", at <= F.round(F.col("n") * share)).drop("__h", "__p", "b", "n")


def fit(train: DataFrame, features: list[str] = FEATURES, check: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = 42) -> PipelineModel:
    """Scaled boosted trees, the rarer label weighted up by the ratio of counts.

    ``check`` rows stop the growth of trees when they no longer gain. One label alone is learnt as it is.
    """
    n = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two labels
    ratio = n.get(0, 1) / max(n.get(1, 1), 1)
    ready = lambda d, held: d.withColumn("w", F.when(F.col("label") == 1, ratio).otherwise(1.0)).withColumn("label", F.col("label").cast("double")).withColumn("held", F.lit(held))
    rows = ready(train, False) if check is None else ready(train, False).unionByName(ready(check, True))
    trees_ = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=STEP, subsamplingRate=0.8, minInstancesPerNode=3, weightCol="w", seed=seed, checkpointInterval=-1)
    if check is not None:
        trees_ = trees_.setValidationIndicatorCol("held")
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), trees_]
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, matrix: DataFrame) -> DataFrame:
    return model.transform(matrix).select("record_id", "label", vector_to_array("probability")[1].alias("pf"), F.col("prediction").cast("int").alias("predicted"))


def metrics(scored: DataFrame) -> DataFrame:
    """One row: n, positives, precision, recall, F1, accuracy and the area under the ROC curve (null with one label only).

    The area is that of ranks with ties shared, from counts per distinct probability in ranges.
    """
    tp, fp = F.count_if((F.col("label") == 1) & (F.col("predicted") == 1)), F.count_if((F.col("label") == 0) & (F.col("predicted") == 1))
    fn, ok = F.count_if((F.col("label") == 1) & (F.col("predicted") == 0)), F.count_if(F.col("label") == F.col("predicted"))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    flat = scored.agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_positive"), F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), F.try_divide(ok, F.count("*")).alias("accuracy"),
    )
    c = in_ranges(scored.groupBy("pf").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("m")), "pf")
    own = c.groupBy("__p").agg(F.sum("m").alias("s"))
    base = own.select("__p", (F.sum("s").over(Window.orderBy("__p")) - F.col("s")).alias("b"))  # a row per range
    below = F.sum("m").over(Window.partitionBy("__p").orderBy("pf")) - F.col("m") + F.col("b")
    area = c.join(F.broadcast(base), "__p").withColumn("won", F.col("p") * (below + F.col("m") / 2)).agg(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("m")).cast("double")).alias("auc"))
    return flat.crossJoin(F.broadcast(area))


def evaluated(matrix: DataFrame, features: list[str] = FEATURES, trees: int = TREES, depth: int = DEPTH) -> tuple[PipelineModel, DataFrame]:
    """A model fitted on four fifths of every label, and the scores of the fifth held out."""
    s = cut(stratified(matrix))
    train, held = s.filter("NOT held_out"), s.filter("held_out")
    model = fit(train, features, held, trees, depth)
    return model, score(model, held)


def importance(model: PipelineModel, features: list[str] = FEATURES) -> DataFrame:
    """(feature, importance, rank), the largest first; ties by name."""
    v = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    d = SparkSession.active().createDataFrame(list(zip(features, v)), "feature string, importance double")
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # a row per feature


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def first_outcomes(runs: DataFrame, combined_table: DataFrame) -> DataFrame:
    """(run_id, test, regression, pass_rate): each selected test of a run with the first outcome whose test name holds its stem.

    First is the smallest record_id. A name that holds a stem holds every piece of it, so names are looked up by the stem's
    rarest piece of six characters before the substring test; shorter stems are looked up whole among all short pieces.
    """
    tests = runs.select("run_id", F.explode(F.array_distinct("selected_tests")).alias("test")).filter("test IS NOT NULL").withColumn("stem", stem("test")).filter("stem <> ''")
    names = combined_table.filter("test_name IS NOT NULL").groupBy("test_name").agg(F.min_by(F.struct("record_id", "regression_detected", "pass_rate_pre"), "record_id").alias("o"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - _GRAM + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(_GRAM))))
    asked = tests.select("stem").distinct()
    held = names.select("test_name", "o", F.explode(grams(F.col("test_name"))).alias("gram"))
    freq = held.groupBy("gram").agg(F.count("*").alias("n"))
    parts = asked.filter(F.length("stem") >= _GRAM).select("stem", F.explode(grams(F.col("stem"))).alias("gram"))
    # a name that holds the stem holds all its grams: the rarest of them finds every such name; a gram of none finds none
    rare = lookup(parts, freq, "gram").groupBy("stem").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    hit = rare.join(held, "gram").filter(F.contains("test_name", F.col("stem"))).groupBy("stem").agg(F.min("o").alias("o"))
    short = asked.filter(F.length("stem") < _GRAM)
    pieces = F.expr(f"array_distinct(flatten(transform(sequence(1, {_GRAM - 1}), k -> transform(sequence(1, length(test_name)), i -> substr(test_name, i, k)))))")
    small = names.filter("test_name <> ''").select("o", F.explode(pieces).alias("stem")).groupBy("stem").agg(F.min("o").alias("o"))
    found = hit.union(short.join(small, "stem").select("stem", "o"))
    return lookup(tests, found, "stem", "inner").select("run_id", "test", F.col("o.record_id").alias("record_id"), F.coalesce("o.regression_detected", F.lit(0)).alias("regression"), F.coalesce("o.pass_rate_pre", F.lit(1.0)).alias("pass_rate"))


def retraining_matrix(runs: DataFrame, combined_table: DataFrame) -> DataFrame:
    """The nine features and the label of every selected test with an outcome, with set values where no run log tells."""
    o = first_outcomes(runs, combined_table)
    low = F.lower("test")
    has = lambda w: low.contains(w).cast("double")
    rate = F.when(F.isnan("pass_rate"), 1.0).otherwise(F.col("pass_rate"))
    fixed = {"cosine_similarity": 0.7, "change_size": 50.0, "is_kafka_consumer": 0.0, "is_kafka_producer": 0.0, "transitive_depth": 1.0}
    made = {"module_impact_score": 1 - rate, "is_shared_db": has("db"), "is_frontend_contract": has("api"), "is_shared_utility": has("util")}
    cols = [(F.lit(fixed[c]) if c in fixed else made[c]).alias(c) for c in SMALL_FEATURES]
    return o.select(F.xxhash64("run_id", "test").alias("record_id"), *cols, F.col("regression").cast("int").alias("label"))


def retrain(runs: DataFrame, combined_table: DataFrame, trees: int = 200) -> PipelineModel | None:
    """A model of ``retraining_matrix``, or None below ``LEAST_ROWS`` runs or labelled rows."""
    if runs.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return None
    m = cut(retraining_matrix(runs, combined_table))
    if m.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return None
    return evaluated(m, SMALL_FEATURES, trees)[0]


def content_vectors(files: DataFrame, terms: int = 5000, dim: int = 256, padded: int = 768) -> DataFrame:
    """(file_id, vector): words and word pairs weighted by 1 + ln tf and inverse document frequency, scaled to length 1, projected.

    The ``terms`` most frequent ones over all texts are kept, and the ``dim`` leading components of their second moments (no
    more than there are terms less one); the rest of ``padded`` is 0. Components come from a terms x terms matrix summed over
    all rows, which is bounded by ``terms``. Empty and null texts are zero vectors; an empty table gives none.
    """
    words = RegexTokenizer(inputCol="t", outputCol="one", pattern=r"\b\w\w+\b", gaps=False)
    pairs = NGram(n=2, inputCol="one", outputCol="two")
    both = pairs.transform(words.transform(files.select("file_id", F.coalesce("source_text", F.lit("")).alias("t")))).select("file_id", F.concat("one", "two").alias("terms"))
    if both.filter(F.size("terms") > 0).isEmpty():
        return files.select("file_id", F.array_repeat(F.lit(0.0), padded).alias("vector"))
    counts = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=terms).fit(both)
    n = len(counts.vocabulary)
    soft = F.transform(vector_to_array("tf"), lambda x: F.when(x > 0, 1 + F.ln(x)).otherwise(0.0))
    tf = counts.transform(both).select("file_id", array_to_vector(soft).alias("soft"))
    weighed = IDF(inputCol="soft", outputCol="w").fit(tf).transform(tf)
    unit = Normalizer(inputCol="w", outputCol="u").transform(weighed)
    k = max(1, min(dim, n - 1))
    out = PCA(k=k, inputCol="u", outputCol="c").fit(unit).transform(unit)
    return out.select("file_id", F.concat(vector_to_array("c"), F.array_repeat(F.lit(0.0), padded - k)).alias("vector"))
