"""Module registry and run log: keyed upserts, incremental plans, copies, value scores, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import ranked


def latest(registry: DataFrame) -> DataFrame:
    """One row per repo and path: the one updated last (ties: the larger hash). An upsert's view of an append log."""
    order = F.struct(F.coalesce("updated_at", F.lit(0).cast("timestamp")), F.coalesce("file_hash", F.lit("")), "module_id")
    keep = [c for c in registry.columns if c not in ("repo", "file_path")]
    return registry.groupBy("repo", "file_path").agg(F.max_by(F.struct(*keep), order).alias("r")).select("repo", "file_path", "r.*")


def upsert(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """``stored`` with the rows of ``changes`` added, or replaced by key (repo, file_path)."""
    return stored.join(changes.select("repo", "file_path"), ["repo", "file_path"], "left_anti").unionByName(changes)


def delete(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys.select("repo", "file_path"), ["repo", "file_path"], "left_anti")


def stats(registry: DataFrame) -> DataFrame:
    return registry.groupBy("repo").agg(F.count("*").alias("n_modules"), F.count("embedding").alias("n_embedded"), F.countDistinct("file_hash").alias("n_hashes"))


def plan(files: DataFrame, registry: DataFrame) -> DataFrame:
    """What an incremental load has to do with each file: new, changed or unchanged by content hash."""
    old = latest(registry).select("repo", "file_path", F.col("file_hash").alias("stored_hash"))
    j = files.select("file_id", "repo", "file_path", "file_hash").join(old, ["repo", "file_path"], "left")
    state = F.when(F.col("stored_hash").isNull(), "new").when(F.col("stored_hash").eqNullSafe(F.col("file_hash")), "unchanged").otherwise("changed")
    return j.select("file_id", "repo", "file_path", state.alias("state"))


def plan_counts(planned: DataFrame) -> DataFrame:
    """(state, n) of a ``plan``: the counts of an extraction report."""
    return planned.groupBy("state").agg(F.count("*").alias("n"))


def get(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """The latest rows of ``keys`` (repo, file_path), distinct; unknown keys give none."""
    return latest(registry.join(keys.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi"))


def copies(files: DataFrame) -> DataFrame:
    """Files whose content hash occurs more than once: the hash, how often, in how many repositories, and the first file."""
    g = files.filter("file_hash IS NOT NULL").groupBy("file_hash").agg(F.count("*").alias("n_files"), F.countDistinct("repo").alias("n_repos"), F.min("file_id").alias("first_file"))
    return g.filter("n_files > 1")


def value_scores(registry: DataFrame) -> DataFrame:
    """0.4 functions + 0.3 imports + 0.2 ln(lines + 1) + 0.1 classes of each module, missing features as 0."""
    f = lambda k: F.coalesce(F.col(f"ast_features.{k}"), F.lit(0))
    score = 0.4 * f("num_functions") + 0.3 * f("num_imports") + 0.2 * F.ln(f("num_lines") + 1.0) + 0.1 * f("num_classes")
    return latest(registry).select("module_id", "repo", "file_path", score.alias("score"))


def top_by_value(registry: DataFrame, k: int = 10) -> DataFrame:
    """The k modules of highest score of each repo."""
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "module_id")
    return value_scores(registry).withColumn("score", F.round(F.col("score") + 1.234567e-9, 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def listing(registry: DataFrame) -> DataFrame:
    """All modules of each repo with their rank by score, the highest first; ties by module_id. Rows without a repo are left out."""
    s = value_scores(registry).filter("repo IS NOT NULL").withColumn("score", F.round(F.col("score") + 1.234567e-9, 6)).withColumn("__down", -F.col("score"))
    return ranked(s, "repo", "__down", "module_id").drop("__down")


def runs_once(log: DataFrame) -> DataFrame:
    """One row per run_id: the one logged last."""
    keep = [c for c in log.columns if c != "run_id"]
    order = F.struct("created_at", F.coalesce("pruning_rate", F.lit(-1.0)), F.coalesce("carbon_gco2", F.lit(-1.0)))
    return log.groupBy("run_id").agg(F.max_by(F.struct(*keep), order).alias("r")).select("run_id", "r.*")


def recent(log: DataFrame, k: int = 50) -> DataFrame:
    """The k latest runs of each repo, newest first."""
    once = runs_once(log)
    w = Window.partitionBy("repo").orderBy(F.desc("created_at"), "run_id")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("repo", "run_id", "pr_number", "created_at", "rank")


def pruning(log: DataFrame) -> DataFrame:
    """Tests selected and pruned per repo, and the pruned share."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    g = log.groupBy("repo").agg(F.count("*").alias("n_runs"), F.sum(F.when(F.col("selected_tests").isNotNull(), size("selected_tests")).otherwise(0)).alias("n_selected"), F.sum(F.when(F.col("pruned_tests").isNotNull(), size("pruned_tests")).otherwise(0)).alias("n_pruned"))
    return g.withColumn("pruned_share", F.col("n_pruned") / F.greatest(F.col("n_selected") + F.col("n_pruned"), F.lit(1)))


def change_counts(log: DataFrame) -> DataFrame:
    """How many runs changed each file, as spelled after trimming."""
    f = log.select("run_id", F.explode("changed_files").alias("file")).select("run_id", F.trim("file").alias("file")).filter("file <> ''")
    return f.groupBy("file").agg(F.countDistinct("run_id").alias("n_runs"))
