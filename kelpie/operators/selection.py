"""Test selection per repo: what changed, which tests are candidates, their signals, scores, decisions and reports.

Every step is a table keyed by repo: changed modules, (changed, test) similarities, dependency tests, candidates with their
signals, decisions. Nothing is paired but changed modules (the queries) with tests, in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import cut, even, lookup
from kelpie.functions.paths import stem
from kelpie.operators import scoring
from kelpie.operators.similarity import cosine, dot

# Similarity of a pair, tests listed per changed module, and the share of failures that makes a test always run.
PAIR, TOP, ALWAYS = 0.70, 20, 0.20
DIRECT, TRANSITIVE, NONE = 0, 2, 999  # depths of a candidate


def versions(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, file_path, file_hash, embedding) as first stored and as stored last; one row each per module file."""
    order = F.struct(F.coalesce("updated_at", F.lit(0).cast("timestamp")), F.coalesce("file_hash", F.lit("")), "module_id", F.xxhash64("embedding"))
    row = F.struct("file_hash", "embedding")
    r = registry.filter("repo IS NOT NULL AND file_path IS NOT NULL").groupBy("repo", "file_path")
    both = r.agg(F.min_by(row, order).alias("a"), F.max_by(row, order).alias("b"))
    return both.select("repo", "file_path", "a.*"), both.select("repo", "file_path", "b.*")


def changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Every current file against the stored snapshot: old_hash, new_hash, hash_changed, is_new, sim.

    ``sim`` is the cosine of the stored and the current vector, 0 where either is missing, of another length, or zero; a file
    without a snapshot is new and counts as changed.
    """
    old = stored.select("repo", "file_path", F.col("file_hash").alias("old_hash"), F.col("embedding").alias("old_v"), F.lit(True).alias("known"))
    j = current.join(old, ["repo", "file_path"], "left")
    fits = (F.size("old_v") == F.size("embedding")) & F.forall("old_v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    sim = F.when(fits, cosine(F.col("old_v"), F.col("embedding")))
    return j.select(
        "repo", "file_path", "old_hash", F.col("file_hash").alias("new_hash"), (~F.col("old_hash").eqNullSafe(F.col("file_hash"))).alias("hash_changed"),
        F.col("known").isNull().alias("is_new"), F.coalesce(sim, F.lit(0.0)).alias("sim"),
    )


def change_impact(sim: Column, changed: Column, meaningful: Column, lines: Column) -> Column:
    """Impact of one changed module from its hash, vector, structure and changed lines."""
    yes = lambda c: F.coalesce(c, F.lit(True))
    return 0.3 * yes(changed).cast("int") + 0.3 * (1 - sim) + 0.2 * F.when(yes(meaningful), 1.0).otherwise(0.3) + 0.2 * scoring.least_one(F.coalesce(lines, F.lit(0)), 200.0)


def module_impact(functions: Column, imports: Column, lines: Column) -> Column:
    """Structural weight of a module in [0, 1]."""
    return F.least((0.4 * functions + 0.3 * imports + 0.2 * F.ln(lines + 1.0)) / 20, F.lit(1.0))


def pairs(sources: DataFrame, tests: DataFrame, k: int = TOP, least: float = PAIR, block: int = 256, salts: int = 8) -> DataFrame:
    """(repo, src, test, sim): of every source's ``k`` most similar tests of its repo those at ``least`` or above.

    Both tables are (repo, file_path, u) with unit vectors. Sources are packed in blocks, every test is read once per
    block of its repo and only its matches leave the expression; a repo that holds most tests is read by ``salts`` tasks.
    Ties go to the smaller path.
    """
    numbered = sources.select("repo", F.col("file_path").alias("src"), "u", F.pmod(F.xxhash64("file_path"), F.lit(1 << 20)).alias("h"))
    n = numbered.groupBy("repo").agg(F.ceil(F.count("*") / block).alias("blocks"))
    packed = lookup(numbered, n, "repo", "inner").groupBy("repo", F.pmod("h", F.col("blocks")).alias("b")).agg(F.collect_list(F.struct("src", "u")).alias("qs"))
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    t = tests.select("repo", F.col("file_path").alias("test"), "u", F.pmod(F.xxhash64("file_path"), F.lit(salts)).cast("int").alias("salt"))
    sims = F.transform("qs", lambda x: F.struct(x["src"].alias("src"), even(dot(F.col("u"), x["u"])).alias("sim")))
    hits = t.join(packed, ["repo", "salt"]).select("repo", "test", F.inline(F.filter(sims, lambda x: x["sim"] >= least))).filter("src <> test")
    w = Window.partitionBy("repo", "src").orderBy(F.desc("sim"), "test")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("repo", "src", "test", "sim")


def reached(edges: DataFrame, test_map: DataFrame, changed: DataFrame, depth: int = 5) -> DataFrame:
    """(repo, module, test, depth): mapped tests of changed modules (depth 0) and of modules that import them within ``depth`` steps.

    Breadth first per repo from all changed modules at once.
    """
    step = cut(edges.select("repo", F.col("imported").alias("file_path"), F.col("importer").alias("next")).distinct())
    seen = cut(changed.select("repo", "file_path").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        near = lookup(step, frontier.select("repo", "file_path"), ["repo", "file_path"], "inner").select("repo", F.col("next").alias("file_path")).distinct()
        frontier = cut(near.join(seen.select("repo", "file_path"), ["repo", "file_path"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return test_map.select("repo", F.col("module").alias("file_path"), "test").join(seen, ["repo", "file_path"]).withColumnRenamed("file_path", "module")


def dependency_tests(edges: DataFrame, test_map: DataFrame, changed: DataFrame, tests: DataFrame, depth: int = 5) -> DataFrame:
    """(repo, test, is_direct, is_transitive): tests of changed modules, of modules that import them, and changed tests themselves."""
    hit = reached(edges, test_map, changed, depth).select("repo", "test", "depth")
    own = changed.select("repo", "file_path").join(tests.select("repo", "file_path"), ["repo", "file_path"], "left_semi").select("repo", F.col("file_path").alias("test"), F.lit(0).alias("depth"))
    return hit.union(own).groupBy("repo", "test").agg(F.max((F.col("depth") == 0).cast("int")).alias("is_direct"), F.max((F.col("depth") > 0).cast("int")).alias("is_transitive"))


def candidates(changed: DataFrame, similar: DataFrame, dependent: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per repo and candidate test with all its signals.

    ``changed`` (repo, file_path, sim, hash_changed, lines); ``similar`` of ``pairs``; ``dependent`` of
    ``dependency_tests``; ``rates`` (test, failure_rate) by stem. Candidates are the tests of either kind. A test without
    a similar pair takes the similarities of all changed modules of its repo (``is_proxy``). The impact is taken before
    a failure probability is known, and that follows from it.
    """
    flags = changed.select("repo", F.col("file_path").alias("src"), "hash_changed")
    sims = lookup(similar, flags, ["repo", "src"]).groupBy("repo", "test").agg(
        F.max("sim").alias("max_pair"), F.avg("sim").alias("avg_pair"), F.slice(F.sort_array(F.collect_set("src")), 1, 3).alias("triggered_by"), F.max(F.coalesce("hash_changed", F.lit(False))).alias("hashed")
    )
    whole = changed.groupBy("repo").agg(F.max("sim").alias("max_all"), F.avg("sim").alias("avg_all"), F.sum("lines").alias("total_lines"), F.count("*").alias("n_changed"))
    c = dependent.select("repo", "test").union(similar.select("repo", "test")).distinct()
    c = c.join(sims, ["repo", "test"], "left").join(dependent, ["repo", "test"], "left")
    c = lookup(c, whole, "repo", "left").withColumn("stem", stem("test"))
    c = lookup(c, rates.select(F.col("stem"), "failure_rate"), "stem")
    zero = F.lit(0.0)
    c = c.select(
        "repo", "test", F.coalesce("max_pair", "max_all", zero).alias("max_sim"), F.coalesce("avg_pair", "avg_all", zero).alias("avg_sim"), F.col("max_pair").isNull().alias("is_proxy"),
        F.col("is_direct").isNotNull().alias("in_dep"), F.when(F.col("is_direct") == 1, DIRECT).when(F.col("is_transitive") == 1, TRANSITIVE).otherwise(NONE).alias("depth"),
        F.coalesce("hashed", F.lit(False)).alias("hash_delta"), F.coalesce("triggered_by", F.array().cast("array<string>")).alias("triggered_by"),
        F.coalesce("failure_rate", zero).alias("failure_rate"), F.coalesce("total_lines", F.lit(0)).alias("total_lines"), F.coalesce("n_changed", F.lit(0)).alias("n_changed"),
    )
    one = lambda x: F.col(x).cast("int")
    impact = scoring.composite(F.col("max_sim"), one("in_dep"), one("hash_delta"), zero, F.col("depth"), F.col("failure_rate"))
    c = c.withColumn("impact", even(impact, 4))
    return c.withColumn("pf", even(scoring.three_signal(F.col("max_sim"), F.col("impact"), F.col("total_lines")), 4))


def decide(c: DataFrame, dirty: bool = False, force: bool = False) -> DataFrame:
    """Candidates with rule, decision and reason, ranked by impact within the repo; ``force`` runs all of them."""
    cols = {"always": F.col("failure_rate") >= ALWAYS, "hashed": F.col("hash_delta"), "in_dep": F.col("in_dep"), "depth": F.col("depth"), "sim": F.col("max_sim"), "pf": F.col("pf"), "impact": F.col("impact")}
    rule = F.lit("FORCE_RUN_ALL") if force else scoring.cascade(cols, F.lit(dirty))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("impact"), "test"))
    d = c.withColumn("rule", rule).withColumn("decision", F.when(F.col("rule") == "PRUNED", "PRUNE").otherwise("RUN"))
    return d.withColumn("reason", scoring.reason(F.col("rule"), cols, F.lit(dirty))).withColumn("rank", rank)


def outcome(decided: DataFrame) -> DataFrame:
    """Per repo: tests found, selected, pruned, the pruning rate, and the changed modules and lines behind them."""
    run = F.col("decision") == "RUN"
    g = decided.groupBy("repo").agg(F.count("*").alias("n_tests"), F.count_if(run).alias("n_selected"), F.count_if(~run).alias("n_pruned"), F.max("n_changed").alias("n_changed"), F.max("total_lines").alias("total_lines"))
    return g.withColumn("pruning_rate", even(F.col("n_pruned") / F.greatest("n_tests", F.lit(1)), 4))


def top_rows(decided: DataFrame, run: int = 10, pruned: int = 5) -> DataFrame:
    """The first ``run`` tests to run and ``pruned`` pruned ones of each repo, in rank order."""
    w = Window.partitionBy("repo", "decision").orderBy("rank")
    d = decided.withColumn("n", F.row_number().over(w))
    return d.filter(F.when(F.col("decision") == "RUN", F.col("n") <= run).otherwise(F.col("n") <= pruned)).select("repo", "decision", "n", "test", "rule", "reason")


def matrix(decided: DataFrame) -> DataFrame:
    """(repo, position, test, source): the tests to run, those of past failures last, each once in order of first occurrence."""
    run = decided.filter("decision = 'RUN'")
    now = run.select("repo", "test", F.lit("now").alias("source"), F.struct(F.lit(0).alias("part"), "rank").alias("o"))
    past = run.filter(F.col("failure_rate") >= ALWAYS).select("repo", "test", F.lit("historic").alias("source"), F.struct(F.lit(1).alias("part"), "rank").alias("o"))
    first = now.union(past).groupBy("repo", "test").agg(F.min_by("source", "o").alias("source"), F.min("o").alias("o"))
    return first.select("repo", F.row_number().over(Window.partitionBy("repo").orderBy("o")).alias("position"), "test", "source")


def only_pruned(decided: DataFrame) -> DataFrame:
    """(test): tests that some repo prunes and none runs."""
    d = decided.select("test", "decision").distinct()
    return d.filter("decision = 'PRUNE'").select("test").join(d.filter("decision = 'RUN'").select("test"), "test", "left_anti")


def shares(decided: DataFrame) -> DataFrame:
    """(repo, category, n, percent): run now, always run and pruned tests of each repo, and their share of the total."""
    kind = F.when(F.col("decision") == "PRUNE", "pruned").when(F.col("rule") == "ALWAYS_RUN", "historic").otherwise("run_now")
    c = decided.groupBy("repo", kind.alias("category")).agg(F.count("*").alias("n"))
    return c.withColumn("percent", even(100 * F.col("n") / F.sum("n").over(Window.partitionBy("repo")), 4))


def labels(decided: DataFrame) -> DataFrame:
    """(repo, labels): what a pull request would be labelled with."""
    has = lambda c: F.max(c.cast("int")) == 1
    g = decided.groupBy("repo").agg(has(F.col("decision") == "PRUNE").alias("p"), has(F.col("failure_rate") >= ALWAYS).alias("h"))
    return g.select("repo", F.array_compact(F.array(F.when(F.col("p"), "pruned"), F.when(F.col("h"), "historic"))).alias("labels"))


def commands(decided: DataFrame, command: str = "pytest") -> DataFrame:
    """Per repo what a runner needs: the test command, selected and pruned tests in order of name, pruning rate and matrix.

    A repo's tests make up one command line, so they are gathered in one row; the command alone is left where none is run.
    """
    run = lambda d: F.sort_array(F.collect_set(F.when(F.col("decision") == d, F.col("test"))))
    g = decided.groupBy("repo").agg(run("RUN").alias("s"), run("PRUNE").alias("p"))
    rate = F.round(F.size("p") / F.greatest(F.size("s") + F.size("p"), F.lit(1)) + 1.234567e-9, 3)
    matrix = F.to_json(F.struct(F.transform("s", lambda t: F.struct(t.alias("test"))).alias("include")))
    return g.select("repo", F.concat_ws(" ", F.lit(command), F.array_join("s", " ")).alias("x"), "s", "p", rate.alias("pruning_rate"), matrix.alias("matrix")).select(
        "repo", F.trim("x").alias("test_command"), F.array_join("s", " ").alias("selected_tests"), F.array_join("p", " ").alias("pruned_tests"), "pruning_rate", "matrix"
    )


def safety(tests: DataFrame, decided: DataFrame) -> DataFrame:
    """(repo, test, decision, reason): all known tests of the repos for which no candidate was found; they run."""
    left = tests.select("repo", F.col("file_path").alias("test")).distinct().join(decided.select("repo").distinct(), "repo", "left_anti")
    return left.select("repo", "test", F.lit("RUN").alias("decision"), F.lit("Safety: no_candidates_found").alias("reason"))


def module_weights(changed: DataFrame, registry: DataFrame) -> DataFrame:
    """(repo, file_path, impact) of changed modules: by the registry's features, or by their own where it does not know them.

    ``changed`` has num_functions, num_imports, num_lines; ``registry`` repo, file_path and ast_features. Missing counts are 0,
    missing lines 100.
    """
    known = registry.filter("ast_features IS NOT NULL").groupBy("repo", "file_path").agg(F.max(F.struct("ast_features.num_functions", "ast_features.num_imports", "ast_features.num_lines")).alias("k"))
    j = changed.join(known, ["repo", "file_path"], "left")
    get = lambda c, missing: F.coalesce(F.col(f"k.{c}"), F.col(c), F.lit(missing))
    return j.select("repo", "file_path", module_impact(get("num_functions", 0), get("num_imports", 0), get("num_lines", 100)).alias("impact"))


def small_features(c: DataFrame) -> DataFrame:
    """The nine features of every candidate, with its repo and test; a candidate out of the graph has depth 5."""
    low = F.lower("test")
    has = lambda *w: sum((F.contains(low, F.lit(x)).cast("int") for x in w), F.lit(0)).cast("boolean").cast("double")
    zero = F.lit(0.0)
    return c.select(
        "repo", "test", F.col("max_sim").alias("cosine_similarity"), F.col("total_lines").cast("double").alias("change_size"), F.col("impact").alias("module_impact_score"), zero.alias("is_kafka_consumer"), zero.alias("is_kafka_producer"),
        has("db", "database").alias("is_shared_db"), has("contract", "api").alias("is_frontend_contract"), has("util", "helper").alias("is_shared_utility"), F.when(F.col("depth") < NONE, F.col("depth")).otherwise(5).cast("double").alias("transitive_depth"),
    )


def explained(decided: DataFrame, through: DataFrame, most: int = 3) -> DataFrame:
    """(repo, test, why): direct, transitive through up to ``most`` modules, by similarity, or pruned.

    ``through`` are the rows of ``reached``.
    """
    via = through.filter("depth > 0").groupBy("repo", "test").agg(F.slice(F.sort_array(F.collect_set("module")), 1, most).alias("via"))
    j = decided.join(via, ["repo", "test"], "left")
    why = (
        F.when(F.col("decision") == "PRUNE", "pruned")
        .when(F.col("depth") == DIRECT, "direct")
        .when(F.col("depth") == TRANSITIVE, F.concat(F.lit("transitive via "), F.array_join(F.coalesce("via", F.array().cast("array<string>")), ", ")))
        .otherwise("similarity")
    )
    return j.select("repo", "test", why.alias("why"))


def pair_features(tests: DataFrame, changed: DataFrame, test_map: DataFrame, history: DataFrame) -> DataFrame:
    """The sixteen features of every (repo, test) against the repo's change as a whole.

    ``tests`` (repo, file_path, embedding), ``changed`` (repo, file_path, embedding, lines, impact), ``history`` (test,
    failure_rate, duration). Vectors of the changed modules are averaged; a missing or unfit vector gives similarity 0.5, a
    zero one 0. Impact defaults to 0.5, depth to 5 (1 for a mapped test of a changed module, 3 for other mapped tests).
    """
    fine = lambda v: (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    at = changed.filter(F.coalesce(fine(F.col("embedding")), F.lit(False))).select("repo", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    mean = at.groupBy("repo", "pos").agg(F.avg("x").alias("x")).groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("composite"))  # one value per dimension
    whole = changed.groupBy("repo").agg(F.sum("lines").alias("total_lines"), F.avg("impact").alias("module_impact_score"), F.count("*").alias("n_changed"), F.min("file_path").alias("first_path")).join(mean, "repo", "left")
    mapped = test_map.join(changed.select("repo", F.col("file_path").alias("module"), F.lit(1).alias("hit")), ["repo", "module"], "left").groupBy("repo", "test").agg(F.max(F.coalesce("hit", F.lit(0))).alias("direct"))
    t = tests.select("repo", F.col("file_path").alias("test"), F.when(F.coalesce(fine(F.col("embedding")), F.lit(False)), F.col("embedding").cast("array<double>")).alias("v"))
    j = lookup(lookup(t, whole, "repo", "inner").join(mapped, ["repo", "test"], "left"), history, "test")
    low = F.lower("test")
    has = lambda w: low.contains(w).cast("int")
    depth = F.when(F.col("direct") == 1, 1).when(F.col("direct") == 0, 3).otherwise(5)
    same = F.endswith("test", F.col("first_path")) | F.contains(stem("first_path"), stem("test"))
    return j.select(
        "repo", "test", F.coalesce(cosine(F.col("composite"), F.col("v")), F.lit(0.5)).alias("cosine_similarity"), scoring.least_one(F.coalesce("total_lines", F.lit(0)), 500.0).alias("change_size"),
        F.coalesce("module_impact_score", F.lit(0.5)).alias("module_impact_score"), F.coalesce("direct", F.lit(0)).alias("is_direct_dependency"), scoring.least_one(depth, 6.0).alias("transitive_depth"),
        has("db").alias("is_shared_db"), has("contract").alias("is_frontend_contract"), has("util").alias("is_shared_utility"), F.lit(0).alias("is_kafka_consumer"), F.lit(0).alias("is_kafka_producer"),
        F.coalesce("failure_rate", F.lit(0.0)).alias("historical_failure_rate"), F.lit(0.0).alias("test_flakiness_score"), F.ln(F.coalesce("duration", F.lit(30.0)) + 1).alias("duration_log"),
        F.lit(1).alias("hash_changed"), scoring.least_one(F.col("n_changed"), 20.0).alias("num_functions_changed"), ((F.col("first_path") != "") & same).cast("int").alias("is_test_file"),
    )


def gated(features: DataFrame, dirty: bool = False) -> DataFrame:
    """(repo, test, pf, gate, decision) of ``pair_features``: the three-way gate, overridden by a history of failures."""
    pf = even(scoring.heuristic(F.col("cosine_similarity"), F.col("is_direct_dependency"), F.col("historical_failure_rate"), F.col("hash_changed")), 4)
    d = features.select("repo", "test", pf.alias("pf"), "historical_failure_rate").withColumn("gate", scoring.gate(F.col("pf"), dirty=F.lit(dirty)))
    run = (F.col("historical_failure_rate") >= ALWAYS) | (F.col("gate") != "PRUNE_TEST")
    return d.select("repo", "test", "pf", "gate", F.when(run, "RUN").otherwise("PRUNE").alias("decision"))
