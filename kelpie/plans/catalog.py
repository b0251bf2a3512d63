"""Queries by name over the test tables, each with its SQL twin where SQL can say the same.

Doubles are rounded once at the end, with a small offset that keeps exact decimal ties off the rounding edge; both sides
do the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.common import even, table
from kelpie.operators import badrows, codetext, graph, outline, registry, scoring, similarity, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[even(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _query(name: str, *tables: str, sql: str | None = None):
    def wrap(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, d: _rounded(f(*[table(spark, d, t) for t in tables]))
        if sql:
            SQL[name] = sql
        return f

    return wrap


def _r(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + 1.234567e-9, 6) AS {name}"


def _t(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


# -- rows that fail to parse

_W = "' ' || chr(9) || chr(10) || chr(13)"
_RECORD = {name: "^" + sep.join(['("(?:[^"]|"")*"|[^"\\r\\n' + sep + "]*)"] * 4) + "$" for name, sep in ((",", ","), ("|", "\\|"), ("tab", "\\t"))}
_LOADED = f"""h AS (SELECT source_file, arg_min(raw_line, (raw_id, raw_line)) AS h FROM presubmit_raw WHERE line_no = 1 GROUP BY 1),
c AS (SELECT source_file, s, list_transform(string_split(regexp_replace(h, '^\ufeff', ''), s), lambda x: lower(trim(replace(x, '"', ''), {_W}))) AS names FROM h, (VALUES (','), ('|'), (chr(9))) v(s)),
l AS (SELECT r.raw_id, r.source_file, r.line_no, raw_line, s, names FROM presubmit_raw r LEFT JOIN (SELECT * FROM c WHERE list_sort(names) = ['build', 'test_duration', 'test_name', 'test_result']) USING (source_file) WHERE line_no IS DISTINCT FROM 1),
x AS (SELECT *, CASE s WHEN ',' THEN regexp_extract(raw_line, '{_RECORD[',']}', ['a', 'b', 'c', 'd']) WHEN '|' THEN regexp_extract(raw_line, '{_RECORD['|']}', ['a', 'b', 'c', 'd']) WHEN chr(9) THEN regexp_extract(raw_line, '{_RECORD['tab']}', ['a', 'b', 'c', 'd']) END AS g,
 coalesce(CASE s WHEN ',' THEN regexp_full_match(raw_line, '{_RECORD[',']}') WHEN '|' THEN regexp_full_match(raw_line, '{_RECORD['|']}') WHEN chr(9) THEN regexp_full_match(raw_line, '{_RECORD['tab']}') END, false) AS sound FROM l),
y AS (SELECT *, list_transform([g.a, g.b, g.c, g.d], lambda q: trim(CASE WHEN q LIKE '"%' THEN replace(q[2:-2], '""', '"') ELSE q END, {_W})) AS v FROM x),
z AS (SELECT raw_id, source_file, line_no, v[list_position(names, 'test_duration')] AS td, v[list_position(names, 'build')] AS bu, v[list_position(names, 'test_name')] AS tn, v[list_position(names, 'test_result')] AS tr, sound FROM y),
w AS (SELECT *, sound AND (td = '' OR regexp_full_match(td, '(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?')) AND regexp_full_match(bu, '[0-9a-fA-F]{{10}}(?:[/_][0-9a-fA-F]{{10}})*') AND tn <> '' AND upper(tr) IN ('PASSED', 'FAILED', 'SKIPPED') AS ok FROM z)"""
_query("p7_found", "presubmit_raw", sql=f"WITH {_LOADED} SELECT raw_id FROM w WHERE NOT ok")(badrows.found)
_query("p7_load", "presubmit_raw")(badrows.load)
_query("p7_rows", "presubmit_raw", sql=f"WITH {_LOADED} SELECT raw_id, {_r('TRY_CAST(td AS DOUBLE)', 'test_duration')}, bu AS build, tn AS test_name, upper(tr) AS test_result FROM w WHERE ok")(
    lambda t: badrows.load(t).filter(F.size("reasons") == 0).select("raw_id", "test_duration", "build", "test_name", "test_result")
)
_query(
    "p7_report", "presubmit_raw",
    sql=f"WITH {_LOADED} SELECT source_file, count(*) AS n_lines, count(*) FILTER (WHERE ok) AS n_loaded, count(*) FILTER (WHERE NOT ok) AS n_rejected, {_r('count(*) FILTER (WHERE NOT ok) / count(*)::DOUBLE', 'rejected_share')} FROM w GROUP BY source_file",
)(badrows.report)

# -- telemetry

_TYPED = f"""
d AS (SELECT DISTINCT phase, {_t('build')} AS build, {_t('test_name')} AS test_name, CASE WHEN isnan(test_duration) THEN NULL ELSE test_duration END AS duration, upper({_t('test_result')}) AS r FROM ci_runs),
typed AS (SELECT phase, build, test_name, CASE WHEN duration >= 0 THEN duration END AS duration, CASE r WHEN 'PASSED' THEN 1 WHEN 'FAILED' THEN 0 END AS result FROM d WHERE build IS NOT NULL OR test_name IS NOT NULL)"""
_CLEAN = f"""{_TYPED},
m AS (SELECT phase, build, test_name, coalesce(duration, median(duration) OVER (PARTITION BY phase, test_name)) AS duration, result FROM typed),
g AS (SELECT phase, median(duration) AS gm FROM m GROUP BY phase),
i AS (SELECT m.phase, build, test_name, coalesce(duration, gm) AS duration, result FROM m JOIN g USING (phase)),
q AS (SELECT phase, quantile_cont(duration, 0.25) AS q1, quantile_cont(duration, 0.75) AS q3 FROM i GROUP BY phase),
cleaned AS (SELECT i.*, CASE WHEN duration < q1 - 3 * (q3 - q1) OR duration > q3 + 3 * (q3 - q1) THEN 1 ELSE 0 END AS is_outlier FROM i JOIN q USING (phase) WHERE result IS NOT NULL)"""

_query("clean_runs", "ci_runs", sql=f"WITH {_CLEAN} SELECT phase, build, test_name, {_r('duration', 'duration')}, result, is_outlier FROM cleaned")(telemetry.clean)
_query(
    "combined_delta", "ci_runs",
    sql=f"""WITH {_CLEAN},
k AS (SELECT phase, build, test_name, avg(duration) AS dm, stddev_samp(duration) AS ds, avg(result) AS pr, count(*) FILTER (WHERE result = 0) AS fc, count(*) AS n FROM cleaned WHERE build IS NOT NULL AND test_name IS NOT NULL GROUP BY ALL),
a AS (SELECT * FROM k WHERE phase = 'pre'), b AS (SELECT * FROM k WHERE phase = 'post')
SELECT build, test_name, {_r('a.dm', 'duration_mean_pre')}, {_r('a.ds', 'duration_std_pre')}, {_r('a.pr', 'pass_rate_pre')}, coalesce(a.fc, 0) AS failure_count_pre, coalesce(a.n, 0) AS total_runs_pre,
{_r('b.dm', 'duration_mean_post')}, {_r('b.ds', 'duration_std_post')}, {_r('b.pr', 'pass_rate_post')}, coalesce(b.fc, 0) AS failure_count_post, coalesce(b.n, 0) AS total_runs_post,
{_r('b.pr - a.pr', 'delta_pass_rate')}, {_r('b.dm - a.dm', 'delta_duration')}, CASE WHEN a.pr >= 0.8 AND b.pr < 0.5 THEN 1 ELSE 0 END AS regression_detected,
CASE WHEN b.n IS NULL THEN 1 ELSE 0 END AS only_in_pre, CASE WHEN a.n IS NULL THEN 1 ELSE 0 END AS only_in_post FROM a FULL JOIN b USING (build, test_name)""",
)(telemetry.combined)
_query(
    "duration_features", "ci_runs",
    sql=f"""WITH {_CLEAN}, p AS (SELECT phase, avg(duration) AS m, stddev_samp(duration) AS s, min(duration) AS lo, max(duration) AS hi FROM cleaned GROUP BY phase),
t AS (SELECT phase, test_name, avg(duration) AS tm, coalesce(stddev_samp(duration), 0) AS ts FROM cleaned WHERE test_name IS NOT NULL GROUP BY ALL)
SELECT phase, build, test_name, {_r('duration', 'duration')}, {_r('ln(1 + duration)', 'log_duration')}, {_r('(duration - m) / (s + 1e-8)', 'z')}, {_r('CASE WHEN hi > lo THEN (duration - lo) / (hi - lo) ELSE 0 END', 'scaled')},
{_r('tm', 'test_mean')}, {_r('ts', 'test_std')}, {_r('duration / (tm + 1e-8)', 'ratio')} FROM cleaned JOIN p USING (phase) JOIN t USING (phase, test_name)""",
)(lambda t: telemetry.duration_features(telemetry.clean(t)))
_query(
    "test_history", "ci_runs",
    sql=f"""WITH {_CLEAN} SELECT phase, test_name, {_r('avg(result)', 'pass_rate')}, {_r('1 - avg(result)', 'failure_rate')}, count(*) AS n_runs, count(*) FILTER (WHERE result = 0) AS n_failures,
{_r('1 - 2 * abs(avg(result) - 0.5)', 'flakiness')} FROM cleaned GROUP BY phase, test_name""",
)(lambda t: telemetry.history(telemetry.clean(t)))
_query(
    "build_stats", "ci_runs",
    sql=f"WITH {_CLEAN} SELECT phase, build, {_r('avg(result)', 'pass_rate')}, count(*) AS n_runs, count(*) FILTER (WHERE result = 0) AS n_failures, max(1 - result) AS has_failure FROM cleaned GROUP BY phase, build",
)(lambda t: telemetry.build_stats(telemetry.clean(t)))
_FLAGS = """CAST(regexp_matches(test_name, 'unit|Unit') AS INT) AS is_unit, CAST(regexp_matches(test_name, 'integrat|Integration|IT') AS INT) AS is_integration, CAST(regexp_matches(test_name, 'e2e|E2E|end.to.end') AS INT) AS is_e2e,
CAST(regexp_matches(test_name, 'perf|Perf|benchmark|Benchmark|load|Load') AS INT) AS is_perf, CAST(regexp_matches(test_name, 'smoke|Smoke|sanity|Sanity') AS INT) AS is_smoke"""
_query(
    "test_name_features", "ci_runs",
    sql=rf"""SELECT test_name, {_FLAGS}, length(test_name) AS name_length, len(list_filter(regexp_split_to_array(test_name, '[./:#_\-]'), lambda x: x <> '')) AS name_depth,
CAST('0x' || substr(md5(test_name), 1, 8) AS BIGINT) AS name_hash FROM (SELECT DISTINCT {_t('test_name')} AS test_name FROM ci_runs) WHERE test_name <> ''""",
)(telemetry.name_features)
_SEG = ", ".join(f"coalesce(p[{i}], '') AS segment_{i}" for i in range(1, 5))
_CODE = ", ".join(f"dense_rank() OVER (ORDER BY segment_{i}) - 1 AS segment_{i}_code" for i in range(1, 5))
_query(
    "build_segments", "ci_runs",
    sql=f"""SELECT *, {_CODE} FROM (SELECT build, {_SEG}, len(p) AS depth, dense_rank() OVER (ORDER BY build) - 1 AS code FROM (SELECT build, regexp_split_to_array(build, '[/_]') AS p FROM (SELECT DISTINCT {_t('build')} AS build FROM ci_runs) WHERE build <> ''))""",
)(telemetry.build_segments)
_query(
    "engineered_runs", "ci_runs",
    sql=f"""WITH {_CLEAN}, p AS (SELECT phase, avg(duration) AS m, stddev_samp(duration) AS s, min(duration) AS lo, max(duration) AS hi FROM cleaned GROUP BY phase),
t AS (SELECT phase, test_name, avg(duration) AS tm, coalesce(stddev_samp(duration), 0) AS ts, avg(result) AS tp, count(*) AS tn, count(*) FILTER (WHERE result = 0) AS tf FROM cleaned GROUP BY ALL),
b AS (SELECT phase, build, avg(result) AS bp, count(*) AS bn, count(*) FILTER (WHERE result = 0) AS bf FROM cleaned GROUP BY ALL)
SELECT phase, build, test_name, {_r('duration', 'duration')}, result, is_outlier, {_r('ln(1 + duration)', 'duration_log')}, {_r('(duration - m) / (s + 1e-8)', 'duration_zscore')}, {_r('CASE WHEN hi > lo THEN (duration - lo) / (hi - lo) ELSE 0 END', 'duration_normalized')},
{_r('tm', 'test_mean')}, {_r('ts', 'test_std')}, {_r('duration / (tm + 1e-8)', 'duration_ratio')}, {_r('tp', 'test_pass_rate')}, {_r('1 - tp', 'test_failure_rate')}, tn AS test_runs, tf AS test_failures, {_r('1 - 2 * abs(tp - 0.5)', 'test_flakiness')},
{_r('bp', 'build_pass_rate')}, bn AS build_runs, bf AS build_failures, CAST(bf > 0 AS INT) AS build_has_failure, {_FLAGS}, length(test_name) AS name_length, len(list_filter(regexp_split_to_array(test_name, '[./:#_\\-]'), lambda x: x <> '')) AS name_depth,
CAST('0x' || substr(md5(test_name), 1, 8) AS BIGINT) AS name_hash, coalesce(split[1], '') AS segment_1, coalesce(split[2], '') AS segment_2, coalesce(split[3], '') AS segment_3, coalesce(split[4], '') AS segment_4, len(split) AS depth
FROM (SELECT *, regexp_split_to_array(build, '[/_]') AS split FROM cleaned) JOIN p USING (phase) JOIN t USING (phase, test_name) JOIN b USING (phase, build)""",
)(lambda t: telemetry.engineered(telemetry.clean(t)).filter("test_name IS NOT NULL AND build IS NOT NULL"))
_query("regression_totals", "combined_submit", sql="SELECT count(*) AS n_records, CAST(sum(regression_detected) AS BIGINT) AS regression_detected, CAST(sum(only_in_pre) AS BIGINT) AS only_in_pre, CAST(sum(only_in_post) AS BIGINT) AS only_in_post FROM combined_submit")(telemetry.totals)
_query(
    "eda_summary", "ci_runs",
    sql=f"""WITH {_TYPED} SELECT phase, count(*) AS n_rows, count(DISTINCT build) AS n_builds, count(DISTINCT test_name) AS n_tests, {_r('avg(duration)', 'mean_duration')},
count(*) FILTER (WHERE duration IS NULL) AS null_durations, count(*) FILTER (WHERE result IS NULL) AS null_results FROM typed GROUP BY phase""",
)(telemetry.summary)
_query(
    "describe_duration", "ci_runs",
    sql=f"""WITH {_CLEAN} SELECT phase, count(duration) AS n, {_r('avg(duration)', 'mean')}, {_r('stddev_samp(duration)', 'std')}, {_r('min(duration)', 'least')}, {_r('quantile_cont(duration, 0.25)', 'q25')},
{_r('quantile_cont(duration, 0.5)', 'q50')}, {_r('quantile_cont(duration, 0.75)', 'q75')}, {_r('max(duration)', 'most')} FROM cleaned GROUP BY phase""",
)(lambda t: telemetry.describe(telemetry.clean(t)))
_query(
    "top_failing", "ci_runs",
    sql=f"""WITH {_CLEAN}, f AS (SELECT phase, test_name, count(*) AS n_failures FROM cleaned WHERE result = 0 AND test_name IS NOT NULL GROUP BY ALL)
SELECT phase, test_name, n_failures, row_number() OVER (PARTITION BY phase ORDER BY n_failures DESC, test_name) AS rank FROM f QUALIFY rank <= 10""",
)(lambda t: telemetry.top_failing(telemetry.clean(t)))
_query(
    "class_balance", "ci_runs",
    sql=f"""WITH {_CLEAN}, c AS (SELECT phase, result, count(*) AS n FROM cleaned GROUP BY ALL)
SELECT phase, result, n, {_r('n / sum(n) OVER (PARTITION BY phase)', 'share')}, {_r('CAST(max(n) OVER (PARTITION BY phase) AS DOUBLE) / min(n) OVER (PARTITION BY phase)', 'imbalance')} FROM c""",
)(lambda t: telemetry.class_balance(telemetry.clean(t)))
_N = "CASE WHEN {0} IS NULL OR isnan(CAST({0} AS DOUBLE)) THEN NULL ELSE CAST({0} AS DOUBLE) END"
_query(
    "training_matrix", "combined_submit",
    sql=f"""WITH c AS (SELECT record_id, lower(coalesce(test_name, '')) AS n, {_N.format('delta_duration')} AS dd, {_N.format('pass_rate_pre')} AS pr, {_N.format('failure_count_pre')} AS fc, {_N.format('total_runs_pre')} AS tr, {_N.format('duration_mean_pre')} AS dm, coalesce(regression_detected, 0) AS label FROM combined_submit)
SELECT record_id, 0.5::DOUBLE AS cosine_similarity, {_r('coalesce(abs(dd) / 500, 0)', 'change_size')}, {_r('coalesce(1 - pr, 0)', 'module_impact_score')}, 0 AS is_direct_dependency, 1 AS transitive_depth,
CAST(regexp_matches(n, 'db|database|sql') AS INT) AS is_shared_db, CAST(regexp_matches(n, 'contract|api|frontend') AS INT) AS is_frontend_contract, CAST(regexp_matches(n, 'util|helper|common') AS INT) AS is_shared_utility,
CAST(regexp_matches(n, 'consumer|kafka|stream') AS INT) AS is_kafka_consumer, CAST(regexp_matches(n, 'producer|publisher|emit') AS INT) AS is_kafka_producer,
{_r('coalesce(fc / CASE WHEN tr < 1 THEN 1 ELSE tr END, 0)', 'historical_failure_rate')}, 0.0::DOUBLE AS test_flakiness_score, {_r('coalesce(ln(CASE WHEN dm < 1 THEN 1 ELSE dm END + 1), 0)', 'duration_log')}, 1 AS hash_changed, 0 AS num_functions_changed, 0 AS is_test_file, label FROM c""",
)(telemetry.training_matrix)
_query(
    "history_rates_last", "combined_submit",
    sql=f"""SELECT stem, {_r("arg_max(rate, (build, test_name, record_id))", 'failure_rate')} FROM (SELECT *, regexp_extract(string_split(test_name, '/')[-1], '^(.+?)(?:\\.[^.]*)?$', 1) AS stem,
coalesce(CAST(failure_count_pre AS DOUBLE) / greatest(total_runs_pre, 1), 0) AS rate FROM combined_submit WHERE build IS NOT NULL AND test_name IS NOT NULL AND test_name NOT LIKE '%/') GROUP BY stem""",
)(telemetry.last_rates)

# -- registry and run log

_LATEST = """latest AS (SELECT repo, file_path, arg_max(x, (coalesce(x.updated_at, TIMESTAMP '1970-01-01'), coalesce(x.file_hash, ''), x.module_id)) AS x
FROM (SELECT repo, file_path, {'module_id': module_id, 'file_hash': file_hash, 'updated_at': updated_at, 'f': ast_features, 'language': language} AS x FROM module_registry) GROUP BY repo, file_path)"""
_query("registry_latest", "module_registry", sql=f"WITH {_LATEST} SELECT repo, file_path, x.module_id AS module_id, x.file_hash AS file_hash, x.language AS language, x.updated_at AS updated_at FROM latest")(
    lambda t: registry.latest(t.select("repo", "file_path", "module_id", "file_hash", "language", "updated_at"))
)
_query("registry_stats", "module_registry", sql="SELECT repo, count(*) AS n_modules, count(embedding) AS n_embedded, count(DISTINCT file_hash) AS n_hashes FROM module_registry GROUP BY repo")(registry.stats)
_query(
    "registry_upsert", "module_registry", "file_ast",
    sql="""WITH c AS (SELECT repo, file_path, file_hash, language FROM file_ast), s AS (SELECT repo, file_path, arg_max(struct_pack(h := file_hash, l := language), (coalesce(updated_at, TIMESTAMP '1970-01-01'), coalesce(file_hash, ''), module_id)) AS x FROM module_registry GROUP BY repo, file_path)
SELECT repo, file_path, x.h AS file_hash, x.l AS language FROM s ANTI JOIN c USING (repo, file_path) UNION ALL SELECT * FROM c""",
)(lambda m, f: registry.upsert(registry.latest(m.select("repo", "file_path", "file_hash", "language", "module_id", "updated_at")).select("repo", "file_path", "file_hash", "language"), f.select("repo", "file_path", "file_hash", "language")))
_query("registry_delete", "module_registry", "file_ast", sql="SELECT m.module_id, m.repo, m.file_path FROM module_registry m ANTI JOIN (SELECT repo, file_path FROM file_ast WHERE language IS NULL) d USING (repo, file_path)")(
    lambda m, f: registry.delete(m.select("module_id", "repo", "file_path"), f.filter("language IS NULL"))
)
_query(
    "incremental_plan", "file_ast", "module_registry",
    sql=f"""WITH {_LATEST} SELECT file_id, f.repo, f.file_path, CASE WHEN x.file_hash IS NULL THEN 'new' WHEN x.file_hash IS NOT DISTINCT FROM f.file_hash THEN 'unchanged' ELSE 'changed' END AS state
FROM file_ast f LEFT JOIN latest USING (repo, file_path)""",
)(registry.plan)
_query("incremental_counts", "file_ast", "module_registry", sql=f"WITH {_LATEST} SELECT CASE WHEN x.file_hash IS NULL THEN 'new' WHEN x.file_hash IS NOT DISTINCT FROM f.file_hash THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS n FROM file_ast f LEFT JOIN latest USING (repo, file_path) GROUP BY 1")(lambda f, m: registry.plan_counts(registry.plan(f, m)))
_query("registry_get", "module_registry", "embedding_result", sql=f"WITH {_LATEST} SELECT repo, file_path, x.module_id AS module_id, x.file_hash AS file_hash FROM latest WHERE (repo, file_path) IN (SELECT (m.repo, m.file_path) FROM module_registry m JOIN embedding_result e USING (module_id))")(
    lambda m, e: registry.get(m.select("repo", "file_path", "module_id", "file_hash", "updated_at"), m.join(e.select("module_id").distinct(), "module_id", "left_semi")).select("repo", "file_path", "module_id", "file_hash")
)
_query("copy_detection", "file_ast", sql="SELECT file_hash, count(*) AS n_files, count(DISTINCT repo) AS n_repos, min(file_id) AS first_file FROM file_ast WHERE file_hash IS NOT NULL GROUP BY file_hash HAVING count(*) > 1")(registry.copies)
_SCORE = "0.4 * coalesce(x.f.num_functions, 0) + 0.3 * coalesce(x.f.num_imports, 0) + 0.2 * ln(coalesce(x.f.num_lines, 0) + 1) + 0.1 * coalesce(x.f.num_classes, 0)"
_query("value_scores", "module_registry", sql=f"WITH {_LATEST} SELECT x.module_id AS module_id, repo, file_path, {_r(_SCORE, 'score')} FROM latest")(registry.value_scores)
_query(
    "value_score_topk", "module_registry",
    sql=f"""WITH {_LATEST}, s AS (SELECT x.module_id AS module_id, repo, file_path, {_r(_SCORE, 'score')} FROM latest)
SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, module_id) AS rank FROM s QUALIFY rank <= 10""",
)(registry.top_by_value)
_query("registry_listing", "module_registry", sql=f"WITH {_LATEST}, s AS (SELECT x.module_id AS module_id, repo, file_path, {_r(_SCORE, 'score')} FROM latest) SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, module_id) AS rank FROM s")(registry.listing)
_ONCE = """once AS (SELECT run_id, arg_max(x, (x.created_at, coalesce(x.pr, -1), coalesce(x.co, -1))) AS x
FROM (SELECT run_id, {'repo': repo, 'pr_number': pr_number, 'created_at': created_at, 'pr': pruning_rate, 'co': carbon_gco2} AS x FROM pr_run_log) GROUP BY run_id)"""
_query(
    "run_log_once", "pr_run_log", sql=f"WITH {_ONCE} SELECT run_id, x.repo AS repo, x.pr_number AS pr_number, x.created_at AS created_at, {_r('x.pr', 'pruning_rate')} FROM once"
)(lambda t: registry.runs_once(t).select("run_id", "repo", "pr_number", "created_at", "pruning_rate"))
_query(
    "run_log_recent", "pr_run_log",
    sql=f"WITH {_ONCE} SELECT x.repo AS repo, run_id, x.pr_number AS pr_number, x.created_at AS created_at, row_number() OVER (PARTITION BY x.repo ORDER BY x.created_at DESC, run_id) AS rank FROM once QUALIFY rank <= 50",
)(registry.recent)
_query(
    "pruning_share", "pr_run_log",
    sql=f"""WITH g AS (SELECT repo, count(*) AS n_runs, CAST(sum(coalesce(len(selected_tests), 0)) AS BIGINT) AS n_selected, CAST(sum(coalesce(len(pruned_tests), 0)) AS BIGINT) AS n_pruned FROM pr_run_log GROUP BY repo)
SELECT *, {_r('CAST(n_pruned AS DOUBLE) / greatest(n_selected + n_pruned, 1)', 'pruned_share')} FROM g""",
)(registry.pruning)
_query("change_counts", "pr_run_log", sql="SELECT file, count(DISTINCT run_id) AS n_runs FROM (SELECT run_id, trim(unnest(changed_files)) AS file FROM pr_run_log) WHERE file <> '' GROUP BY file")(registry.change_counts)

# -- graphs

_EDGES = """SELECT DISTINCT importer, imported FROM (
 SELECT p_partkey AS importer, CAST(floor(p_partkey / 2) AS BIGINT) AS imported FROM part WHERE p_partkey > 0
 UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 3) AS BIGINT) FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0
 UNION ALL SELECT CAST(floor(p_partkey / 2) AS BIGINT), p_partkey FROM part WHERE p_partkey % 50 = 0 AND p_partkey > 0) e"""


def _edges(part: DataFrame) -> DataFrame:
    k, half, third = F.col("p_partkey"), F.floor(F.col("p_partkey") / 2).alias("imported"), F.floor(F.col("p_partkey") / 3)
    p = part.filter(k > 0)
    return p.select(k.alias("importer"), half).union(p.filter(k % 3 == 0).select(k, third)).union(p.filter(k % 50 == 0).select(F.floor(k / 2), k)).distinct()


def _seeds(part: DataFrame) -> DataFrame:
    return part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("node"))


def _test_map(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(k.alias("module"), F.concat(F.lit("test_"), (k % 97).cast("string")).alias("test")).union(part.filter(k % 4 == 0).select(k, F.concat(F.lit("test_x"), (k % 53).cast("string"))))


_GRAPH = f"""edges AS ({_EDGES}), seeds AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 100 = 0),
r(n, d) AS (SELECT n, 0 FROM seeds UNION SELECT e.importer, r.d + 1 FROM r JOIN edges e ON e.imported = r.n WHERE r.d < 5),
up AS (SELECT n AS node, min(d) AS depth FROM r GROUP BY n),
tm AS (SELECT p_partkey AS module, 'test_' || (p_partkey % 97) AS test FROM part UNION ALL SELECT p_partkey, 'test_x' || (p_partkey % 53) FROM part WHERE p_partkey % 4 = 0)"""
_query("upstream_closure", "part", sql=f"WITH RECURSIVE {_GRAPH} SELECT node, depth FROM up")(lambda p: graph.upstream(_edges(p), _seeds(p)))
_query(
    "closure_per_seed", "part",
    sql=f"""WITH RECURSIVE edges AS ({_EDGES}), r(s, n, d) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 100 = 0 UNION SELECT r.s, e.importer, r.d + 1 FROM r JOIN edges e ON e.imported = r.n WHERE r.d < 5)
SELECT s AS seed, n AS node, min(d) AS depth FROM r GROUP BY s, n""",
)(lambda p: graph.closure(_edges(p), _seeds(p)))
_query(
    "select_tests", "part",
    sql=f"WITH RECURSIVE {_GRAPH} SELECT test, max(CASE WHEN depth = 0 THEN 1 ELSE 0 END) AS is_direct, max(CASE WHEN depth > 0 THEN 1 ELSE 0 END) AS is_transitive, min(depth) AS depth FROM tm JOIN up ON up.node = tm.module GROUP BY test",
)(lambda p: graph.select_tests(_edges(p), _test_map(p), _seeds(p)))
_query(
    "explain_selection", "part",
    sql=f"""WITH RECURSIVE {_GRAPH} SELECT test, CASE WHEN min(depth) = 0 THEN 'direct' ELSE 'via ' || array_to_string(list_slice(list_sort(list_distinct(list(node) FILTER (WHERE depth > 0))), 1, 3), ', ') END AS reason
FROM tm JOIN up ON up.node = tm.module GROUP BY test""",
)(lambda p: graph.explain(_edges(p), _test_map(p), _seeds(p)))
_query("graph_degrees", "part", sql=f"WITH e AS ({_EDGES}), o AS (SELECT importer AS node, count(DISTINCT imported) AS a FROM e GROUP BY 1), i AS (SELECT imported AS node, count(DISTINCT importer) AS b FROM e GROUP BY 1) SELECT node, coalesce(a, 0) AS n_imports, coalesce(b, 0) AS n_importers FROM o FULL JOIN i USING (node)")(
    lambda p: graph.degrees(_edges(p))
)
_query(
    "forward_depth", "part",
    sql=f"""WITH RECURSIVE edges AS ({_EDGES}), r(s, n, d) USING KEY (s, n) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 100 = 0
 UNION SELECT r.s, e.imported, min(r.d + 1) FROM r JOIN edges e ON e.importer = r.n LEFT JOIN recurring.r x ON x.s = r.s AND x.n = e.imported WHERE x.n IS NULL OR x.d > r.d + 1 GROUP BY r.s, e.imported)
SELECT s AS seed, max(d) AS depth FROM r GROUP BY s""",
)(lambda p: graph.forward_depth(_edges(p), _seeds(p)))
_query("cycles", "part")(lambda p: graph.cycles(_edges(p)).select("component", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle")))
_query(
    "strong_components", "part",
    sql=f"""WITH RECURSIVE edges AS ({_EDGES}), r(s, n) AS (SELECT importer, imported FROM edges UNION SELECT r.s, e.imported FROM r JOIN edges e ON e.importer = r.n) SELECT a.s AS node, min(least(a.s, a.n)) AS component FROM r a JOIN r b ON a.s = b.n AND a.n = b.s GROUP BY a.s""",
)(lambda p: graph.strong_components(_edges(p)))
_PAIRS = "SELECT 'f' || (l_suppkey % 500) AS src, 'test_' || (l_partkey % 300) AS test, max(l_discount * 8 + l_tax * 2) AS sim FROM lineitem GROUP BY ALL"


def _pairs(lineitem: DataFrame) -> DataFrame:
    s = F.max(F.col("l_discount") * 8 + F.col("l_tax") * 2)
    return lineitem.groupBy(F.concat(F.lit("f"), (F.col("l_suppkey") % 500).cast("string")).alias("src"), F.concat(F.lit("test_"), (F.col("l_partkey") % 300).cast("string")).alias("test")).agg(s.alias("sim"))


_query("test_weights", "lineitem", sql=f"WITH w AS (SELECT test, sum(sim) AS weight FROM ({_PAIRS}) WHERE sim >= 0.5 GROUP BY test) SELECT test, {_r('weight', 'weight')}, {_r('weight / max(weight) OVER ()', 'pf')} FROM w")(
    lambda l: graph.test_weights(_pairs(l))
)
_query("ranked_weights", "lineitem", sql=f"WITH w AS (SELECT test, sum(sim) AS weight FROM ({_PAIRS}) WHERE sim >= 0.5 GROUP BY test) SELECT test, {_r('weight', 'weight')}, {_r('least(weight / max(weight) OVER () + 0.1, 1)', 'pf')}, row_number() OVER (ORDER BY round(weight, 9) DESC, test) AS rank FROM w")(
    lambda l: graph.ranked_weights(_pairs(l), dirty=True)
)
_query("function_test_graph", "lineitem", sql=f"SELECT src, array_to_string(list_sort(list_distinct(list(test) FILTER (WHERE sim >= 0.9))), ',') AS tests FROM ({_PAIRS}) GROUP BY src")(
    lambda l: graph.bipartite(_pairs(l), 0.9).select("src", F.array_join("tests", ",").alias("tests"))
)
# -- similarity

_VEC = """v AS (SELECT module_id, arg_max(CAST(embedding AS DOUBLE[]), updated_at) AS v FROM module_registry WHERE len(embedding) = 64
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY module_id)"""
_query(
    "vector_search", "module_registry",
    sql=f"""WITH {_VEC}, q AS (SELECT v AS q FROM v WHERE module_id = (SELECT min(module_id) FROM v)), s AS (SELECT module_id, {_r('list_cosine_similarity(v, q)', 'sim')} FROM v, q WHERE module_id <> (SELECT min(module_id) FROM v))
SELECT module_id, sim, row_number() OVER (ORDER BY sim DESC, module_id) AS rank, sim >= 0.75 AS is_relevant FROM s QUALIFY rank <= 20""",
)(lambda m: similarity.search(similarity.usable(m), similarity.usable(m).agg(F.min("module_id")).first()[0] or 0, 20, -1.0))
_query(
    "cosine_topk_per_source", "module_registry",
    sql=f"""WITH {_VEC}, s AS (SELECT a.module_id AS src, b.module_id AS module_id, {_r('list_cosine_similarity(a.v, b.v)', 'sim')} FROM v a JOIN v b ON a.module_id <> b.module_id WHERE a.module_id % 100 = 0)
SELECT src, module_id, sim, row_number() OVER (PARTITION BY src ORDER BY sim DESC, module_id) AS rank FROM s WHERE sim >= 0.2 QUALIFY rank <= 20""",
)(lambda m: similarity.top_per_source(similarity.usable(m)))
_query(
    "mean_pool", "module_registry",
    sql=f"WITH {_VEC}, r AS (SELECT DISTINCT module_id, repo FROM module_registry), e AS (SELECT repo, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM v JOIN r USING (module_id)) SELECT repo, CAST(pos AS INT) AS pos, {_r('avg(x)', 'value')} FROM e GROUP BY repo, pos",
)(similarity.mean_vectors)

# -- code and text

_LANG = "CASE ext WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rb' THEN 'ruby' WHEN 'rs' THEN 'rust' ELSE 'unknown' END"
_query(
    "file_facts", "file_ast",
    sql=rf"""SELECT file_id, name, regexp_replace(name, '\.[^.]*$', '') AS stem, ext AS extension, {_LANG} AS language, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines, sha256(t) AS sha256
FROM (SELECT file_id, string_split(file_path, '/')[-1] AS name, lower(regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1)) AS ext, coalesce(source_text, '') AS t FROM file_ast)""",
)(codetext.file_facts)
_PATTERNS = r"""CASE lang WHEN 'python' THEN regexp_extract_all(t, '(?m)^(?:import|from)\s+([A-Za-z0-9_.]+)', 1) WHEN 'javascript' THEN regexp_extract_all(t, '(?:import|require)\s*[({''"](.+?)["'')}]', 1) WHEN 'java' THEN regexp_extract_all(t, '(?m)^import\s+([A-Za-z0-9_.]+);', 1) ELSE [] END AS i,
CASE lang WHEN 'python' THEN regexp_extract_all(t, '(?m)^def\s+([A-Za-z0-9_]+)\s*\(', 1) WHEN 'javascript' THEN regexp_extract_all(t, '(?:function|const|let|var)\s+([A-Za-z0-9_]+)\s*(?:=\s*(?:async\s+)?(?:function|\()|\()', 1) WHEN 'java' THEN regexp_extract_all(t, '(?:public|private|protected)\s+[A-Za-z0-9_]+\s+([A-Za-z0-9_]+)\s*\(', 1) ELSE [] END AS f,
CASE lang WHEN 'python' THEN regexp_extract_all(t, '(?m)^class\s+([A-Za-z0-9_]+)\s*[:(]', 1) WHEN 'javascript' THEN regexp_extract_all(t, 'class\s+([A-Za-z0-9_]+)', 1) WHEN 'java' THEN regexp_extract_all(t, 'class\s+([A-Za-z0-9_]+)', 1) ELSE [] END AS c"""
_STRUCTURE = rf"""st AS (SELECT *, CASE lang WHEN 'python' THEN list_filter(f, lambda x: x LIKE 'test\_%' ESCAPE '\') WHEN 'javascript' THEN list_filter(f, lambda x: regexp_matches(lower(x), 'test|spec|it|describe')) ELSE list_filter(f, lambda x: x LIKE 'test%') END AS tf FROM (SELECT *, {_PATTERNS} FROM (SELECT file_id, lower(string_split(file_path, '/')[-1]) AS name,
CASE lower(regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'ts' THEN 'javascript' WHEN 'java' THEN 'java' ELSE '' END AS lang, replace(replace(coalesce(source_text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM file_ast)))"""
_query(
    "regex_structure", "file_ast",
    sql=f"""WITH {_STRUCTURE} SELECT file_id, length(t) - length(replace(t, chr(10), '')) + 1 AS num_lines, len(i) AS num_imports, len(f) AS num_functions, len(c) AS num_classes, array_to_string(i[1:50], '|') AS imports, array_to_string(f[1:100], '|') AS functions,
array_to_string(c[1:30], '|') AS classes, array_to_string(tf[1:50], '|') AS test_functions, contains(name, 'test') OR contains(name, 'spec') OR len(tf) > 0 AS is_test_file FROM st""",
)(lambda f: codetext.structure(f).withColumns({c: F.array_join(c, "|") for c in ("imports", "functions", "classes", "test_functions")}))
_query("structure_scores", "file_ast", sql=f"WITH {_STRUCTURE} SELECT file_id, {_r('0.4 * len(f) + 0.3 * len(i) + 0.2 * ln(len(string_split(t, chr(10))) + 1) + 0.1 * len(c)', 'score')} FROM st")(codetext.structure_scores)
_query("python_imports", "file_ast")(lambda f: outline.outlines(f).select("file_id", F.inline("imports")).distinct())
_WORDS = " + ".join(f"contains(low, '{w}')::INT" for w in ("migration", "schema", "alter table", "drop column", "rename column", "kafka", "message", "event", "contract", "interface", "api"))
_query(
    "impact_keywords", "documents",
    sql=rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents),
x AS (SELECT *, {_WORDS} AS n, regexp_matches(t, '(?i)kafka[_\s.]*(topic|consumer|producer|stream)|KafkaProducer|KafkaConsumer|@KafkaListener|send\s*\(.*topic|subscribe\s*\(.*topic') AS q,
 regexp_extract_all(t, '["''`]([a-z][a-z0-9._\-]{{2,40}})["''`]', 1)[1:5] AS tp, list_filter(list_concat(regexp_extract_all(t, '(?i)TABLE\s+([A-Za-z0-9_]+)', 1), regexp_extract_all(t, '(?i)FROM\s+([A-Za-z0-9_]+)', 1), regexp_extract_all(t, '(?i)INSERT\s+INTO\s+([A-Za-z0-9_]+)', 1),
 regexp_extract_all(t, '(?i)UPDATE\s+([A-Za-z0-9_]+)\s+SET', 1)), lambda v: length(v) > 2) AS tb FROM d)
SELECT doc_id, CASE WHEN q THEN array_to_string(list_filter(tp, lambda v, i: list_position(tp, v) = i), ',') ELSE '' END AS topics, array_to_string(list_filter(tb, lambda v, i: list_position(tb, v) = i)[1:8], ',') AS tables,
regexp_matches(t, '@RestController|@RequestMapping|@GetMapping|@PostMapping|FastAPI|flask\.route|@app\.route') AS api_contract, regexp_matches(t, '(?i)migration|alembic|flyway|liquibase|alter\s+table|add\s+column') AS schema_migration,
n AS n_words, CASE WHEN n >= 3 THEN 'HIGH' WHEN n >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM x""",
)(lambda d: codetext.impact(d).withColumns({c: F.array_join(c, ",") for c in ("topics", "tables")}))
_query(
    "impact_tags", "file_ast",
    sql=r"""SELECT repo, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM (SELECT repo, lower(regexp_extract(string_split(file_path, '/')[-1], '^(.+?)(?:\.[^.]*)?$', 1)) AS s, unnest(['auth', 'payment', 'user', 'order', 'cart', 'api', 'db', 'kafka', 'email', 'notification']) AS tag FROM file_ast) WHERE contains(s, tag) GROUP BY repo""",
)(lambda f: codetext.tags(f).withColumn("tags", F.array_join("tags", ",")))
_query("model_answers", "documents")(lambda d: codetext.answers(d.filter("text LIKE '%{%'")).select("doc_id", "summary", "risk_level"))
_query("diff_lines", "documents")(lambda d: codetext.diff_lines(codetext.embedded_diffs(d)).select(F.col("id.doc_id").alias("id"), "id.block", "file_path", "op", "hunk", "line", "text"))
_query("diff_files", "documents")(lambda d: codetext.diff_files(codetext.diff_lines(codetext.embedded_diffs(d))).select(F.col("id.doc_id").alias("id"), "id.block", "file_path", "n_added", "n_removed", "n_net"))
_query("diff_changes", "documents")(lambda d: codetext.changed_files(codetext.embedded_diffs(d)).select(F.col("id.doc_id").alias("doc_id"), "id.block", "section", "file_path", "language", "n_changed", "added_code", "removed_code"))
_query("diff_added", "documents")(lambda d: codetext.changed_files(codetext.embedded_diffs(d), added_only=True).select(F.col("id.doc_id").alias("doc_id"), "id.block", "section", "file_path", "language", "added_code"))
_query("diff_summary", "documents")(lambda d: codetext.diff_summary(codetext.changed_files(codetext.embedded_diffs(d))).select(F.col("id.doc_id").alias("doc_id"), "id.block", "n_files", F.array_join("languages", ",").alias("languages"), "lines_changed"))
_query("added_text", "documents")(lambda d: codetext.added_text(codetext.embedded_diffs(d)).select(F.col("id.doc_id").alias("doc_id"), "id.block", "text"))
_query("python_functions", "file_ast")(outline.functions)

# -- scores, decisions, models

_CAND = """c AS (SELECT o_orderkey AS candidate, (o_totalprice % 1000) / 1000 AS sim, (o_custkey % 10) / 10.0::DOUBLE AS pf, o_orderkey % 3 = 0 AS in_dep, o_orderkey % 5 = 0 AS hashed,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 ELSE 999 END AS depth, (o_custkey % 7) / 20.0::DOUBLE AS failure FROM orders),
s AS (SELECT *, round(0.25 * sim + 0.2 * in_dep::INT + 0.15 * hashed::INT + 0.1 * greatest(0, 1 - depth / 6.0::DOUBLE) + 0.2 * pf + 0.1 * failure + 1.234567e-9, 4) AS impact, 0.4 * sim + 0.25 * in_dep::INT + 0.2 * failure + 0.15 * hashed::INT AS h FROM c)"""


def _candidates(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = orders.select(k.alias("candidate"), ((F.col("o_totalprice") % 1000) / 1000).alias("sim"), ((c % 7) / 20).alias("failure"), ((c % 10) / 10).alias("pf"), (k % 3 == 0).alias("in_dep"), (k % 5 == 0).alias("hashed"), F.when(k % 3 == 0, k % 4).otherwise(999).alias("depth"))
    one = lambda x: F.col(x).cast("int")
    return d.withColumn("impact", even(scoring.composite(F.col("sim"), one("in_dep"), one("hashed"), F.col("pf"), F.col("depth"), F.col("failure")), 4)).withColumn("h", scoring.heuristic(F.col("sim"), one("in_dep"), F.col("failure"), one("hashed")))


def _decided(orders: DataFrame, dirty: bool) -> DataFrame:
    d = _candidates(orders)
    cols = {k: F.col(k) for k in ("sim", "in_dep", "hashed", "depth", "pf", "impact")} | {"always": F.col("failure") >= 0.2}
    return d.select("candidate", scoring.cascade(cols, F.lit(dirty)).alias("rule"))


_query("composite_impact", "orders", sql=f"WITH {_CAND} SELECT candidate, {_r('impact', 'impact')}, {_r('h', 'heuristic_pf')} FROM s")(lambda o: _candidates(o).select("candidate", "impact", F.col("h").alias("heuristic_pf")))
_query("gatekeeper_3way", "orders", sql=f"WITH {_CAND} SELECT candidate, CASE WHEN h >= 0.6 THEN 'RUN_ALL_TESTS' WHEN h >= 0.35 THEN 'RUN_TEST' ELSE 'PRUNE_TEST' END AS decision FROM s")(
    lambda o: _candidates(o).select("candidate", scoring.gate(F.col("h")).alias("decision"))
)
for _name, _dirty, _thr in (("run_prune_cascade", False, 0.65), ("run_prune_cascade_dirty", True, 0.70)):
    _query(
        _name, "orders",
        sql=f"""WITH {_CAND} SELECT candidate, CASE WHEN failure >= 0.2 THEN 'ALWAYS_RUN' WHEN hashed AND in_dep AND depth <= 1 THEN 'DIRECT_DEPENDENCY' WHEN sim >= {_thr}::DOUBLE THEN 'HIGH_SIMILARITY'
WHEN in_dep AND sim >= {_thr}::DOUBLE / 2 THEN 'TRANSITIVE_DEP' WHEN pf >= 0.3::DOUBLE THEN 'HIGH_PF' WHEN impact >= 0.15::DOUBLE THEN 'COMPOSITE_IMPACT' ELSE 'PRUNED' END AS rule FROM s""",
    )(lambda o, dirty=_dirty: _decided(o, dirty))
_query("gatekeeper_dirty", "orders", sql=f"WITH {_CAND} SELECT candidate, CASE WHEN h >= 0.65::DOUBLE THEN 'RUN_ALL_TESTS' WHEN h >= 0.4::DOUBLE THEN 'RUN_TEST' ELSE 'PRUNE_TEST' END AS decision FROM s")(
    lambda o: _candidates(o).select("candidate", scoring.gate(F.col("h"), dirty=F.lit(True)).alias("decision"))
)
_query("similarity_alone", "orders", sql=f"WITH {_CAND} SELECT candidate, CASE WHEN sim >= 0.5::DOUBLE THEN 'RUN_TEST' ELSE 'PRUNE_TEST' END AS decision FROM s")(lambda o: _candidates(o).select("candidate", scoring.alone(F.col("sim")).alias("decision")))
