"""Queries on repositories: import graphs, test maps, test selection, models. SQL twins say the rules on their own.

The files of the test tables import nothing of their repositories, so the graph queries read a view of them (``linked``):
every Python file imports the first file of its class (file_id modulo 16, by path) and that file imports the first one of the
next class; scripts require likewise; a function of each Python file calls that of the next class; and a test named after
each such first file imports it. What changed is what the
latest pull requests of a repository saw last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.common import cut
from kelpie.functions import paths
from kelpie.operators import codetext, graph, imports, models, outline, scoring, selection, similarity, telemetry
from kelpie.plans.catalog import _STRUCTURE, _VEC, _query, _r

_PLAIN = r"^(?:[A-Za-z_][A-Za-z0-9_]*/)*[A-Za-z_][A-Za-z0-9_]*\.(?:py|js)$"


def linked(files: DataFrame) -> DataFrame:
    """file_id, repo, file_path, source_text: files that import each other, see above."""
    f = files.filter(F.col("file_path").rlike(_PLAIN) & F.col("repo").isNotNull()).select("file_id", "repo", "file_path", F.element_at(F.split("file_path", r"\."), -1).alias("ext"), F.pmod("file_id", F.lit(16)).alias("k"))
    g = cut(f.groupBy("repo", "ext", "k").agg(F.min("file_path").alias("target"), F.min("file_id").alias("first_id")))
    j = f.join(g.drop("first_id"), ["repo", "ext", "k"]).join(g.select("repo", "ext", (F.col("k") - 1).alias("k"), F.col("target").alias("next")), ["repo", "ext", "k"], "left")
    j = j.withColumn("to", F.when(F.col("file_path") != F.col("target"), F.col("target")).otherwise(F.col("next")))
    dotted = lambda c: F.replace(F.regexp_replace(c, r"\.py$", ""), F.lit("/"), F.lit("."))
    up = F.size(F.split("file_path", "/"))  # dots that lead from the file to the root
    how = F.pmod("file_id", F.lit(3))
    py = F.when(how == 0, F.concat(F.lit("import os, "), dotted("to"), F.lit("\n"))).when(how == 1, F.concat(F.lit("import "), dotted("to"), F.lit(".thing as t\nfrom . import u\n"))).otherwise(F.concat(F.lit("def f():\n    from "), F.repeat(F.lit("."), up), dotted("to"), F.lit(" import z\n")))
    js = F.concat(F.lit("const a = require('./"), F.repeat(F.lit("../"), up - 1), F.regexp_replace("to", r"\.js$", ""), F.lit("');\nimport b from \"lib\";\n"))
    k = lambda i: F.pmod(F.col("k") + i, F.lit(16)).cast("string")
    calls = F.concat(F.lit("\ndef fn_"), k(0), F.lit("(a):\n    return m.fn_"), k(1), F.lit("(a)\n"))
    text = F.when(F.col("ext") == "py", F.concat(F.when(F.col("to").isNull(), "").otherwise(py), calls)).when(F.col("to").isNull(), "").otherwise(js)
    own = j.select("file_id", "repo", "file_path", text.alias("source_text"))
    name = F.element_at(F.split("target", "/"), -1)
    tests = g.filter("ext = 'py' AND NOT target LIKE '%test%'").select((-F.col("first_id")).alias("file_id"), "repo", F.concat(F.lit("tests/unit/"), F.col("k").cast("string"), F.lit("/test_"), name).alias("file_path"), F.concat(F.lit("import "), dotted("target"), F.lit("\n")).alias("source_text"))
    return own.union(tests)


_SKIP = "string_split(p, '/') && ['__pycache__', '.git', 'node_modules', 'venv', '.venv', 'dist', 'build', '.eggs']"
_IS_TEST = r"(regexp_matches(p, 'test_.*\.py$|.*_test\.py$|.*_spec\.py$|.*Test\.java$|.*Spec\.java$|.*\.test\.(js|ts)$|.*\.spec\.(js|ts)$'))"
_LINKED = rf"""
lf AS (SELECT file_id, repo, file_path AS p, string_split(file_path, '.')[-1] AS ext, file_id % 16 AS k FROM file_ast WHERE repo IS NOT NULL AND regexp_matches(file_path, '{_PLAIN}')),
lg AS (SELECT repo, ext, k, min(p) AS target FROM lf GROUP BY ALL),
lo AS (SELECT lf.repo, lf.p, CASE WHEN lf.p <> a.target THEN a.target ELSE b.target END AS t FROM lf JOIN lg a USING (repo, ext, k) LEFT JOIN lg b ON b.repo = lf.repo AND b.ext = lf.ext AND b.k = lf.k + 1),
lt AS (SELECT repo, 'tests/unit/' || k || '/test_' || string_split(target, '/')[-1] AS p, target AS t FROM lg WHERE ext = 'py' AND target NOT LIKE '%test%'),
files AS (SELECT DISTINCT repo, p FROM lo UNION SELECT repo, p FROM lt),
kept AS (SELECT * FROM files WHERE NOT {_SKIP}),
edges AS (SELECT DISTINCT repo, p AS importer, t AS imported FROM (SELECT * FROM lo UNION ALL SELECT * FROM lt) x WHERE t IS NOT NULL AND (repo, p) IN (SELECT (repo, p) FROM kept) AND (repo, t) IN (SELECT (repo, p) FROM kept)),
tm AS (SELECT repo, imported AS module, importer AS test FROM edges WHERE importer LIKE '%.py' AND {_IS_TEST.replace('(p,', '(importer,')} AND NOT {_IS_TEST.replace('(p,', '(imported,')}
 UNION SELECT a.repo, b.p, a.p FROM (SELECT *, regexp_extract(p, '([^/]*)\.[^./]*$', 1) AS s FROM files WHERE {_IS_TEST}) a JOIN (SELECT *, regexp_extract(p, '([^/]*)\.py$', 1) AS n FROM files WHERE p LIKE '%.py' AND NOT {_IS_TEST}) b
  ON a.repo = b.repo AND (a.s = 'test_' || b.n OR a.s = 'test' || b.n))"""

_query("test_discovery", "file_ast", sql=f"SELECT DISTINCT repo, file_path FROM (SELECT repo, file_path, file_path AS p FROM file_ast) WHERE {_IS_TEST}")(imports.test_files)
_query("test_like_paths", "file_ast", sql="SELECT DISTINCT repo, file_path FROM file_ast WHERE file_path ILIKE '%test%' OR file_path ILIKE '%spec%'")(imports.named_like_tests)
_query(
    "script_requires", "file_ast",
    sql=r"""WITH r AS (SELECT DISTINCT repo, file_path, unnest(regexp_extract_all(replace(replace(source_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?:import\s+(?:.*?\s+from\s+)?|require\s*\()\s*[''"](\..*?)[''"]\s*\)?', 1)) AS spec FROM file_ast WHERE regexp_matches(lower(file_path), '\.(js|mjs|ts|jsx|tsx)$'))
SELECT repo, file_path, spec, regexp_replace(file_path, '/?[^/]*$', '') || '/' || substr(spec, 3) AS path FROM r""",
)(imports.script_requires)
_query("import_graph", "file_ast", sql=f"WITH {_LINKED} SELECT * FROM edges")(lambda f: imports.graph(linked(f)))


def _mapped(f: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = cut(linked(f))
    edges = cut(imports.graph(files))
    return files, edges, cut(imports.test_map(files, edges))


_query("test_map", "file_ast", sql=f"WITH {_LINKED} SELECT * FROM tm")(lambda f: _mapped(f)[2])
_query(
    "graph_stats", "file_ast",
    sql=f"""WITH {_LINKED} SELECT repo, coalesce(a, 0) AS n_modules, coalesce(b, 0) AS n_edges, coalesce(c, 0) AS n_covered FROM (SELECT DISTINCT repo FROM files) LEFT JOIN (SELECT repo, count(DISTINCT importer) AS a, count(*) AS b FROM edges GROUP BY repo) USING (repo)
LEFT JOIN (SELECT repo, count(DISTINCT module) AS c FROM tm GROUP BY repo) USING (repo)""",
)(lambda f: imports.graph_stats(*_mapped(f)))
_query(
    "test_sources", "combined_submit", "file_ast",
    sql=r"""WITH n AS (SELECT DISTINCT test_name, trim(regexp_replace(test_name, '^//[A-Za-z0-9_/]+\s+', ''), ' ' || chr(9) || chr(10) || chr(13)) AS c FROM combined_submit WHERE test_name IS NOT NULL),
w AS (SELECT test_name, nullif(regexp_extract(c, '([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)+)', 1), '') AS j, regexp_extract(c, '([A-Za-z0-9_]+)', 1) AS word FROM n),
py AS (SELECT regexp_extract(file_path, '([^/]*)\.py$', 1) AS word, min(file_path) AS f FROM file_ast WHERE lower(file_path) LIKE '%.py' GROUP BY 1)
SELECT test_name, coalesce(a.file_path, py.f) AS file_path FROM w LEFT JOIN (SELECT DISTINCT file_path FROM file_ast) a ON a.file_path = 'src/' || replace(j, '.', '/') || '.java' LEFT JOIN py USING (word)""",
)(imports.test_sources)

# -- selection

_PR = "SELECT module_id, max(last_seen_pr) AS pr FROM module_registry GROUP BY 1"
_MODULES = f"""{_VEC},
md AS (SELECT f.repo, f.file_path, f.file_hash, coalesce(f.num_lines, 0) AS lines, v.v, coalesce(x.pr, 0) AS pr FROM file_ast f LEFT JOIN v ON v.module_id = f.file_id LEFT JOIN ({_PR}) x ON x.module_id = f.file_id),
tp AS (SELECT repo, max(pr) AS top FROM md GROUP BY repo),
changed AS (SELECT md.repo, file_path, lines, v, file_hash, pr = top AS is_new, (pr = top OR file_hash IS NULL) AS hash_changed, CASE WHEN pr = top OR v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS sim FROM md JOIN tp USING (repo) WHERE pr >= 0.8 * top)"""


def _modules(f: DataFrame, m: DataFrame) -> DataFrame:
    v = similarity.usable(m).select(F.col("module_id").alias("file_id"), F.col("v").alias("embedding"))
    pr = m.groupBy(F.col("module_id").alias("file_id")).agg(F.max("last_seen_pr").alias("pr"))
    j = f.select("file_id", "repo", "file_path", "file_hash", F.coalesce("num_lines", F.lit(0)).alias("lines")).join(v, "file_id", "left").join(pr, "file_id", "left").fillna(0, ["pr"])
    top = j.groupBy("repo").agg(F.max("pr").alias("top"))
    return cut(j.join(top, "repo"))


def _changed(modules: DataFrame) -> DataFrame:
    """The files that the latest pull requests of each repo saw, against a snapshot without those that the last one saw."""
    now = modules.filter("pr >= 0.8 * top")
    c = selection.changes(now.select("repo", "file_path", "file_hash", "embedding"), modules.filter("pr < top").select("repo", "file_path", "file_hash", "embedding"))
    return c.join(now.select("repo", "file_path", "lines", "embedding"), ["repo", "file_path"])


_query(
    "module_changes", "file_ast", "module_registry",
    sql=f"""WITH {_MODULES} SELECT repo, file_path, hash_changed, is_new, {_r('sim', 'sim')}, {_r('round(0.3 * hash_changed::INT + 0.3 * (1 - sim) + 0.2 + 0.2 * least(lines / 200.0::DOUBLE, 1) + 1.234567e-9, 4)', 'impact')} FROM changed""",
)(lambda f, m: _changed(_modules(f, m)).select("repo", "file_path", "hash_changed", "is_new", "sim", F.round(selection.change_impact(F.col("sim"), F.col("hash_changed"), F.lit(True), F.col("lines")) + 1.234567e-9, 4).alias("impact")))
_SIMILAR = f"""{_MODULES},
pr0 AS (SELECT a.repo, a.file_path AS src, b.file_path AS test, {_r('list_cosine_similarity(a.v, b.v)', 'sim')} FROM changed a JOIN md b ON a.repo = b.repo AND a.file_path <> b.file_path AND (b.file_path ILIKE '%test%' OR b.file_path ILIKE '%spec%')),
pairs AS (SELECT * FROM pr0 WHERE sim >= 0.70 QUALIFY row_number() OVER (PARTITION BY repo, src ORDER BY sim DESC, test) <= 20)"""


def _unit(d: DataFrame) -> DataFrame:
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return d.filter("embedding IS NOT NULL").withColumn("n", n).select("repo", "file_path", F.transform("embedding", lambda x: x / F.col("n")).alias("u"))


def _similar(modules: DataFrame, changed: DataFrame) -> DataFrame:
    low = F.lower("file_path")
    return selection.pairs(_unit(changed), _unit(modules.filter(low.contains("test") | low.contains("spec"))))


def _pairs_of(f: DataFrame, m: DataFrame) -> DataFrame:
    modules = _modules(f, m)
    return _similar(modules, _changed(modules))


_query("similar_tests", "file_ast", "module_registry", sql=f"WITH {_SIMILAR} SELECT * FROM pairs")(_pairs_of)
_DEPENDENT = f"""
seen(repo, p, d) AS (SELECT repo, file_path, 0 FROM changed UNION SELECT e.repo, e.importer, s.d + 1 FROM seen s JOIN edges e ON e.repo = s.repo AND e.imported = s.p WHERE s.d < 5),
reach AS (SELECT repo, p, min(d) AS d FROM seen GROUP BY ALL),
dep AS (SELECT repo, test, max((d = 0)::INT) AS is_direct, max((d > 0)::INT) AS is_transitive FROM (SELECT tm.repo, test, d FROM tm JOIN reach r ON r.repo = tm.repo AND r.p = tm.module
 UNION ALL SELECT repo, file_path, 0 FROM changed WHERE {_IS_TEST.replace('(p,', '(file_path,')} AND (repo, file_path) IN (SELECT (repo, p) FROM files)) GROUP BY ALL)"""


def _dependent(f: DataFrame, changed: DataFrame) -> DataFrame:
    files, edges, tests = _mapped(f)
    return selection.dependency_tests(edges, tests, changed, imports.test_files(files))


_query("dependency_tests", "file_ast", "module_registry", sql=f"WITH RECURSIVE {_MODULES}, {_LINKED}, {_DEPENDENT} SELECT * FROM dep")(lambda f, m: _dependent(f, _changed(_modules(f, m))))
_STEM = r"regexp_extract(string_split({}, '/')[-1], '^(.+?)(?:\.[^.]*)?$', 1)"
_RATES = f"""rates AS (SELECT {_STEM.format('test_name')} AS stem, arg_max(1 - pass_rate_pre, (build, test_name, record_id)) AS rate FROM combined_submit WHERE build IS NOT NULL AND test_name IS NOT NULL AND pass_rate_pre IS NOT NULL AND NOT isnan(pass_rate_pre) GROUP BY 1)"""
_CANDIDATES = f"""{_SIMILAR}, {_LINKED}, {_DEPENDENT}, {_RATES},
ps AS (SELECT p.repo, test, max(p.sim) AS mx, avg(p.sim) AS av, array_to_string(list_slice(list_sort(list_distinct(list(src))), 1, 3), ',') AS by_, max(c.hash_changed::INT) AS h FROM pairs p JOIN changed c ON c.repo = p.repo AND c.file_path = p.src GROUP BY ALL),
wh AS (SELECT repo, max(sim) AS mx, avg(sim) AS av, CAST(sum(lines) AS BIGINT) AS ln, count(*) AS nc FROM changed GROUP BY repo),
ca AS (SELECT repo, test FROM dep UNION SELECT repo, test FROM pairs),
c0 AS (SELECT ca.repo, ca.test, coalesce(ps.mx, wh.mx, 0) AS max_sim, coalesce(ps.av, wh.av, 0) AS avg_sim, ps.mx IS NULL AS is_proxy, is_direct IS NOT NULL AS in_dep, CASE WHEN is_direct = 1 THEN 0 WHEN is_transitive = 1 THEN 2 ELSE 999 END AS depth,
 coalesce(h, 0) = 1 AS hash_delta, coalesce(by_, '') AS triggered_by, coalesce(rate, 0) AS failure_rate, coalesce(ln, 0) AS total_lines FROM ca LEFT JOIN ps USING (repo, test) LEFT JOIN dep USING (repo, test) LEFT JOIN wh USING (repo) LEFT JOIN rates ON rates.stem = {_STEM.format('ca.test')}),
c1 AS (SELECT *, round(0.25 * max_sim + 0.20 * in_dep::INT + 0.15 * hash_delta::INT + 0.10 * greatest(0, 1 - depth / 6.0::DOUBLE) + 0.10 * failure_rate + 1.234567e-9, 4) AS impact FROM c0),
c2 AS (SELECT *, round(0.5 * max_sim + 0.3 * impact + 0.2 * least(total_lines / 200.0::DOUBLE, 1) + 1.234567e-9, 4) AS pf FROM c1),
dc AS (SELECT *, CASE WHEN failure_rate >= 0.2::DOUBLE THEN 'ALWAYS_RUN' WHEN hash_delta AND in_dep AND depth <= 1 THEN 'DIRECT_DEPENDENCY' WHEN max_sim >= 0.65::DOUBLE THEN 'HIGH_SIMILARITY' WHEN in_dep AND max_sim >= 0.325::DOUBLE THEN 'TRANSITIVE_DEP'
 WHEN pf >= 0.3::DOUBLE THEN 'HIGH_PF' WHEN impact >= 0.15::DOUBLE THEN 'COMPOSITE_IMPACT' ELSE 'PRUNED' END AS rule FROM c2),
de AS (SELECT *, CASE WHEN rule = 'PRUNED' THEN 'PRUNE' ELSE 'RUN' END AS decision, row_number() OVER (PARTITION BY repo ORDER BY impact DESC, test) AS rank FROM dc)"""


def _rates(c: DataFrame) -> DataFrame:
    fine = c.filter("build IS NOT NULL AND test_name IS NOT NULL AND pass_rate_pre IS NOT NULL AND NOT isnan(pass_rate_pre)")
    return fine.groupBy(paths.stem("test_name").alias("stem")).agg(F.max_by(1 - F.col("pass_rate_pre"), F.struct("build", "test_name", "record_id")).alias("failure_rate"))


def decided(f: DataFrame, m: DataFrame, c: DataFrame) -> DataFrame:
    """Candidates of every repo with signals and decision: the whole selection."""
    modules = _modules(f, m)
    changed = cut(_changed(modules))
    got = selection.candidates(changed, cut(_similar(modules, changed)), cut(_dependent(f, changed)), _rates(c))
    return cut(selection.decide(got))


_T3 = ("file_ast", "module_registry", "combined_submit")
_query(
    "test_selection", *_T3,
    sql=f"WITH RECURSIVE {_CANDIDATES} SELECT repo, test, {_r('max_sim', 'max_sim')}, {_r('avg_sim', 'avg_sim')}, is_proxy, in_dep, depth, hash_delta, triggered_by, {_r('failure_rate', 'failure_rate')}, total_lines, {_r('impact', 'impact')}, {_r('pf', 'pf')}, rule, decision, rank FROM de",
)(lambda *t: decided(*t).withColumn("triggered_by", F.array_join("triggered_by", ",")).drop("n_changed", "reason"))
_query(
    "selection_reasons", *_T3,
    sql=f"""WITH RECURSIVE {_CANDIDATES}, tr AS (SELECT *, row_number() OVER (PARTITION BY repo, decision ORDER BY rank) AS n FROM de)
SELECT repo, decision, n, test, rule, CASE rule WHEN 'ALWAYS_RUN' THEN 'ALWAYS_RUN: historic failure rate above 20%' WHEN 'DIRECT_DEPENDENCY' THEN format('DIRECT_DEPENDENCY: hash changed + direct import path (sim={{:.3f}})', max_sim)
 WHEN 'HIGH_SIMILARITY' THEN format('HIGH_SIMILARITY: sim={{:.3f}} >= 0.65', max_sim) WHEN 'TRANSITIVE_DEP' THEN format('TRANSITIVE_DEP: depth={{}}, sim={{:.3f}}', depth, max_sim) WHEN 'HIGH_PF' THEN format('HIGH_PF: pf={{:.3f}} >= 0.30', pf)
 WHEN 'COMPOSITE_IMPACT' THEN format('COMPOSITE_IMPACT: score={{:.3f}}', impact) ELSE format('PRUNED: sim={{:.3f}} < 0.65, pf={{:.3f}} < 0.30, dep={{}}, impact={{:.3f}}', max_sim, pf, CASE WHEN in_dep THEN 'yes' ELSE 'no' END, impact) END AS reason
FROM tr WHERE CASE WHEN decision = 'RUN' THEN n <= 10 ELSE n <= 5 END""",
)(lambda *t: selection.top_rows(decided(*t)))
_query(
    "selection_outcome", *_T3,
    sql=f"""WITH RECURSIVE {_CANDIDATES} SELECT repo, count(*) AS n_tests, count(*) FILTER (WHERE decision = 'RUN') AS n_selected, count(*) FILTER (WHERE decision = 'PRUNE') AS n_pruned, any_value(nc) AS n_changed, any_value(ln) AS total_lines,
{_r("round(count(*) FILTER (WHERE decision = 'PRUNE') / count(*)::DOUBLE + 1.234567e-9, 4)", 'pruning_rate')} FROM de JOIN wh USING (repo) GROUP BY repo""",
)(lambda *t: selection.outcome(decided(*t)))
_query(
    "test_matrix", *_T3,
    sql=f"""WITH RECURSIVE {_CANDIDATES} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY rank) AS position, test, 'now' AS source FROM de WHERE decision = 'RUN'""",
)(lambda *t: selection.matrix(decided(*t)))
_query(
    "selection_shares", *_T3,
    sql=f"""WITH RECURSIVE {_CANDIDATES}, k AS (SELECT repo, CASE WHEN decision = 'PRUNE' THEN 'pruned' WHEN rule = 'ALWAYS_RUN' THEN 'historic' ELSE 'run_now' END AS category, count(*) AS n FROM de GROUP BY ALL)
SELECT repo, category, n, {_r('round(100 * n / sum(n) OVER (PARTITION BY repo) + 1.234567e-9, 4)', 'percent')} FROM k""",
)(lambda *t: selection.shares(decided(*t)))
_query("only_pruned", *_T3, sql=f"WITH RECURSIVE {_CANDIDATES} SELECT test FROM de GROUP BY test HAVING max((decision = 'RUN')::INT) = 0")(lambda *t: selection.only_pruned(decided(*t)))
_query(
    "selection_labels", *_T3,
    sql=f"""WITH RECURSIVE {_CANDIDATES} SELECT repo, concat_ws(',', CASE WHEN max((decision = 'PRUNE')::INT) = 1 THEN 'pruned' END, CASE WHEN max((failure_rate >= 0.2)::INT) = 1 THEN 'historic' END) AS labels FROM de GROUP BY repo""",
)(lambda *t: selection.labels(decided(*t)).withColumn("labels", F.array_join("labels", ",")))

_query(
    "test_commands", *_T3,
    sql=f"""WITH RECURSIVE {_CANDIDATES}, q AS (SELECT repo, coalesce(string_agg(test, ' ' ORDER BY test) FILTER (WHERE decision = 'RUN'), '') AS s, coalesce(string_agg(test, ' ' ORDER BY test) FILTER (WHERE decision = 'PRUNE'), '') AS p,
 count(*) FILTER (WHERE decision = 'PRUNE') / count(*)::DOUBLE AS r, coalesce(string_agg('{{"test":"' || test || '"}}', ',' ORDER BY test) FILTER (WHERE decision = 'RUN'), '') AS m FROM de GROUP BY repo)
SELECT repo, trim('pytest ' || s) AS test_command, s AS selected_tests, p AS pruned_tests, {_r('round(r + 1.234567e-9, 3)', 'pruning_rate')}, '{{"include":[' || m || ']}}' AS matrix FROM q""",
)(lambda *t: selection.commands(decided(*t)))
_query(
    "safety_tests", *_T3,
    sql=f"WITH RECURSIVE {_CANDIDATES} SELECT DISTINCT repo, file_path AS test, 'RUN' AS decision, 'Safety: no_candidates_found' AS reason FROM file_ast WHERE (file_path ILIKE '%test%' OR file_path ILIKE '%spec%') AND repo NOT IN (SELECT repo FROM de)",
)(lambda f, m, c: selection.safety(imports.named_like_tests(f), decided(f, m, c)))
_query(
    "small_features", *_T3,
    sql=f"""WITH RECURSIVE {_CANDIDATES} SELECT repo, test, {_r('max_sim', 'cosine_similarity')}, {_r('total_lines', 'change_size')}, {_r('impact', 'module_impact_score')}, 0.0::DOUBLE AS is_kafka_consumer, 0.0::DOUBLE AS is_kafka_producer,
regexp_matches(lower(test), 'db|database')::INT::DOUBLE AS is_shared_db, regexp_matches(lower(test), 'contract|api')::INT::DOUBLE AS is_frontend_contract, regexp_matches(lower(test), 'util|helper')::INT::DOUBLE AS is_shared_utility,
CASE WHEN depth < 999 THEN depth ELSE 5 END::DOUBLE AS transitive_depth FROM de""",
)(lambda *t: selection.small_features(decided(*t)))


def _small_scores(*t: DataFrame) -> DataFrame:
    f = selection.small_features(decided(*t)).withColumn("record_id", F.xxhash64("repo", "test")).withColumn("label", F.lit(0))
    model = models.fit(models.small_prior(f.sparkSession), models.SMALL_FEATURES, trees=50, depth=3)
    return models.score(model, f).select("record_id", "pf", "predicted")


_query("small_model_scores", *_T3)(_small_scores)
_query(
    "module_weights", "file_ast", "module_registry",
    sql=f"""WITH {_STRUCTURE}, k AS (SELECT repo, file_path, max(struct_pack(f := ast_features.num_functions, i := ast_features.num_imports, l := ast_features.num_lines)) AS k FROM module_registry WHERE ast_features IS NOT NULL GROUP BY ALL)
SELECT a.repo, a.file_path, {_r("least((0.4 * coalesce(k.f, len(st.f), 0) + 0.3 * coalesce(k.i, len(st.i), 0) + 0.2 * ln(coalesce(k.l, len(string_split(t, chr(10))), 100) + 1)) / 20, 1)", 'impact')} FROM file_ast a JOIN st USING (file_id) LEFT JOIN k USING (repo, file_path)""",
)(lambda f, m: selection.module_weights(f.select("file_id", "repo", "file_path").join(codetext.structure(f).select("file_id", "num_functions", "num_imports", "num_lines"), "file_id"), m))


def _explained(f: DataFrame, m: DataFrame, c: DataFrame) -> DataFrame:
    changed = cut(_changed(_modules(f, m)))
    _, edges, tests = _mapped(f)
    return selection.explained(decided(f, m, c), selection.reached(edges, tests, changed))


_query(
    "selection_explained", *_T3,
    sql=f"""WITH RECURSIVE {_CANDIDATES}, via AS (SELECT tm.repo, test, array_to_string(list_slice(list_sort(list_distinct(list(module))), 1, 3), ', ') AS v FROM tm JOIN reach r ON r.repo = tm.repo AND r.p = tm.module WHERE d > 0 GROUP BY ALL)
SELECT de.repo, de.test, CASE WHEN decision = 'PRUNE' THEN 'pruned' WHEN depth = 0 THEN 'direct' WHEN depth = 2 THEN 'transitive via ' || coalesce(v, '') ELSE 'similarity' END AS why FROM de LEFT JOIN via USING (repo, test)""",
)(_explained)
_HISTORY = f"""hk AS (SELECT s, k, arg_max(struct_pack(rate := rate, dur := dur), (build, test_name, record_id)) AS v FROM (SELECT *, unnest(['s', 'n']) AS s, unnest([{_STEM.format('test_name')}, test_name]) AS k,
 coalesce(failure_count_pre / greatest(coalesce(total_runs_pre, 1), 1)::DOUBLE, 0) AS rate, CASE WHEN duration_mean_pre IS NULL OR isnan(duration_mean_pre) THEN 30 ELSE duration_mean_pre END AS dur FROM combined_submit WHERE build IS NOT NULL AND test_name IS NOT NULL) WHERE k <> '' GROUP BY s, k)"""
_query(
    "history_fallback", "ci_runs", "combined_submit",
    sql=f"""WITH {_HISTORY}, t AS (SELECT DISTINCT test_name AS test FROM ci_runs WHERE test_name IS NOT NULL)
SELECT test, {_r('coalesce(a.v.rate, b.v.rate, 0)', 'failure_rate')}, {_r('coalesce(a.v.dur, b.v.dur, 30)', 'duration')} FROM t LEFT JOIN hk a ON a.s = 's' AND a.k = {_STEM.format('t.test')} LEFT JOIN hk b ON b.s = 'n' AND b.k = t.test""",
)(lambda r, c: telemetry.history_of(r.filter("test_name IS NOT NULL").select(F.col("test_name").alias("test")), c))


def _features(f: DataFrame, m: DataFrame, c: DataFrame) -> DataFrame:
    modules = _modules(f, m)
    s = codetext.structure(f).select("file_id", "num_functions", "num_imports", "num_lines")
    weight = f.select("file_id", "repo", "file_path").join(s, "file_id").select("repo", "file_path", selection.module_impact(F.col("num_functions"), F.col("num_imports"), F.col("num_lines")).alias("impact"))
    changed = _changed(modules).select("repo", "file_path", "embedding", "lines").join(weight, ["repo", "file_path"])
    tests = modules.select("repo", "file_path", "embedding").join(imports.named_like_tests(f), ["repo", "file_path"], "left_semi")
    return selection.pair_features(tests, cut(changed), _mapped(f)[2], telemetry.history_of(tests.select(F.col("file_path").alias("test")), c))


_FEATURES = f"""{_MODULES}, {_LINKED}, {_STRUCTURE}, {_HISTORY},
ch AS (SELECT c.repo, c.file_path, c.v, c.lines, least((0.4 * len(st.f) + 0.3 * len(st.i) + 0.2 * ln(len(string_split(st.t, chr(10))) + 1)) / 20, 1) AS impact FROM changed c JOIN file_ast a ON a.repo = c.repo AND a.file_path = c.file_path JOIN st ON st.file_id = a.file_id),
cp AS (SELECT repo, list(x ORDER BY pos) AS cv FROM (SELECT repo, pos, avg(x) AS x FROM (SELECT repo, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM ch WHERE v IS NOT NULL) GROUP BY ALL) GROUP BY repo),
w2 AS (SELECT repo, sum(lines) AS ln, avg(impact) AS im, count(*) AS nc, min(file_path) AS fp FROM ch GROUP BY repo),
mp AS (SELECT tm.repo, tm.test, max((ch.repo IS NOT NULL)::INT) AS direct FROM tm LEFT JOIN ch ON ch.repo = tm.repo AND ch.file_path = tm.module GROUP BY ALL),
ft AS (SELECT md.repo, md.file_path AS test, coalesce(list_cosine_similarity(cv, md.v), 0.5) AS sim, least(ln / 500.0::DOUBLE, 1) AS cs, coalesce(im, 0.5) AS im, coalesce(direct, 0) AS direct, CASE direct WHEN 1 THEN 1 WHEN 0 THEN 3 ELSE 5 END / 6.0::DOUBLE AS td,
 coalesce(a.v.rate, b.v.rate, 0) AS rate, ln(coalesce(a.v.dur, b.v.dur, 30) + 1) AS dl, least(nc / 20.0::DOUBLE, 1) AS nf, (ends_with(md.file_path, fp) OR contains({_STEM.format('fp')}, {_STEM.format('md.file_path')}))::INT AS it
 FROM md JOIN w2 USING (repo) LEFT JOIN cp USING (repo) LEFT JOIN mp ON mp.repo = md.repo AND mp.test = md.file_path LEFT JOIN hk a ON a.s = 's' AND a.k = {_STEM.format('md.file_path')} LEFT JOIN hk b ON b.s = 'n' AND b.k = md.file_path
 WHERE md.file_path ILIKE '%test%' OR md.file_path ILIKE '%spec%')"""
_query(
    "pair_features", *_T3,
    sql=f"""WITH {_FEATURES} SELECT repo, test, {_r('sim', 'cosine_similarity')}, {_r('cs', 'change_size')}, {_r('im', 'module_impact_score')}, direct AS is_direct_dependency, {_r('td', 'transitive_depth')}, contains(lower(test), 'db')::INT AS is_shared_db,
contains(lower(test), 'contract')::INT AS is_frontend_contract, contains(lower(test), 'util')::INT AS is_shared_utility, 0 AS is_kafka_consumer, 0 AS is_kafka_producer, {_r('rate', 'historical_failure_rate')}, 0.0::DOUBLE AS test_flakiness_score,
{_r('dl', 'duration_log')}, 1 AS hash_changed, {_r('nf', 'num_functions_changed')}, it AS is_test_file FROM ft""",
)(_features)
_query(
    "gatekeeper_pairs", *_T3,
    sql=f"""WITH {_FEATURES}, g AS (SELECT repo, test, rate, round(0.40 * sim + 0.25 * direct + 0.20 * rate + 0.15 + 1.234567e-9, 4) AS pf FROM ft),
h AS (SELECT *, CASE WHEN pf >= 0.6::DOUBLE THEN 'RUN_ALL_TESTS' WHEN pf >= 0.35::DOUBLE THEN 'RUN_TEST' ELSE 'PRUNE_TEST' END AS gate FROM g)
SELECT repo, test, {_r('pf', 'pf')}, gate, CASE WHEN rate >= 0.2::DOUBLE OR gate <> 'PRUNE_TEST' THEN 'RUN' ELSE 'PRUNE' END AS decision FROM h""",
)(lambda *t: selection.gated(_features(*t)))


# -- structure

_query("value_scores_ast", "file_ast")(outline.value_scores)
_query("fingerprints", "file_ast")(outline.fingerprints)
_query("function_snippets", "file_ast")(outline.snippets)
_CALLS = f"ck AS (SELECT DISTINCT repo, k FROM lf WHERE ext = 'py'), calls AS (SELECT a.repo, 'fn_' || a.k AS caller, 'fn_' || b.k AS callee FROM ck a JOIN ck b ON a.repo = b.repo AND b.k = (a.k + 1) % 16)"
_query("call_graph", "file_ast", sql=f"WITH {_LINKED}, {_CALLS} SELECT * FROM calls")(lambda f: outline.calls(linked(f)))
_query(
    "call_expansion", "file_ast",
    sql=f"""WITH RECURSIVE {_LINKED}, {_CALLS}, r(f, s, d) AS (SELECT DISTINCT callee, callee, 0 FROM calls WHERE callee IN ('fn_0', 'fn_7') UNION SELECT c.caller, r.s, d + 1 FROM r JOIN calls c ON c.callee = r.f WHERE d < 3)
SELECT f AS function, arg_min(s, (d, s)) AS seed, min(d) AS depth FROM r GROUP BY f""",
)(lambda f: _expansion(f))


def _expansion(f: DataFrame) -> DataFrame:
    calls = cut(outline.calls(linked(f)).select("caller", "callee").distinct())
    return graph.expand_calls(calls, calls.filter("callee IN ('fn_0', 'fn_7')").select(F.col("callee").alias("function")))


_query("structural_changes", "file_ast")(lambda f: outline.successive(f).select("file_id", *[F.array_join(c, ",").alias(c) for c in ("added_functions", "removed_functions", "changed_functions", "added_classes", "removed_classes", "added_imports", "removed_imports")], "is_meaningful", "summary"))
_query(
    "java_outline", "file_ast",
    sql=r"""WITH t AS (SELECT file_id, replace(replace(coalesce(source_text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM file_ast WHERE lower(file_path) LIKE '%.java')
SELECT file_id, array_to_string(regexp_extract_all(t, 'import\s+([A-Za-z0-9_.]+);', 1), ',') AS imports, array_to_string(regexp_extract_all(t, 'class\s+([A-Za-z0-9_]+)', 1), ',') AS classes,
array_to_string(regexp_extract_all(t, '(?:public|private|protected|static|final)[\sA-Za-z0-9_<>\[\]]+\s+([A-Za-z0-9_]+)\s*\(', 1), ',') AS methods FROM t""",
)(lambda f: codetext.java_outline(f).select("file_id", *[F.array_join(c, ",").alias(c) for c in ("imports", "classes", "methods")]))

# -- models


def _matrix(c: DataFrame) -> DataFrame:
    return telemetry.training_matrix(c)


_query("gbt_scores", "combined_submit")(lambda c: models.evaluated(_matrix(c), trees=20, depth=4)[1])
_query("gbt_metrics", "combined_submit")(lambda c: models.metrics(cut(models.evaluated(_matrix(c), trees=20, depth=4)[1])))
_query("gbt_importance", "combined_submit")(lambda c: models.importance(models.evaluated(_matrix(c), trees=20, depth=4)[0]))
_query("prior_scores", "combined_submit")(lambda c: models.score(models.fit(models.prior(c.sparkSession), trees=80, depth=4), _matrix(c)))
_query(
    "stratified_split", "combined_submit",
    sql="""WITH c AS (SELECT coalesce(regression_detected, 0) AS label, count(*) AS n FROM combined_submit GROUP BY 1)
SELECT label, true AS held_out, CAST(round(n * 0.2) AS BIGINT) AS count FROM c WHERE round(n * 0.2) > 0 UNION ALL SELECT label, false, CAST(n - round(n * 0.2) AS BIGINT) FROM c WHERE n > round(n * 0.2)""",
)(lambda c: models.stratified(_matrix(c)).groupBy("label", "held_out").count())
_query(
    "first_outcomes", "pr_run_log", "combined_submit",
    sql=f"""WITH t AS (SELECT run_id, test, {_STEM.format('test')} AS stem FROM (SELECT run_id, unnest(list_distinct(selected_tests)) AS test FROM pr_run_log) WHERE test IS NOT NULL),
n AS (SELECT test_name, arg_min(struct_pack(r := record_id, g := regression_detected, p := pass_rate_pre), record_id) AS o FROM combined_submit WHERE test_name IS NOT NULL GROUP BY test_name),
m AS (SELECT stem, arg_min(o, o.r) AS o FROM (SELECT DISTINCT stem FROM t WHERE stem <> '') JOIN n ON contains(test_name, stem) GROUP BY stem)
SELECT run_id, test, o.r AS record_id, coalesce(o.g, 0) AS regression, {_r('coalesce(o.p, 1)', 'pass_rate')} FROM t JOIN m USING (stem)""",
)(models.first_outcomes)
_query("retraining_matrix", "pr_run_log", "combined_submit")(models.retraining_matrix)
_query("content_vectors", "file_ast")(lambda f: models.content_vectors(f, 1000, 64).select("file_id", F.posexplode("vector").alias("pos", "x")).filter("x <> 0"))
