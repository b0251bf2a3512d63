import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie import common
from kelpie.common import quantiles, table
from kelpie.operators import codetext, graph, imports, models, outline, registry, scoring, selection, similarity, telemetry
from kelpie.sources import files, synthetic


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "importer long, imported long")


def test_closure_with_cycle_diamond_and_self_import(spark):
    e = edges(spark, [(2, 1), (3, 1), (4, 2), (4, 3), (1, 4), (5, 5), (6, 4)])
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in graph.upstream(e, seeds).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (6, 3)}
    assert {(r.node, r.depth) for r in graph.closure(e, seeds, 1).select("node", "depth").collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {tuple(r.cycle) for r in graph.cycles(e).collect()} == {(1, 4, 2), (5,)}
    assert graph.upstream(edges(spark, []), seeds).count() == 1


def test_cycles_of_any_length(spark):
    ring = [(i, (i + 1) % 40) for i in range(40)]
    e = edges(spark, [*ring, (100, 101), (101, 100), (101, 102), (102, 103), (103, 101), (7, 100), (50, 51), (51, 52)])
    got = {r.component: tuple(r.cycle) for r in graph.cycles(e).collect()}
    assert got == {0: tuple(range(40)), 100: (100, 101)}
    assert {(r.node, r.component) for r in graph.strong_components(e).collect()} == {(i, 0) for i in range(40)} | {(i, 100) for i in range(100, 104)}
    assert graph.cycles(edges(spark, [])).count() == 0


def test_weights_by_hand(spark):
    p = spark.createDataFrame([("load", "t_a", 0.9), ("load", "t_b", 0.6), ("load", "t_c", 0.49), ("save", "t_a", 0.6), ("save", "t_d", 0.5), ("idle", "t_c", 0.1)], "src string, test string, sim double")
    w = {r.test: (round(r.weight, 6), round(r.pf, 4)) for r in graph.test_weights(p).collect()}
    assert w == {"t_a": (1.5, 1.0), "t_b": (0.6, 0.4), "t_d": (0.5, 0.3333)}
    assert {r.src: r.tests for r in graph.bipartite(p).collect()} == {"load": ["t_a", "t_b"], "save": ["t_a", "t_d"], "idle": []}
    assert [(r.test, r.rank, round(r.pf, 4)) for r in graph.ranked_weights(p, dirty=True).orderBy("rank").collect()] == [("t_a", 1, 1.0), ("t_b", 2, 0.5), ("t_d", 3, 0.4333)]
    more = spark.createDataFrame([("load", "t_z"), ("new", "t_z")], "src string, test string")
    assert ("load", "t_z") in {tuple(r) for r in graph.merge_edges(p, more).collect()} and ("new", "t_z") not in {tuple(r) for r in graph.merge_edges(p, more).collect()}


def test_calls_inherit_the_first_seed(spark):
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("a", "c")], "caller string, callee string")
    t = spark.createDataFrame([("a",)], "function string")
    assert {(r.function, r.seed, r.depth) for r in graph.expand_calls(calls, t).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3)}


def runs(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "phase string, build string, test_name string, test_duration double, test_result string, duration string")


def test_clean_edges(spark):
    rows = [("pre", "b", "t", 1.0, " passed "), ("pre", " b", "t", 1.0, "PASSED"), ("pre", "b", "t", -1.0, "FAILED"), ("pre", "b", "t", float("nan"), "PASSED"), ("pre", None, None, 1.0, "PASSED"), ("pre", "b", "u", None, "FAILED"), ("pre", "b", "t", 5.0, "SKIPPED"), ("post", "b", "t", 2.0, "FAILED")]
    got = sorted((r.phase, r.test_name, r.duration, r.result) for r in telemetry.clean(runs(spark, rows)).collect())
    assert got == [("post", "t", 2.0, 0), ("pre", "t", 1.0, 1), ("pre", "t", 3.0, 0), ("pre", "t", 3.0, 1), ("pre", "u", 3.0, 0)]
    assert telemetry.clean(runs(spark, [])).count() == 0
    c = telemetry.combined(runs(spark, rows)).collect()
    assert {(r.test_name, r.only_in_pre, r.only_in_post, r.regression_detected) for r in c} == {("t", 0, 0, 0), ("u", 1, 0, 0)}


def test_dense_codes(spark):
    v = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("abc",), ("ab",), ("é",)], "x string")
    assert {r.x: r.code for r in telemetry.dense_codes(v, "x").collect()} == {"a": 0, "ab": 1, "abc": 2, "b": 3, "é": 4}


def test_upsert_and_delete(spark):
    s = spark.createDataFrame([("r", "a", 1), ("r", "b", 1)], "repo string, file_path string, v int")
    c = spark.createDataFrame([("r", "b", 2), ("r", "c", 2)], "repo string, file_path string, v int")
    assert {(r.file_path, r.v) for r in registry.upsert(s, c).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert {r.file_path for r in registry.delete(s, c).collect()} == {"a"}


@pytest.mark.parametrize(("sim", "direct", "fail", "hashed", "want", "decision"), [(0.92, 1, 0.8, 1, 0.928, "RUN_ALL_TESTS"), (0.65, 0, 0.4, 1, 0.49, "RUN_TEST"), (0.15, 0, 0.05, 0, 0.07, "PRUNE_TEST")])
def test_heuristic_by_hand(spark, sim, direct, fail, hashed, want, decision):
    pf = scoring.heuristic(F.lit(sim), F.lit(direct), F.lit(fail), F.lit(hashed))
    r = spark.range(1).select(pf.alias("pf"), scoring.gate(pf).alias("d")).first()
    assert abs(r.pf - want) < 1e-9 and r.d == decision


def test_composite_by_hand(spark):
    r = spark.range(1).select(scoring.composite(F.lit(0.9), F.lit(1), F.lit(1), F.lit(0.0), F.lit(0), F.lit(0.1)).alias("a"), scoring.composite(F.lit(0.4), F.lit(1), F.lit(0), F.lit(0.0), F.lit(2), F.lit(0.0)).alias("c"), scoring.composite(F.lit(0.182), F.lit(0), F.lit(0), F.lit(0.0), F.lit(999), F.lit(0.0)).alias("b")).first()
    assert abs(r.a - 0.685) < 1e-9 and abs(r.b - 0.0455) < 1e-9 and round(r.c, 4) == 0.3667


def test_cosine_of_zero_vector(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


DIFF = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,3 +1,4 @@
 x
-old
+new
+more
 y
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-z
"""


def test_diff_lines(spark):
    d = spark.createDataFrame([("d1", DIFF), ("d2", "")], "id string, diff string")
    lines = codetext.diff_lines(d)
    assert [(r.op, r.line, r.text) for r in lines.orderBy("line").collect() if r.op != "-"] == [(" ", 1, "x"), ("+", 2, "new"), ("+", 3, "more"), (" ", 4, "y")]
    assert [(r.file_path, r.n_added, r.n_removed) for r in codetext.diff_files(lines).collect()] == [("src/a.py", 2, 1)]
    fn = spark.createDataFrame([("src/a.py", "f", 3, 5), ("src/a.py", "g", 4, 9)], "file_path string, name string, start_line int, end_line int")
    assert [r.name for r in codetext.touched(fn, lines).collect()] == ["f"]


def test_every_fenced_diff(spark):
    body = "--- a/{0}\n+++ b/{0}\n@@ -1 +1 @@\n-x\n+y\n"
    text = "\n".join(f"see\n```{n}\n{b}```" for n, b in (("diff", body.format("a")), ("py", "x = 1\n"), ("", body.format("b")), ("diff", body.format("c"))))
    d = codetext.embedded_diffs(spark.createDataFrame([(7, text), (8, None), (9, "no fence")], "doc_id long, text string"))
    got = codetext.diff_files(codetext.diff_lines(d)).collect()
    assert {(r.id.doc_id, r.id.block, r.file_path, r.n_added, r.n_removed) for r in got} == {(7, 0, "a", 1, 1), (7, 1, "b", 1, 1), (7, 2, "c", 1, 1)}


FILES = "file_id long, repo string, file_path string, source_text string"


def test_python_outline(spark):
    src = "import os, a.b\nfrom . import q\nfrom ..x.y import z\nLIMIT = 3\nclass A(Base, m.B):\n    INNER = 1\n    def f(self, x):\n        '''doc'''\n        return g(x).h() if x and y else 0\n\n@pytest.mark.slow\nasync def g(y):\n    for i in y:\n        h(i)\n    def test_in(): pass\n"
    d = spark.createDataFrame([(1, "r", "a.py", src), (2, "r", "b.py", "def broken(:"), (3, "r", "c.py", None), (4, "r", "d.java", "class X {}"), (5, "r", "e.py", "import u\nclass A: pass\ndef g(y, z): pass\ndef n(): pass")], FILES)
    o = {r.file_id: r for r in outline.outlines(d).collect()}
    assert set(o) == {1, 2, 3, 5} and not o[2].parsed and o[3].parsed
    got = {(f.name, f.class_name, f.complexity, f.num_args, f.has_decorator, f.is_test) for f in o[1].functions}
    assert got == {("f", "A", 3, 2, False, False), ("g", None, 2, 1, True, True), ("test_in", None, 1, 0, False, True)}
    assert [(i.module, i.level) for i in o[1].imports] == [("os", 0), ("a.b", 0), ("", 1), ("x.y", 2)] and o[1].import_names == ["os", "a.b", ".q", "x.y.z"]
    assert o[1].global_vars == ["LIMIT"] and [(c.name, c.bases, c.num_methods) for c in o[1].classes] == [("A", ["Base", "m.B"], 1)]
    assert {f.name: f.calls for f in o[1].functions}["f"] == [".h", "g"] and {f.name: f.docstring for f in o[1].functions}["f"] == "doc"
    assert {(r.caller, r.callee) for r in outline.calls(d).collect()} == {("A.f", "g")}
    snip = {r.identifier: r.snippet for r in outline.snippets(d).collect()}
    assert snip["a.py#A.f"].startswith("    def f(self, x):") and snip["a.py#test_in"] == "    def test_in(): pass"
    v = {r.file_id: r for r in outline.value_scores(d).collect()}
    assert abs(v[1].by_complexity - (0.5 * 6 + 0.3 * 4 + 0.2 * math.log(17))) < 1e-9 and abs(v[3].by_complexity - (0.5 + 0.2 * math.log(2))) < 1e-9
    print_ = {r.file_id: r.fingerprint for r in outline.fingerprints(d).collect()}
    want = '{"classes":["A"],"functions":["g","test_in"],"imports":[".q","a.b","os","x.y.z"],"methods":["A.f"]}'
    assert print_[1] == hashlib.sha256(want.encode()).hexdigest()
    diff = outline.successive(d).filter("file_id = 3").first()
    assert diff is not None and not diff.is_meaningful
    one, two = outline.outlines(d).filter("file_id = 1"), outline.outlines(d).filter("file_id = 5").withColumn("file_id", F.lit(1).cast("long"))
    x = outline.differences(one, two).first()
    assert (x.added_functions, x.removed_functions, x.changed_functions, x.added_imports) == (["n"], ["A.f", "test_in"], ["g"], ["u"]) and x.is_meaningful
    assert outline.functions(d.limit(0)).count() == 0


def test_import_graph_and_test_map(spark):
    rows = [
        (1, "r", "a/b.py", "import os, a.c.name\nfrom . import x\nfrom .c import d\nfrom ..top import e\n"), (2, "r", "a/c.py", "from a import b\n"), (3, "r", "a/__init__.py", ""), (4, "r", "top.py", "def f():\n    import stub.inner\n"),
        (5, "r", "stub.pyi", ""), (6, "s", "a/c.py", "import a.b"), (7, "r", "tests/test_c.py", "from a.c import d\nimport top"), (8, "r", "web/x.js", "import y from './y';\nconst z = require(\"../lib\");\nrequire('../../../out');\nrequire('./x/../y.js')"),
        (9, "r", "web/y.ts", ""), (10, "r", "lib/index.js", ""), (11, "r", "web/y.js", ""), (12, "r", "build/z.py", "import top"), (13, "r", "_c.py", ""), (14, "r", "n.py", None),
    ]
    f = spark.createDataFrame(rows, FILES)
    e = imports.graph(f)
    got = {(r.repo, r.importer, r.imported) for r in e.collect()}
    assert got == {("r", *x) for x in [("a/b.py", "a/c.py"), ("a/b.py", "top.py"), ("a/c.py", "a/__init__.py"), ("top.py", "stub.pyi"), ("tests/test_c.py", "a/c.py"), ("tests/test_c.py", "top.py"), ("web/x.js", "web/y.js"), ("web/x.js", "lib/index.js")]}
    assert {(r.module, r.test) for r in imports.test_map(f, e).collect()} == {("a/c.py", "tests/test_c.py"), ("_c.py", "tests/test_c.py"), ("top.py", "tests/test_c.py")}
    assert {(r.repo, r.n_edges, r.n_covered) for r in imports.graph_stats(f, e, imports.test_map(f, e)).collect()} == {("r", 8, 3), ("s", 0, 0)}
    assert imports.graph(f.limit(0)).count() == 0
    paths = spark.createDataFrame([("r", p) for p in ("x/test_a.py", "a_test.py", "b_spec.py", "FooTest.java", "FooSpec.java", "a.test.ts", "b.spec.js", "latest.py", "Foo.java")], "repo string, file_path string")
    assert {r.file_path for r in imports.test_files(paths).collect()} == {"x/test_a.py", "a_test.py", "b_spec.py", "FooTest.java", "FooSpec.java", "a.test.ts", "b.spec.js"}
    assert "latest.py" in {r.file_path for r in imports.named_like_tests(paths).collect()}
    names = spark.createDataFrame([("//pkg/x org.foo.Bar#m",), ("word_one::t",), ("zzz",), (None,)], "test_name string")
    src = spark.createDataFrame([("r", "src/org/foo/Bar.java"), ("r", "q/word_one.py")], "repo string, file_path string")
    assert {r.test_name: r.file_path for r in imports.test_sources(names, src).collect()} == {"//pkg/x org.foo.Bar#m": "src/org/foo/Bar.java", "word_one::t": "q/word_one.py", "zzz": None}


def test_changed_files_of_a_diff(spark):
    d = spark.createDataFrame([("d1", DIFF + "diff --git a/k b/k\n+++ b/k.kt\n+x\n+++ b/only.py\n-gone\n+++ b/doc.md\n+x\n"), ("d2", None)], "id string, diff string")
    got = {(r.file_path, r.language, r.n_changed, r.added_code, r.removed_code) for r in codetext.changed_files(d).collect()}
    assert got == {("src/a.py", "python", 4, "new\nmore", "old\nz"), ("only.py", "python", 1, "", "gone")} or got == {("src/a.py", "python", 3, "new\nmore", "old"), ("only.py", "python", 1, "", "gone")}
    assert {(r.file_path, r.language) for r in codetext.changed_files(d, added_only=True).collect()} == {("src/a.py", "python"), ("k.kt", "kotlin")}
    assert {r.id: r.text for r in codetext.added_text(spark.createDataFrame([("a", "+x\n-y\n+z"), ("b", "-y\n+ "), ("c", None)], "id string, diff string")).collect()} == {"a": "x\nz", "b": "-y\n+ ", "c": ""}


def test_impact_by_words(spark):
    d = spark.createDataFrame([(1, "INSERT INTO orders x; update Users set a; KafkaProducer p = send('order.events', \"order.events\", 'X'); ALTER TABLE orders"), (2, "schema"), (3, None), (4, "@app.route alembic")], "doc_id long, text string")
    got = {r.doc_id: r for r in codetext.impact(d).collect()}
    assert (got[1].topics, got[1].tables, got[1].level) == (["order.events"], ["orders", "Users"], "HIGH")
    assert (got[2].level, got[3].level, got[3].topics) == ("MEDIUM", "LOW", []) and got[4].api_contract and got[4].schema_migration
    a = spark.createDataFrame([(1, '```json\n{"summary": "s", "risk_level": "bad", "safe_to_prune": ["x"]}\n```'), (2, "none"), (3, "{broken"), (4, None)], "doc_id long, text string")
    assert [(r.doc_id, r.summary, r.risk_level, r.safe_to_prune, r.recommended_test_tags) for r in codetext.answers(a).collect()] == [(1, "s", "MEDIUM", ["x"], [])]


def test_selection_signals(spark):
    v = lambda *x: [float(y) for y in x] + [0.0] * 61
    old = spark.createDataFrame([("r", "a.py", "h1", v(1, 0, 0)), ("r", "b.py", "h2", v(0, 1, 0))], "repo string, file_path string, file_hash string, embedding array<double>")
    new = spark.createDataFrame([("r", "a.py", "h9", v(1, 1, 0)), ("r", "b.py", "h2", v(0, 1, 0)), ("r", "n.py", "h3", None)], "repo string, file_path string, file_hash string, embedding array<double>")
    c = selection.changes(new, old).withColumn("lines", F.lit(10))
    assert {(r.file_path, r.hash_changed, r.is_new, round(r.sim, 4)) for r in c.collect()} == {("a.py", True, False, 0.7071), ("b.py", False, False, 1.0), ("n.py", True, True, 0.0)}
    u = lambda rows: spark.createDataFrame(rows, "repo string, file_path string, u array<double>")
    pairs = selection.pairs(u([("r", "a.py", [1.0, 0.0])]), u([("r", "t1", [0.8, 0.6]), ("r", "t2", [0.6, 0.8]), ("s", "t3", [1.0, 0.0])]))
    assert [(r.src, r.test, r.sim) for r in pairs.collect()] == [("a.py", "t1", 0.8)]
    e = spark.createDataFrame([("r", "m.py", "a.py"), ("r", "a.py", "m.py")], "repo string, importer string, imported string")
    tm = spark.createDataFrame([("r", "m.py", "t2"), ("r", "a.py", "t4"), ("r", "x.py", "t5")], "repo string, module string, test string")
    ch = spark.createDataFrame([("r", "a.py")], "repo string, file_path string")
    dep = selection.dependency_tests(e, tm, ch, spark.createDataFrame([("r", "a.py")], "repo string, file_path string"))
    assert {(r.test, r.is_direct, r.is_transitive) for r in dep.collect()} == {("t2", 0, 1), ("t4", 1, 0), ("a.py", 1, 0)}
    rates = spark.createDataFrame([("t4", 0.5)], "stem string, failure_rate double")
    got = {r.test: r for r in selection.decide(selection.candidates(c, pairs, dep, rates)).collect()}
    assert set(got) == {"t1", "t2", "t4", "a.py"} and got["t4"].rule == "ALWAYS_RUN" and got["t1"].rule == "HIGH_SIMILARITY" and got["t1"].hash_delta and not got["t1"].is_proxy
    assert got["t2"].depth == 2 and got["t2"].is_proxy and got["t2"].max_sim == 1.0
    assert {r.rule for r in selection.decide(selection.candidates(c, pairs, dep, rates), force=True).collect()} == {"FORCE_RUN_ALL"}
    with pytest.raises(ValueError):
        scoring.valid_threshold(0)


def test_pluggable_embedder(spark):
    class Lengths:
        def embed(self, texts):
            return [[len(t), 1] for t in texts]

    d = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, t string")
    assert {r.id: r.embedding for r in similarity.embed(d, lambda: Lengths(), "id", "t").collect()} == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    assert similarity.embed(d.limit(0), lambda: Lengths(), "id", "t").count() == 0
    with pytest.raises(TypeError):
        similarity.entry_point(object())


def test_first_outcome_by_substring(spark):
    runs_ = spark.createDataFrame([("r1", ["tests/test_login.py", "x/ab.py", "nope_nothing.py", None]), ("r2", None)], "run_id string, selected_tests array<string>")
    rows = [(5, "suite.test_login_fast", 1, 0.5), (3, "zz.test_login", 0, 0.9), (9, "cab", 1, None), (1, None, 1, 1.0)]
    c = spark.createDataFrame(rows, "record_id long, test_name string, regression_detected int, pass_rate_pre double")
    assert {(r.test, r.record_id, r.regression, r.pass_rate) for r in models.first_outcomes(runs_, c).collect()} == {("tests/test_login.py", 3, 0, 0.9), ("x/ab.py", 9, 1, 1.0)}
    assert models.retrain(runs_, c) is None


def test_attach_with_small_and_large_sides(spark, monkeypatch):
    left = spark.createDataFrame([(i % 3, i) for i in range(90)] + [(None, 1)], "k int, v int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k int, w string")
    small = sorted(map(str, common.attach(left, right, "k").collect()))
    monkeypatch.setattr(common, "MOST_ROWS", 1)
    assert sorted(map(str, common.attach(left, right, "k").collect())) == small and len(small) == 91
    assert sorted(map(str, common.lookup(left, right, "k").collect())) == small
    assert common.attach(left, right.limit(0), "k", "inner").count() == 0
    ranks = common.ranked(left.filter("k IS NOT NULL"), "k", "v").collect()
    assert {(r.k, r.v): r["rank"] for r in ranks} == {(i % 3, i): i // 3 + 1 for i in range(90)}


def test_cut_starts_with_fresh_estimates(spark):
    d = spark.range(3)
    for _ in range(6):
        d = common.cut(d.join(d.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert d.count() == 3 and d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= 1 << 64


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(4)
    data = {"a": r.integers(0, 50, 1001).astype(float), "b": r.normal(size=10), "c": np.array([7.0])}
    d = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("d", None), (None, 2.0)], "k string, x double")
    got = {x.k: x.q for x in quantiles(d, ["k"], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, v in data.items():
        assert np.allclose(got[k], np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_delimited_source(spark, tmp_path):
    (tmp_path / "x.csv").write_text(" Test_Duration |build|test_name|test_result\n1.5|aabbccddee|t|PASSED\n1|2|3|4|5\n2|aabbccddee|u|FAILED\n")
    (tmp_path / "y.csv").write_text("build,test_name,test_result,test_duration\naabbccddee,v,skipped,\n")
    d = {(r.test_name, r.test_duration, r.test_result, len(r.reasons)) for r in files.delimited(spark, str(tmp_path)).collect()}
    assert d == {("t", 1.5, "PASSED", 0), ("u", 2.0, "FAILED", 0), ("v", None, "SKIPPED", 0), (None, None, None, 1)}


def test_source_tree_and_graph(spark, tmp_path):
    root = tmp_path / "build" / ".x"
    for q in ("src/a.py", "build/b.py", ".git/c.py", "src/d.txt", "z.py"):
        (root / q).parent.mkdir(parents=True, exist_ok=True)
        (root / q).write_text("x = 1")
    assert {r.file_path for r in files.source_tree(spark, str(root), ["py"]).collect()} == {"src/a.py", "z.py"}
    assert [r.file_path for r in files.source_tree(spark, str(root), ["py"], 1).collect()] == ["src/a.py"]
    (tmp_path / "g.json").write_text('{"a": ["b", "c"], "d": []}')
    assert {(r.importer, r.imported) for r in files.graph_json(spark, str(tmp_path / "g.json")).collect()} == {("a", "b"), ("a", "c")}
    (tmp_path / "s.json").write_text('{"module_graph": {"a": ["b"]}, "test_map": {"b": ["t1", "t2"]}, "test_files": []}')
    e, t = files.saved_graph(spark, str(tmp_path / "s.json"))
    assert {tuple(r) for r in e.collect()} == {("a", "b")} and {tuple(r) for r in t.collect()} == {("b", "t1"), ("b", "t2")}
    files.write_text(t.orderBy("test"), F.col("test"), str(tmp_path / "run"))
    assert {r.value for r in spark.read.text(str(tmp_path / "run")).collect()} == {"t1", "t2"}


def test_synthetic_telemetry(spark):
    t = synthetic.telemetry(synthetic.pull_requests(spark, 50))
    per = {r["count"] for r in t.filter("phase = 'pre'").groupBy("build").count().collect()}
    assert per <= set(range(3, 10)) and len(per) > 3
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, synthetic.telemetry(synthetic.pull_requests(spark, 50).repartition(7)).collect()))


def test_run_log_keeps_the_last_row(spark):
    t = dt.datetime(2025, 1, 1)
    log = spark.createDataFrame([("r1", t, 0.1, 1.0), ("r1", t + dt.timedelta(1), 0.2, 1.0), ("r2", t, None, None)], "run_id string, created_at timestamp, pruning_rate double, carbon_gco2 double")
    assert {(r.run_id, r.pruning_rate) for r in registry.runs_once(log).collect()} == {("r1", 0.2), ("r2", None)}


def test_model_is_judged_on_rows_held_out(spark, tmp_path):
    m = telemetry.training_matrix(table(spark, "/root/testdata/sf0.01", "combined_submit")).cache()
    s = models.stratified(m)
    per = {(r.label, r.held_out): r["count"] for r in s.groupBy("label", "held_out").count().collect()}
    assert all(abs(per[k, True] - 0.2 * (per[k, True] + per[k, False])) <= 1 for k in (0, 1))
    model, scored = models.evaluated(m, trees=5, depth=3)
    r = models.metrics(scored).first()
    rows = [(x.label, x.pf) for x in scored.collect()]
    won = [(p > q) + (p == q) / 2 for a, p in rows if a for b, q in rows if not b]
    assert r.n == len(rows) and abs(r.auc - sum(won) / len(won)) < 1e-9
    models.save(model, str(tmp_path / "m"))
    assert models.score(models.load(str(tmp_path / "m")), m).count() == m.count()
    imp = models.importance(model).collect()
    assert [x["rank"] for x in sorted(imp, key=lambda x: (-x.importance, x.feature))] == list(range(1, 17))
    cold = models.fit(models.prior(spark), trees=10, depth=3)
    assert models.metrics(models.score(cold, models.prior(spark))).first().auc > 0.95
    assert models.small_prior(spark).count() == 7


def test_content_vectors(spark):
    d = spark.createDataFrame([(1, "alpha beta alpha gamma"), (2, "alpha beta alpha gamma"), (3, "delta epsilon"), (4, None)], "file_id long, source_text string")
    v = {r.file_id: r.vector for r in models.content_vectors(d, 50, 4).collect()}
    assert v[1] == v[2] != v[3] and all(len(x) == 768 for x in v.values()) and not any(v[4])
    assert models.content_vectors(d.filter("file_id = 4")).count() == 1
