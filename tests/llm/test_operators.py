import ast
import collections
import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.common import table
from kelpie.llm import cutoff, encode, grammar, groups, lexers, mixing, neighbours, origin, pieces, productions, python_grammar, queries, repair, syntax, together
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES, queries.SQL, name)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).columns


# -- 1


def files(spark, texts):
    return spark.createDataFrame([(i, f"r{i % 2}", p, t, "lang", "pos") for i, (p, t) in enumerate(texts)], "file_id long, repo string, file_path string, source_text string, lang string, pos string")


GOOD = [
    ("a.py", ""), ("a.js", ""), ("a.go", "package a\n"), ("A.java", ""), ("a.py", "if x:\n    y\nelse:\n    z\n"), ("b.py", "s = '''\n<<<<<<< a\n'''\n"), ("a.txt", "(((("), ("n.py", None),
    ("a.js", "const f = async (x) => { const { a, b = 2, ...c } = x; return `t${a ? `u${b}` : ''}`; };\nlet r = /[/(]/g.test(s), q = a / b / c\nfor (const k of [1, , 2]) if (k) continue; else break\nlabel: while (1) { break label }\n"),
    ("b.mjs", 'import d, { e as g } from "x";\nexport default class A extends B { static #p = 1; get v() { return this.#p } async *it() { yield* x; } }\nexport const o = { a, "b": 1, [c]: 2, d() {}, get e() { return 1 }, ...f };\n'),
    ("A.java", 'package a.b;\nimport java.util.*;\n@Deprecated(since = "1")\npublic final class A<T extends Comparable<T>> extends B<T> implements C, D {\n  private static final int[] X = {1, 2,};\n  enum E { P(1) { int f() { return 1; } }, Q; }\n  <R> R m(final Map<String, List<? super T>> x, int... y) throws E {\n    for (int i = 0, j = 1; i < j; i++) { x.get("k").forEach(v -> v.f()); }\n    int[] a = new int[3]; String s = (String) (Object) a[0]; boolean b = a.length > 1 && s instanceof String t;\n    try (var r = open()) { } catch (A | B e) { throw e; } finally { }\n    switch (y[0]) { case 1: case 2: break; default: return null; }\n    Runnable q = B::new; var z = b ? 1 : -2; synchronized (this) { do { z >>>= 1; } while (z > 0); }\n    return (R) q;\n  }\n}\n'),
    ("b.go", 'package b\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype T struct {\n\tA, B int `json:"a"`\n\t*C\n}\n\nfunc (t *T) F(a, b int, c ...string) (r map[string][]int, err error) {\n\tif v, ok := t.m["k"]; ok && v > 1 {\n\t\treturn nil, nil\n\t} else if !ok {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tfor i, s := range []string{"a", "b"} {\n\t\tfmt.Println(i, s[1:2], T{A: 1}, x.(*T))\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\tdefault:\n\t}\n\tswitch y := z.(type) {\n\tcase int, string:\n\t\tdefer f(y...)\n\t}\n\treturn\n}\n'),
]
BAD = [
    ("a.go", ""), ("a.py", "def f(:\n    pass\n"), ("a.py", "if x\n    y\n"), ("a.py", "if x:\ny\n"), ("a.py", "x = 'a\n"), ("a.py", "<<<<<<< main\nx\n"), ("a.py", "else:\n    x\n"), ("a.py", "try:\n    x\ny\n"),
    ("a.py", "if x:\n\ty\n        z\n"), ("a.py", "x = 7c1\n"), ("a.py", "print 'x'\n"), ("a.py", "const x = 1;\n"),
    ("a.js", "function f( {\n}\n"), ("a.js", 'const s = "a;\n'), ("a.js", "=======\n"), ("a.js", "f(a b);\n"), ("a.js", "if (x) {\n"), ("a.js", "def f(x):\n    return x\n"), ("a.js", "x = `a${b`;\n"),
    ("A.java", "class A { int f() { return 1 } }"), ("A.java", "class A { int f( { return 1; } }"), ("A.java", "class A {"), ("A.java", "<html>"), ("A.java", "class A { }\n}"), ("A.java", 'class A { String s = "a" "b"; }'),
    ("a.go", "package a\nfunc f() {\n\tx := \n}\n"), ("a.go", "func f() {}\n"), ("a.go", "package a\nfunc f() { return }}\n"), ("a.go", "package a\nfunc f(a b c) {}\n"), ("a.go", "package a\nclass X:\n"),
]


def test_syntax_cases(spark):
    got = {r.file_id: r.reason for r in syntax.faults(files(spark, GOOD + BAD)).collect()}
    assert {i: got.get(i) for i in range(len(GOOD))} == {i: None for i in range(len(GOOD))}
    assert [t for i, t in enumerate(BAD) if len(GOOD) + i not in got] == []
    assert syntax.found(files(spark, [])).count() == 0 and syntax.report(files(spark, [])).count() == 0


def test_python_agrees_with_its_parser(spark, sf):
    f = table(spark, sf, "file_ast")
    got = {r.file_id for r in syntax.found(f).collect()}
    for r in f.filter("file_path LIKE '%.py'").collect():
        try:
            ast.parse(r.source_text)
            assert r.file_id not in got
        except SyntaxError:
            assert r.file_id in got


def test_deep_and_long_files(spark):
    deep, long = "(" * 5000 + ")" * 5000, "var a = [" + "1, " * 100_000 + "1];"
    got = {r.file_id for r in syntax.found(files(spark, [("a.js", f"x = {deep};"), ("b.js", long), ("c.py", f"x = {deep}"), ("d.py", "x = [" + "1, " * 100_000 + "]")])).collect()}
    assert 1 not in got and 3 not in got and 2 in got


def test_python_faults_inside_tokens_and_blocks(spark):
    bad = [
        'x = f"""{a b}"""\n', "x = '\\x1'\n", "x = b'\u00e9'\n", "case a:\n    pass\n", "match a:\n    case 1:\n        pass\n    x = 1\n", "match a:\n    case 1 + 2:\n        pass\n", "try:\n    a\nexcept A:\n    b\nexcept* B:\n    c\n",
        "if a:\n    b\nelse:\n    c\nfinally:\n    d\n", "@d\nx = 1\n", "f(a=1, b)\n", "def f(a=1, b): pass\n", "f() = 1\n", "x = f'{a!z}'\n", "(a, b): int\n", "del f()\n", "if a:\n    try:\n        b\nexcept A:\n    c\n", "x = 1 if 2\n", "for f() in x: pass\n", "\u201cx\u201d\n", "x = 'a' b'b'\n",
    ]
    good = [
        'x = f"""{a + b}"""\n', "x = '\\x11'\n", "match a:\n    case 1:\n        pass\n    case {'k': [x, *_], **r} if x: y\n    case A(b=C.d) | None as e:\n        pass\n", "x = " + "-" * 20_000 + "1\n", "match = case = type = 1\nmatch[0]: case = type(match)\n", "type X[T: int, *U, **P] = f'{x!r:>{w}}' 's'\n",
        "async def f(a, /, b=1, *, c, **d) -> x:\n    async with a as b, c: pass\n    return [x async for x in y if await z]\n", "x = f'{f'{1}'}' rf'\\{y}'\nprint(*a, b=1, *c, **d)\n", "try:\n    a\nexcept* A: b\nelse:\n    c\nfinally: d\n", "with (a as b, c as (d, *e),): pass\n", "lambda *a, b=1, **c: (yield)\n", "a = b[c, *d, ::2] = yield\n",
    ]
    assert {r.file_id for r in syntax.found(files(spark, [("a.py", t) for t in bad + good])).collect()} == set(range(len(bad)))


def test_permitted_pairs_come_from_the_rules():
    rules = grammar.parse("s: 'x' t* ['!' 'z'] | '(' s ')'\nt: 'y' | ',' s")
    assert grammar.pairs(rules, ["s"]) == {("x", "y"), ("x", ","), ("x", "!"), ("y", "y"), ("y", ","), ("y", "!"), ("!", "z"), ("(", "x"), ("(", "("), ("x", ")"), ("y", ")"), ("z", ")"), (")", ")"), (",", "x"), (",", "("), ("z", "y"), ("z", ","), ("z", "!"), (")", "y"), (")", ","), (")", "!")}
    r = grammar.Recogniser(rules)
    assert r.derives("s", "x y , ( x )".split()) and not r.derives("s", "x y ,".split()) and not r.derives("s", [])


def test_python_grammar_on_its_library():
    folder = os.path.dirname(os.__file__)
    names = sorted(n for n in os.listdir(folder) if n.endswith(".py"))
    for n in names:
        with open(os.path.join(folder, n), encoding="utf-8") as f:
            for _, line in lexers.python_lines(f.read()):
                toks = line.split(" ")
                assert python_grammar.is_line(toks) or python_grammar.is_case(toks), (n, line)
                assert set(zip(toks, toks[1:])) <= python_grammar.permitted(), (n, line)


# -- 2

TOK = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]")


@pytest.mark.parametrize(("limit", "overlap"), [(512, 32), (20, 4), (10, 0)])
def test_pieces_cover_the_text(spark, sf, limit, overlap):
    items = table(spark, sf, "embedding_result").withColumn("text", F.lit("clash"))
    texts = {r.item_id: r.snippet for r in items.collect()}
    by = collections.defaultdict(list)
    for r in pieces.split(items, limit, overlap).collect():
        by[r.item_id].append(r)
    assert set(by) == {k for k, t in texts.items() if len(TOK.findall(t or "")) > limit} == {r.item_id for r in pieces.oversized(items, limit, overlap).collect()}
    for k, rows in by.items():
        seen = []
        for i, r in enumerate(sorted(rows, key=lambda r: r.piece_no)):
            toks = TOK.findall(r.piece)
            assert texts[k][r.start : r.start + len(r.piece)] == r.piece and len(toks) == r.n_tokens <= limit
            if i:
                assert toks[:overlap] == seen[len(seen) - overlap :]
            seen += toks[overlap if i else 0 :]
        assert seen == TOK.findall(texts[k])


def test_pieces_edges(spark):
    t = [(1, None), (2, ""), (3, " \n"), (4, "x" * 100_000), (5, "é " * 600), (6, "a\n\n" * 400 + "b " * 400), (6, "a\n\n" * 400 + "b " * 400)]
    d = spark.createDataFrame(t, "item_id long, snippet string")
    rows = pieces.split(d).collect()
    assert {r.item_id for r in rows} == {5, 6} and all(r.n_tokens <= 512 for r in rows)
    assert pieces.split(d.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000)], "item_id long, snippet string")
    got = sorted((r.piece_no, r.start, len(r.piece)) for r in pieces.split(long, 60, 10).collect())
    assert len(got) >= 4000 and all(b[1] == a[1] + a[2] - 49 for a, b in zip(got, got[1:]))


# -- 3


def components_by_hand(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for rid, b, t in rows:
        for v, sep in ((b, "[/_]"), (t, "[./:#_-]")):
            if v is None or v.strip().lower() in groups.MISSING:
                continue
            w = tuple(x.strip() for x in re.split(sep, v.strip().lower()) if x.strip())
            if w:
                parent[find(rid)] = find((sep, w))
    best = {}
    for rid, *_ in rows:
        best[find(rid)] = min(best.get(find(rid), rid), rid)
    return {rid: best[find(rid)] for rid, *_ in rows}


def test_groups_equal_union_find(spark, sf):
    t = table(spark, sf, "combined_submit")
    want = components_by_hand([(r.record_id, r.build, r.test_name) for r in t.collect()])
    out = groups.splits(t).collect()
    assert {r.record_id: r.group_id for r in out} == want
    split = {}
    assert all(split.setdefault(r.group_id, r.split) == r.split for r in out)


def recs(spark, rows):
    return spark.createDataFrame([(*r, "b", 1) for r in rows], "record_id long, build string, test_name string, b string, label int")


def test_group_edges(spark):
    rows = [(1, "AA/bb", "t.x"), (2, "aa_BB/", None), (3, None, "T/X"), (4, None, None), (5, "n/a", "-"), (6, "zz", "NaN"), (6, "zz", "nan"), (7, "chain", "t1"), (8, "chain2", "t1"), (9, "chain2", "t2")]
    assert {r.record_id: r.group_id for r in groups.group(recs(spark, rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 7}
    assert groups.group(recs(spark, [])).count() == 0 and groups.splits(recs(spark, [])).count() == 0


def test_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r.label for r in groups.components(e).collect()} == {0}


def test_batches_keep_splits_and_quarantine_conflicts(spark, tmp_path):
    first = [(i, f"b{i}", f"t{i}") for i in range(40)]
    out, state = groups.assign(recs(spark, first))
    split = {r.record_id: r.split for r in out.collect()}
    by = collections.defaultdict(list)
    for k, v in split.items():
        by[v].append(k)
    assert len(by["train"]) == 32 and len(by["validation"]) == len(by["test"]) == 4
    a, b, c = by["train"][0], by["train"][1], by["test"][0]
    second = [(100, f"b{a}", f"t{b}"), (101, f"b{b}", f"t{c}"), (102, "new", "new")]
    out2, state2 = groups.assign(recs(spark, second[:1] + second[2:]), state)
    s2 = {r.record_id: r.split for r in out2.collect()}
    assert s2[100] == "train" and s2[102] in by
    out3, state3 = groups.assign(recs(spark, second[1:2]), state2)
    assert [r.split for r in out3.collect()] == ["quarantine"]
    assert {(r.key, r.split) for r in state3.collect()} == {(r.key, r.split) for r in state2.collect()}
    p = str(tmp_path / "state")
    groups.update(recs(spark, first), p)
    again = {r.record_id: r.split for r in groups.update(recs(spark, first), p).collect()}
    assert again == split


def test_two_batches_of_a_table(spark, sf):
    t = table(spark, sf, "combined_submit")
    rows = groups.batched(t).collect()
    assert len(rows) == t.count() == len({r.record_id for r in rows})
    by = collections.defaultdict(set)
    for r in rows:
        if r.split != "quarantine":
            by[r.group_id].add(r.split)
    assert all(len(v) == 1 for v in by.values())
    first = {r.record_id for r in rows if r.batch == 1}
    want = components_by_hand([(r.record_id, r.build, r.test_name) for r in t.collect() if r.record_id in first])
    assert {r.record_id: r.group_id for r in rows if r.batch == 1} == want
    # a later record that only meets one stored group joins it
    whole = components_by_hand([(r.record_id, r.build, r.test_name) for r in t.collect()])
    roots = collections.defaultdict(set)
    for k in first:
        roots[whole[k]].add(want[k])
    for r in rows:
        if r.batch == 2 and len(roots[whole[r.record_id]]) == 1:
            assert r.group_id in roots[whole[r.record_id]] and r.split in by[r.group_id]


# -- 4


def test_repair_finds_repeats():
    seqs = [[1, 2, 3, 4] * 20, list(range(50)), [7] * 64, []]
    fid = np.repeat(np.arange(4), [len(s) for s in seqs])
    owner, uses, span, _, final = repair.infer(fid, repair.dense(fid, np.array(sum(seqs, []))), 4)
    assert max(u * s for o, u, s in zip(owner, uses, span) if o == 0 and s >= 4) == 80
    wide = np.arange(1 << 21) % (3 << 19)  # more symbols than fit in twenty bits
    o, u, w, _, f = repair.infer(np.zeros(len(wide), np.int64), wide, 1)
    assert f[0] == (3 << 19) - (1 << 19) + 2 and w.max() == 1 << 19
    assert final[1] == 50 and final[0] <= 10 and final[2] <= 4 and final[3] == 0


def test_origin_kinds(spark):
    rows = "".join(f'    "k{i}": [{i}, "v"],\n' for i in range(60))
    acc = "".join(f"def get_f{i}(m):\n    return m._fields[{i}]\n\n" for i in range(40))
    hand = "import os\n\n" + "\n\n".join(f"def {w}(a, b):\n    for x in a:\n        if x {o} b:\n            yield x {p} {i}" for i, (w, o, p) in enumerate(itertools.product(("load", "save"), (">", "in"), ("+", "*"))))
    r = np.random.default_rng(3)
    forms = ["{} = {}({}, {})", "if {} not in {}:", "    {}.append([{}[{}] for k in {}])", "for {}, {} in {}.items():", "    yield {} % ({} - {})", "assert {} is not {}, {}", "while {}:", "    del {}[{}:{}]", "with {} as {}:", "    return lambda {}: {} or {}", "{} @= ~{}", "raise {}({!r})"]
    names = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    lib = "\n".join(forms[k].format(*r.choice(names, 4)) for k in r.integers(0, len(forms), 70))
    t = [(1, "a", "x.py", "R = {\n" + rows + "}\n"), (2, "a", "gen.py", acc), (3, "a", "generated_by_hand.py", hand), (4, "b", "v.py", lib), (5, "c", "w.py", lib.replace("epsilon", "patched", 1)), (6, "a", "e.py", ""), (7, "a", "n.py", None), (8, "b", "own.py", "x = 1")]
    f = spark.createDataFrame([(*r, "dup") for r in t], "file_id long, repo string, file_path string, source_text string, module_id string")
    m = spark.createDataFrame([(i, "r") for i in [1, 2, 3, 4, 5, 6, 7, 8, 8, 99]] + [(None, "r")], "module_id long, file_id string")
    got = {r.module_id: r.kind for r in origin.judge(m, f).collect()}
    assert got.pop(1) in ("data", "generated")
    assert got == {2: "generated", 3: "hand", 4: "vendored", 5: "vendored", 6: "hand", 7: "hand", 8: "hand"}
    assert origin.not_by_hand(m.limit(0), f).count() == 0 and origin.not_by_hand(m, f.limit(0)).count() == 0


def test_attributions_need_several_repositories(spark):
    body = "\n".join(f"def {w}(a):\n    return a.{w[::-1]} {o} {i}" for i, (w, o) in enumerate(itertools.product(("load", "save", "scan", "trim"), ("+", "*"))))
    other = body.replace("load", "left").replace("save", "keep").replace("trim", "snip").replace("return a", "yield b")
    long = ("# " + "licence" * 20 + "\n") * 5
    t = [("r/own", "# Copyright 2021 the Mine project\n" + body), ("r/gen", 'HEAD = "Copyright 2021 the Far project"\n' + body.replace("a", "q")), ("r/x", long + "# Copyright 2021\n# the Far project\n" + other), ("r/y", "# Copyright 2020 the Far project\n" + other.replace("b", "z").replace("def", "async def")), ("r/far", "# Copyright 2020 the Far project\n" + body.replace("return", "raise"))]
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(t)], "file_id long, repo string, source_text string")
    got = {r.module_id: r.kind for r in origin.judge(f.select(F.col("file_id").alias("module_id")), f).collect()}
    assert got == {0: "hand", 1: "hand", 2: "vendored", 3: "vendored", 4: "hand"}


# -- 5


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.lexsort((ids, -s[i]))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_recall_with_many_shards(spark, monkeypatch):
    r = np.random.default_rng(5)
    centres = r.normal(size=(300, 64))
    x = np.concatenate([c + r.normal(scale=0.25, size=(int(n), 64)) for c, n in zip(centres, r.integers(1, 25, 300))])
    ids = np.arange(len(x)) * 3 + 1
    v = spark.createDataFrame([(int(i), [float(y) for y in row]) for i, row in zip(ids, x)], "id long, v array<double>")
    want = brute(ids, x, 10, 0.85)
    for cells in (neighbours.MAX_CELLS, 8):  # one level of cells, and two
        monkeypatch.setattr(neighbours, "MAX_CELLS", cells)
        got = {(min(r.id, r.other), max(r.id, r.other)) for r in neighbours.nearest(v, 10, shard=256).filter("cosine >= 0.85").collect()}
        assert len(got & want) >= 0.97 * len(want)


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] + [0.0] * 63
    two = [0.9, 0.1] + [0.0] * 62
    rows = [(1, one), (2, one), (3, two), (4, [0.0] * 64), (5, None), (6, [nan] + [1.0] * 63), (7, [1.0] * 32), (8, [inf] + [1.0] * 63), (3, two), (None, one), (9, [None] + [1.0] * 63), (10, [-1.0] + [0.0] * 63)]
    d = spark.createDataFrame([(*r, None, 5) for r in rows], "module_id long, embedding array<float>, updated_at timestamp, v int")
    assert {(r.module_id, r.neighbor_id) for r in neighbours.similar_pairs(d).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert neighbours.similar_pairs(d.limit(0)).count() == 0 and neighbours.similar_pairs(d.filter("module_id = 1")).count() == 0
    same_ = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "id long, v array<double>")
    per = collections.Counter(r.id for r in neighbours.nearest(same_, 10).collect())
    assert set(per.values()) == {10} and len(per) == 50


# -- 6


def logs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "run_id string, changed_files array<string>, selected_tests array<string>, item string, n int")


def test_pairs_against_counting(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(f"r{i % 90}", [f"f{k}" for k in r.integers(0, 30, 6)], [f"t{k}" for k in r.integers(0, 9, 3)] if i % 4 else None) for i in range(120)]
    rows += [("big", [f"b{i}" for i in range(700)], None), ("none", None, None), (None, ["f1", "f2"], None), ("odd", [" ./f1 ", ".\\f2", "", None, "f1"], [])]
    held = collections.defaultdict(set)
    for run, a, b in rows:
        if run is not None:
            held[run] |= {y for x in (a or []) + (b or []) if x is not None and (y := re.sub(r"^(\./+)+", "", x.strip().replace("\\", "/")).strip())}
    two = collections.Counter(p for s in held.values() for p in itertools.combinations(sorted(s), 2))
    one = collections.Counter(x for s in held.values() for x in s)
    got = together.pairs(logs(spark, rows)).collect()
    assert {(x.item_a, x.item_b): (x.n, x.n_a, x.n_b, x.n_runs) for x in got} == {p: (n, one[p[0]], one[p[1]], len(held)) for p, n in two.items()}
    some = {(x.item_a, x.item_b) for x in together.pairs(logs(spark, rows), 3, 1.2).collect()}
    assert some == {p for p, n in two.items() if n >= 3 and n * len(held) >= 1.2 * one[p[0]] * one[p[1]]}
    assert together.pairs(logs(spark, [])).count() == 0


# -- 8


def test_encoding_in_chunks_and_back(spark, sf):
    enc = encode.codec(encode.TOKENIZERS, "byte_bpe_50k")
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    texts |= {-1: "a" * 5000, -2: " \n" * 3000, -3: "<|endoftext|>" * 60, -4: "日本語 " * 900, -5: "😀" * 700, -6: "x1 " * 2000, -7: None, -8: ""}
    d = spark.createDataFrame([(k, v, [1]) for k, v in texts.items()], "doc_id long, text string, ids array<int>")
    for chunk, overlap in ((16384, 1024), (300, 60), (64, 16)):
        e = encode.encode(d, chunk=chunk, overlap=overlap)
        assert {r.doc_id: r.ids for r in e.collect()} == {k: enc.encode_ordinary(v) if v else [] for k, v in texts.items()}
    assert {r.doc_id: r.text for r in encode.decode(e).collect()} == {k: v or "" for k, v in texts.items()}
    twice = spark.createDataFrame([(None, "a b " * 200), (None, "a b " * 200), (1, None)], "doc_id long, text string")
    assert [len(r.ids) for r in encode.encode(twice, chunk=100, overlap=20).orderBy("doc_id").collect()].count(0) == 1
    assert encode.encode(d.limit(0)).count() == 0


# -- 9


def test_mix_meets_shares_and_caps(spark, sf):
    d, t = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, sf, "mix_targets")
    for r in mixing.report(d, t).collect():
        assert abs(r.reached_share - r.target_share) < 0.02
    cap = {r.source: r.max_repeats for r in t.collect()}
    drawn = mixing.mix(d, t).collect()
    assert all(1 <= r.repeats <= cap[r.source] for r in drawn)
    texts = {r.doc_id: r.text for r in d.collect()}
    assert len({texts[r.doc_id] for r in drawn}) == len(drawn)


def test_mix_edges(spark):
    s = "doc_id long, text string, source string, rate int"
    d = spark.createDataFrame([(i, f"word{i} alpha beta", "A " if i % 2 else "b", 1) for i in range(40)] + [(90, None, "a", 1), (91, "", "a", 1), (92, "alpha beta", None, 1), (None, "x", "a", 1), (93, "same", "b", 1), (94, "same", "b", 1)], s)
    t = spark.createDataFrame([("a", 0.5, 1), ("B", 0.5, 2), ("c", 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn = {r.doc_id: r.repeats for r in mixing.mix(d, t).collect()}
    assert not {90, 91, 94, None} & set(drawn) and drawn
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


def test_mix_without_texts_of_a_source_and_without_labels(spark):
    s = "doc_id long, text string, source string"
    words = {"a": "red green blue", "b": "one two three", "c": "north south east"}
    d = spark.createDataFrame([(i, f"{words['abc'[i % 3]]} {i}", "abc"[i % 3]) for i in range(60)] + [(100 + i, "green two south", None) for i in range(1)] + [(200 + i, f"unknown{i}", "?") for i in range(30)], s)
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.3, 1), ("z", 0.1, 1)], "source string, target_share double, max_repeats int")
    rep = {r.source: r for r in mixing.report(d, t).collect()}
    assert rep["z"].reached_share == 0 and all(rep[k].n_tokens > 0 and rep[k].most_repeats == 1 for k in "abc")
    drawn = {r.doc_id for r in mixing.mix(d, t).collect()}
    assert any(k >= 200 for k in drawn)  # a text without a label can be drawn even where each share of it is below one
    near = {r.doc_id: r for r in mixing.likeliest(d, t).collect()}
    assert all(near[i].likeliest == "abc"[i % 3] for i in range(60)) and set(near) == {r.doc_id for r in d.collect()}
    member = mixing.posteriors(d.filter("source IN ('a', 'b', 'c')"), d.filter("source = '?'"), ["a", "b", "c", "z"]).collect()
    assert all(abs(sum(r.member) - 1) < 1e-12 and all(abs(x * 100 - round(x * 100)) < 1e-9 for x in r.member) for r in member)
    with pytest.raises(ValueError):
        mixing.mix(d, spark.range(1001).select(F.col("id").cast("string").alias("source"), F.lit(0.001).alias("target_share"), F.lit(1).alias("max_repeats")))


# -- 10


def test_cut_texts(spark):
    whole = [f"The gate kept {i} of the {w} tests. We skip the {w} suite when nothing changes." for i in range(12) for w in ("north", "south", "east", "west", "middle")]
    t = [(i, x, "body") for i, x in enumerate(whole)]
    t += [(900, "The gate kept 7 of the north tests. We skip the sou", "body"), (901, "The gate kept 3 of the east tests. We skip the", "BODY "), (902, whole[0][:40] + "…", "body"), (903, None, "body"), (904, "", "body"), (905, " \n ", "body"), (906, whole[1] + "\n```\nx = 1", "body"), (907, whole[2] + "\n\n```\nx\n```", "body"), (908, whole[3] + " 🚀", "body"), (909, whole[4] + "\n| a | b |", None), (None, "cut of", "body"), (910, whole[5], "body"), (910, whole[5], "body")]
    d = spark.createDataFrame([(*r, "x") for r in t], "doc_id long, text string, source string, kind string")
    assert {r.doc_id for r in cutoff.found(d).collect()} == {900, 901, 902, 906}
    assert cutoff.found(d.limit(0)).count() == 0 and cutoff.report(d.limit(0)).count() == 0
    rep = {r.source: r.n_cut for r in cutoff.report(d).collect()}
    assert rep == {"body": 4, "": 0}


def test_long_words_and_lines(spark):
    word = "extraordinarilylongidentifierofonemodule"
    whole = [f"The gate kept {i} of the {word} tests. We skip the rest." for i in range(30)]
    long = " ".join(["Step"] * 60)
    t = whole + [f"The gate kept 7 of the {word[:36]}", f"The gate kept 7 of the {word[:12]}"]
    d = spark.createDataFrame([(i, x, "body") for i, x in enumerate(t)], "doc_id long, text string, source string")
    assert {r.doc_id: r.reason for r in cutoff.inspect(d).filter("reason IS NOT NULL").collect()} == {30: "ends inside a word", 31: "ends inside a word"}
    assert cutoff.shape(long + " a") != cutoff.shape(long + " 1") and len(cutoff.shape(long)) < 200


def test_limits_are_found(spark):
    r = np.random.default_rng(2)
    t = [("x" * int(n)) for n in r.integers(10, 900, 300)] + ["é" * 250] * 9 + ["y" * 500] * 9
    d = spark.createDataFrame([(i, x, "s") for i, x in enumerate(t)], "doc_id long, text string, source string")
    assert ("bytes", 500, 18) in {(r.measure, r.length, r.n) for r in cutoff.limits(d).collect()}


def test_copies_of_a_cut_text_are_no_evidence(spark):
    whole = [f"The gate kept {i} of the {w} tests. We skip the {w} suite when nothing changes." for i in range(12) for w in ("north", "south", "east", "west", "middle")]
    t = [(i, x, "body") for i, x in enumerate(whole)]
    cuts = ["Zebra runs are slow. We skip the", "Yaks run {} of the tests. We kept …", "Xenon lamps of the suite. We skip when the"]
    t += [(900 + 10 * k + i, x + " " * (i % 2), ("body", "title")[k == 2 and i % 2]) for k, x in enumerate(cuts) for i in range(8)]
    d = spark.createDataFrame(t, "doc_id long, text string, source string")
    assert {r.doc_id for r in cutoff.found(d).collect()} == {900 + 10 * k + i for k in range(3) for i in range(8)}
    hot = spark.createDataFrame([(i, "One text that is stored again and again.", "s") for i in range(50)] + [(100 + i, "y" * (20 + i) + ".", "s") for i in range(9)], "doc_id long, text string, source string")
    assert cutoff.inspect(hot).filter("at_limit").count() == 0
