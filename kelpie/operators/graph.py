"""Dependency graphs as edge tables (importer, imported): closures, test selection, explanations, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import cut, in_ranges, lookup


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("imported").alias("importer"), F.col("importer").alias("imported"))


def closure(edges: DataFrame, seeds: DataFrame, depth: int | None = 5) -> DataFrame:
    """(seed, node, depth): what imports each seed, directly or through others, within ``depth`` steps; the seed at 0.

    Breadth first: each level joins the frontier to the edges and drops what the seed has reached before, so cycles
    and diamonds cost nothing and each level's state is at most the answer. ``depth`` None goes on until nothing is new.
    """
    seen = cut(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0)))
    frontier, d = seen, 0
    step = edges.select(F.col("imported").alias("node"), F.col("importer").alias("next")).distinct()
    while depth is None or d < depth:
        d += 1
        reached = frontier.join(step, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def upstream(edges: DataFrame, seeds: DataFrame, depth: int | None = 5) -> DataFrame:
    """(node, depth) reached from any seed: one search for all seeds at once. The edges of a hub are spread over several tasks."""
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, d = seen, 0
    step = edges.select(F.col("imported").alias("node"), F.col("importer").alias("next")).distinct()
    while depth is None or d < depth:
        d += 1
        reached = lookup(step, frontier.select("node"), "node", "inner").select(F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def forward_depth(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, depth): the number of steps to the farthest node a seed imports, uncapped."""
    return closure(reverse(edges), seeds, None).groupBy("seed").agg(F.max("depth").alias("depth"))


def select_tests(edges: DataFrame, test_map: DataFrame, changed: DataFrame, depth: int = 5) -> DataFrame:
    """(test, is_direct, is_transitive, depth) of tests mapped to changed modules or to modules that import them."""
    up = upstream(edges, changed, depth)
    hit = test_map.select(F.col("module").alias("node"), "test").join(up, "node")
    return hit.groupBy("test").agg(F.max((F.col("depth") == 0).cast("int")).alias("is_direct"), F.max((F.col("depth") > 0).cast("int")).alias("is_transitive"), F.min("depth").alias("depth"))


def explain(edges: DataFrame, test_map: DataFrame, changed: DataFrame, depth: int = 5, most: int = 3) -> DataFrame:
    """(test, reason): direct, or the first ``most`` modules through which a test is reached."""
    up = upstream(edges, changed, depth)
    hit = test_map.select(F.col("module").alias("node"), "test").join(up, "node")
    via = F.slice(F.sort_array(F.collect_set(F.when(F.col("depth") > 0, F.col("node")))), 1, most)
    g = hit.groupBy("test").agg(F.min("depth").alias("d"), via.alias("via"))
    return g.select("test", F.when(F.col("d") == 0, "direct").otherwise(F.concat(F.lit("via "), F.array_join(F.transform("via", lambda x: x.cast("string")), ", "))).alias("reason"))


def bipartite(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(src, tests): the tests at or above the threshold of every source, sources without any included."""
    return pairs.groupBy("src").agg(F.sort_array(F.collect_set(F.when(F.col("sim") >= threshold, F.col("test")))).alias("tests"))


def test_weights(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Sum of similarities at or above the threshold of each test, and its share of the largest."""
    w = pairs.filter(F.col("sim") >= threshold).groupBy("test").agg(F.sum("sim").alias("weight"))
    top = w.agg(F.max("weight").alias("top"))
    return w.crossJoin(F.broadcast(top)).select("test", "weight", (F.col("weight") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))).alias("pf"))


def ranked_weights(pairs: DataFrame, threshold: float = 0.5, dirty: bool = False) -> DataFrame:
    """``test_weights`` with the probability raised by 0.1 on a dirty grid, largest weight first; ties by name."""
    w = test_weights(pairs, threshold)
    pf = F.least(F.col("pf") + 0.1, F.lit(1.0)) if dirty else F.col("pf")
    key = F.struct((-F.round("weight", 9)).alias("w"), "test")
    r = in_ranges(w.withColumn("pf", pf).withColumn("__k", key), "__k")
    sizes = r.groupBy("__p").agg(F.count("*").alias("n"))
    base = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("b"))  # a row per range
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__k")) + F.col("b")
    return r.join(F.broadcast(base), "__p").select("test", "weight", "pf", rank.alias("rank"))


def merge_edges(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """``edges`` (src, test) and those of ``proposed`` whose src is known, each once; nothing is taken away."""
    known = proposed.join(edges.select("src").distinct(), "src", "left_semi").select("src", "test")
    return edges.select("src", "test").union(known).distinct()


def expand_calls(calls: DataFrame, tests: DataFrame, depth: int = 3) -> DataFrame:
    """(function, seed, depth): callers within ``depth`` steps; each inherits from the smallest seed that first reached it."""
    seen = cut(tests.select(F.col("function"), F.col("function").alias("seed")).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        up = lookup(calls.select(F.col("callee").alias("function"), "caller"), frontier.select("function", "seed"), "function", "inner").groupBy("caller").agg(F.min("seed").alias("seed"))
        frontier = cut(up.select(F.col("caller").alias("function"), "seed", F.lit(d).alias("depth")).join(seen.select("function"), "function", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def _core(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges without those at nodes that lack an edge in or one out, which no cycle holds; a few rounds peel most of them."""
    for _ in range(rounds):
        inside = edges.select(F.col("a").alias("n")).intersect(edges.select(F.col("b").alias("n")))
        edges = edges.join(inside.select(F.col("n").alias("a")), "a", "left_semi").join(inside.select(F.col("n").alias("b")), "b", "left_semi").select("a", "b")
    return cut(edges)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two or more nodes, named by their smallest node, and self loops.

    Forward and backward minima are spread along the edges until they settle; nodes whose two minima agree reach each
    other and form a component, and the edges between unlike minima are dropped before the next round. State is one row
    per node, of whatever length the cycles are.
    """
    e = edges.select(F.col("importer").alias("a"), F.col("imported").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    loops = e.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    e = cut(e.filter("a <> b"))
    done = loops.limit(0)
    while True:
        e = _core(e)
        if e.isEmpty():
            break
        f, g = _spread(e, "a", "b"), _spread(e, "b", "a")
        both = cut(f.withColumnRenamed("least", "f").join(g.withColumnRenamed("least", "g"), "node"))
        done = cut(done.union(both.filter("f = g").select("node", F.col("f").alias("component"))))
        left = both.filter("f <> g")
        x, y = (left.select(F.col("node").alias(c), F.col("f").alias(f"f{c}"), F.col("g").alias(f"g{c}")) for c in "ab")
        e = cut(e.join(x, "a").join(y, "b").filter("fa = fb AND ga = gb").select("a", "b"))
    many = done.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    done = done.join(many, "component", "left_semi").select("node", "component")
    return done.union(loops.join(done, "node", "left_anti"))


def _spread(e: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, least): the smallest node from which each node is reached along the edges, itself included.

    A round passes minima on along the edges and then follows the pointer of every minimum, which doubles its reach.
    """
    low = cut(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("least", F.col("node")))
    while True:
        passed = e.join(low.withColumnRenamed("node", src), src).groupBy(F.col(dst).alias("node")).agg(F.min("least").alias("m"))
        new = low.join(passed, "node", "left").select("node", "least", F.least("least", "m").alias("now"))
        far = new.select(F.col("node").alias("now"), F.col("now").alias("further"))
        new = cut(lookup(new, far, "now").select("node", F.least("now", "further").alias("now"), (F.least("now", "further") < F.col("least")).alias("moved")))
        low = new.select("node", F.col("now").alias("least"))
        if new.filter("moved").isEmpty():
            return low


def cycles(edges: DataFrame) -> DataFrame:
    """(component, cycle): one cycle, of any length, through the smallest node of each strongly connected component.

    Cycles are arrays that begin with the component's smallest node and are shortest through it; of equally short ones the
    way back over smaller nodes is taken. A search from that node inside the component gives every node one parent, all
    components at once.
    """
    c = cut(strong_components(edges))
    e = edges.select(F.col("importer").alias("a"), F.col("imported").alias("b")).distinct()
    node = lambda n: c.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    e = cut(e.join(node("a"), "a").join(node("b"), "b").filter("ca = cb").select("a", "b", F.col("ca").alias("component")))
    seen = cut(c.filter("node = component").select("component", "node", F.lit(None).cast(c.schema["node"].dataType).alias("parent"), F.lit(0).alias("depth")))
    frontier, d = seen, 0
    while True:
        d += 1
        step = frontier.select(F.col("node").alias("a")).join(e, "a").groupBy("component", F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").select("component", "node", "parent", F.lit(d).alias("depth")))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    back = e.filter("b = component").select("component", F.col("a").alias("node")).join(seen.select("node", "depth"), "node")
    walk = back.groupBy("component").agg(F.min(F.struct("depth", "node")).alias("m")).select("component", F.col("m.node").alias("at"), F.array("m.node").alias("cycle"))
    done = []
    walk = cut(walk)
    while True:
        done.append(walk.filter("at = component").select("component", "cycle"))
        walk = walk.filter("at <> component").join(seen.select(F.col("node").alias("at"), "parent"), "at")
        walk = cut(walk.select("component", F.col("parent").alias("at"), F.concat(F.array("parent"), "cycle").alias("cycle")))
        if walk.isEmpty():
            break
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("importer").alias("node")).agg(F.countDistinct("imported").alias("n_imports"))
    into = edges.groupBy(F.col("imported").alias("node")).agg(F.countDistinct("importer").alias("n_importers"))
    return out.join(into, "node", "full").fillna(0, ["n_imports", "n_importers"])
