"""Splits that keep related records together.

Records that share a key (here a build or a test) form groups; a group is never divided between splits. Groups are
connected components: builds are nodes, named by their smallest record, and every test links the builds it occurs with to
the smallest of them, never all pairs. Rounds of hooking and pointer jumping contract the links. The result is a component
table with one row per key, which is kept between batches, so that later batches only touch the components they reach:

* a component that is already in the table keeps its split,
* a new component goes to the split with the largest deficit,
* a batch that joins components of different splits is a conflicting merge: its new records are quarantined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import attach, blanks, cut, lookup

# Spellings that stand for a missing build or test, in lower case.
MISSING = ["", "-", "--", ".", "?", "n/a", "#n/a", "n.a.", "na", "nan", "nil", "none", "null", "missing", "undefined", "unknown", "(null)", "<null>", "(none)", "<na>", "tbd"]
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
_LARGE = 1000  # components above 1/_LARGE of all records are placed one by one: at most _LARGE of them exist
_BUCKETS = 1024


def _key(c: str, separators: str) -> Column:
    v = F.lower(blanks(F.col(c)))
    words = F.filter(F.transform(F.split(v, separators), blanks), lambda x: x != "")
    return F.when(v.isin(MISSING) | (F.size(words) == 0), None).otherwise(F.array_join(words, "/"))


def build_key(c: str) -> Column:
    """Hash segments in order, in lower case, joined by one slash; null where the build is missing."""
    return _key(c, "[/_]")


def test_key(c: str) -> Column:
    """Words in order, in lower case, joined by one slash; null where the test is missing."""
    return _key(c, "[./:#_-]")


def _pointers(edges: DataFrame) -> DataFrame:
    """(u, p): every node that is not the smallest of its component, with the smallest.

    Each round points every node at its smallest neighbour, jumps pointers until each reaches a root, and contracts
    the edges to the roots, which at least halves the nodes of every unfinished component. A round's pointers are written
    once and followed once more at the end, last round first, so the work of all rounds is that of a geometric series.
    """
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    follow = lambda df, c, to: attach(df, to.select(F.col("u").alias(c), F.col("p").alias("__p")), c, written=True)
    while not e.isEmpty():
        point = cut(e.groupBy("u").agg(F.min("v").alias("p")))
        while True:  # doubles the reach of every pointer, so a chain of n nodes takes log2(n) jumps
            # the distinct targets that point on; a target of many pointers is looked up once
            on = cut(point.select("p").distinct().join(point.select(F.col("u").alias("p"), F.col("p").alias("further")), "p"))
            if on.isEmpty():
                break
            point = cut(attach(point, on, "p", written=True).select("u", F.coalesce("further", "p").alias("p")))
        rounds.append(point)
        e = follow(e, "u", point).select(F.coalesce("__p", "u").alias("u"), "v")
        e = follow(e, "v", point).select("u", F.coalesce("__p", "v").alias("v")).filter("u <> v")
        e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if not rounds:
        return e.select("u", F.col("v").alias("p"))
    out = rounds.pop()
    while rounds:
        out = cut(follow(rounds.pop(), "p", out).select("u", F.coalesce("__p", "p").alias("p")).union(out))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node connected to each node of ``edges`` (u, v, both bigint, self edges allowed).

    Minima are pre-aggregated before the shuffle and pointer lookups are salted, so a node that touches a third of all
    edges is no bottleneck. An empty table gives an empty table.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    to = _pointers(edges).select(F.col("u").alias("node"), "p")
    return lookup(nodes, to, "node").select("node", F.coalesce("p", "node").alias("label"))


def keyed(records: DataFrame) -> DataFrame:
    """record_id, b, t: the keys of every record that has an id."""
    return records.filter("record_id IS NOT NULL").select(F.col("record_id").cast("long").alias("record_id"), build_key("build").alias("b"), test_key("test_name").alias("t"))


def key_table(records: DataFrame) -> DataFrame:
    """(key, group_id): the component table of ``records``, one row per key, with the smallest record of its component.

    Builds are keyed "b:...", tests "t:...", and a record without either "r:<record_id>".
    """
    r = keyed(records)
    builds = r.filter("b IS NOT NULL").groupBy("b").agg(F.min("record_id").alias("u"))
    at = lookup(r.filter("t IS NOT NULL"), builds, "b").groupBy("t", "u").agg(F.min(F.coalesce("u", "record_id")).alias("node"))
    at = cut(at.select("t", F.col("node").alias("u")))
    tests = at.groupBy("t").agg(F.min("u").alias("v"))
    to = _pointers(lookup(at, tests, "t", "inner").select("u", "v"))
    lone = r.filter("b IS NULL AND t IS NULL").select(F.concat(F.lit("r:"), "record_id").alias("key"), F.col("record_id").alias("u")).distinct()
    keys = builds.select(F.concat(F.lit("b:"), "b").alias("key"), "u").union(tests.select(F.concat(F.lit("t:"), "t"), "v")).union(lone)
    return cut(attach(keys, to, "u", written=True).select("key", F.coalesce("p", "u").alias("group_id")))


def _grouped(records: DataFrame, keys: DataFrame) -> DataFrame:
    """record_id, group_id of every record, by any of its keys: they all lie in one component."""
    key = F.coalesce(F.concat(F.lit("b:"), "b"), F.concat(F.lit("t:"), "t"), F.concat(F.lit("r:"), "record_id"))
    return lookup(keyed(records).select("record_id", key.alias("key")), keys, "key", "inner").select("record_id", "group_id")


def group(records: DataFrame) -> DataFrame:
    """record_id, group_id (the smallest record_id of the group) for every row of ``records``.

    Reads record_id (bigint), build and test_name. A missing key links nothing; a record without any key is its own
    group; repeated records meet in one group; rows with a null record_id are left out as they cannot be named.
    """
    return _grouped(records, key_table(records))


def place(sizes: DataFrame, held: dict[str, int], splits=SPLITS) -> DataFrame:
    """(group_id, split) for new groups of (group_id, n), filling the deficits left by the records ``held`` per split.

    Groups with more than 1/1000 of the records, of which there are at most a thousand, are placed largest first, each
    into the split with the largest deficit. The others follow in the order of their hash and fill the rest by running
    totals, taken in two levels (bounded hash buckets, then inside each bucket), so that no task sees all groups.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("n")).first()[0] or 0
    goal = {s: share * (total + sum(held.values())) - held.get(s, 0) for s, share in splits}
    large = sizes.filter(F.col("n") * _LARGE > total).orderBy(F.desc("n"), "group_id").collect()
    chosen = []
    for g in large:
        s = max(goal, key=lambda k: (goal[k], -list(goal).index(k)))
        goal[s] -= g.n
        chosen.append((g.group_id, s))
    big = spark.createDataFrame(chosen, "group_id long, split string")
    small = sizes.filter(F.col("n") * _LARGE <= total).withColumn("h", F.xxhash64("group_id")).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)))
    before = small.groupBy("bucket").agg(F.sum("n").alias("m")).select("bucket", (F.sum("m").over(Window.orderBy("bucket")) - F.col("m")).alias("base"))
    run = F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "group_id")) + F.col("base")
    room = {s: max(0.0, g) for s, g in goal.items()}
    scale = (total - sum(g.n for g in large)) / (sum(room.values()) or 1.0)
    pick, upto = F.lit(splits[0][0]), 0.0
    bounds = []
    for s, _ in splits:
        upto += room[s] * scale
        bounds.append((s, upto))
    for s, b in reversed(bounds):
        pick = F.when(F.col("at") <= b, F.lit(s)).otherwise(pick)
    rest = small.join(F.broadcast(before), "bucket").withColumn("at", run - F.col("n") / 2).select("group_id", pick.alias("split"))
    return big.union(rest)


def _merge(keys: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of a batch that meet stored components: (group_id, root, fate), and the stored components that merge: (group_id, root).

    A batch group and a stored component are one if they share a key: pointers are jumped over both kinds of node. Fate is
    the split that the merged components have in common, or quarantine, in which case the stored ones stay apart.
    """
    links = lookup(keys, state.select("key", F.col("group_id").alias("old")), "key", "inner").select((F.col("group_id") * 2).alias("u"), (F.col("old") * 2 + 1).alias("v")).distinct()
    merged = cut(components(cut(links)))
    stored = state.groupBy("group_id").agg(F.min("split").alias("split")).select((F.col("group_id") * 2 + 1).alias("node"), "split")
    old = F.when(F.col("node") % 2 != 0, F.floor((F.col("node") - 1) / 2))
    met = lookup(merged, stored, "node").groupBy("label").agg(F.countDistinct("split").alias("k"), F.min("split").alias("kept"), F.min(old).alias("root"))
    fate = lookup(merged, met, "label", "inner").select("node", "root", F.when(F.col("k") > 1, "quarantine").otherwise(F.col("kept")).alias("fate"))
    fate = cut(fate)
    touched = fate.filter("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("group_id"), "root", "fate")
    return touched, fate.filter("node % 2 <> 0 AND fate <> 'quarantine'").select(F.floor((F.col("node") - 1) / 2).cast("long").alias("group_id"), "root")


def assign(records: DataFrame, state: DataFrame | None = None, splits=SPLITS) -> tuple[DataFrame, DataFrame]:
    """One batch. Returns (record_id, group_id, split) and the new component table (key, group_id, split, n_records).

    ``state`` is the table a former batch returned; None starts one. Split "quarantine" marks new records whose group
    would join components of different splits; such records leave the table as it was. Run twice on the same batch the
    splits stay as they are, though its records then count twice in n_records, which only steers how deficits are
    filled. A group that meets a stored component takes that component's group_id.
    """
    keys = key_table(records)
    grouped = cut(_grouped(records, keys))
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("n"))
    if state is None:
        fates = cut(place(cut(sizes), {}, splits).select("group_id", F.col("group_id").alias("root"), F.col("split").alias("fate")))
        known = grown = None
    else:
        touched, grown = _merge(keys, state)
        stored = state.groupBy("group_id").agg(F.min("split").alias("split"), F.max("n_records").alias("n"))
        known = lookup(state, grown, "group_id").select("key", F.coalesce("root", "group_id").alias("group_id"), "split", "n_records")
        held = {x.split: x.n for x in stored.groupBy("split").agg(F.sum("n").alias("n")).collect()}  # a row per split
        new = cut(sizes.join(touched, "group_id", "left_anti"))
        fresh = place(new, {s: held.get(s, 0) for s, _ in splits}, splits)
        fates = cut(touched.union(fresh.select("group_id", F.col("group_id").alias("root"), F.col("split").alias("fate"))))
    out = lookup(grouped, fates, "group_id", "inner").select("record_id", F.col("root").alias("group_id"), F.col("fate").alias("split"))
    added = lookup(keys, fates.filter("fate <> 'quarantine'"), "group_id", "inner").select("key", F.col("root").alias("group_id"), F.col("fate").alias("split"))
    more = lookup(sizes, fates.filter("fate <> 'quarantine'"), "group_id", "inner").select(F.col("root").alias("group_id"), "n")
    if known is not None:
        added = added.join(known.select("key"), "key", "left_anti").union(known.select("key", "group_id", "split"))
        # every stored component once: its keys repeat its count
        had = lookup(state.groupBy("group_id").agg(F.max("n_records").alias("n")), grown, "group_id").select(F.coalesce("root", "group_id").alias("group_id"), "n")
        more = more.union(had)
    counts = more.groupBy("group_id").agg(F.sum("n").cast("long").alias("n_records"))
    return out, cut(lookup(added, counts, "group_id", "inner").select("key", "group_id", "split", "n_records"))


def update(records: DataFrame, path: str, splits=SPLITS) -> DataFrame:
    """Assign one batch against the component table kept under ``path`` and store the table's next version there.

    Versions are whole Parquet folders v=0, v=1, ... beside each other; a version counts once its _SUCCESS file is
    there, so a job lost half way leaves the former version in force.
    """
    spark = records.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    done = sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))
    out, table = assign(records, spark.read.parquet(f"{path}/v={done[-1]}") if done else None, splits)
    table.write.mode("overwrite").parquet(f"{path}/v={done[-1] + 1 if done else 0}")
    return out


def splits(records: DataFrame) -> DataFrame:
    """record_id, group_id, split of one table, as the first batch of an empty component table."""
    return assign(records)[0]


def batched(records: DataFrame) -> DataFrame:
    """record_id, batch, group_id, split of one table that arrives as two batches, the smaller half of its ids first."""
    ends = records.agg(F.min("record_id").cast("long").alias("a"), F.max("record_id").cast("long").alias("b")).first()
    middle = ((ends.a or 0) + (ends.b or 0)) // 2
    first, state = assign(records.filter(F.col("record_id") <= middle))
    second, _ = assign(records.filter(F.col("record_id") > middle), state)
    return first.withColumn("batch", F.lit(1)).union(second.withColumn("batch", F.lit(2))).select("record_id", "batch", "group_id", "split")


def report(assigned: DataFrame) -> DataFrame:
    """Per split: records, groups and the share of records."""
    total = assigned.agg(F.count("*").alias("total"))
    per = assigned.groupBy("split").agg(F.count("*").alias("n_records"), F.countDistinct("group_id").alias("n_groups"))
    return per.crossJoin(F.broadcast(total)).select("split", "n_records", "n_groups", (F.col("n_records") / F.col("total")).alias("share"))
