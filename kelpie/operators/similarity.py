"""Vector similarity as JVM expressions: cosine, ranked search, pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a zero vector, null for a missing one."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def usable(registry: DataFrame, dim: int = 64) -> DataFrame:
    """(module_id, v): one vector per module, of ``dim`` finite values not all zero; the latest by updated_at, then by hash."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return registry.filter(fine).groupBy("module_id").agg(F.max_by(v, F.struct("updated_at", F.xxhash64("embedding"))).alias("v"))


def cosine_or(a: Column, b: Column, missing: float) -> Column:
    """Cosine of two arrays; ``missing`` where one is null."""
    return F.coalesce(cosine(a, b), F.lit(missing))


def unit(vectors: DataFrame) -> DataFrame:
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("n", n).select("module_id", F.transform("v", lambda x: x / F.col("n")).alias("u"))


def search(vectors: DataFrame, query_id: int, k: int = 20, least: float = 0.0) -> DataFrame:
    """The k vectors most similar to that of one module, ranked: one scan and a bounded sort."""
    u = unit(vectors)
    q = u.filter(F.col("module_id") == query_id).select(F.col("u").alias("q"))
    sim = u.filter(F.col("module_id") != query_id).crossJoin(F.broadcast(q)).select("module_id", F.round(dot(F.col("u"), F.col("q")) + 1.234567e-9, 6).alias("sim"))
    top = sim.filter(F.col("sim") >= least).orderBy(F.desc("sim"), "module_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), "module_id"))).withColumn("is_relevant", F.col("sim") >= 0.75)


def top_per_source(vectors: DataFrame, every: int = 100, k: int = 20, least: float = 0.2, block: int = 512) -> DataFrame:
    """The k most similar modules of every query module (ids divisible by ``every``), in blocks of queries.

    Queries are packed into arrays of up to ``block`` vectors, so each row is read once per block and only its best
    matches leave the expression; the ranking then sees k candidates per query and task at most.
    """
    u = unit(vectors)
    q = u.filter(F.col("module_id") % every == 0).select(F.col("module_id").alias("src"), F.col("u").alias("q"))
    blocks = q.groupBy(F.floor(F.col("src") / (every * block)).alias("block")).agg(F.collect_list(F.struct("src", "q")).alias("qs"))
    rows = u.join(blocks, F.lit(True))
    hits = rows.select("module_id", F.inline(F.filter(F.transform("qs", lambda x: F.struct(x["src"].alias("src"), F.round(dot(F.col("u"), x["q"]) + 1.234567e-9, 6).alias("sim"))), lambda x: x["sim"] >= least)))
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "module_id")
    return hits.filter("src <> module_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mean_vectors(registry: DataFrame) -> DataFrame:
    """(repo, pos, value): the mean vector of each repo's usable modules, one row per dimension."""
    v = usable(registry).join(registry.select("module_id", "repo").distinct(), "module_id")
    return v.select("repo", F.posexplode("v").alias("pos", "x")).groupBy("repo", "pos").agg(F.avg("x").alias("value"))


def entry_point(thing, names: tuple[str, ...] = ("embed_batch", "embed", "encode")) -> Callable:
    """The first of the methods ``names`` that ``thing`` has, or ``thing`` itself if it can be called."""
    for n in names:
        if callable(getattr(thing, n, None)):
            return getattr(thing, n)
    if callable(thing):
        return thing
    raise TypeError(f"needs one of the methods {', '.join(names)}")


def embed(texts: DataFrame, make: Callable, id_col: str, text_col: str) -> DataFrame:
    """(id_col, embedding): vectors of all texts by a pluggable embedder, in Arrow batches.

    ``make`` builds the embedder once per task; it has a method of ``entry_point`` from a list of texts to as many vectors.
    Null texts have a null vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = entry_point(make())
        for b in batches:
            t = b.column(1).to_pylist()
            given = [x for x in t if x is not None]
            got = iter([[float(x) for x in np.asarray(v).ravel()] for v in call(given)] if given else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else next(got) for x in t], pa.list_(pa.float64()))], names=[id_col, "embedding"])

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}, embedding array<double>")
