"""Items that appear together: counts of pairs over all runs and how far they exceed chance.

Every pair of items of a run becomes one 64-bit code of two 32-bit item ids. Codes are gathered in bounded buffers,
sorted and run-length counted before the shuffle, then merged: Spark's external sorter spills the sorted runs of a
partition and merges them, and a second run-length count sums equal codes. Odds ratios get a continuity correction.

Two exact bounds keep hot items out of the pair stage where thresholds are given: a pair seen n times needs both
items n times, and a lift of L needs max(n_a, n_b) <= N / L, as n <= min(n_a, n_b). No pair that meets the thresholds is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import attach, blanks, cut

_BLOCK = 256  # a run of more items is cut into chunks, and pairs are made chunk by chunk
_MOST = (1 << 31) - 1  # items that two halves of a code can name; more are an error, never mixed up
_BUFFER = 1 << 20  # pair codes sorted at once in a task


def plain(c: Column) -> Column:
    """An item in plain spelling: forward slashes, no outer blanks, no leading ./"""
    return blanks(F.regexp_replace(F.replace(blanks(c), F.lit("\\"), F.lit("/")), r"^(?:\./+)+", ""))


def holdings(runs: DataFrame) -> DataFrame:
    """Distinct (run_id, item). Null and blank items, null lists and rows without run_id hold nothing."""
    none = F.array().cast("array<string>")
    items = F.concat(F.coalesce("changed_files", none), F.coalesce("selected_tests", none))
    return (
        runs.filter("run_id IS NOT NULL").select("run_id", F.explode(F.array_distinct(F.transform(F.array_compact(items), plain))).alias("item")).filter("item <> ''").distinct()
    )


def dense_ids(items: DataFrame) -> DataFrame:
    """Adds ``id``: 0, 1, ... in no meaningful order, without gathering all items in one task."""
    b = items.withColumn("__b", F.pmod(F.xxhash64("item"), F.lit(4096)))
    base = b.groupBy("__b").agg(F.count("*").alias("m")).select("__b", (F.sum("m").over(Window.orderBy("__b")) - F.col("m")).alias("__base"))
    rn = F.row_number().over(Window.partitionBy("__b").orderBy("item"))
    return b.withColumn("__rn", rn).join(F.broadcast(base), "__b").withColumn("id", F.col("__base") + F.col("__rn") - 1).drop("__b", "__rn", "__base")


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with their counts."""
    if counts is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    return codes[starts], np.add.reduceat(counts, starts) if len(codes) else counts


def _batch(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["code", "n"])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left ids, right ids or null) rows to sorted runs of (code, n)."""
    buffer: list[np.ndarray] = []
    held = 0
    for b in batches:
        lo, hi = b.column(0), b.column(1)
        lv, lo_off = lo.values.to_numpy(zero_copy_only=False), lo.offsets.to_numpy()
        hv, hi_off = hi.values.to_numpy(zero_copy_only=False), hi.offsets.to_numpy()
        for i in range(b.num_rows):
            x, y = lv[lo_off[i] : lo_off[i + 1]], hv[hi_off[i] : hi_off[i + 1]]
            if len(y):
                a, c = np.repeat(x, len(y)), np.tile(y, len(x))
            else:
                p, q = np.triu_indices(len(x), 1)
                a, c = x[p], x[q]
            buffer.append((np.minimum(a, c) << 32) | np.maximum(a, c))
            held += len(a)
            if held >= _BUFFER:
                yield _batch(*_runs(np.concatenate(buffer)))
                buffer, held = [], 0
    if held:
        yield _batch(*_runs(np.concatenate(buffer)))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length sum over a stream sorted by code; a code may go on in the next batch."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        codes, counts = _runs(b.column(0).to_numpy(), b.column(1).to_numpy())
        if last is not None:
            if codes[0] == last[0]:
                counts[0] += last[1]
            else:
                yield _batch(np.array([last[0]]), np.array([last[1]]))
        last = (codes[-1], counts[-1])
        yield _batch(codes[:-1], counts[:-1])
    if last is not None:
        yield _batch(np.array([last[0]]), np.array([last[1]]))


def count_pairs(baskets: DataFrame) -> DataFrame:
    """(code, n) of distinct (run_id, id): the number of runs that hold both ids of the code."""
    sizes = baskets.groupBy("run_id").agg(F.count("*").alias("m")).filter(F.col("m") > _BLOCK)
    k = F.coalesce(F.ceil(F.col("m") / _BLOCK), F.lit(1)).cast("int")
    chunked = attach(baskets, sizes, "run_id").withColumn("k", k).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    meet = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    blocks = chunked.select("run_id", "id", "chunk", meet).select("run_id", "id", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    side = lambda cond: F.collect_list(F.when(cond, F.col("id")))
    lists = blocks.groupBy("run_id", "i", "j").agg(side(F.col("chunk") == F.col("i")).alias("a"), side(F.col("chunk") != F.col("i")).alias("b"))
    lists = lists.filter("(i = j AND size(a) > 1) OR (i <> j AND size(a) > 0 AND size(b) > 0)").select("a", "b")
    codes = lists.mapInArrow(_codes, "code long, n long")
    return codes.repartition("code").sortWithinPartitions("code").mapInArrow(_merged, "code long, n long")


def pairs(runs: DataFrame, min_runs: int = 1, min_lift: float = 0.0) -> DataFrame:
    """item_a < item_b, n, n_a, n_b, n_runs, lift = n * N / (n_a * n_b) and odds_ratio (0.5 added to each cell).

    Reads run_id, changed_files, selected_tests. N counts the distinct run_ids, runs without items included. A run
    logged again counts once, with the items of all its rows; empty tables give no rows.
    """
    held = cut(holdings(runs))
    total = runs.agg(F.countDistinct("run_id")).first()[0]
    counts = held.groupBy("item").agg(F.count("*").alias("n_item"))
    kept = counts.filter(F.col("n_item") >= min_runs)
    if min_lift > 0:
        kept = kept.filter(F.col("n_item") * F.lit(float(min_lift)) <= total)
    ids = cut(dense_ids(kept))
    if ids.count() > _MOST:
        raise ValueError(f"more than {_MOST} items")
    baskets = attach(held, ids.select("item", "id"), "item", "inner", written=True).select("run_id", "id")
    n = count_pairs(baskets).filter(F.col("n") >= min_runs)
    coded = n.select(F.shiftright("code", 32).alias("x"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("y"), "n")
    a = ids.select(F.col("id").alias("x"), F.col("item").alias("ix"), F.col("n_item").alias("nx"))
    b = ids.select(F.col("id").alias("y"), F.col("item").alias("iy"), F.col("n_item").alias("ny"))
    named = attach(attach(coded, a, "x", "inner", written=True), b, "y", "inner", written=True)
    first = F.col("ix") < F.col("iy")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    out = named.select(pick("ix", "iy").alias("item_a"), pick("iy", "ix").alias("item_b"), "n", pick("nx", "ny").alias("n_a"), pick("ny", "nx").alias("n_b"), F.lit(total).cast("long").alias("n_runs"))
    lift = F.col("n") * F.col("n_runs") / (F.col("n_a") * F.col("n_b"))
    odds = (F.col("n") + 0.5) * (F.col("n_runs") - F.col("n_a") - F.col("n_b") + F.col("n") + 0.5) / ((F.col("n_a") - F.col("n") + 0.5) * (F.col("n_b") - F.col("n") + 0.5))
    return out.withColumn("lift", lift).withColumn("odds_ratio", odds).filter(F.col("n") * F.col("n_runs") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
