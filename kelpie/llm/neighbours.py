"""Most similar vectors for every vector, by robust-pruned directed graphs.

Vectors are normalised and routed to cells of a coarse quantiser (k-means, fitted on a bounded sample). A cell with
more than ``SHARD`` vectors is cut into shards by hash. In every shard a directed graph is built by batches: a greedy
beam search over the graph so far proposes neighbours, and relaxed distance pruning keeps diverse edges (an edge is
dropped only if a kept neighbour is closer by the factor ``ALPHA``). Every vector then queries each shard of its
``PROBES`` nearest cells by beam search, in blocks, and the results are merged. Exact copies are indexed once.

All vectors are indexed and all are queries. Cells grow with the vectors: beyond ``MAX_CELLS`` each cell is divided by a
quantiser of its own, fitted on a bounded sample of it, and a vector asks the nearest of the finer cells of its nearest
cells. Vectors travel as they are stored and are normalised where they are used. Recall is measured in tests/llm against
brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import attach, cut, lookup

SHARD, MAX_CELLS, SAMPLE = 2048, 4096, 65536
PROBES, DEGREE, BEAM, ALPHA = 10, 24, 40, 1.2
_BATCH, _STEP = 512, 4


def usable(vectors: DataFrame, dim: int = 64, id_col: str = "module_id") -> DataFrame:
    """(id, v): one row per id, the latest usable vector by updated_at.

    Usable are vectors of ``dim`` finite values that are not all zero. Null ids, null and short vectors, NaN and
    infinite values take no part. Of rows with the same time the one with the larger hash is taken.
    """
    v = F.col("embedding")
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    fine = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.filter(F.col(id_col).isNotNull() & fine)
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max_by(v, F.struct("updated_at", F.xxhash64("embedding"))).alias("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(col: pa.Array) -> np.ndarray:
    return _unit(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1))


def quantiser(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids by spherical k-means from evenly spaced rows; empty cells keep their place."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].astype(np.float32)
    x = x.astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def beam_search(x: np.ndarray, adj: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the ``beam`` best nodes found (ids, similarities; id -1 where fewer), all in lockstep."""
    m, n = len(q), len(x)
    rows = np.arange(m)[:, None]
    width = max(beam, len(entry))
    ids = np.full((m, width), -1, np.int32)
    sim = np.full((m, width), -np.inf, np.float32)
    ids[:, : len(entry)] = entry
    sim[:, : len(entry)] = q @ x[entry].T
    seen = np.zeros((m, n + 1), bool)  # the last column takes the padding
    seen[:, entry] = True
    seen[:, n] = True
    done = ids < 0
    while True:
        open_ = np.where(done, -np.inf, sim)
        at = np.argpartition(-open_, _STEP - 1, axis=1)[:, :_STEP]
        live = open_[rows, at] > -np.inf
        if not live.any():
            break
        done[rows, at] = True
        nxt = np.where(live[:, :, None], adj[np.where(live, ids[rows, at], 0)], n).reshape(m, -1)
        nxt[nxt < 0] = n
        nxt.sort(axis=1)
        nxt[:, 1:][nxt[:, 1:] == nxt[:, :-1]] = n
        nxt = np.where(seen[rows, nxt], n, nxt)
        seen[rows, nxt] = True
        fresh = nxt < n
        keep = max(1, int(fresh.sum(axis=1).max()))
        nxt = np.sort(nxt, axis=1)[:, :keep]
        fresh = nxt < n
        got = np.matmul(x[np.where(fresh, nxt, 0)], q[:, :, None])[:, :, 0]
        got[~fresh] = -np.inf
        ids = np.concatenate([ids, np.where(fresh, nxt, -1).astype(np.int32)], axis=1)
        sim = np.concatenate([sim, got.astype(np.float32)], axis=1)
        done = np.concatenate([done, ~fresh], axis=1)
        top = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        ids, sim, done = ids[rows, top], sim[rows, top], done[rows, top]
    order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
    return ids[rows, order], sim[rows, order]


def robust_prune(x: np.ndarray, of: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of ``of`` up to ``degree`` of its candidates (-1 pads): nearest first, without those a kept one covers."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == of[:, None]] = -1
    g = x[np.maximum(cand, 0)]
    far = 2 - 2 * np.matmul(g, x[of][:, :, None])[:, :, 0]
    far[cand < 0] = np.inf
    out = np.full((len(of), degree), -1, np.int32)
    rows = np.arange(len(of))
    for s in range(degree):
        best = far.argmin(axis=1)
        live = far[rows, best] < np.inf
        if not live.any():
            break
        out[live, s] = cand[rows, best][live]
        between = 2 - 2 * np.matmul(g, g[rows, best][:, :, None])[:, :, 0]
        far[alpha * between <= far] = np.inf
        far[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency (n, degree), -1 padded, of the rows of ``x`` in the order given."""
    n = len(x)
    adj = np.full((n, degree), -1, np.int32)
    first = min(n, 2 * degree)
    everyone = np.broadcast_to(np.arange(first, dtype=np.int32), (first, first)).copy()
    adj[:first] = robust_prune(x, np.arange(first), everyone, degree, alpha)
    at, entry = first, entries(first)
    while at < n:
        new = np.arange(at, min(n, at + min(_BATCH, at)))
        ids, _ = beam_search(x[:at], adj[:at], entry, x[new], beam)
        # batch mates see each other too, as they are inserted at once
        mates = x[new] @ x[new].T
        near = new[np.argsort(-mates, axis=1)[:, : min(degree, len(new))]].astype(np.int32)
        adj[new] = robust_prune(x, new, np.concatenate([ids, near], axis=1), degree, alpha)
        src = np.repeat(new, degree)
        dst = adj[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(count.max())), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(start, count)] = src
        for i in range(0, len(nodes), _BATCH):
            part = nodes[i : i + _BATCH]
            adj[part] = robust_prune(x, part, np.concatenate([adj[part], extra[i : i + _BATCH]], axis=1), degree, alpha)
        at = int(new[-1]) + 1
        entry = entries(at)
    return adj


def entries(n: int) -> np.ndarray:
    """Evenly spaced nodes where every search starts."""
    return np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int32))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    x = _unit(np.stack(pdf.v.to_numpy()))
    adj = build_graph(x.astype(np.float32))
    return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "ids": [pdf.id.to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "adj": [adj.tobytes()]})


def _search(k: int):
    def run(key, queries: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": pd.Series([], dtype="int64"), "other": pd.Series([], dtype="int64"), "cosine": pd.Series([], dtype="float64")})
        if not len(queries) or not len(graph):
            return empty
        ids = np.frombuffer(graph.ids.iloc[0], np.int64)
        x = np.frombuffer(graph.x.iloc[0], np.float64).reshape(len(ids), -1)
        adj = np.frombuffer(graph.adj.iloc[0], np.int32).reshape(len(ids), -1)
        x32, q = x.astype(np.float32), _unit(np.stack(queries.v.to_numpy()))
        qid = queries.id.to_numpy(np.int64)
        out = []
        for i in range(0, len(q), _BATCH):
            got, _ = beam_search(x32, adj, entries(len(ids)), q[i : i + _BATCH].astype(np.float32), BEAM)
            cos = np.matmul(x[np.maximum(got, 0)], q[i : i + _BATCH][:, :, None])[:, :, 0]
            other = ids[np.maximum(got, 0)]
            cos[(got < 0) | (other == qid[i : i + _BATCH][:, None])] = -np.inf
            order = np.lexsort((other, -cos), axis=1)[:, :k]
            r = np.arange(len(order))[:, None]
            c, o = cos[r, order], other[r, order]
            ok = c > -np.inf
            out.append(pd.DataFrame({"id": np.repeat(qid[i : i + _BATCH], ok.sum(axis=1)), "other": o[ok], "cosine": c[ok]}))
        return pd.concat(out) if out else empty

    return run


def _routed(rep: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Adds cells: the ``probes`` nearest cells of each vector, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = _matrix(b.column(1)).astype(np.float32) @ centroids.T
            k = min(probes, len(centroids))
            near = np.argsort(-s, axis=1, kind="stable")[:, :k].astype(np.int64)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k), pa.int32()), pa.array(near.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells], names=["id", "v", "cells"])

    return rep.mapInArrow(run, f"id long, v {rep.schema['v'].dataType.simpleString()}, cells array<long>")


def _in_blocks(asked: DataFrame, held: DataFrame, by: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``asked`` in blocks of about ``block`` per ``by``, and ``held`` (a row per ``by``) once for every block."""
    per = cut(asked.groupBy(by).agg(F.count("*").alias("m")).select(by, F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    a = attach(asked, per, by, "inner").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    return a, held.join(per, by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _refined(routed: DataFrame, shard: int, probes: int) -> DataFrame:
    """``routed`` by finer cells: those of each cell's own quantiser, numbered cell * MAX_CELLS + fine."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _unit(np.stack(pdf.v.to_numpy()))
        c = quantiser(x, max(1, min(int(pdf.f.iloc[0]), len(x))))
        return pd.DataFrame({"cell": [pdf.cell.iloc[0]], "c": [c.astype(np.float32).tobytes()]})

    def near(key, queries: pd.DataFrame, fine: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(fine):
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "cell": pd.Series([], dtype="int64"), "s": pd.Series([], dtype="float32")})
        q = _unit(np.stack(queries.v.to_numpy())).astype(np.float32)
        s = q @ np.frombuffer(fine.c.iloc[0], np.float32).reshape(-1, q.shape[1]).T
        k = min(probes, s.shape[1])
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"id": np.repeat(queries.id.to_numpy(np.int64), k), "cell": (int(fine.cell.iloc[0]) * MAX_CELLS + top).ravel(), "s": np.take_along_axis(s, top, 1).ravel()})

    sizes = routed.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("m"))
    sizes = sizes.withColumn("f", F.least(F.lit(MAX_CELLS), F.ceil(F.col("m") / (shard // 2))))
    home = routed.select("id", "v", F.col("cells")[0].alias("cell")).join(F.broadcast(sizes), "cell")  # at most MAX_CELLS rows
    some = home.filter(F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("m") / F.least(F.lit(SAMPLE), 64 * F.col("f"))))) == 0)
    fine = cut(some.select("id", "v", "cell", "f").groupBy("cell").applyInPandas(fit, "cell long, c binary"))
    asked, held = _in_blocks(routed.select("id", "v", F.explode("cells").alias("cell")), fine, "cell", 8 * shard)
    hits = asked.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInPandas(near, "id long, cell long, s float")
    best = hits.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("s"), (-F.col("cell")).alias("c"))), False), 1, probes).alias("t"))  # probes squared at most
    return routed.select("id", "v").join(best, "id").select("id", "v", F.transform("t", lambda x: -x["c"]).alias("cells"))


def nearest(points: DataFrame, k: int = 10, probes: int = PROBES, shard: int = SHARD) -> DataFrame:
    """(id, other, cosine, rank): the k most similar of the other points for every row of ``points`` (id long, v array<double> or array<float>).

    Points with the same vector are searched as one and listed first, smaller ids before larger ones; ties elsewhere
    are broken by the smaller id. One point has no neighbours; an empty table gives no rows.
    """
    spark = points.sparkSession
    # copies: equal vectors. The smallest k + 1 ids of each are enough to list the neighbours of every member.
    salted = Window.partitionBy("v", "__s").orderBy("id")
    top = points.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("__s")).withColumn("__r", F.row_number().over(salted)).filter(F.col("__r") <= k + 1)
    members = cut(
        top.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1).select("id", "v", "r")
    )
    rep = members.filter("r = 1").select("id", "v")
    n = rep.count()
    if n == 0:
        return spark.createDataFrame([], "id long, other long, cosine double, rank int")
    wanted = -(-n // (shard // 2))
    cells = max(1, min(MAX_CELLS, wanted))
    sample = rep.orderBy(F.xxhash64("id")).limit(min(SAMPLE, 64 * cells)).select("v").toArrow()
    centroids = quantiser(_matrix(sample.column(0).combine_chunks()), min(cells, sample.num_rows))
    routed = cut(_routed(rep, centroids, probes))
    if wanted > MAX_CELLS:
        routed = cut(_refined(routed, shard, probes))
    sizes = cut(routed.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("m")).select("cell", F.ceil(F.col("m") / shard).cast("int").alias("parts")))
    home = attach(routed.select("id", "v", F.col("cells")[0].alias("cell")), sizes, "cell", "inner")
    name = F.col("cell") * F.lit(1 << 32)
    graphs = cut(home.select("id", "v", (name + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shard")).groupBy("shard").applyInPandas(_build, "shard long, ids binary, x binary, adj binary"))
    asked = attach(routed.select("id", "v", F.explode("cells").alias("cell")), sizes, "cell", "inner")
    asked = asked.select("id", "v", F.explode(F.sequence(name, name + F.col("parts") - 1)).alias("shard"))
    asked, held = _in_blocks(asked, graphs, "shard", 4 * shard)
    hits = asked.select("shard", "block", "id", "v").groupBy("shard", "block").cogroup(held.select("shard", "block", "ids", "x", "adj").groupBy("shard", "block")).applyInPandas(_search(k), "id long, other long, cosine double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    found = cut(hits.withColumn("rank", rank).filter(F.col("rank") <= k))
    alone = members.groupBy("v").agg(F.max("r").alias("c")).filter("c > 1")
    if alone.isEmpty():
        return found
    return _expand(points, members, alone, found, k)


def _expand(points: DataFrame, members: DataFrame, alone: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Neighbours of classes of equal vectors to neighbours of their members."""
    firsts = cut(members.withColumn("rep", F.min("id").over(Window.partitionBy("v"))).select("rep", F.col("id").alias("member"), "v"))
    # a class holds at most k + 1 members here, so a table by class is no hot side; points of a class may be many
    classes = firsts.groupBy("rep").agg(F.min("v").alias("v"), F.collect_list("member").alias("members"))
    of = lookup(points, classes, "v", "inner").select("id", "rep", "members")
    same = of.select("id", F.explode("members").alias("other"), F.lit(1.0).alias("cosine")).filter("id <> other")
    near = found.select(F.col("id").alias("rep"), F.col("other").alias("orep"), "cosine")
    near = lookup(near, classes.select(F.col("rep").alias("orep"), "members"), "orep", "inner").select("rep", F.explode("members").alias("other"), "cosine")
    cap = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    near = near.withColumn("__r", F.row_number().over(cap)).filter(F.col("__r") <= k)
    near = near.groupBy("rep").agg(F.collect_list(F.struct("other", "cosine")).alias("near"))  # k at most
    both = same.union(lookup(of.select("id", "rep"), near, "rep", "inner").select("id", F.inline("near")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def similar_pairs(modules: DataFrame, k: int = 10, least: float = 0.85) -> DataFrame:
    """module_id < neighbor_id, cosine: each pair once of which one is among the other's k most similar, at ``least`` or above."""
    near = nearest(usable(modules), k).filter(F.col("cosine") >= least)
    pair = near.select(F.least("id", "other").alias("module_id"), F.greatest("id", "other").alias("neighbor_id"), "cosine")
    return pair.groupBy("module_id", "neighbor_id").agg(F.max("cosine").alias("cosine"))


def named(modules: DataFrame, embedded: DataFrame, k: int = 10) -> DataFrame:
    """The k most similar modules of every usable module, with the first identifier embedded for either, if any."""
    near = nearest(usable(modules), k)
    ids = embedded.filter("module_id IS NOT NULL").groupBy("module_id").agg(F.min("identifier").alias("identifier"))
    a = ids.select(F.col("module_id").alias("id"), "identifier")
    b = ids.select(F.col("module_id").alias("other"), F.col("identifier").alias("neighbor_identifier"))
    return near.join(a, "id", "left").join(b, "other", "left").select(F.col("id").alias("module_id"), "identifier", F.col("other").alias("neighbor_id"), "neighbor_identifier", "cosine", "rank")
