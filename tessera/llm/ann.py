"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Equal vectors are one point of the index (so that thousands of copies do not fill each other's neighbour lists); every
row stands behind a point.  Points are dealt into shards by hash.  Each shard's graph is a set of flat arrays: per
layer, neighbour positions in rows of fixed width and -1 where there is none.  Searches advance many queries at once,
each with a beam of its own.  An extra component makes all points equally long, which turns the largest inner product
into the smallest distance.  Shard results are merged, and scores are computed anew in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Points of a shard, about.
SHARD_POINTS = 16_384
WIDTH, BUILD_BEAM, SEARCH_BEAM = 16, 64, 128


@dataclass
class Graph:
    """Points (float32, rows of equal length), and per layer the points on it and their flat neighbour array."""

    points: np.ndarray
    layers: list[np.ndarray]
    entry: int

    def search(self, queries: np.ndarray, beam: int, top: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions and inner products, best first, of ``beam`` points per query (-1 where there are fewer)."""
        at = np.full(len(queries), self.entry)
        for layer in range(len(self.layers) - 1, top, -1):
            at = self._beam(queries, at[:, None], layer, 1)[0][:, 0]
        return self._beam(queries, at[:, None], top, beam)

    def _beam(self, queries, starts, layer, beam):
        """Best-first search of all queries in step: each round expands every query's best unexpanded point."""
        n, neighbours = len(queries), self.layers[layer]
        ids = np.full((n, beam), -1, np.int64)
        score = np.full((n, beam), -np.inf, np.float32)
        ids[:, 0] = starts[:, 0]
        score[:, 0] = np.einsum("qd,qd->q", queries, self.points[starts[:, 0]])
        open_ = np.zeros((n, beam), bool)
        open_[:, 0] = True
        seen = np.zeros((n, -(-len(self.points) // 8)), np.uint8)
        seen[np.arange(n), starts[:, 0] >> 3] |= (1 << (starts[:, 0] & 7)).astype(np.uint8)
        active = np.arange(n)
        while len(active):
            waiting = np.where(open_[active], score[active], -np.inf)
            pick = waiting.argmax(axis=1)
            going = np.isfinite(waiting[np.arange(len(active)), pick])
            active, pick = active[going], pick[going]
            if not len(active):
                break
            open_[active, pick] = False
            near = neighbours[ids[active, pick]]
            row = np.broadcast_to(active[:, None], near.shape)
            bit = (1 << (near & 7)).astype(np.uint8)
            fresh = (near >= 0) & ((seen[row, near >> 3] & bit) == 0)
            # neighbour lists hold a point once, so no byte's bit is set twice here
            np.bitwise_or.at(seen, (row[fresh], near[fresh] >> 3), bit[fresh])
            s = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh)
            s[r, c] = np.einsum("kd,kd->k", queries[active[r]], self.points[near[r, c]])
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
            all_score = np.concatenate([score[active], s], axis=1)
            all_open = np.concatenate([open_[active], fresh], axis=1)
            best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam] if all_score.shape[1] > beam else np.argsort(-all_score, axis=1)
            ids[active] = np.take_along_axis(all_ids, best, 1)
            score[active] = np.take_along_axis(all_score, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.where(np.isfinite(np.take_along_axis(score, order, 1)), np.take_along_axis(ids, order, 1), -1), np.take_along_axis(score, order, 1)


def _spread(points: np.ndarray, ids: np.ndarray, to_owner: np.ndarray, width: int) -> np.ndarray:
    """Neighbours for each row of candidates (best first): those nearer to the owner than to any chosen one, then, if
    places are left, the best of the others.  All points are equally long, so products stand for distances."""
    n, k = ids.shape
    chosen = np.full((n, width), -1, np.int64)
    count = np.zeros(n, np.int64)
    taken = np.zeros((n, k), bool)
    vectors = points[np.maximum(ids, 0)]
    among = np.einsum("nid,njd->nij", vectors, vectors)
    for c in range(k):
        rival = np.where(taken[:, :c], among[:, c, :c], -np.inf).max(axis=1) if c else np.full(n, -np.inf)
        ok = (ids[:, c] >= 0) & (count < width) & (to_owner[:, c] > rival)
        chosen[ok, count[ok]] = ids[ok, c]
        count[ok] += 1
        taken[ok, c] = True
    for c in range(k):
        ok = (ids[:, c] >= 0) & (count < width) & ~taken[:, c]
        chosen[ok, count[ok]] = ids[ok, c]
        count[ok] += 1
    return chosen


def build(points: np.ndarray, *, width: int = WIDTH, beam: int = BUILD_BEAM, seed: int = 7) -> Graph:
    """A graph of equally long points.  Points come in batches that double in size, up to 512: each batch searches what
    stands, and its members see each other."""
    n = len(points)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / math.log(width)).astype(int), 6)
    order = np.argsort(-level, kind="stable")  # upper layers first, so that an entry point stands from the start
    tops = int(level.max()) if n else 0
    widths = [2 * width] + [width] * tops
    graph = Graph(points, [np.full((n, w), -1, np.int32) for w in widths], int(order[0]) if n else 0)
    placed, size = 1, 1
    while placed < n:
        batch = order[placed : placed + size]
        for layer in range(int(level[batch].max()), -1, -1):
            own = batch[level[batch] >= layer]
            ids, score = graph.search(points[own], beam, layer)
            inside = points[own] @ points[own].T
            inside[np.arange(len(own)), np.arange(len(own))] = -np.inf
            some = min(len(own) - 1, width)
            if some > 0:
                near = np.argpartition(-inside, some - 1, axis=1)[:, :some]
                ids = np.concatenate([ids, own[near]], axis=1)
                score = np.concatenate([score, np.take_along_axis(inside, near, 1)], axis=1)
                best = np.argsort(-score, axis=1, kind="stable")
                ids, score = np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1)
            keep = min(ids.shape[1], 3 * width)
            out = _spread(points, ids[:, :keep], score[:, :keep], width)
            flat = graph.layers[layer]
            flat[own, : out.shape[1]] = out
            _link_back(points, flat, own, out)
        placed += len(batch)
        size = min(512, 2 * size, max(1, placed))
    return graph


def _link_back(points: np.ndarray, flat: np.ndarray, own: np.ndarray, out: np.ndarray) -> None:
    """Adds each owner to the lists of its neighbours, and spreads lists that would overflow."""
    r, c = np.nonzero(out >= 0)
    target, source = out[r, c], own[r]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    starts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    ends = np.append(starts[1:], len(target))
    width, longest = flat.shape[1], int((ends - starts).max()) if len(starts) else 0
    if not longest:
        return
    who = target[starts]
    more = np.full((len(who), longest), -1, np.int64)
    position = np.arange(len(target)) - np.repeat(starts, ends - starts)
    more[np.repeat(np.arange(len(who)), ends - starts), position] = source
    lists = np.concatenate([flat[who].astype(np.int64), more], axis=1)
    ordered = np.sort(lists, axis=1)[:, ::-1]  # a point that is there twice goes, once
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    for k in range(0, len(who), 256):
        rows = ordered[k : k + 256]
        score = np.where(rows >= 0, np.einsum("nkd,nd->nk", points[np.maximum(rows, 0)], points[who[k : k + 256]]), -np.inf)
        best = np.argsort(-score, axis=1, kind="stable")[:, : 2 * width]
        rows, score = np.take_along_axis(rows, best, 1), np.take_along_axis(score, best, 1)
        full = (rows >= 0).sum(axis=1) > width
        flat[who[k : k + 256]] = rows[:, :width] if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])), constant_values=-1)
        if full.any():
            flat[who[k : k + 256][full]] = _spread(points, rows[full], score[full], width)


# ---------------------------------------------------------------- Spark


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v array<double>`` of the rows that take part: an id, and finite components that are not all zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_points: int = SHARD_POINTS, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id``, ``rank``, ``id_col``, ``score``: the ``k`` nearest found for each row whose id meets ``is_query``.

    Vectors that are null, zero or not finite, and null ids, take no part; among rows of one id the first by its
    components counts; vectors of one length are compared among each other.  Other columns are
    ignored.
    """
    rows = usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    rows = written(rows.withColumn("p", F.xxhash64("v")), "vectors")
    # the k + 1 smallest ids of equal vectors are all that any query can see of them; Spark prunes before the shuffle
    place = F.row_number().over(Window.partitionBy("p", "v").orderBy("id"))
    members = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    points = written(members.groupBy("p", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")), "points")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shape = points.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("most")).orderBy("dim").collect()  # one row per length of vectors
    asked = rows.where(is_query(F.col("id"))).select(F.col("v"), "p", "id")
    queries = written(asked.groupBy("p", "v").agg(F.min("id").alias("q")).withColumn("dim", F.size("v")), "queries")
    parts = [_search(points.where(F.col("dim") == s["dim"]), queries.where(F.col("dim") == s["dim"]), s, k, shard_points, beam) for s in shape]
    out = "query_id long, rank int, id long, score double"
    if not parts:
        return vectors.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    found = written(found, "found")
    # each query row with the points found for its vector, then their rows, its own left out
    each = asked.select("p", "v", F.col("id").alias("query_id")).join(queries.select("p", "v", "q"), ["p", "v"]).join(found, "q")
    ranked = each.select("query_id", F.explode("hits").alias("hit")).select("query_id", F.col("hit.score").alias("score"), F.explode("hit.ids").alias("id")).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _search(points: DataFrame, queries: DataFrame, shape, k: int, shard_points: int, beam: int) -> DataFrame:
    """``q``, ``hits`` (score and ids of the ``k + 1`` best points) for the queries of one length of vectors."""
    shards, dim, most = max(1, round(shape["n"] / shard_points)), int(shape["dim"]), float(shape["most"])
    scale = 1 / math.sqrt(most)
    rows = points.select(F.pmod(F.col("p"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), F.monotonically_increasing_id().alias("n"), "v", "ids")
    # the stated set of queries goes to every shard
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), F.col("q").alias("n"), "v", F.lit(None).cast("array<long>").alias("ids"))
    dealt = rows.unionByName(asks).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks", "n")
    out = T.StructType.fromDDL("q long, score double, ids array<long>")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        graphs: dict[int, tuple] = {}
        for b in batches:
            if not b.num_rows:
                continue
            which, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            v = b.column("v").flatten().to_numpy().reshape(-1, dim)
            for s in np.unique(which):
                own = (which == s) & ~asks
                if own.any():
                    held.setdefault(int(s), []).append((v[own], b.column("ids").filter(pa.array(own))))
                ask = (which == s) & asks
                if not ask.any() or (int(s) not in held and int(s) not in graphs):
                    continue
                if int(s) not in graphs:  # its points came first
                    gathered = held.pop(int(s))
                    exact = np.concatenate([x for x, _ in gathered])
                    ids = pa.concat_arrays([x for _, x in gathered])
                    short = exact * scale
                    rest = np.sqrt(np.maximum(0, 1 - (short * short).sum(axis=1, keepdims=True)))
                    graphs.clear()
                    graphs[int(s)] = build(np.concatenate([short, rest], axis=1).astype(np.float32)), exact, ids
                graph, exact, ids = graphs[int(s)]
                for at in range(0, int(ask.sum()), 512):
                    asked = v[ask][at : at + 512]
                    flat = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1)
                    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
                    near, _ = graph.search(flat.astype(np.float32), max(beam, k + 1))
                    score = np.where(near >= 0, np.einsum("qkd,qd->qk", exact[np.maximum(near, 0)], asked), -np.inf)
                    best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                    near, score = np.take_along_axis(near, best, 1), np.take_along_axis(score, best, 1)
                    r, c = np.nonzero(near >= 0)
                    name = b.column("n").to_numpy()[ask][at : at + 512]
                    yield pa.RecordBatch.from_arrays([pa.array(name[r]), pa.array(score[r, c]), ids.take(pa.array(near[r, c]))], names=out.names)

    got = dealt.mapInArrow(shard, out)
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))
    return got.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))
