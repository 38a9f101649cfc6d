"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are indexed once, with their ``k + 1`` smallest ids: more can never be among a query's ``k`` nearest. Distinct
vectors are dealt over shards of about ``SHARD``; a shard inserts its vectors one after another, in order of their smallest id, on layers
drawn from an exponential distribution: each searches the graph of those before it, links to a diverse choice of what it finds, and
neighbours are kept as flat arrays. Every query vector descends greedily to the bottom layer, searches there with a beam of
``beam``, and its candidates are scored by the cosine in double precision; the merged best ``k`` are returned.

Defined results: null, empty or zero vectors, vectors with null or non-finite components and rows with null ids take no
part; only vectors of the query's dimension are compared; of equal scores the smaller id comes first; rows that share an id are
one candidate at its best score; with fewer than ``k`` candidates all are returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHARD = 8192
LINKS = 16  # neighbours chosen on insertion; twice as many stay on the bottom layer
POOL = 64  # beam of an insertion's search; the choice is made from what it finds
BEAM = 128


def usable(v: Column) -> Column:
    """Whether a vector takes part in comparisons."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


class Graph:
    """Layers of flat neighbour arrays: ``links[layer][node]`` padded with -1, ``size[layer][node]`` in use.

    Vectors are inserted in order: each descends greedily to its own highest layer, searches that and all layers below with a beam of
    ``POOL`` over what was inserted before it, and links to a diverse choice of what the beam found.
    """

    def __init__(self, unit: np.ndarray, seed: int = 7):
        self.unit = unit = unit.astype(np.float32)
        n = len(unit)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int), 8)
        layers = int(self.level.max(initial=0)) + 1
        self.links = [np.full((n, 4 * LINKS if layer == 0 else 2 * LINKS), -1, np.int32) for layer in range(layers)]
        self.size = [np.zeros(n, np.int32) for _ in range(layers)]
        self.entry, self.top = 0 if n else -1, int(self.level[0]) if n else -1
        for node in range(1, n):
            self.insert(node)

    def insert(self, me: int) -> None:
        q, level = self.unit[me], int(self.level[me])
        starts = [self.descended(q, level)]
        for layer in range(min(level, self.top), -1, -1):
            found = sorted(self.beam(q, layer, starts, POOL), reverse=True)
            self.connect(layer, me, np.array([x for _, x in found]))
            starts = found
        if level > self.top:
            self.entry, self.top = me, level

    def connect(self, layer: int, me: int, pool: np.ndarray) -> None:
        """Links in both directions; a neighbour's full list is cut down to a diverse choice."""
        unit, links, size = self.unit, self.links[layer], self.size[layer]
        chosen = self.diverse(me, pool, LINKS)
        links[me, : len(chosen)] = chosen
        size[me] = len(chosen)
        for c in chosen:
            if size[c] == links.shape[1]:
                old = links[c]
                old = old[np.argsort(-(unit[old] @ unit[c]), kind="stable")]
                best = self.diverse(c, old, links.shape[1] // 2)
                links[c] = -1
                links[c, : len(best)] = best
                size[c] = len(best)
            links[c, size[c]] = me
            size[c] += 1

    def diverse(self, node: int, pool: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in order of nearness, those nearer to ``node`` than to any chosen before; filled up with the nearest left."""
        v = self.unit[pool]
        to = v @ self.unit[node]
        among = v @ v.T
        closest = np.full(len(pool), -2.0, np.float32)
        chosen, left = [], []
        for i in range(len(pool)):
            if closest[i] < to[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.maximum(closest, among[i], out=closest)
            else:
                left.append(i)
        return pool[chosen + left[: max(0, most - len(chosen))]]

    def descended(self, q: np.ndarray, level: int) -> tuple[float, int]:
        """The node that greedy steps through the layers above ``level`` end at, after its similarity."""
        unit, at = self.unit, self.entry
        sim = float(unit[at] @ q)
        for layer in range(self.top, level, -1):
            while True:
                near = self.links[layer][at, : self.size[layer][at]]
                if not len(near):
                    break
                sims = unit[near] @ q
                j = int(np.argmax(sims))
                if sims[j] <= sim:
                    break
                at, sim = int(near[j]), float(sims[j])
        return sim, at

    def beam(self, q: np.ndarray, layer: int, starts: list[tuple[float, int]], width: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes (similarity, node) that a best-first search of one layer meets from ``starts``."""
        unit, links, size = self.unit, self.links[layer], self.size[layer]
        seen = np.zeros(len(unit), bool)
        seen[[x for _, x in starts]] = True
        todo, best = [(-s, x) for s, x in starts], list(starts)
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, at = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            near = links[at, : size[at]]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            sims = unit[near] @ q
            if len(best) >= width:
                keep = sims > best[0][0]
                near, sims = near[keep], sims[keep]
            for s, x in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, x))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, x))
                else:
                    continue
                heapq.heappush(todo, (-s, x))
        return best

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Nodes near to the unit vector ``q``, the best of the bottom layer's beam."""
        q = q.astype(np.float32)
        return np.array([x for _, x in self.beam(q, 0, [self.descended(q, 0)], beam)])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return np.asarray(lists.flatten()).astype(np.float64).reshape(len(lists), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """The ``k`` nearest of ``vectors(vec_id, embedding)`` to each row of ``queries(query_id, embedding)`` whose own id differs."""
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "hnsw")
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("v")
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    few = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    index = scratch.save(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "index")
    sizes = {r["d"]: max(1, math.ceil(r["n"] / shard)) for r in index.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    asked = queries.where(usable(F.col("embedding")) & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), vector)
    reps = scratch.save(asked.groupBy("v").agg(F.min("query_id").alias("rep")), "reps")
    placed = index.select(F.size("v").alias("d"), F.pmod(F.xxhash64("v"), shards[F.size("v")]).cast("int").alias("shard"), "v", "ids")
    copies = reps.where(shards[F.size("v")].isNotNull()).select(F.size("v").alias("d"), "rep", "v", F.explode(F.sequence(F.lit(0), shards[F.size("v")] - 1)).alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            # In order of ids, so that a task that runs again builds the same graph.
            left = left.take(pa.array(np.argsort([i[0] for i in left.column("ids").to_pylist()])))
            v, q = matrix(left.column("v")), matrix(right.column("v"))
            norm = np.sqrt((v * v).sum(axis=1))
            graph, ids = Graph(v / norm[:, None]), left.column("ids").to_pylist()
            for rep, x in zip(right.column("rep").to_pylist(), q, strict=True):
                length = math.sqrt(float((x * x).sum()))
                near = graph.search(x / length, beam)
                scores = (v[near] * x).sum(axis=1) / (norm[near] * length)
                found = sorted((-s, i) for s, n in zip(scores.tolist(), near.tolist(), strict=True) for i in ids[n])[: k + 1]
                out[0].extend([rep] * len(found))
                out[1].extend(i for _, i in found)
                out[2].extend(-s for s, _ in found)
        return pa.table({"rep": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = placed.groupBy("d", "shard").cogroup(copies.groupBy("d", "shard")).applyInArrow(run, "rep long, vec_id long, score double")
    found = found.groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    per_rep = found.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("rn") <= k + 1).drop("rn")
    joined = asked.join(reps, "v").select("query_id", "rep").distinct().join(per_rep, "rep").where("vec_id <> query_id")
    best = joined.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), 5)
