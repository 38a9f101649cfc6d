"""Near-duplicate vectors by an inverted multi-index.

Vectors are compared within a label, by cosine in double precision; equal vectors of a label are one node with a weight.
Two codebooks, one for each half of the unit vectors, are fitted on at most ``SAMPLE`` vectors chosen by a hash of their id;
their product is the grid of cells. A vector's multi-sequence visits cells in the order of the sum of its halves'
squared distances to the two centroids, until the sum exceeds that of its own cell by a limit: the one that reaches the
farthest link, by brute force over all vectors, of ``RECALL`` of a sample of queries, each of which counts once; if few
queries have links outside their cell, what the triangle inequality allows at most. Every vector is in the index, in its own
cell; visitors meet it there and all pairs found are verified on the original vectors.

Rows travel once for each first-half code they visit. Cells of one first-half code of a label are dealt over salts of
``BLOCK`` vectors, to each of which its visitors are copied. A block counts links and returns counts and a spanning
forest, never pairs. A link that only one side's sequence finds is credited to both, so counts are symmetric.

Defined results: null, empty or zero vectors, vectors with null or non-finite components and rows without label link with nothing
(0 links, component their own id); vectors of different dimensions are never linked; rows that share a vec_id share a
component; rows with null ids link with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hnsw import matrix, usable

SAMPLE = 20_000
QUERIES = 1_000
RECALL = 0.999
ROUNDS = 12
BLOCK = 4_000
PER_CELL = 200  # vectors a cell should hold on average
MOST_CODES = 256


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)[None, :], 0.0)


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct starting points; centroids that lose all points stay where they were."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS):
        near = distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class MultiIndex:
    """Codebooks and visiting limit of one dimension."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, codes: int, least: float):
        unit = sample / np.sqrt((sample * sample).sum(axis=1))[:, None]
        self.half = max(1, unit.shape[1] // 2)
        self.first = codebook(unit[:, : self.half], codes, 1)
        self.second = codebook(unit[:, self.half :], codes, 2) if unit.shape[1] > 1 else np.zeros((1, 0))
        d1, d2 = self.halves(unit)
        own = d1.min(axis=1) + d2.min(axis=1)
        self.own = float(own.max())
        self.pick = np.linspace(0, len(unit) - 1, min(QUERIES, len(unit))).astype(int)
        self.queries, self.labels = unit[self.pick], labels[self.pick]
        self.least, self.limit = least, None

    def excess(self, unit: np.ndarray, labels: np.ndarray, nodes: np.ndarray, query_nodes: np.ndarray) -> tuple[np.ndarray, float]:
        """For each query: how far the farthest of its links in ``unit`` lies beyond its own cell (-inf without one); widest cell."""
        d1, d2 = self.halves(unit)
        q1, q2 = self.halves(self.queries)
        over = q1[:, d1.argmin(axis=1)] + q2[:, d2.argmin(axis=1)] - (q1.min(axis=1) + q2.min(axis=1))[:, None]
        hit = (self.queries @ unit.T >= self.least) & (self.labels[:, None] == labels[None, :]) & (query_nodes[:, None] != nodes[None, :])
        return np.where(hit, over, -np.inf).max(axis=1, initial=-np.inf), float((d1.min(axis=1) + d2.min(axis=1)).max(initial=0.0))

    def settle(self, farthest: np.ndarray, own: float) -> None:
        """The visiting limit from each query's farthest link, one value a query however many links it has."""
        # By the triangle inequality no link lies further than this from a cell of the widest cell's width.
        widest = float((np.sqrt(2 * (1 - self.least)) + np.sqrt(max(own, self.own))) ** 2)
        self.limit = min(widest, float(np.quantile(farthest, RECALL)) * 1.1 + 1e-9) if (farthest > 0).sum() >= 100 else widest

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        second = distances(unit[:, self.half :], self.second) if self.second.shape[1] else np.zeros((len(unit), 1))
        return distances(unit[:, : self.half], self.first), second

    def sequences(self, unit: np.ndarray):
        """Own cell and visited cells (first code * number of second codes + second code) of each vector, nearest first."""
        d1, d2 = self.halves(unit)
        width = d2.shape[1]
        for a, b in zip(d1, d2, strict=True):
            o1, o2 = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            most = a[o1[0]] + b[o2[0]] + self.limit
            keys, cells = [], []
            for i in o1:  # rows of the grid in order; each row's sums rise, so it is left at the first too large
                n = int(np.searchsorted(a[i] + b[o2], most, "right"))
                if not n:
                    break
                keys.append(a[i] + b[o2[:n]])
                cells.append(i * width + o2[:n])
            keys, cells = np.concatenate(keys), np.concatenate(cells)
            yield int(o1[0]) * width + int(o2[0]), cells[np.argsort(keys, kind="stable")]


def forest(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (node, smallest node of its tree) that connect what the pairs (x, y) of nodes below n connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(i, int(label[i])) for i in np.flatnonzero(label != np.arange(n))]


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "imi")
    ok = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, F.transform("embedding", lambda x: x.cast("double"))).alias("v"), F.when(ok, F.col("label").cast("string")).alias("label"))
    nodes = scratch.save(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("w")), "nodes")
    dims = {r["d"]: r["n"] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    books, picked = {}, {}
    for d, n in dims.items():
        sample = nodes.where(F.size("v") == d).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("label", "v", "node").toArrow()
        codes = int(min(MOST_CODES, max(8, round((n / PER_CELL) ** 0.5))))
        books[d] = MultiIndex(matrix(sample.column("v")), np.array(sample.column("label").to_pylist()), codes, least)
        picked[d] = sample.column("node").to_numpy()[books[d].pick]
    unsettled = spark.sparkContext.broadcast((books, picked))

    def reach(batches):
        """For each query the largest excess of its links in a batch; query -1 has the widest cell."""
        for b in batches:
            data, out = b.to_pydict(), {"d": [], "q": [], "far": []}
            by: dict[int, list[int]] = {}
            for i, v in enumerate(data["v"]):
                by.setdefault(len(v), []).append(i)
            for d, at in by.items():
                m = np.array([data["v"][i] for i in at])
                unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
                book, ids = (x[d] for x in unsettled.value)
                far, own = book.excess(unit, *(np.array([data[c][i] for i in at]) for c in ("label", "node")), ids)
                some = np.flatnonzero(np.isfinite(far))
                out["d"] += [d] * (1 + len(some))
                out["q"] += [-1, *some.tolist()]
                out["far"] += [own, *far[some].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), (pa.int32(), pa.int32(), pa.float64()), strict=True)], list(out))

    common.small_batches(spark)
    farthest: dict[int, dict[int, float]] = {d: {} for d in dims}
    for r in nodes.select("label", "v", "node").mapInArrow(reach, "d int, q int, far double").groupBy("d", "q").agg(F.max("far").alias("far")).collect():  # at most QUERIES + 1 rows a dimension
        farthest[r["d"]][r["q"]] = r["far"]
    for d, far in farthest.items():
        own = far.pop(-1)
        books[d].settle(np.array(list(far.values())), own)
    shared = spark.sparkContext.broadcast(books)  # two codebooks of at most MOST_CODES centroids a dimension
    PLACED = "part string, visits boolean, node long, w long, cell int, cells array<int>, v array<double>"

    def place(batches):
        """One row for the index and one for each first-half code visited."""
        for b in batches:
            out = {k: [] for k in ("part", "visits", "node", "w", "cell", "cells", "v")}
            data = b.to_pydict()
            by: dict[int, list[int]] = {}
            for i, v in enumerate(data["v"]):
                by.setdefault(len(v), []).append(i)
            for d, at in by.items():
                book = shared.value[d]
                m = np.array([data["v"][i] for i in at])
                unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
                width = len(book.second)
                for i, (own, cells) in zip(at, book.sequences(unit), strict=True):
                    rest = (data["node"][i], data["w"][i], own)
                    first = cells // width
                    for code in dict.fromkeys(first.tolist()):
                        for k, x in zip(out, (f"{d}|{code}|{data['label'][i]}", True, *rest, cells[first == code], data["v"][i]), strict=True):
                            out[k].append(x)
                    for k, x in zip(out, (f"{d}|{own // width}|{data['label'][i]}", False, *rest, cells, data["v"][i]), strict=True):
                        out[k].append(x)
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], list(out))

    placed = scratch.save(nodes.select("label", "v", "node", "w").mapInArrow(place, PLACED), "placed")
    salts = placed.where("not visits").groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    dealt = placed.join(common.small(salts), "part")
    dealt = dealt.withColumn("salt", F.explode(F.when(F.col("visits"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")))))

    def meet(t: pa.Table) -> pa.Table:
        visits = np.asarray(t.column("visits").combine_chunks().to_numpy(zero_copy_only=False), bool)
        node, w, cell = (np.asarray(t.column(c).to_numpy()) for c in ("node", "w", "cell"))
        v, cells = matrix(t.column("v")), t.column("cells").to_pylist()
        norm = np.sqrt((v * v).sum(axis=1))
        index, guests = np.flatnonzero(~visits), np.flatnonzero(visits)
        goes = {int(i): set(cells[i]) for i in index}
        there: dict[int, list[int]] = {}
        for g in guests:
            for c in cells[g]:
                there.setdefault(c, []).append(g)
        links = np.zeros(len(node), np.int64)
        xs, ys = [], []
        home: dict[int, list[int]] = {}
        for i in index:
            home.setdefault(int(cell[i]), []).append(i)
        for c, own in home.items():
            own = np.array(own)
            come = np.array(there.get(c, []), np.int64)
            for begin in range(0, len(come), 1000):
                part = come[begin : begin + 1000]
                cosine = (v[part] @ v[own].T) / (norm[part][:, None] * norm[own][None, :])
                a, b = np.nonzero((cosine >= least) & (node[part][:, None] != node[own][None, :]))
                if not len(a):
                    continue
                x, y = part[a], own[b]
                np.add.at(links, x, w[y])
                # y's own sequence counts x unless it does not come to x's cell.
                alone = np.fromiter((int(cell[p]) not in goes[int(q)] for p, q in zip(x, y, strict=True)), bool, len(x))
                np.add.at(links, y[alone], w[x[alone]])
                ids, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
                tree = forest(flat[: len(x)], flat[len(x) :], len(ids))
                xs += [int(node[ids[i]]) for i, _ in tree]
                ys += [int(node[ids[j]]) for _, j in tree]
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([node[some], np.array(xs, np.int64)])),
            "b": pa.array([None] * len(some) + ys, pa.int64()),
            "n": pa.array(np.concatenate([links[some], np.zeros(len(xs), np.int64)])),
        })

    met = scratch.save(dealt.groupBy("part", "salt").applyInArrow(meet, "a long, b long, n long"), "met")
    counts = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    cc = common.components(met.where("b is not null").select("a", "b"), scratch)
    known = nodes.select("label", "v", "node", "w").join(counts, "node", "left").join(cc, "node", "left")
    out = rows.join(known, ["label", "v"], "left").select("vec_id", F.coalesce(F.col("w") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "node", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
