"""Near-duplicate documents by MinHash bands, odd sketches and exact verification.

Words are runs of bytes outside space and 0x09-0x0D of the text with A-Z lower-cased; a document's set holds its distinct
``k``-word shingles as 64-bit hashes, or its whole sequence as one if it has fewer words. Documents with equal sets
become one node. A node's MinHash samples are split into bands; its odd sketch is the parity bitmap of all samples.

Candidates are the nodes that share a band bucket. A bucket's members are never paired with each other: buckets whose
members share smaller neighbours get one common centre (the smallest node two steps away), and each node meets each of
its centres once. The population count of two sketches' XOR and the two sizes leave pairs that may reach the threshold; full
sets confirm them. What a centre does not link meets all others of its centre's buckets by what sets each apart from the
centre (``around``): two sets' symmetric difference is that of these short lists, so sketches leave few pairs, the lists
decide exactly, and a block of a group returns no more than a spanning forest of its links. Nothing leaves a bucket untested.

Defined results: null texts and texts without words have an empty set and link with nothing; an empty table gives no rows;
null doc_ids are kept, with a null component; rows that share a doc_id are one node with several sets; very long texts are
shingled whole (memory follows one text); similarities equal to the threshold link, and of equal candidates the smallest
doc_id names the group; columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROWS = 5  # samples in a band
MISS = 4e-6  # chance that a pair right at the threshold shares no band
WIDTH = 8  # 64-bit words of an odd sketch
SIGMAS = 5.5  # how far below the threshold a sketch may estimate a pair that is still verified
BLOCK = 2000  # members of a centre's group that one block holds
MEMO = 100_000  # words whose hashes a worker remembers at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Word -> 64-bit hash, emptied when it has grown to ``MEMO`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(min(k, len(h))))
    for i in range(min(k, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


class Plan:
    """Bands, sketch and limits for a threshold of ``num / den``."""

    def __init__(self, k: int, num: int, den: int):
        t = num / den
        self.k, self.num, self.den = k, num, den
        self.bands = math.ceil(math.log(MISS) / math.log(1 - t**ROWS))
        self.samples = self.bands * ROWS
        rng = np.random.default_rng(20240607)
        self.a = rng.integers(0, 1 << 63, self.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.samples, dtype=np.uint64)
        # Differing samples expected at the threshold plus some deviations, as set bits of the XOR of two sketches.
        bits, m = 64 * WIDTH, self.samples
        differ = min(m, m * (1 - t) + SIGMAS * math.sqrt(m * t * (1 - t)))
        mean = bits / 2 * (1 - math.exp(-4 * differ / bits))
        self.flips = math.ceil(mean + SIGMAS * math.sqrt(mean) / 2)

    def signature(self, s: np.ndarray) -> tuple[list[int], list[int]]:
        """Band keys and odd sketch of a non-empty set."""
        low = np.full(self.samples, np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(0, len(s), 2048):
            part = s[i : i + 2048]
            np.minimum(low, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1), out=low)
        low = mix(low)
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        rows = low.reshape(self.bands, ROWS)
        for i in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
        spot = mix(low + np.arange(self.samples, dtype=np.uint64)) % np.uint64(64 * WIDTH)
        odd = (np.bincount(spot.astype(np.int64), minlength=64 * WIDTH) & 1).astype(np.uint8)
        return keys.view(np.int64).tolist(), np.packbits(odd).view(np.int64).tolist()


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """Per row: doc_id, n_shingles, fingerprint of the set, band keys, sketch."""

    def run(batches):
        hashes = Hashes()
        for b in batches:
            n, fp, bands, sketch = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, plan.k, hashes)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys, odd = plan.signature(s) if len(s) else (None, None)
                bands.append(keys)
                sketch.append(odd)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "fp", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, fp binary, bands array<long>, sketch array<long>")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """Per row: node (its doc_id), the fingerprint of its set, and the set."""

    def run(batches):
        hashes = Hashes()
        for b in batches:
            found = [shingles(t, k, hashes).view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int64)
            fp = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), fp, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "fp", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, fp binary, s array<long>")


def met(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, plan: Plan, scratch: common.Scratch) -> DataFrame:
    """The pairs with ``link`` (sketches and sizes allow it and the full sets reach the threshold), and of b: n, sketch, and what sets it apart from a."""
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    light = nodes.select("fp", "node", "n", "sketch").join(common.small(ids.withColumnRenamed("doc_id", "node")), "node", "left_semi")
    found = sets(docs.join(common.small(ids), "doc_id", "left_semi"), plan.k).join(light, ["fp", "node"])
    s = scratch.save(found.dropDuplicates(["fp", "node"]).select("node", "n", "s", "sketch"), "sets")
    of = lambda x: s.select(*[F.col(c).alias(c + x) for c in s.columns])
    both = pairs.join(of("_a"), F.col("a") == F.col("node_a")).join(of("_b"), F.col("b") == F.col("node_b"))
    flips = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(WIDTH)), F.lit(0))
    likely = (F.least("n_a", "n_b") * plan.den >= F.greatest("n_a", "n_b") * plan.num) & (flips <= plan.flips)
    same = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    reaches = same * plan.den >= (F.col("n_a") + F.col("n_b") - same) * plan.num
    delta = F.concat(F.array_except("s_a", "s_b"), F.array_except("s_b", "s_a"))
    out = scratch.save(both.select("a", "b", (likely & reaches).alias("link"), F.col("n_b").alias("n"), F.col("sketch_b").alias("sketch"), delta.alias("delta")), "met")
    scratch.free("ids", "sets")
    return out


def around(met: DataFrame, plan: Plan) -> DataFrame:
    """Links between members of a group that its centre does not link: ``(a, b)``.

    Members that are not linked with the centre meet all others, a block of ``BLOCK`` against a block at a time. Of what is not
    connected yet in the block, sizes and sketches leave the pairs that may link, and the lists of differences decide.
    """
    sizes = met.groupBy("a").agg(F.count("*").alias("members"), F.sum(F.when(~F.col("link"), 1).otherwise(0)).alias("loose")).where("loose > 0 and members > 1")
    rows = met.join(sizes, "a").withColumn("rows", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("cols", F.ceil(F.col("loose") / BLOCK).cast("int"))
    place = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["a", "b", "n", "link", "sketch", "delta"]
    targets = rows.withColumn("y", place("rows")).withColumn("x", every("cols")).select(*cols, "x", "y", F.lit(False).alias("probe"))
    probes = rows.where("not link").withColumn("x", place("cols")).withColumn("y", every("rows")).select(*cols, "x", "y", F.lit(True).alias("probe"))

    def meet(t: pa.Table) -> pa.Table:
        flag = lambda name: np.asarray(t.column(name).combine_chunks().to_numpy(zero_copy_only=False), bool)
        probe, linked = flag("probe"), flag("link")
        node, n = t.column("b").to_numpy(), t.column("n").to_numpy()
        sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WIDTH)
        lists = t.column("delta").combine_chunks()
        ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
        size = np.diff(ends)
        at = np.flatnonzero(~probe)
        where = np.repeat(np.arange(len(at)), size[at])
        flat = np.concatenate([values[ends[i] : ends[i + 1]] for i in at]) if len(at) else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        flat, where = flat[order], where[order]
        who, of = np.unique(node, return_inverse=True)
        part = np.arange(len(who))  # what is connected has one number
        part[of[linked]] = len(who)
        a, b = [], []
        for i in np.flatnonzero(probe):
            may = part[of[at]] != part[of[i]]
            may &= np.minimum(n[at], n[i]) * plan.den >= np.maximum(n[at], n[i]) * plan.num
            may[may] = np.bitwise_count(sketch[at[may]] ^ sketch[i]).sum(axis=1) <= plan.flips
            if not may.any():
                continue
            own = values[ends[i] : ends[i + 1]]
            lo, hi = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
            hits = [where[x:z] for x, z in zip(lo.tolist(), hi.tolist(), strict=True) if z > x]
            both = np.bincount(np.concatenate(hits), minlength=len(at)) if hits else np.zeros(len(at), np.int64)
            apart = size[i] + size[at] - 2 * both
            same = (n[i] + n[at] - apart) // 2
            for j in at[may & (same * plan.den >= (n[i] + n[at] - same) * plan.num)]:
                if part[of[i]] != part[of[j]]:
                    part[part == part[of[j]]] = part[of[i]]
                    a.append(int(node[i]))
                    b.append(int(node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # Dealt by the block too: the join above is by centre, which would put all blocks of a group in one task.
    blocks = targets.unionByName(probes).repartition("a", "x", "y")
    return blocks.groupBy("a", "x", "y").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plan, scratch = Plan(k, num, den), common.Scratch(spark, "minhash")
    sigs = scratch.save(signatures(docs, plan), "sigs")
    nodes = scratch.save(
        sigs.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("m"))
        .select("fp", F.col("m.doc_id").alias("node"), F.col("m.n").alias("n"), F.col("m.bands").alias("bands"), F.col("m.sketch").alias("sketch")),
        "nodes",
    )
    pairs = common.stars(nodes.select(F.explode("bands").alias("key"), "node"), scratch)
    scratch.free("member")
    meetings = met(docs, nodes, pairs, plan, scratch)
    placed = scratch.save(sigs.select("doc_id", "n", "fp").join(nodes.select("fp", "node"), "fp", "left").select("doc_id", "n", "node"), "placed")
    # A doc_id whose rows are of several nodes connects these.
    several = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    same_id = placed.join(common.small(several), "doc_id").select("a", F.col("node").alias("b"))
    links = meetings.where("link").select("a", "b").unionByName(around(meetings, plan)).unionByName(same_id)
    result = placed.join(common.components(links, scratch), "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
    result = scratch.save(result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "result")
    scratch.free_but("result")
    return result


def deduplicated(docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each group of near copies (five words, 0.8) stays, with its columns."""
    drop = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(common.small(drop), "doc_id", "left_anti").select(docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), k=3, num=85, den=100)
