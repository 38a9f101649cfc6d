"""Shared plumbing: scratch tables in the cluster's shared folder, size-checked joins, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of bare keys that a broadcast may hold (about 16 bytes each); larger sides are shuffled instead.
BROADCAST_ROWS = 2_000_000
# Bytes that a broadcast of rows of any length may hold.
BROADCAST_BYTES = 32 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one is made only for a local master without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="lumindex-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts holds, unless the session already asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class Scratch:
    """Intermediate tables as Parquet in the shared folder: lineage is cut and any executor can read them.

    With ``tidy``, what a table's query shuffled is deleted as soon as the table is written; else it stays until the driver
    happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.base = f"{scratch_root(spark)}/lumindex-{name}-{uuid.uuid4().hex[:12]}"
        self.fs().deleteOnExit(self.path(""))

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def fs(self):
        return self.path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        finally:
            if self.tidy:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def free(self, *names: str) -> None:
        for name in names:
            self.fs().delete(self.path(name), True)

    def free_but(self, *names: str) -> None:
        """Delete all tables except those that what is returned still reads."""
        for status in self.fs().listStatus(self.path("")):
            if status.getPath().getName() not in names:
                self.fs().delete(status.getPath(), True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it is counted to hold at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Smallest node reachable from each node of ``edges(a long, b long)``, as ``(node, component)``.

    Alternates large-star and small-star contractions until the edges stop changing; every round is one
    written table, all minima are combined before the shuffle, and nothing is collected but two checksums.
    Isolated nodes do not appear. Null ends and loops are ignored.
    """
    e = scratch.save(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}0",
    )
    seen, i = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(m, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (
            large.join(m2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(m2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        i += 1
        new = scratch.save(small_star, f"{name}{i}")
        now = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        scratch.free(f"{name}{i - 1}")
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stars(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``(a, b)`` of a centre and a node that shares a bucket with it or with one of its neighbours, from ``keyed(key, node)``.

    A bucket's centre is the least of what its members meet as smallest node of any of their buckets, so the many buckets of
    one group of like nodes have one centre or few, and a node meets it once. The table ``member(key, node, a)`` of the buckets
    with several nodes and their smallest one stays in the scratch.
    """
    buckets = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a")
    member = scratch.save(keyed.join(buckets, "key").select("key", "node", "a"), "member")
    near = member.groupBy("node").agg(F.min("a").alias("m"))
    centre = member.join(near, "node").groupBy("key").agg(F.min("m").alias("centre"))
    return scratch.save(member.join(centre, "key").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "stars")
