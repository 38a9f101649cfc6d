"""Keeping an index up to date from a stream of change events."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SearchConfig
from ..operators import index as ix

CHANGES = "event_time timestamp, post_id long, kind string, old_status string, new_status string"


def relevant(changes: DataFrame) -> DataFrame:
    """Change events that can alter the index: no revisions, and status changes only if something became or stays published."""
    same = F.coalesce(F.col("new_status") == F.col("old_status"), F.lit(False)) & (F.col("new_status") != "publish")
    return changes.where(~F.col("kind").isin("revision", "autosave") & ~same & F.col("post_id").isNotNull())


def dirty(changes: DataFrame) -> DataFrame:
    """The distinct posts to index again, with the time of their last event."""
    return relevant(changes).groupBy("post_id").agg(F.max("event_time").alias("last_event"))


class Versions:
    """Index versions in one folder: ``v<number>`` directories; the last whole one is current.

    A rebuild or a batch takes the number after the current one, writes its directory and then a marker, so readers never see
    half of one. A batch notes its number first: run again after a failure, it writes the same version anew, from the
    version before it, unless a newer one has come meanwhile.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))

    def current(self, before: int | None = None) -> ix.Index | None:
        found = [n for n in self.numbers() if before is None or n < before]
        return ix.Index.read(self.spark, f"{self.folder}/v{found[-1]}") if found else None

    def put(self, index: ix.Index, number: int) -> None:
        fs = self._fs()
        fs.delete(self._path(f"v{number}.done"), False)
        index.write(f"{self.folder}/v{number}")
        fs.create(self._path(f"v{number}.done")).close()

    def next(self) -> int:
        return (self.numbers() or [-1])[-1] + 1

    def claimed(self, batch: str) -> int:
        """The number of a batch: the one that it noted, if nothing newer is there, or else the next."""
        fs, last = self._fs(), (self.numbers() or [-1])[-1]
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))] if fs.exists(self._path("")) else []
        noted = [int(n.rpartition("_v")[2]) for n in names if n.startswith(f"batch_{batch}_v")]
        if noted and max(noted) >= last:
            return max(noted)
        number = last + 1
        fs.create(self._path(f"batch_{batch}_v{number}")).close()
        return number

    def drop(self) -> None:
        """All versions go; settings are kept elsewhere."""
        self._fs().delete(self._path(""), True)

    def prune(self, keep: int = 2) -> None:
        for n in self.numbers()[:-keep]:
            self._fs().delete(self._path(f"v{n}.done"), False)
            self._fs().delete(self._path(f"v{n}"), True)
        last = (self.numbers() or [-1])[-1]
        for s in self._fs().listStatus(self._path("")) if last >= 0 else []:
            name = s.getPath().getName()
            if name.startswith("batch_") and int(name.rpartition("_v")[2]) < last:
                self._fs().delete(s.getPath(), False)


def rebuild(versions: Versions, posts: DataFrame, post_terms: DataFrame, cfg: SearchConfig, number: int | None = None, done: Callable[[], None] | None = None) -> ix.Index:
    """A full build as the version after the current one, which answers until the new one is whole; batches follow on."""
    versions.put(ix.build(posts, post_terms, cfg), versions.next() if number is None else number)
    if done:
        done()
    return versions.current()


def apply_batch(versions: Versions, changes: DataFrame, batch: int, load: Callable[[], tuple[DataFrame, DataFrame]], cfg: SearchConfig, stream: str = "") -> None:
    """One micro-batch: distinct posts, then an upsert on the version before. A stale or missing index is built anew."""
    posts, post_terms = load()
    number = versions.claimed(f"{stream}{batch}")
    old = versions.current(before=number)
    new = ix.build(posts, post_terms, cfg) if old is None or old.stale(cfg) else ix.upsert(old, dirty(changes), posts, post_terms, cfg)
    versions.put(new, number)
    versions.prune()


def start(changes: DataFrame, versions: Versions, load, cfg: SearchConfig, checkpoint: str, delay: str = "60 seconds", once: bool = False):
    """The streaming query. The trigger interval is the debounce: what comes in between is one batch."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8] + "-"
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: apply_batch(versions, df, batch, load, cfg, stream))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=delay)).start()


def debounced(events: DataFrame, key: str = "user_id", time: str = "ts", value: str = "event_id", wait: str = "200 milliseconds") -> DataFrame:
    """The last event of each burst in which no gap is longer than ``wait``."""
    return events.groupBy(key, F.session_window(time, wait).alias("w")).agg(F.max(F.struct(time, value)).alias("m")).select(key, F.col("m")[time].alias(time), F.col("m")[value].alias(value))


def latest(responses: DataFrame, key: str, token: str) -> DataFrame:
    """Of each key's responses, that of the newest request only."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(token)))
    return responses.withColumn("nth", nth).where("nth = 1").drop("nth")
