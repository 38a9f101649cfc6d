"""Packing sequences into token-budget batches over optimal length buckets.

Documents longer than ``max_len`` tokens become several pieces of at most ``max_len``; each piece is padded to the upper
bound of its bucket. Over the global histogram of piece lengths (at most ``max_len`` entries, so small whatever the
input), dynamic programming picks the ``n_buckets`` upper bounds with the least total padding, exactly; of equal
solutions it takes fewer buckets, then smaller bounds. Inside a bucket of bound L, batches hold ``budget // L`` pieces.
Pieces are numbered densely per bucket without gathering a bucket in one task: they are dealt over shards by doc_id, numbered
there, and shifted by the counts of the shards before, so only the last batch of a bucket may be part empty.

Defined results: null and empty documents have no pieces; null lengths count as 0; null doc_ids count as id 0 for the shard only;
repeated rows are separate pieces; further columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, common

SHARD = 50_000  # pieces that one shard numbers
LONG = 4096  # characters of a word or of white space that the library takes
SPACES = re.compile(rf"\s{{{LONG}}}")


def best_bounds(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets with the least padding over ``histogram`` (length -> count)."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    n = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])])
    cost = np.full(len(lengths) + 1, np.iinfo(np.int64).max // 2, np.int64)  # of the first j lengths, tokens after padding
    cost[0] = 0
    back = []
    for _ in range(min(n_buckets, len(lengths))):
        new, cut = cost.copy(), np.full(len(lengths) + 1, -1, np.int64)
        for j in range(1, len(lengths) + 1):
            total = cost[:j] + lengths[j - 1] * (n[j] - n[:j])
            i = int(np.argmin(total))
            if total[i] < new[j]:
                new[j], cut[j] = total[i], i
        back.append(cut)
        cost = new
    out, j = [], len(lengths)
    for cut in back[::-1]:
        if j and cut[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def words(text: Column) -> Column:
    """Number of white-space separated words, a measure of length that needs no vocabulary."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pieces(docs: DataFrame, length: Column, max_len: int) -> DataFrame:
    """One row per piece: doc_id, piece number, its length."""
    n = F.coalesce(length, F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).where("n > 0")
    last = F.floor((F.col("n") - 1) / max_len).cast("int")
    return sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select("doc_id", "piece", F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("piece") * F.lit(max_len).cast("long")).alias("n_tokens"))


def packed(docs: DataFrame, length: Column | None = None, max_len: int = 2048, n_buckets: int = 12, budget: int = 32_768) -> DataFrame:
    """Per piece: doc_id, piece, n_tokens, bucket_len, batch (number in its bucket), slot (place in the batch)."""
    if budget < max_len:
        raise ValueError("a batch must hold at least one sequence of max_len")
    spark = docs.sparkSession
    p = common.Scratch(spark, "packing").save(pieces(docs, words(F.col("text")) if length is None else length, max_len), "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in p.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    bounds = best_bounds(histogram, n_buckets)
    shards = max(1, math.ceil(sum(histogram.values()) / SHARD))
    bucket = F.lit(bounds[-1] if bounds else max_len)
    for b in bounds[-2::-1]:
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    dealt = p.withColumn("bucket_len", bucket.cast("long")).withColumn("shard", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(shards)).cast("int"))
    counts = dealt.groupBy("bucket_len", "shard").agg(F.count("*").alias("n"))  # at most n_buckets rows a shard
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bucket_len").orderBy("shard")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "piece", "n_tokens")) - 1
    place = F.col("before") + F.col("own")
    room = F.floor(F.lit(budget) / F.col("bucket_len"))
    return (
        dealt.withColumn("own", own).join(common.small(before), ["bucket_len", "shard"])
        .select("doc_id", "piece", "n_tokens", "bucket_len", F.floor(place / room).cast("long").alias("batch"), F.pmod(place, room).cast("int").alias("slot"))
    )


@lru_cache(maxsize=4)
def encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lengths", pat_str=bpe.PATTERN, mergeable_ranks=table, special_tokens={})


def token_counts(docs: DataFrame, ranks: str, merges: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id and n_tokens, the tokens of byte-level BPE by the file ``ranks``.

    The library counts; texts with words or white space of over ``LONG`` characters, on which it takes the square of their
    length, are counted by operator 7's transducer with the file ``merges`` of the same vocabulary.
    """
    common.small_batches(docs.sparkSession)

    def run(batches):
        library = encoding(ranks)

        def count(text: str | None) -> int:
            if not text:
                return 0
            if max(map(len, text.split()), default=LONG + 1) > LONG or SPACES.search(text):
                return bpe.transducer(merges).count(text)
            return len(library.encode_ordinary(text))

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(count, b.column(1).to_pylist())), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def packed_tokens(docs: DataFrame) -> DataFrame:
    """``packed`` by byte-level BPE tokens: the registered query and the pipeline's last stage."""
    import public_tokenizers

    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed(counted, F.col("n_tokens"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(common.documents(spark, sf_dir))
