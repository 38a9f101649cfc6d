"""As-you-type suggestions: the title payload, matching over titles, and the merge with full search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SearchConfig
from ..functions import text as tx
from ..sources import corpus
from . import index as ix
from . import search

KEPT: list[ix.Index] = []  # the last index of titles
CAP = 10_000  # titles in the payload, newest first: a limit that is the feature


def docs(posts: DataFrame, cfg: SearchConfig, cap: int = CAP) -> DataFrame:
    """id, title, url, type_label of the newest visible posts."""
    newest = posts.where(corpus.visible(cfg.post_types)).orderBy(F.desc("post_date_gmt"), F.desc("post_id")).limit(cap)
    return newest.select(F.col("post_id").alias("id"), "title", "url", F.initcap("post_type").alias("type_label"))


def payload(posts: DataFrame, index: ix.Index, cfg: SearchConfig, cap: int = CAP) -> DataFrame:
    """One JSON document per title, with the index version, for conditional requests."""
    return docs(posts, cfg, cap).crossJoin(F.broadcast(index.version())).select("version", "id", F.to_json(F.array(F.col("id").cast("string"), "title", "url", "type_label")).alias("doc"))


def changed_since(versioned: DataFrame, known: str) -> DataFrame:
    """The payload, or nothing if the caller has this version."""
    return versioned.where(F.col("version") != known)


def title_index(posts: DataFrame, cfg: SearchConfig) -> tuple[ix.Index, SearchConfig]:
    only = replace(cfg, fields=("title",), taxonomies=(), or_fallback=False)
    spark = posts.sparkSession
    return ix.build(posts, spark.createDataFrame([], "post_id long, taxonomy string, name string"), only), only


def suggest(queries: DataFrame, posts: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Titles that match by prefix or typo, best first, for queries long enough. The index of titles is kept until the next call."""
    index, only = title_index(posts, cfg)
    while KEPT:
        kept = KEPT.pop()
        if kept.terms.sparkSession is posts.sparkSession:
            kept.free()
    KEPT.append(index := index.cached())
    long = queries.where(F.char_length(F.trim("q")) >= max(1, cfg.min_token_length))
    return search.search(long, index, posts, only).where(F.col("rank") <= cfg.typeahead_max).select("query_id", "rank", F.col("post_id").alias("id"))


def merged(server: DataFrame, local: DataFrame, most: int) -> DataFrame:
    """Server suggestions first, local ones fill up, no id twice: query_id, rank, id."""
    both = server.select("query_id", "id", "rank", F.lit(0).alias("side")).unionByName(local.join(server.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "rank", F.lit(1).alias("side")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("side", "rank", "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "id")


def highlighted(title, q):
    """Client marks: words split at white space and punctuation only."""
    words = F.filter(F.split(q, r"[\s\p{P}]+"), lambda w: w != "")
    longest = F.slice(F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.char_length(w)).alias("n"), i.alias("i"), w.alias("w")))), lambda s: s["w"]), 1, 10)
    return tx.mark(tx.escape_html(title), longest)
