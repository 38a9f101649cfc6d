"""The inverted index: vocabulary, postings and statistics as tables, built at once or kept up to date."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions import analyze
from ..sources import corpus

BROADCAST_ROWS = 2_000_000  # ids that are sent to all executors at most


@dataclass(frozen=True)
class Index:
    """postings(term, post_id, field, tf, dl), terms(term, doc_freq), stats (one row), and the settings' hash."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    pipeline_hash: str = ""
    #: The postings as they were counted, with the ``mark`` that vocabulary and statistics are added up by; None if they were read.
    marked: DataFrame | None = None

    def stale(self, cfg: SearchConfig) -> bool:
        return self.pipeline_hash != cfg.pipeline_hash()

    def cached(self) -> Index:
        """Kept in memory or on disk once: postings that were counted here are a view of the marked ones."""
        (self.postings if self.marked is None else self.marked).cache()
        return replace(self, terms=self.terms.cache(), stats=self.stats.cache())

    def free(self) -> None:
        """What ``cached`` kept goes."""
        for df in (self.stats, self.terms, self.postings if self.marked is None else self.marked):
            df.unpersist()

    def version(self) -> DataFrame:
        """Twelve hexadecimal digits that change with the statistics or the settings."""
        key = F.concat_ws(",", "doc_count", "terms", F.lit(self.pipeline_hash))
        return self.stats.select(F.substring(F.md5(F.concat(F.lit("["), key, F.lit("]"))), 1, 12).alias("version"))

    def write(self, path: str) -> None:
        """Postings and vocabulary sorted by term within hash partitions of it, so that lookups prune row groups."""
        self.postings.repartition("term").sortWithinPartitions("term", "post_id", "field").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.withColumn("pipeline_hash", F.lit(self.pipeline_hash)).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        stats = spark.read.parquet(f"{path}/stats")
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), stats.drop("pipeline_hash"), stats.first()["pipeline_hash"])


def listed(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` with a broadcast hint when counted to hold at most ``rows`` rows, so that texts and postings are not shuffled for them; else as they are."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def postings_of(texts: DataFrame, cfg: SearchConfig, general: bool = False) -> DataFrame:
    """term, post_id, field, tf, dl, mark of ``texts(post_id, one column for each field)``.

    A post's terms are counted where its row is, so that no posting is shuffled or sorted. Rows that share a post_id are one
    post: they alone are brought together first.
    """
    key = texts.select("post_id")
    twice = key.groupBy("post_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("post_id").alias("id"))
    if not twice.isEmpty():
        twice, same = listed(twice), F.col("post_id").eqNullSafe(F.col("id"))
        texts = texts.join(twice, same, "left_anti").unionByName(texts.join(twice, same, "left_semi").repartition("post_id").sortWithinPartitions("post_id"))
    return texts.mapInArrow(analyze.analyzer(cfg, general, analyze.unknown(texts.sparkSession)), analyze.SCHEMA)


def marked_vocabulary(marked: DataFrame) -> DataFrame:
    """``vocabulary`` by marks: each post has one row of a term that counts."""
    return marked.where(F.col("mark").bitwiseAND(analyze.TERM) != 0).groupBy("term").agg(F.count("*").alias("doc_freq"))


def marked_counts(marked: DataFrame) -> DataFrame:
    """``counts`` by marks."""
    of_field = F.struct(F.col("field"), F.col("dl").cast("long").alias("tokens"), F.lit(1).cast("long").alias("docs"))
    of_post = F.struct(F.lit(None).cast("tinyint").alias("field"), F.lit(0).cast("long").alias("tokens"), F.lit(1).cast("long").alias("docs"))
    each = F.when(F.col("mark").bitwiseAND(analyze.POST) != 0, F.array(of_field, of_post)).otherwise(F.array(of_field))
    heads = marked.where(F.col("mark").bitwiseAND(analyze.FIELD) != 0).select(F.inline(each))
    return heads.groupBy("field").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """Posts in which each term occurs, over all fields."""
    return postings.select("term", "post_id").distinct().groupBy("term").agg(F.count("*").alias("doc_freq"))


def statistics(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: doc_count, terms, and per field the sum of lengths and the number of posts that have it."""
    return from_counts(counts(postings), terms)


def counts(postings: DataFrame) -> DataFrame:
    """What statistics add up: per field the sum of lengths and the number of posts, and the posts of all fields in a row of field null."""
    per_field = postings.select("post_id", "field", "dl").distinct()
    posts = per_field.select("post_id").distinct().agg(F.lit(None).cast("tinyint").alias("field"), F.lit(0).cast("long").alias("tokens"), F.count("*").alias("docs"))
    return per_field.groupBy("field").agg(F.sum("dl").alias("tokens"), F.count("*").alias("docs")).unionByName(posts)


def from_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Statistics from ``counts``; fields without posts go."""
    has = F.col("field").isNotNull() & (F.col("docs") > 0)
    of = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.when(has, F.struct("field", c))))).alias(f"field_{c}")
    doc_count = F.coalesce(F.sum(F.when(F.col("field").isNull(), F.col("docs"))), F.lit(0)).alias("doc_count")
    sums = rows.agg(doc_count, of("tokens"), of("docs"))
    return sums.crossJoin(terms.agg(F.count("*").alias("terms"))).select("doc_count", "terms", "field_tokens", "field_docs")


def counted_back(stats: DataFrame) -> DataFrame:
    """The rows of ``counts`` that statistics were made from."""
    fields = stats.select(F.explode("field_tokens").alias("field", "tokens"), "field_docs").select("field", "tokens", F.col("field_docs")[F.col("field")].alias("docs"))
    return fields.unionByName(stats.select(F.lit(None).cast("tinyint").alias("field"), F.lit(0).cast("long").alias("tokens"), F.col("doc_count").alias("docs")))


def build(posts: DataFrame, post_terms: DataFrame, cfg: SearchConfig, should_index: Column | None = None, general: bool = False) -> Index:
    p = corpus.eligible(posts, cfg, should_index)
    marked = postings_of(corpus.texts(p, corpus.taxonomy_text(post_terms, cfg), cfg), cfg, general)
    terms = marked_vocabulary(marked)
    return Index(marked.drop("mark"), terms, from_counts(marked_counts(marked), terms), cfg.pipeline_hash(), marked)


def upsert(index: Index, changed: DataFrame, posts: DataFrame, post_terms: DataFrame, cfg: SearchConfig) -> Index:
    """The index after the posts of ``changed(post_id)`` were edited, hidden or deleted: their old rows go, what is eligible now comes.

    Vocabulary and statistics change by what left and what came; terms and fields that lose their last post go.
    """
    ids = listed(changed.select("post_id").distinct())
    fresh = build(posts.join(ids, "post_id", "left_semi"), post_terms.join(ids, "post_id", "left_semi"), cfg)
    postings = index.postings.join(ids, "post_id", "left_anti").unionByName(fresh.postings)
    gone = (index.postings if index.marked is None else index.marked).join(ids, "post_id", "left_semi")
    went, less = (vocabulary(gone), counts(gone)) if index.marked is None else (marked_vocabulary(gone), marked_counts(gone))
    delta = fresh.terms.unionByName(went.withColumn("doc_freq", -F.col("doc_freq")))
    terms = index.terms.unionByName(delta).groupBy("term").agg(F.sum("doc_freq").alias("doc_freq")).where("doc_freq > 0")
    less = less.withColumns({"tokens": -F.col("tokens"), "docs": -F.col("docs")})
    rows = counted_back(index.stats).unionByName(marked_counts(fresh.marked)).unionByName(less).groupBy("field").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
    return Index(postings, terms, from_counts(rows, terms), cfg.pipeline_hash())


def missing_terms(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that the vocabulary lacks."""
    return wanted.select("term").distinct().join(terms, "term", "left_anti")


def progress(done: int, total: int) -> int:
    """Percent of a rebuild."""
    return 100 if total <= 0 else min(100, done * 100 // total)


def settings_json(cfg: SearchConfig) -> str:
    from dataclasses import asdict

    return json.dumps(asdict(cfg), sort_keys=True)
