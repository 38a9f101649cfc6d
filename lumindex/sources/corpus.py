"""Posts, taxonomy assignments, query log and change events over the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig

PAGE_IDS = 1_000_000  # pages are numbered from here on


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, post_type, post_status, post_password, post_date_gmt, title, content, excerpt, url.

    Documents are posts, protected by a password where labelled toxic; pages are pages.
    """
    start = F.timestamp_seconds(F.lit(1704067200))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(1))
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left").select(
        F.col("doc_id").alias("post_id"), F.lit("post").alias("post_type"), F.lit("publish").alias("post_status"),
        F.when(F.col("toxic") == 1, "x").otherwise("").alias("post_password"), F.timestamp_seconds(F.unix_timestamp(start) + F.col("doc_id") * 60).alias("post_date_gmt"),
        F.substring(F.substring_index(text, "\n", 1), 1, 80).alias("title"), text.alias("content"),
        F.when(F.col("doc_id") % 2 == 0, F.substring(text, 1, 160)).otherwise("").alias("excerpt"), F.concat(F.lit("/post/"), F.col("doc_id").cast("string")).alias("url"),
    )
    html = F.coalesce("html", F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + PAGE_IDS).alias("post_id"), F.lit("page").alias("post_type"), F.lit("publish").alias("post_status"), F.lit("").alias("post_password"),
        F.timestamp_seconds(F.unix_timestamp(start) + F.col("page_id") * 60).alias("post_date_gmt"), F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"),
        html.alias("content"), F.lit("").alias("excerpt"), "url",
    )
    return docs.unionByName(pages)


def post_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, taxonomy, name: language and source of documents, host of pages."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.expr("stack(2, 'category', lang, 'post_tag', source) as (taxonomy, name)"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + PAGE_IDS).alias("post_id"), F.lit("category").alias("taxonomy"), F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([^/]+)", 1).alias("name"))
    return docs.unionByName(pages).where("name is not null and name <> ''")


def visible(types: list[str] | tuple[str, ...]) -> Column:
    """Published, without password, of an indexed type."""
    return (F.col("post_status") == "publish") & (F.col("post_password") == "") & F.col("post_type").isin(*types)


def eligible(p: DataFrame, cfg: SearchConfig, should_index: Column | None = None) -> DataFrame:
    p = p.where(visible(cfg.post_types))
    return p if should_index is None else p.where(should_index)


def allowed_types(requested: list[str] | str | None, cfg: SearchConfig) -> list[str]:
    """Types to search: all indexed ones if none or the word 'any' is asked for, else the common ones; in a list 'any' is a name like others."""
    if not requested or requested == "any":
        return list(cfg.post_types)
    return [t for t in cfg.post_types if t in ([requested] if isinstance(requested, str) else requested)]


def taxonomy_text(terms: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Names of the indexed taxonomies of each post, joined by spaces in order."""
    return terms.where(F.col("taxonomy").isin(*cfg.taxonomies)).groupBy("post_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("taxonomy_text"))


def posts_with_term(terms: DataFrame, taxonomy: str, name: str) -> DataFrame:
    """Posts to index again when a taxonomy term is edited."""
    return terms.where((F.col("taxonomy") == taxonomy) & (F.col("name") == name)).select("post_id").distinct()


LITERALS = ("the of and", "tion er", "photo studio", "thand", "ition with erea", "le queeux", "und pfein", "an anst of thonre", "zzzzqq thent", "c++ $100", "ciones osrañ", "erinst resh", "reciept")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, q: fixed literals, benchmark items (from 100 on) and first user turns (from 100,000 on)."""
    fixed = spark.createDataFrame([(i + 1, q) for i, q in enumerate(LITERALS)], "query_id long, q string")
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100).alias("query_id"), F.col("text").alias("q"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user' and turn = 0").select((F.col("conv_id") + 100_000).alias("query_id"), F.col("text").alias("q"))
    return fixed.unionByName(items).unionByName(turns)


def texts(p: DataFrame, names: DataFrame, cfg: SearchConfig) -> DataFrame:
    """One row per post: post_id and the enabled fields, as they are stored."""
    joined = p.join(names, "post_id", "left") if "taxonomy" in cfg.fields else p
    return joined.select("post_id", *[F.col("taxonomy_text" if name == "taxonomy" else name) for name in cfg.fields])
