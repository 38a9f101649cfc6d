"""Query planning, scoring and ranking of a whole query log at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SearchConfig
from ..functions import stem
from ..functions import text as tx
from ..sources import corpus
from .index import BROADCAST_ROWS, Index, listed


def query_tokens(queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    """query_id, group_ix, token, last: the first distinct tokens of each query, in order."""
    found = queries.select("query_id", F.posexplode(tx.tokens(F.col("q"), cfg)).alias("at", "token"))
    if cfg.stemming:
        stems = found.select(F.col("token").alias("word")).distinct().withColumn("stem", stem.stem_terms("word")).where(F.char_length("stem") >= cfg.min_token_length)
        found = found.join(stems, found["token"] == stems["word"]).select("query_id", "at", F.col("stem").alias("token"))
    first = found.groupBy("query_id", "token").agg(F.min("at").alias("at"))
    by = Window.partitionBy("query_id")
    ranked = first.withColumn("group_ix", F.row_number().over(by.orderBy("at")) - 1).where(F.col("group_ix") < cfg.max_query_tokens)
    return ranked.withColumn("last", F.col("group_ix") == F.max("group_ix").over(by)).select("query_id", "group_ix", "token", "last")


def exact(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    return tokens.join(terms, tokens["token"] == terms["term"]).select("query_id", "group_ix", "term", "doc_freq")


def most_frequent(found: DataFrame, cap: int, *key: str) -> DataFrame:
    """The ``cap`` most frequent terms of each key; of equal frequency the first in order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("doc_freq"), "term"))
    return found.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def prefix(tokens: DataFrame, terms: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Terms that start with a query's last token.

    Distinct tokens meet the terms' beginnings by equality, so that only matches leave the join; the most frequent are
    chosen for each token once, before the queries that share it get them.
    """
    last = tokens.where("last").select("query_id", "group_ix", "token")
    sizes = F.sequence(F.lit(max(1, cfg.min_token_length)), F.char_length("term"))
    some = terms.where(F.char_length("term") >= max(1, cfg.min_token_length)).select("term", "doc_freq", F.explode(F.transform(sizes, lambda n: F.left("term", n))).alias("token"))
    found = some.join(listed(last.select("token").distinct()), "token")
    return last.join(most_frequent(found, cfg.max_expansions, "token"), "token").select("query_id", "group_ix", "term", "doc_freq")


def fuzzy_tokens(tokens: DataFrame, cfg: SearchConfig) -> DataFrame:
    """The first tokens of a query that typos are allowed in, with the number of edits."""
    some = tokens.withColumn("edits", tx.fuzzy_distance(F.col("token"), cfg)).where("edits > 0")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("group_ix"))
    return some.withColumn("nth", nth).where(F.col("nth") <= cfg.max_fuzzy_tokens).drop("nth")


def fuzzy(tokens: DataFrame, terms: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Other terms within the allowed edits, in bytes. Lengths are the equi-join key: each token asks for the few that it can reach.

    Distinct tokens meet the vocabulary once, however many queries share them.
    """
    some = fuzzy_tokens(tokens, cfg)
    words = some.select("token", "edits").distinct().withColumn("size", F.explode(F.sequence(F.octet_length("token") - F.col("edits"), F.octet_length("token") + F.col("edits"))))
    sized = terms.withColumn("size", F.octet_length("term"))
    a, b = tx.byte_text(F.col("token")), tx.byte_text(F.col("term"))
    near = words.join(sized, "size").where((F.col("term") != F.col("token")) & (F.levenshtein(a, b, 2) >= 0) & (F.levenshtein(a, b, 2) <= F.col("edits")))
    found = some.join(near.select("token", "term", "doc_freq"), "token").select("query_id", "group_ix", "term", "doc_freq")
    if cfg.vocabulary_limit is not None:
        size = terms.limit(cfg.vocabulary_limit + 1).count()
        found = found.where(F.lit(size <= cfg.vocabulary_limit))
    return most_frequent(found, cfg.max_expansions, "query_id", "group_ix")


def expand(tokens: DataFrame, terms: DataFrame, cfg: SearchConfig) -> DataFrame:
    """query_id, group_ix, term, doc_freq: all alternatives of every token."""
    terms = terms.where("doc_freq > 0")
    out = exact(tokens, terms)
    if cfg.prefix_last:
        out = out.unionByName(prefix(tokens, terms, cfg))
    if cfg.fuzzy != "off":
        out = out.unionByName(fuzzy(tokens, terms, cfg))
    return out.dropDuplicates(["query_id", "group_ix", "term"])


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, dl: Column, average: Column, cfg: SearchConfig) -> Column:
    length = F.greatest(dl, F.lit(1))
    return tf * (cfg.bm25_k1 + 1) / (tf + cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * length / F.greatest(average, F.lit(0.0001))))


def fetched(groups: DataFrame, index: Index, cfg: SearchConfig, visible: DataFrame | None = None) -> DataFrame:
    """Postings of the groups' terms in enabled fields of positive weight, of visible posts only. The groups side is the small one."""
    fields = [f for f in cfg.field_numbers() if cfg.weights()[f] > 0]
    rows = index.postings.where(F.col("field").isin(*fields) if fields else F.lit(False)).join(groups, "term")
    return rows if visible is None else rows.join(visible.select("post_id"), "post_id", "left_semi")


def worth(cfg: SearchConfig) -> Column:
    """What a posting adds, of a row with the statistics and doc_freq."""
    weight = F.create_map(*[F.lit(x) for pair in cfg.weights().items() for x in pair])[F.col("field").cast("int")]
    docs = F.greatest(F.col("field_docs")[F.col("field")], F.lit(1))
    average = F.coalesce(F.col("field_tokens")[F.col("field")] / docs, F.greatest("dl", F.lit(1)).cast("double"))
    return idf(F.greatest("doc_count", F.lit(1)), F.col("doc_freq")) * bm25(F.col("tf"), F.col("dl"), average, cfg) * weight


def scores(groups: DataFrame, index: Index, cfg: SearchConfig, visible: DataFrame | None = None) -> DataFrame:
    """query_id, post_id, score (sum over tokens and fields of the best alternative), matched (tokens)."""
    rows = fetched(groups, index, cfg, visible).crossJoin(F.broadcast(index.stats))  # statistics are one row
    best = rows.select("query_id", "post_id", "group_ix", "field", worth(cfg).alias("value")).groupBy("query_id", "post_id", "group_ix", "field").agg(F.max("value").alias("value"))
    per_group = best.groupBy("query_id", "post_id", "group_ix").agg(F.sum("value").alias("value"))
    return per_group.groupBy("query_id", "post_id").agg(F.sum("value").alias("score"), F.count("*").cast("int").alias("matched"))


def gated(scored: DataFrame, tokens: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Posts that match all tokens; where a query has none of them, all posts with scores scaled by coverage."""
    sizes = tokens.groupBy("query_id").agg(F.count("*").cast("int").alias("groups"))
    all_of = scored.join(sizes, "query_id").withColumn("full", F.col("matched") == F.col("groups"))
    has = F.max(F.col("full")).over(Window.partitionBy("query_id"))
    kept = all_of.withColumn("has", has).where(F.col("full") | (~F.col("has") & F.lit(cfg.or_fallback)))
    return kept.select("query_id", "post_id", F.when(F.col("has"), F.col("score")).otherwise(F.col("score") * F.col("matched") / F.greatest("groups", F.lit(1))).alias("score"), "matched", F.col("has").alias("all_tokens"))


def ranked(kept: DataFrame, posts: DataFrame) -> DataFrame:
    """Rank by score (six decimals), then newer, then larger id first; only id and date of posts are read."""
    dated = kept.join(posts.select("post_id", "post_date_gmt"), "post_id", "left").withColumn("score", F.round("score", 6))
    by = Window.partitionBy("query_id")
    order = by.orderBy(F.desc("score"), F.desc_nulls_last("post_date_gmt"), F.desc("post_id"))
    return dated.withColumn("rank", F.row_number().over(order)).withColumn("total", F.count("*").over(by)).select("query_id", "rank", "post_id", "score", "total", "matched", "all_tokens")


def search(queries: DataFrame, index: Index, posts: DataFrame, cfg: SearchConfig, types: list[str] | None = None, hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All hits of all queries: query_id, rank, post_id, score, total, matched, all_tokens. ``hook`` may filter or re-rank them."""
    tokens = query_tokens(queries, cfg)
    visible = posts.where(corpus.visible(corpus.allowed_types(types, cfg) or [""]))
    # Few queries come to the vocabulary and the postings, so that these are not shuffled for them; a token has so many alternatives at most.
    alternatives = 1 + cfg.max_expansions * (int(cfg.prefix_last) + int(cfg.fuzzy != "off"))
    few = tokens.limit(BROADCAST_ROWS + 1).count() * alternatives <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda df: df
    groups = expand(sent(tokens), index.terms, cfg)
    out = ranked(gated(scores(sent(groups), index, cfg, visible), sent(tokens), cfg), posts)
    return hook(out) if hook else out


def page(hits: DataFrame, number: int = 1, per_page: int = 10) -> DataFrame:
    """One page of each query's hits with the number of pages; ``per_page`` of 0 or less gives all."""
    if per_page <= 0:
        return hits.withColumn("pages", F.lit(1).cast("long"))
    first = (number - 1) * per_page
    return hits.where((F.col("rank") > first) & (F.col("rank") <= first + per_page)).withColumn("pages", F.ceil(F.col("total") / per_page))


def status(queries: DataFrame, hits: DataFrame, cfg: SearchConfig, gate: Column | None = None) -> DataFrame:
    """ok, empty or abstain per query: abstain (the caller's own search answers) without tokens or where ``gate`` is false."""
    has = query_tokens(queries, cfg).select("query_id").distinct().withColumn("has", F.lit(True))
    totals = hits.groupBy("query_id").agg(F.max("total").alias("total"))
    asked = F.lit(True) if gate is None else gate
    state = F.when(~asked | F.col("has").isNull(), "abstain").when(F.col("total").isNull(), "empty").otherwise("ok")
    return queries.join(has, "query_id", "left").join(totals, "query_id", "left").select("query_id", state.alias("status"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


# What makes a page query more than a plain search: each of these leaves it to the caller's own search.
SPECIAL = ("orderby", "tax_query", "meta_query", "post__in", "author", "year", "monthnum", "day", "bypass")


def handled(requests: DataFrame, enabled: Column | None = None) -> Column:
    """Whether the engine answers a page request: a main front-end search with words and nothing ``SPECIAL``; columns not there count as unset."""
    has = set(requests.columns)
    out = F.trim(F.coalesce("q", F.lit(""))) != ""
    for flag, want in (("is_main", True), ("is_admin", False)):
        if flag in has:
            out = out & (F.coalesce(flag, F.lit(False)) == want)
    for name in SPECIAL:
        if name in has:
            out = out & F.coalesce(F.col(name).cast("string"), F.lit("")).isin("", "false", "0")
    return out if enabled is None else out & F.coalesce(enabled, F.lit(False))


def valid_request(q: Column, number: Column, per_page: Column) -> Column:
    """Whether an API request may be answered."""
    return (F.trim(q) != "") & (F.octet_length(F.trim(q)) <= 200) & number.between(1, 1000) & per_page.between(1, 50)


def fallback(queries: DataFrame, posts: DataFrame, cfg: SearchConfig) -> DataFrame:
    """The plain search used where the engine abstains: posts whose text holds the trimmed query."""
    seen = posts.where(corpus.visible(cfg.post_types))
    q = F.lower(F.trim("q"))
    holds = F.contains(F.lower("title"), q) | F.contains(F.lower("content"), q) | F.contains(F.lower("excerpt"), q)
    # A stated (broadcast) query set against all rows.
    return seen.join(F.broadcast(queries.where("trim(q) <> ''")), holds).select("query_id", "post_id")


def hits(results: DataFrame, posts: DataFrame, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Hits with what is shown: text is joined last, for the page's rows only, and rows without a post are left out."""
    source = F.coalesce(F.nullif(tx.clean(F.col("excerpt"), cfg.shortcodes), F.lit("")), tx.clean(F.col("content"), cfg.shortcodes))
    joined = results.join(queries, "query_id").join(posts, "post_id")
    label = F.initcap("post_type")
    return joined.select("query_id", "rank", F.col("post_id").alias("id"), "title", "url", F.date_format("post_date_gmt", "yyyy-MM-dd").alias("date"), F.col("post_type").alias("type"), label.alias("type_label"), tx.snippet(source, F.col("q")).alias("snippet"), "score", "total")


def as_json(shown: DataFrame, number: int, per_page: int) -> DataFrame:
    """One JSON document per query: results, total, page, pages."""
    item = F.struct("rank", "id", "title", "url", "date", "type", "type_label", "snippet")
    grouped = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("results"), F.max("total").alias("total"))  # at most per_page rows
    bare = F.transform("results", lambda r: F.struct(*[r[c].alias(c) for c in ("id", "title", "url", "date", "type", "type_label", "snippet")]))
    return grouped.select("query_id", F.to_json(F.struct(bare.alias("results"), "total", F.lit(number).alias("page"), F.ceil(F.col("total") / per_page).alias("pages"))).alias("body"))
