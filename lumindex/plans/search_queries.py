"""Registered search queries, over whole tables, and their SQL twins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STOPWORDS, SearchConfig
from ..functions import stem
from ..functions import text as tx
from ..operators import index as ix
from ..operators import search, shards, typeahead
from ..sources import corpus
from ..streaming import maintain, throttle

CFG = SearchConfig()
PLAIN = replace(CFG, fuzzy="off", prefix_last=False)
INDEXES: dict = {}


def literal_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, q) for i, q in enumerate(corpus.LITERALS)], "query_id long, q string")


def kept(spark: SparkSession, name: str, sf_dir: str, make) -> ix.Index:
    """An index built once a session and input; that of the input before is let go."""
    session, key = spark.sparkContext.applicationId, (name, sf_dir)
    for old in [k for k in INDEXES if k[0] != session or k[2] != sf_dir]:
        gone = INDEXES.pop(old)
        if old[0] == session:
            gone.free()
    if (session, *key) not in INDEXES:
        INDEXES[(session, *key)] = make().cached()
    return INDEXES[(session, *key)]


def small_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The four-field index."""
    return kept(spark, "small", sf_dir, lambda: ix.build(corpus.posts(spark, sf_dir), corpus.post_terms(spark, sf_dir), CFG))


def stemmed_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    return kept(spark, "stemmed", sf_dir, lambda: ix.build(corpus.posts(spark, sf_dir), corpus.post_terms(spark, sf_dir), replace(CFG, stemming=True)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits with snippets of the literal query log."""
    posts, queries = corpus.posts(spark, sf_dir), literal_queries(spark)
    found = search.page(search.search(queries, small_index(spark, sf_dir), posts, CFG))
    return search.hits(found, posts, queries, CFG)


def _queries():
    posts, names, index = corpus.posts, corpus.post_terms, small_index
    lit = literal_queries

    def toks(spark):
        return search.query_tokens(lit(spark), CFG)

    def hits(spark, d, cfg, queries=None):
        return search.search(lit(spark) if queries is None else queries, index(spark, d), posts(spark, d), cfg)

    def tokenize_terms(spark, d):
        return corpus.table(spark, d, "documents").select("doc_id", F.posexplode(tx.split(F.col("text"))).alias("pos", "token")).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")

    def stats(spark, d):
        i = index(spark, d)
        return i.stats.select("doc_count", "terms", F.explode("field_tokens").alias("field", "tokens"), "field_docs").select("doc_count", "terms", F.col("field").cast("int").alias("field"), F.col("tokens").cast("long").alias("tokens"), F.col("field_docs")[F.col("field")].alias("docs"), F.round(F.col("tokens") / F.greatest(F.col("field_docs")[F.col("field")], F.lit(1)), 6).alias("average"))

    def ranked(spark, d, cfg, queries=None):
        return hits(spark, d, cfg, queries).select("query_id", F.col("rank").cast("long").alias("rank"), "post_id", "score", F.col("total").cast("long").alias("total"))

    def changes(spark, d):
        kind = F.when(F.col("event_type") == "view", "revision").when(F.col("event_type") == "error", "delete").otherwise("upsert")
        return corpus.table(spark, d, "events").select(F.col("ts").alias("event_time"), F.col("user_id").alias("post_id"), kind.alias("kind"), F.lit("publish").alias("old_status"), F.when(F.col("event_type") == "error", "trash").otherwise("publish").alias("new_status"))

    def incremental(spark, d):
        p, n = posts(spark, d), names(spark, d)
        old = p.withColumn("title", F.when(F.col("post_id") % 7 == 0, F.lit("old title words")).otherwise(F.col("title"))).where("post_id % 11 <> 3")
        changed = p.where("post_id % 7 = 0 or post_id % 11 = 3").select("post_id")
        return ix.upsert(kept(spark, "older", d, lambda: ix.build(old, n, CFG)), changed, p, n, CFG).terms.select("term", "doc_freq")

    def suggest_merge(spark, d):
        server = hits(spark, d, PLAIN).where("rank <= 5").select("query_id", "rank", F.col("post_id").alias("id"))
        local = typeahead.suggest(lit(spark), posts(spark, d), CFG)
        return typeahead.merged(server, local, CFG.typeahead_max).select("query_id", F.col("rank").cast("long").alias("rank"), "id")

    def snippets(spark, d):
        docs = corpus.table(spark, d, "documents").select("doc_id", "text")
        return docs.withColumn("q", F.concat_ws(" ", F.get(F.split(F.trim("text"), r"\s+"), 2), F.lit("the"))).select("doc_id", tx.snippet(F.col("text"), F.col("q")).alias("snippet"))

    def requests(spark, d):
        ev = corpus.table(spark, d, "events")
        user = F.col("user_id").cast("string")
        return ev.select(F.col("event_id").alias("request_id"), throttle.bucket(user, "a").alias("visitor"), throttle.bucket((F.col("user_id") % 97).cast("string"), "b").alias("connection"), "ts")

    return {
        "search_hits": lambda s, d: flagship(s, d).select("query_id", "id", "title", "snippet", F.round("score", 6).alias("score")),
        "tokenize_terms": tokenize_terms,
        "clean_pages": lambda s, d: corpus.table(s, d, "pages").select("page_id", tx.clean(F.col("html")).alias("content")),
        "clean_pages_general": lambda s, d: corpus.table(s, d, "pages").select("page_id", tx.clean(F.col("html"), general=True).alias("content")),
        "fold_terms": lambda s, d: corpus.table(s, d, "documents").select("doc_id", F.lower(tx.fold(F.col("text"))).alias("folded")),
        "term_frequencies": lambda s, d: index(s, d).postings.select("term", "post_id", F.col("field").cast("int").alias("field"), F.col("tf").cast("long").alias("tf")),
        "field_lengths": lambda s, d: index(s, d).postings.select("post_id", F.col("field").cast("int").alias("field"), F.col("dl").cast("long").alias("dl")).distinct(),
        "doc_freq": lambda s, d: index(s, d).terms.select("term", "doc_freq"),
        "corpus_stats": stats,
        "vocabulary_size": lambda s, d: index(s, d).terms.where("doc_freq > 0").agg(F.count("*").alias("terms")),
        "eligible_posts": lambda s, d: corpus.eligible(posts(s, d), CFG).select("post_id", "post_type"),
        "eligible_count": lambda s, d: corpus.eligible(posts(s, d), CFG).agg(F.count("*").alias("n")),
        "post_types": lambda s, d: posts(s, d).select("post_type").distinct(),
        "taxonomy_text": lambda s, d: corpus.taxonomy_text(names(s, d), CFG),
        "posts_with_term": lambda s, d: corpus.posts_with_term(names(s, d), "category", "de"),
        "query_tokens": lambda s, d: search.query_tokens(corpus.query_log(s, d), CFG).select("query_id", F.col("group_ix").cast("long").alias("group_ix"), "token"),
        "token_caps": lambda s, d: search.fuzzy_tokens(search.query_tokens(corpus.query_log(s, d), CFG), CFG).select("query_id", F.col("group_ix").cast("long").alias("group_ix"), "token", F.col("edits").cast("long").alias("edits")),
        "fuzzy_distance": lambda s, d: index(s, d).terms.select("term", tx.fuzzy_distance(F.col("term"), CFG).cast("long").alias("edits")),
        "exact_lookup": lambda s, d: search.exact(toks(s), index(s, d).terms).select("query_id", "term", "doc_freq"),
        "prefix_expand": lambda s, d: search.prefix(toks(s), index(s, d).terms, CFG).select("query_id", "term", "doc_freq"),
        "fuzzy_expand": lambda s, d: search.fuzzy(toks(s), index(s, d).terms, CFG).select("query_id", F.col("group_ix").cast("long").alias("group_ix"), "term", "doc_freq"),
        "candidate_union": lambda s, d: search.expand(toks(s), index(s, d).terms, CFG).select("query_id", F.col("group_ix").cast("long").alias("group_ix"), "term", "doc_freq"),
        "idf": lambda s, d: index(s, d).terms.crossJoin(F.broadcast(index(s, d).stats)).select("term", F.round(search.idf(F.col("doc_count"), F.col("doc_freq")), 6).alias("idf")),
        "postings_visible": lambda s, d: search.fetched(search.expand(toks(s), index(s, d).terms, PLAIN), index(s, d), PLAIN, posts(s, d).where(corpus.visible(["page"]))).select("query_id", "term", "post_id", F.col("field").cast("int").alias("field")),
        "bm25_exact": lambda s, d: ranked(s, d, PLAIN),
        "bm25_and": lambda s, d: ranked(s, d, replace(PLAIN, or_fallback=False)),
        "bm25_single_field": lambda s, d: ranked(s, d, replace(PLAIN, fields=("content",), taxonomies=())),
        "bm25_zero_weight": lambda s, d: ranked(s, d, replace(PLAIN, weight_title=0.0)),
        "search_ranked": lambda s, d: ranked(s, d, CFG),
        "query_log_topk": lambda s, d: shards.top(corpus.query_log(s, d), index(s, d), posts(s, d), PLAIN, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "post_id", "score", F.col("total").cast("long").alias("total")),
        "ranked_page": lambda s, d: search.page(hits(s, d, PLAIN), 2, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "post_id", F.col("pages").cast("long").alias("pages")),
        "query_status": lambda s, d: search.status(lit(s), hits(s, d, PLAIN), PLAIN),
        "contains_fallback": lambda s, d: search.fallback(lit(s), posts(s, d), CFG),
        "search_json": lambda s, d: search.as_json(search.hits(search.page(hits(s, d, PLAIN)), posts(s, d), lit(s), CFG), 1, 10),
        "missing_terms": lambda s, d: ix.missing_terms(toks(s).select(F.col("token").alias("term")), index(s, d).terms),
        "typeahead_docs": lambda s, d: typeahead.docs(posts(s, d), CFG),
        "typeahead_payload": lambda s, d: typeahead.payload(posts(s, d), index(s, d), CFG),
        "typeahead_suggest": lambda s, d: typeahead.suggest(lit(s), posts(s, d), CFG),
        "suggest_merge": suggest_merge,
        "snippet": snippets,
        "highlight_words": lambda s, d: corpus.query_log(s, d).select("query_id", F.array_join(tx.highlight_words(F.col("q")), "|").alias("words")),
        "index_version": lambda s, d: index(s, d).version(),
        "incremental_upsert": incremental,
        "dirty_queue": lambda s, d: maintain.dirty(changes(s, d)).select("post_id"),
        "session_debounce": lambda s, d: maintain.debounced(corpus.table(s, d, "events"), wait="10 minutes").select("user_id", "event_id"),
        "latest_response": lambda s, d: maintain.latest(corpus.table(s, d, "events").select("user_id", "event_id"), "user_id", "event_id"),
        "stem_terms": lambda s, d: index(s, d).terms.select("term", stem.stem_terms("term").alias("stem")),
        "stemmed_search": lambda s, d: search.search(lit(s), stemmed_index(s, d), posts(s, d), replace(PLAIN, stemming=True)).select("query_id", "rank", "post_id", "score"),
        "throttle": lambda s, d: throttle.throttled(requests(s, d), limit=3, window=3600.0).select("request_id", "accepted"),
    }


QUERIES = _queries()


# ---- the same in DuckDB SQL -------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
QUERY_ROWS = ", ".join(f"({i + 1}, '{q}')" for i, q in enumerate(corpus.LITERALS))
RE_SPLIT = r"[\p{Z}\p{P}\p{C}\s]+"


def sql_replace(x: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


# Written out, not imported: DuckDB strips what decomposes, these are the rest.
SQL_FOLD_FROM = "ØøĐđĦħıĸŁłŊŋŦŧŉĿŀſɑªº€£"
SQL_FOLD_TO = "OoDdHhikLlNnTtnLlsaaoE"
SQL_FOLD_MORE = {"ß": "s", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "ĳ": "ij", "Ĳ": "IJ"}


def sql_fold(x: str) -> str:
    return f"lower(strip_accents({sql_replace(f'''translate({x}, '{SQL_FOLD_FROM}', '{SQL_FOLD_TO}')''', SQL_FOLD_MORE)}))"


def sql_split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({sql_fold(x)}, '{RE_SPLIT}'), lambda t: t <> '')"


def sql_tokens(x: str) -> str:
    return f"list_filter({sql_split(x)}, lambda t: length(t) >= 2 AND t NOT IN ({STOP}))"


def sql_clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    for p in (r"<!--\s*/?wp:.*?-->", r"<!--.*?-->"):
        x = f"regexp_replace({x}, '{p}', ' ', 'gs')"
    for tag in ("script", "style"):
        x = rf"regexp_replace({x}, '<{tag}\b[^>]*>.*?</{tag}>', ' ', 'gsi')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({sql_replace(x, tx.ENTITIES)}, '[\s\p{{Z}}]+', ' ', 'g'))"


BASE = f"""
q(query_id, q) AS (VALUES {QUERY_ROWS}),
log AS (SELECT CAST(query_id AS BIGINT) AS query_id, q FROM q UNION ALL SELECT item_id + 100, text FROM benchmark
        UNION ALL SELECT conv_id + 100000, text FROM conversations WHERE role = 'user' AND turn = 0),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
posts AS (
  SELECT doc_id AS post_id, 'post' AS post_type, doc_id IN (FROM toxic) AS hidden, doc_id AS minutes,
         substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) AS title, coalesce(text, '') AS content,
         CASE WHEN doc_id % 2 = 0 THEN substr(coalesce(text, ''), 1, 160) ELSE '' END AS excerpt, '/post/' || doc_id AS url FROM documents
  UNION ALL
  SELECT page_id + {corpus.PAGE_IDS}, 'page', false, page_id, regexp_extract(coalesce(html, ''), '<title>(.*?)</title>', 1, 's'), coalesce(html, ''), '', url FROM pages),
names AS (
  SELECT doc_id AS post_id, 'category' AS taxonomy, lang AS name FROM documents UNION ALL SELECT doc_id, 'post_tag', source FROM documents
  UNION ALL SELECT page_id + {corpus.PAGE_IDS}, 'category', regexp_extract(coalesce(url, ''), '^[a-z]+://([^/]+)', 1) FROM pages),
taxonomy AS (SELECT post_id, string_agg(name, ' ' ORDER BY name) AS taxonomy_text FROM names WHERE name <> '' GROUP BY 1),
seen AS (SELECT * FROM posts WHERE NOT hidden)"""

INDEX = f"""{BASE},
fields AS (
  SELECT post_id, 0 AS field, title AS text FROM seen
  UNION ALL SELECT post_id, 1, {sql_clean('content')} FROM seen UNION ALL SELECT post_id, 2, {sql_clean('excerpt')} FROM seen
  UNION ALL SELECT post_id, 3, taxonomy_text FROM seen JOIN taxonomy USING (post_id)),
tokens AS (SELECT post_id, field, {sql_tokens('text')} AS ts FROM fields),
postings AS MATERIALIZED (SELECT post_id, field, CAST(len(ts) AS BIGINT) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(ts) AS term FROM tokens) GROUP BY ALL),
terms AS MATERIALIZED (SELECT term, count(DISTINCT post_id) AS doc_freq FROM postings GROUP BY 1),
per_field AS (SELECT field, sum(dl) AS tokens, count(*) AS docs FROM (SELECT DISTINCT post_id, field, dl FROM postings) GROUP BY 1),
doc_count AS (SELECT count(DISTINCT post_id) AS n FROM postings)"""


def query_side(log: str = "q") -> str:
    return f"""
qt0 AS (SELECT query_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS nth FROM (SELECT CAST(query_id AS BIGINT) AS query_id, {sql_tokens('q')} AS ts FROM {log})),
qt1 AS (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY min(nth)) - 1 AS group_ix FROM qt0 GROUP BY 1, 2),
qt AS (SELECT *, group_ix = max(group_ix) OVER (PARTITION BY query_id) AS last FROM qt1 WHERE group_ix < 16)"""


FUZZY = """
edits AS (SELECT *, CASE WHEN strlen(token) < 4 THEN 0 WHEN strlen(token) >= 8 THEN 2 ELSE 1 END AS edits FROM qt),
fz AS (SELECT * FROM edits WHERE edits > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY group_ix) <= 6)"""
EXACT = "SELECT query_id, group_ix, term, doc_freq FROM qt JOIN terms ON token = term"
PREFIX = "SELECT query_id, group_ix, term, doc_freq FROM qt JOIN terms ON starts_with(term, token) WHERE last QUALIFY row_number() OVER (PARTITION BY query_id, group_ix ORDER BY doc_freq DESC, term) <= 50"
TYPOS = "SELECT query_id, group_ix, term, doc_freq FROM fz JOIN terms ON abs(strlen(term) - strlen(token)) <= edits AND term <> token AND levenshtein(term, token) <= edits QUALIFY row_number() OVER (PARTITION BY query_id, group_ix ORDER BY doc_freq DESC, term) <= 50"


def scored(groups: str, fields: str = "0, 1, 2, 3", log: str = "q", base: str = INDEX, types: str = "'post', 'page'", fallback: bool = True) -> str:
    """CTEs up to ``r(query_id, rank, post_id, score, total)``."""
    return f"""WITH {base},{query_side(log)},{FUZZY},
grp AS ({groups}),
v AS (SELECT query_id, p.post_id, group_ix, p.field, max(ln((n - doc_freq + 0.5) / (doc_freq + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(0.0001, tokens / docs)))
      * CASE p.field WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 ELSE 2.0 END) AS value
      FROM grp JOIN postings p USING (term) JOIN per_field USING (field) CROSS JOIN doc_count JOIN seen USING (post_id)
      WHERE p.field IN ({fields}) AND post_type IN ({types}) GROUP BY 1, 2, 3, 4),
s AS (SELECT query_id, post_id, sum(value) AS score, count(DISTINCT group_ix) AS matched FROM v GROUP BY 1, 2),
g AS (SELECT s.*, groups, max(CAST(matched = groups AS INT)) OVER (PARTITION BY query_id) AS has FROM s JOIN (SELECT query_id, count(*) AS groups FROM qt GROUP BY 1) USING (query_id)),
k AS (SELECT query_id, post_id, round(CASE WHEN has = 1 THEN score ELSE score * matched / groups END, 6) AS score FROM g WHERE matched = groups {'OR has = 0' if fallback else ''}),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, minutes DESC, post_id DESC) AS rank, post_id, score, count(*) OVER (PARTITION BY query_id) AS total
      FROM k JOIN posts USING (post_id))
"""


RANKED = "SELECT query_id, rank, post_id, score, total FROM r"

ORACLES = {
    "tokenize_terms": f"SELECT doc_id, CAST(generate_subscripts(ts, 1) - 1 AS BIGINT) AS pos, unnest(ts) AS token FROM (SELECT doc_id, {sql_split('text')} AS ts FROM documents)",
    "clean_pages": f"SELECT page_id, {sql_clean('html')} AS content FROM pages",
    "fold_terms": f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents",
    "term_frequencies": f"WITH {INDEX} SELECT term, post_id, field, tf FROM postings",
    "field_lengths": f"WITH {INDEX} SELECT DISTINCT post_id, field, dl FROM postings",
    "doc_freq": f"WITH {INDEX} SELECT term, doc_freq FROM terms",
    "corpus_stats": f"WITH {INDEX} SELECT n AS doc_count, (SELECT count(*) FROM terms) AS terms, field, CAST(tokens AS BIGINT) AS tokens, docs, round(tokens / docs, 6) AS average FROM per_field CROSS JOIN doc_count",
    "vocabulary_size": f"WITH {INDEX} SELECT count(*) AS terms FROM terms",
    "eligible_posts": f"WITH {BASE} SELECT post_id, post_type FROM seen",
    "eligible_count": f"WITH {BASE} SELECT count(*) AS n FROM seen",
    "post_types": f"WITH {BASE} SELECT DISTINCT post_type FROM posts",
    "taxonomy_text": f"WITH {BASE} SELECT post_id, taxonomy_text FROM taxonomy",
    "posts_with_term": f"WITH {BASE} SELECT DISTINCT post_id FROM names WHERE taxonomy = 'category' AND name = 'de'",
    "query_tokens": f"WITH {BASE},{query_side('log')} SELECT query_id, group_ix, token FROM qt",
    "token_caps": f"WITH {BASE},{query_side('log')},{FUZZY} SELECT query_id, group_ix, token, CAST(edits AS BIGINT) AS edits FROM fz",
    "fuzzy_distance": f"WITH {INDEX} SELECT term, CAST(CASE WHEN strlen(term) < 4 THEN 0 WHEN strlen(term) >= 8 THEN 2 ELSE 1 END AS BIGINT) AS edits FROM terms",
    "exact_lookup": f"WITH {INDEX},{query_side()} SELECT query_id, term, doc_freq FROM ({EXACT})",
    "prefix_expand": f"WITH {INDEX},{query_side()} SELECT query_id, term, doc_freq FROM ({PREFIX})",
    "fuzzy_expand": f"WITH {INDEX},{query_side()},{FUZZY} {TYPOS}",
    "candidate_union": f"WITH {INDEX},{query_side()},{FUZZY} ({EXACT}) UNION ({PREFIX}) UNION ({TYPOS})",
    "idf": f"WITH {INDEX} SELECT term, round(ln((n - doc_freq + 0.5) / (doc_freq + 0.5) + 1), 6) AS idf FROM terms CROSS JOIN doc_count",
    "postings_visible": f"WITH {INDEX},{query_side()} SELECT query_id, term, post_id, field FROM ({EXACT}) JOIN postings USING (term) JOIN seen USING (post_id) WHERE post_type = 'page'",
    "bm25_exact": scored(EXACT) + RANKED,
    "bm25_and": scored(EXACT, fallback=False) + RANKED,
    "bm25_single_field": scored(EXACT, fields="1") + RANKED,
    "bm25_zero_weight": scored(EXACT, fields="1, 2, 3") + RANKED,
    "search_ranked": scored(f"({EXACT}) UNION ({PREFIX}) UNION ({TYPOS})") + RANKED,
    "query_log_topk": scored(EXACT, log="log") + RANKED + " WHERE rank <= 10",
    "ranked_page": scored(EXACT) + "SELECT query_id, rank, post_id, CAST(ceil(total / 10) AS BIGINT) AS pages FROM r WHERE rank BETWEEN 11 AND 20",
    "query_status": scored(EXACT) + "SELECT CAST(q.query_id AS BIGINT) AS query_id, CASE WHEN q.query_id NOT IN (SELECT query_id FROM qt) THEN 'abstain' WHEN t.total IS NULL THEN 'empty' ELSE 'ok' END AS status, coalesce(t.total, 0) AS total FROM q LEFT JOIN (SELECT DISTINCT query_id, total FROM r) t USING (query_id)",
    "contains_fallback": f"WITH {BASE} SELECT CAST(query_id AS BIGINT) AS query_id, post_id FROM seen, q WHERE trim(q) <> '' AND (contains(lower(title), lower(trim(q))) OR contains(lower(content), lower(trim(q))) OR contains(lower(excerpt), lower(trim(q))))",
    "missing_terms": f"WITH {INDEX},{query_side()} SELECT DISTINCT token AS term FROM qt WHERE token NOT IN (SELECT term FROM terms)",
    "typeahead_docs": f"WITH {BASE} SELECT post_id AS id, title, url, CASE post_type WHEN 'post' THEN 'Post' ELSE 'Page' END AS type_label FROM seen ORDER BY minutes DESC, post_id DESC LIMIT {typeahead.CAP}",
    "highlight_words": f"WITH {BASE} SELECT query_id, coalesce(array_to_string(list_transform(list_sort(list_transform(list_filter(regexp_split_to_array(q, '{RE_SPLIT}'), lambda w: length(w) >= 2), lambda w, i: {{'n': -length(w), 'i': i, 'w': w}}))[1:10], lambda s: s.w), '|'), '') AS words FROM log",
    "incremental_upsert": f"WITH {INDEX} SELECT term, doc_freq FROM terms",
    "index_version": f"WITH {INDEX} SELECT substr(md5('[' || n || ',' || (SELECT count(*) FROM terms) || ',{CFG.pipeline_hash()}]'), 1, 12) AS version FROM doc_count",
    "dirty_queue": "SELECT DISTINCT user_id AS post_id FROM events WHERE event_type <> 'view' AND user_id IS NOT NULL",
    "session_debounce": "SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR next > ts + INTERVAL 10 MINUTE",
    "latest_response": "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1",
}
