"""More registered queries and SQL twins: what is shown to visitors, request rules, stemming, upkeep of an index."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as tx
from ..operators import index as ix
from ..operators import search, typeahead
from ..sources import corpus
from ..streaming import maintain, throttle
from . import search_queries as sq
from .search_queries import CFG, EXACT, FUZZY, INDEX, PLAIN, PREFIX, RE_SPLIT, TYPOS, query_side, scored, sql_clean

LONG = "long"


def ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast(LONG).alias("rank"), "post_id", "score", F.col("total").cast(LONG).alias("total"))


def upserted(spark: SparkSession, sf_dir: str, keep: bool = False) -> ix.Index:
    """An index in which posts were edited, added, and hidden by a password, brought up to date. What is read more than once is to be kept."""
    p, n = corpus.posts(spark, sf_dir), corpus.post_terms(spark, sf_dir)
    edited, added, hidden = F.col("post_id") % 7 == 0, F.col("post_id") % 11 == 3, F.col("post_password") != ""
    old = p.where(~added).withColumn("title", F.when(edited, F.lit("old title words")).otherwise(F.col("title"))).withColumn("post_password", F.lit(""))
    before = sq.kept(spark, "before", sf_dir, lambda: ix.build(old, n, CFG)) if keep else ix.build(old, n, CFG)
    return ix.upsert(before, p.where(edited | added | hidden).select("post_id"), p, n, CFG)


def stats_rows(index: ix.Index) -> DataFrame:
    each = index.stats.select("doc_count", "terms", F.explode("field_tokens").alias("field", "tokens"), "field_docs")
    return each.select("doc_count", "terms", F.col("field").cast("int").alias("field"), F.col("tokens").cast(LONG).alias("tokens"), F.col("field_docs")[F.col("field")].alias("docs"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes made of the events table, kept ones only."""
    ev = corpus.table(spark, sf_dir, "events")
    status = lambda n: F.element_at(F.array(*map(F.lit, ("publish", "draft", "trash"))), (F.col("event_id") % n % 3 + 1).cast("int"))
    rows = ev.select(F.col("ts").alias("event_time"), F.col("event_id").alias("post_id"), F.when(F.col("event_type") == "view", "autosave").otherwise("upsert").alias("kind"), status(5).alias("old_status"), status(7).alias("new_status"))
    return maintain.relevant(rows).select("post_id", "old_status", "new_status")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API requests made of the query log."""
    return corpus.query_log(spark, sf_dir).select("query_id", "q", (F.col("query_id") % 1100).alias("page"), (F.col("query_id") % 60).alias("per_page"))


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("query_id")
    return corpus.query_log(spark, sf_dir).select("query_id", "q", (n % 2 == 0).alias("is_main"), (n % 5 == 0).alias("is_admin"), F.when(n % 3 == 0, "date").otherwise("").alias("orderby"))


def shortcoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('[box a="1"]<b>inside</b>[/box] [gone] '), F.coalesce("text", F.lit("")), F.lit(" [boxes] [/gone]"))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", tx.clean(text, ("box", "gone")).alias("content"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("user_id")
    forwarded = F.when(n % 3 == 0, F.concat(F.lit("10.0.0."), n % 256)).when(n % 3 == 1, F.concat(F.lit("host"), n)).otherwise(F.lit(""))
    remote = F.when(n % 2 == 0, F.concat(F.lit("fe80::"), n % 10)).otherwise(F.lit(None).cast("string"))
    found = throttle.client_address(forwarded, remote)
    return corpus.table(spark, sf_dir, "events").select("event_id", found.alias("address"), throttle.bucket(found, "salt").alias("bucket"))


lit, posts, names, index = sq.literal_queries, corpus.posts, corpus.post_terms, sq.small_index

QUERIES = {
    "upsert_postings": lambda s, d: upserted(s, d).postings.select("term", "post_id", F.col("field").cast("int").alias("field"), F.col("tf").cast(LONG).alias("tf"), F.col("dl").cast(LONG).alias("dl")),
    "upsert_terms": lambda s, d: upserted(s, d, keep=True).terms.select("term", "doc_freq"),
    "upsert_stats": lambda s, d: stats_rows(upserted(s, d, keep=True)),
    "status_transitions": transitions,
    "search_types": lambda s, d: ranked(search.search(lit(s), index(s, d), posts(s, d), PLAIN, types=["page", "any"])),
    "search_prefix_only": lambda s, d: ranked(search.search(lit(s), index(s, d), posts(s, d), replace(CFG, fuzzy="off"))),
    "vocabulary_switch": lambda s, d: ranked(search.search(lit(s), index(s, d), posts(s, d), replace(CFG, vocabulary_limit=10))),
    "prefix_expand_log": lambda s, d: search.prefix(search.query_tokens(corpus.query_log(s, d), CFG), index(s, d).terms, CFG).select("query_id", "term", "doc_freq"),
    "exact_lookup_log": lambda s, d: search.exact(search.query_tokens(corpus.query_log(s, d), CFG), index(s, d).terms).select("query_id", "term", "doc_freq"),
    "valid_requests": lambda s, d: requests(s, d).select("query_id", search.valid_request(F.col("q"), F.col("page"), F.col("per_page")).alias("valid")),
    "handled_requests": lambda s, d: (lambda r: r.select("query_id", search.handled(r).alias("handled")))(page_requests(s, d)),
    "clean_shortcodes": shortcoded,
    "clamped_terms": lambda s, d: corpus.table(s, d, "documents").select("doc_id", tx.clamp(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("é"))).alias("term")),
    "client_address": addresses,
    "title_marks": lambda s, d: corpus.posts(s, d).select("post_id", typeahead.highlighted(F.col("title"), F.lit("the ion tion")).alias("title")),
    "typeahead_changed": lambda s, d: typeahead.changed_since(typeahead.payload(posts(s, d), index(s, d), CFG), "000000000000").select("id"),
}


# ---- the same in DuckDB SQL -------------------------------------------------------------------------------------------

NO_FOLD_SPLIT = f"regexp_split_to_array(%s, '{RE_SPLIT}')"


def sql_words(q: str) -> str:
    """Words to mark: two characters and more, longest first, at most ten."""
    keyed = f"list_transform(list_filter({NO_FOLD_SPLIT % q}, lambda w: length(w) >= 2), lambda w, i: {{'n': -length(w), 'i': i, 'w': w}})"
    return f"list_transform(list_sort({keyed})[1:10], lambda s: s.w)"


def sql_escape(x: str) -> str:
    return sq.sql_replace(x, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#039;"})


def sql_mark(x: str, words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN {x} ELSE regexp_replace({x}, '(' || array_to_string(list_transform({words}, lambda w: regexp_escape(w)), '|') || ')', '<mark>\\1</mark>', 'gi') END"


def snippet_ctes(source: str) -> str:
    """CTEs up to ``snip(key columns, snippet)`` of a ``source(k, text, q)``: 180 characters from 40 before the first word found."""
    return rf"""
n0 AS (SELECT k, trim(regexp_replace(coalesce(text, ''), '[\s\p{{Z}}]+', ' ', 'g')) AS t, {sql_words('q')} AS w FROM {source}),
n1 AS (SELECT *, list_filter(list_transform(w, lambda x: strpos(lower(t), lower(x))), lambda p: p > 0) AS f FROM n0),
n2 AS (SELECT *, CASE WHEN len(f) > 0 THEN greatest(0, f[1] - 41) ELSE 0 END AS st FROM n1),
n3 AS (SELECT k, t, w, {sql_escape("(CASE WHEN st > 0 THEN '…' ELSE '' END || substr(t, st + 1, 180) || CASE WHEN length(t) > st + 180 THEN '…' ELSE '' END)")} AS body FROM n2),
snip AS (SELECT k, CASE WHEN t = '' THEN '' ELSE {sql_mark('body', 'w')} END AS snippet FROM n3)"""


TITLES = INDEX.replace("SELECT post_id, 0 AS field, title AS text FROM seen", "SELECT post_id, 0 AS field, title AS text FROM seen), unused AS (SELECT post_id, 0 AS field, title AS text FROM seen")
ALL_KINDS = f"({EXACT}) UNION ({PREFIX}) UNION ({TYPOS})"
SUGGESTED = "sug AS (SELECT query_id, rank, post_id AS id FROM r JOIN q USING (query_id) WHERE rank <= 8 AND length(trim(q)) >= 2)"
PAGE = f"""sh AS (SELECT {{'query_id': r.query_id, 'rank': rank, 'id': post_id, 'title': title, 'url': url, 'minutes': minutes, 'type': post_type, 'score': score, 'total': total}} AS k, q,
  coalesce(nullif({sql_clean('excerpt')}, ''), {sql_clean('content')}) AS text FROM r JOIN posts USING (post_id) JOIN q ON q.query_id = r.query_id WHERE rank <= 10),{snippet_ctes('sh')}"""
VERSION = sq.ORACLES["index_version"].partition("SELECT substr(md5")[2].partition(" AS version")[0]
LABEL = "CASE {} WHEN 'post' THEN 'Post' ELSE 'Page' END"


def form(x: str) -> str:
    """V and C for each letter; y is resolved from what stands before it."""
    x = f"regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '[a-xz]', 'C', 'g')"
    for _ in range(4):
        x = f"replace(regexp_replace({x}, '(^|V)y', '\\1C', 'g'), 'Cy', 'CV')"
    return x


def measure(f: str) -> str:
    return f"(length(regexp_replace(regexp_replace({f}, '^C+', ''), 'V+$', '')) // 2)"


def suffixed(name: str, source: str, pairs, least: int) -> str:
    """One CTE pair: the first suffix that fits is replaced if the rest's measure is above ``least``."""
    size = " ".join(f"WHEN ends_with(x, '{a}') THEN {len(a)}" for a, _ in pairs)
    new = " ".join(f"WHEN ends_with(x, '{a}') THEN '{b}'" for a, b in pairs)
    return f"""{name}0 AS (SELECT word, x, CASE {size} END AS n, CASE {new} END AS new FROM {source}),
{name}1 AS (SELECT word, x, n, new, left(x, length(x) - coalesce(n, 0)) AS rest, {form('left(x, length(x) - coalesce(n, 0))')} AS f FROM {name}0),
{name} AS (SELECT word, CASE WHEN n IS NULL OR {measure('f')} <= {least} THEN x ELSE rest || new END AS x, n FROM {name}1)"""


CLOSED = "(f LIKE '%CVC' AND right(rest, 1) NOT IN ('w', 'x', 'y'))"
DOUBLED = "(length(rest) > 1 AND right(rest, 1) = substr(rest, length(rest) - 1, 1) AND f LIKE '%C')"


def stem_ctes(source: str) -> str:
    """CTEs up to ``stems(word, stem)`` of the distinct words of ``source(word)``."""
    last = [(a, "") for a in stem.STEP4]
    return f"""
a0 AS (SELECT DISTINCT word FROM {source}),
a1 AS (SELECT word, CASE WHEN word LIKE '%sses' OR word LIKE '%ies' THEN left(word, length(word) - 2) WHEN word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, length(word) - 1) ELSE word END AS x FROM a0 WHERE regexp_full_match(word, '[a-z]{{3,}}')),
a2 AS (SELECT word, x, CASE WHEN x LIKE '%eed' OR x LIKE '%ing' THEN 3 WHEN x LIKE '%ed' THEN 2 ELSE 0 END AS n FROM a1),
a3 AS (SELECT *, left(x, length(x) - n) AS rest, {form('left(x, length(x) - n)')} AS f FROM a2),
a4 AS (SELECT word, CASE WHEN n = 0 THEN x WHEN x LIKE '%eed' THEN CASE WHEN {measure('f')} > 0 THEN left(x, length(x) - 1) ELSE x END WHEN f NOT LIKE '%V%' THEN x
       WHEN rest LIKE '%at' OR rest LIKE '%bl' OR rest LIKE '%iz' OR ({measure('f')} = 1 AND {CLOSED} AND NOT {DOUBLED}) THEN rest || 'e'
       WHEN {DOUBLED} AND right(rest, 1) NOT IN ('l', 's', 'z') THEN left(rest, length(rest) - 1) ELSE rest END AS x FROM a3),
a5 AS (SELECT word, CASE WHEN x LIKE '%y' AND {form('left(x, length(x) - 1)')} LIKE '%V%' THEN left(x, length(x) - 1) || 'i' ELSE x END AS x FROM a4),
{suffixed('b', 'a5', stem.STEP2, 0)},
{suffixed('c', 'b', stem.STEP3, 0)},
{suffixed('d', 'c', last, 1)},
e0 AS (SELECT word, x, n IS NULL AND (x LIKE '%sion' OR x LIKE '%tion') AS ion, left(x, length(x) - 3) AS rest, {form('left(x, length(x) - 3)')} AS f FROM d),
e1 AS (SELECT word, CASE WHEN ion AND {measure('f')} > 1 THEN rest ELSE x END AS x FROM e0),
e2 AS (SELECT word, x, left(x, length(x) - 1) AS rest, {form('left(x, length(x) - 1)')} AS f FROM e1),
e3 AS (SELECT word, CASE WHEN x LIKE '%e' AND ({measure('f')} > 1 OR ({measure('f')} = 1 AND NOT {CLOSED})) THEN rest ELSE x END AS x FROM e2),
e4 AS (SELECT word, x, x AS rest, {form('x')} AS f FROM e3),
stems AS (SELECT word, CASE WHEN x LIKE '%l' AND {DOUBLED} AND {measure('f')} > 1 THEN left(x, length(x) - 1) ELSE x END AS stem FROM e4
          UNION ALL SELECT word, word FROM a0 WHERE NOT regexp_full_match(word, '[a-z]{{3,}}'))"""


# The postings and the query's tokens with stems in place of words.
STEM_INDEX = INDEX.replace(
    "postings AS MATERIALIZED (", f"spelled AS (SELECT unnest(ts) AS word FROM tokens UNION ALL SELECT unnest({sq.sql_tokens('q')}) FROM q),{stem_ctes('spelled')},\nwords_of AS (SELECT post_id, field, unnest(ts) AS word FROM tokens),\npostings AS MATERIALIZED (SELECT *, CAST(sum(tf) OVER (PARTITION BY post_id, field) AS BIGINT) AS dl FROM (SELECT post_id, field, stem AS term, count(*) AS tf FROM words_of JOIN stems USING (word) WHERE length(stem) >= 2 GROUP BY ALL)),\nunused AS ("
)
STEM_QUERY = query_side().replace("SELECT query_id, token, row_number()", "SELECT query_id, stem AS token, row_number()").replace("FROM qt0 GROUP", "FROM qt0 JOIN stems ON token = word WHERE length(stem) >= 2 GROUP")

ORACLES = {
    "upsert_postings": f"WITH {INDEX} SELECT term, post_id, field, tf, dl FROM postings",
    "upsert_terms": f"WITH {INDEX} SELECT term, doc_freq FROM terms",
    "upsert_stats": f"WITH {INDEX} SELECT n AS doc_count, (SELECT count(*) FROM terms) AS terms, field, CAST(tokens AS BIGINT) AS tokens, docs FROM per_field CROSS JOIN doc_count",
    "status_transitions": """SELECT post_id, old_status, new_status FROM (SELECT event_id AS post_id, event_type, ['publish', 'draft', 'trash'][event_id % 5 % 3 + 1] AS old_status, ['publish', 'draft', 'trash'][event_id % 7 % 3 + 1] AS new_status FROM events)
        WHERE event_type <> 'view' AND (old_status <> new_status OR new_status = 'publish')""",
    "search_types": scored(EXACT, types="'page'") + sq.RANKED,
    "search_prefix_only": scored(f"({EXACT}) UNION ({PREFIX})") + sq.RANKED,
    "vocabulary_switch": scored(f"({EXACT}) UNION ({PREFIX})") + sq.RANKED,
    "prefix_expand_log": f"WITH {INDEX},{query_side('log')} SELECT query_id, term, doc_freq FROM ({PREFIX})",
    "exact_lookup_log": f"WITH {INDEX},{query_side('log')} SELECT query_id, term, doc_freq FROM ({EXACT})",
    "valid_requests": f"WITH {sq.BASE} SELECT query_id, trim(q) <> '' AND strlen(trim(q)) <= 200 AND query_id % 1100 BETWEEN 1 AND 1000 AND query_id % 60 BETWEEN 1 AND 50 AS valid FROM log",
    "handled_requests": f"WITH {sq.BASE} SELECT query_id, trim(q) <> '' AND query_id % 2 = 0 AND query_id % 5 <> 0 AND query_id % 3 <> 0 AS handled FROM log",
    "clean_shortcodes": "SELECT doc_id, " + sql_clean(r"""regexp_replace(regexp_replace('[box a="1"]<b>inside</b>[/box] [gone] ' || coalesce(text, '') || ' [boxes] [/gone]', '\[box\b[^\]]*\](?:.*?\[/box\])?', ' ', 'gs'), '\[gone\b[^\]]*\](?:.*?\[/gone\])?', ' ', 'gs')""") + " AS content FROM documents",
    "clamped_terms": "SELECT doc_id, left(t, CAST(list_max(list_filter(range(0, 65), lambda n: strlen(left(t, CAST(n AS BIGINT))) <= 64)) AS BIGINT)) AS term FROM (SELECT doc_id, replace(coalesce(text, ''), ' ', 'é') AS t FROM documents)",
    "client_address": """SELECT event_id, address, substr(sha256('salt' || address), 1, 3) AS bucket FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || (user_id % 256) WHEN user_id % 2 = 0 THEN 'fe80::' || (user_id % 10) ELSE 'unknown' END AS address FROM events)""",
    "title_marks": f"WITH {sq.BASE} SELECT post_id, regexp_replace({sql_escape('title')}, '(tion|the|ion)', '<mark>\\1</mark>', 'gi') AS title FROM posts",
    "typeahead_changed": f"WITH {sq.BASE} SELECT post_id AS id FROM seen ORDER BY minutes DESC, post_id DESC LIMIT {typeahead.CAP}",
    "typeahead_payload": f"WITH {INDEX}, ver AS (SELECT substr(md5{VERSION} AS version FROM doc_count) SELECT version, post_id AS id, CAST(to_json([CAST(post_id AS VARCHAR), title, url, {LABEL.format('post_type')}]) AS VARCHAR) AS doc FROM seen CROSS JOIN ver ORDER BY minutes DESC, post_id DESC LIMIT {typeahead.CAP}",
    "typeahead_suggest": scored(ALL_KINDS, base=TITLES, fallback=False) + f", {SUGGESTED} SELECT query_id, rank, id FROM sug",
    "suggest_merge": f"""WITH local AS ({scored(ALL_KINDS, base=TITLES, fallback=False)}, {SUGGESTED} SELECT query_id, rank, id FROM sug), server AS ({scored(EXACT)} SELECT query_id, rank, post_id AS id FROM r WHERE rank <= 5),
        both_sides AS (SELECT *, 0 AS side FROM server UNION ALL SELECT *, 1 FROM local WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM server))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY side, rank, id) AS rank, id FROM both_sides QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY side, rank, id) <= 8""",
    "snippet": rf"WITH src AS (SELECT doc_id AS k, text, coalesce(regexp_split_to_array(trim(text), '\s+')[3] || ' ', '') || 'the' AS q FROM documents),{snippet_ctes('src')} SELECT k AS doc_id, snippet FROM snip",
    "search_hits": scored(ALL_KINDS) + f", {PAGE} SELECT k.query_id AS query_id, k.id AS id, k.title AS title, snippet, k.score AS score FROM snip",
    "search_json": scored(EXACT) + f""", {PAGE} SELECT query_id, CAST(to_json({{'results': list(item ORDER BY rank), 'total': max(total), 'page': 1, 'pages': CAST(ceil(max(total) / 10) AS BIGINT)}}) AS VARCHAR) AS body FROM (
        SELECT k.query_id AS query_id, k.rank AS rank, k.total AS total, {{'id': k.id, 'title': k.title, 'url': k.url, 'date': strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * k.minutes, '%Y-%m-%d'), 'type': k.type, 'type_label': {LABEL.format('k.type')}, 'snippet': snippet}} AS item FROM snip) GROUP BY 1""",
    "stem_terms": f"WITH {INDEX}, spelled AS (SELECT term AS word FROM terms),{stem_ctes('spelled')} SELECT word AS term, stem FROM stems",
    "stemmed_search": (scored(EXACT, base=STEM_INDEX) + "SELECT query_id, rank, post_id, score FROM r").replace(query_side(), STEM_QUERY),
    # The tables hold the entities of the closed set only, so that both modes give one text.
    "clean_pages_general": f"SELECT page_id, {sql_clean('html')} AS content FROM pages",
}
