import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lumindex.config import SearchConfig
from lumindex.operators import index as ix
from lumindex.operators import search, typeahead
from lumindex.sources import corpus
from lumindex.streaming import maintain, throttle

POSTS = "post_id long, post_type string, post_status string, post_password string, post_date_gmt timestamp, title string, content string, excerpt string, url string"
CFG = SearchConfig()


def post(i, title, content="", excerpt="", kind="post", status="publish", password="", day=1):
    return (i, kind, status, password, dt.datetime(2024, 1, day), title, content, excerpt, f"/{i}")


@pytest.fixture(scope="module")
def posts(spark):
    rows = [
        post(1, "Photography studio", "<p>A photo of the receipt</p>"), post(2, "Receipt book", "photo photo", day=2), post(3, "Hidden photo", status="draft"), post(4, "Secret photo", password="x"),
        post(5, "About studio", "", "portrait studio", kind="page"), post(6, "Other kind photo", kind="custom"), post(7, None, None, None),
    ]
    return spark.createDataFrame(rows, POSTS).cache()


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(1, "category", "portrait"), (2, "other", "portrait"), (2, "post_tag", "books")], "post_id long, taxonomy string, name string").cache()


@pytest.fixture(scope="module")
def index(posts, names):
    return ix.build(posts, names, CFG).cached()


def ids(spark, index, posts, q, cfg=CFG, **kw):
    out = search.search(spark.createDataFrame([(1, q)], "query_id long, q string"), index, posts, cfg, **kw)
    return [r["post_id"] for r in out.orderBy("rank").collect()]


def test_only_visible_posts_are_indexed(index):
    assert {r["post_id"] for r in index.postings.select("post_id").distinct().collect()} == {1, 2, 5}
    assert {r["term"]: r["doc_freq"] for r in index.terms.collect()}["studio"] == 2


def test_lengths_and_frequencies(index):
    row = index.postings.where("post_id = 2 and field = 1 and term = 'photo'").first()
    assert (row["tf"], row["dl"]) == (2, 2)
    stats = index.stats.first()
    assert stats["doc_count"] == 3 and stats["field_docs"][0] == 3 and stats["field_tokens"][1] == 4


def test_prefix_and_typos(spark, index, posts):
    assert 1 in ids(spark, index, posts, "photog")
    assert ids(spark, index, posts, "reciept", replace(CFG, prefix_last=False)) == []  # a transposition is two edits
    assert set(ids(spark, index, posts, "receips", replace(CFG, prefix_last=False))) == {1, 2}


def test_all_tokens_then_fallback(spark, index, posts):
    assert ids(spark, index, posts, "photo studio") == [1]
    assert set(ids(spark, index, posts, "studio zzzzz")) == {1, 5}
    assert ids(spark, index, posts, "studio zzzzz", replace(CFG, or_fallback=False)) == []


def test_types_and_hook(spark, index, posts):
    assert ids(spark, index, posts, "studio", types=["page"]) == [5]
    assert ids(spark, index, posts, "studio", types=["nothing"]) == []
    assert ids(spark, index, posts, "studio", hook=lambda df: df.where("post_id <> 5")) == [1]


def test_status_page_and_json(spark, index, posts):
    q = spark.createDataFrame([(1, "the of"), (2, "zzzzqqq"), (3, "photo"), (4, "")], "query_id long, q string")
    found = search.search(q, index, posts, CFG)
    assert {r["query_id"]: r["status"] for r in search.status(q, found, CFG).collect()} == {1: "abstain", 2: "empty", 3: "ok", 4: "abstain"}
    paged = search.page(found, 2, 1).where("query_id = 3").first()
    assert (paged["rank"], paged["pages"], paged["total"]) == (2, 2, 2)
    body = search.as_json(search.hits(search.page(found), posts, q, CFG), 1, 10).first()["body"]
    assert '"pages":1' in body and "<mark>" in body
    assert [r["post_id"] for r in search.fallback(q.where("query_id = 3"), posts, CFG).orderBy("post_id").collect()] == [1, 2]


def test_request_validation(spark):
    df = spark.createDataFrame([("a", 1, 10), (" ", 1, 10), ("é" * 101, 1, 10), ("a", 0, 10), ("a", 1, 51)], "q string, p int, n int")
    assert [r["ok"] for r in df.select(search.valid_request(F.col("q"), F.col("p"), F.col("n")).alias("ok")).collect()] == [True, False, False, False, False]


def test_gate(spark):
    df = spark.createDataFrame([("a", True, None), ("a", False, None), (" ", True, None), ("a", True, "date")], "q string, is_main boolean, orderby string")
    assert [r["ok"] for r in df.select(search.handled(df).alias("ok")).collect()] == [True, False, False, False]
    assert [r["ok"] for r in df.select(search.handled(df, F.col("q") == "b").alias("ok")).collect()] == [False] * 4


def test_stemmed_index(spark, posts, names):
    cfg = replace(CFG, stemming=True, fuzzy="off", prefix_last=False)
    index = ix.build(posts, names, cfg)
    assert set(ids(spark, index, posts, "receipts", cfg)) == {1, 2}


def test_upsert_equals_rebuild(spark, posts, names):
    old = posts.withColumn("title", F.when(F.col("post_id") == 1, "was something else").otherwise(F.col("title"))).where("post_id <> 2").unionByName(spark.createDataFrame([post(9, "gone later")], POSTS))
    changed = spark.createDataFrame([(1,), (2,), (9,)], "post_id long")
    got, want = ix.upsert(ix.build(old, names, CFG), changed, posts, names, CFG), ix.build(posts, names, CFG)
    for a, b in ((got.postings, want.postings), (got.terms, want.terms)):
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    again = ix.upsert(got, changed, posts, names, CFG)
    assert sorted(map(tuple, again.terms.collect())) == sorted(map(tuple, want.terms.collect()))


def test_empty_tables(spark, posts, names):
    index = ix.build(posts.where("false"), names.where("false"), CFG)
    assert ids(spark, index, posts, "photo") == []
    assert index.stats.first()["doc_count"] == 0


def test_suggestions(spark, posts):
    q = spark.createDataFrame([(1, "stud"), (2, "x")], "query_id long, q string")
    assert {r["id"] for r in typeahead.suggest(q, posts, CFG).collect()} == {1, 5}
    server = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, id long, rank int")
    local = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id long, id long, rank int")
    assert [r["id"] for r in typeahead.merged(server, local, 8).orderBy("rank").collect()] == [7, 8, 9]


def test_stream_upkeep_and_replay(spark, posts, names, tmp_path):
    versions = maintain.Versions(spark, f"file://{tmp_path}/index")
    maintain.rebuild(versions, posts.where("post_id <> 2"), names, CFG)
    source = f"{tmp_path}/changes"
    stamp = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(stamp, 2, "upsert", "draft", "publish"), (stamp, 2, "upsert", "publish", "publish"), (stamp, 1, "revision", None, None)], maintain.CHANGES).write.parquet(source)
    stream = spark.readStream.schema(maintain.CHANGES).parquet(source)
    maintain.start(stream, versions, lambda: (posts, names), CFG, f"{tmp_path}/cp", once=True).awaitTermination()
    want = sorted(map(tuple, ix.build(posts, names, CFG).terms.collect()))
    assert sorted(map(tuple, versions.current().terms.collect())) == want
    maintain.apply_batch(versions, spark.read.parquet(source), 0, lambda: (posts, names), CFG)  # the same batch once more
    assert sorted(map(tuple, versions.current().terms.collect())) == want
    versions.drop()
    assert versions.current() is None


def test_throttle_window_slides_with_accepted_requests(spark):
    c = throttle.Counters(limit=2)
    assert [c.accept("v", "t", at) for at in (0, 50, 100, 111)] == [True, True, False, True]
    rows = [(i, "v", "t", dt.datetime(2024, 1, 1, 0, m, s)) for i, (m, s) in enumerate([(0, 0), (0, 50), (1, 40), (1, 51)])]
    out = throttle.throttled(spark.createDataFrame(rows, "request_id long, visitor string, connection string, ts timestamp"), limit=2)
    assert [r["accepted"] for r in out.orderBy("request_id").collect()] == [True, True, False, True]
    df = spark.createDataFrame([("x", "10.0.0.1"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(throttle.client_address(F.col("a"), F.col("b"))).collect()] == ["10.0.0.1", "unknown"]


def test_vocabulary_limit_switches_typos_off(spark, index, posts):
    assert ids(spark, index, posts, "receips", replace(CFG, prefix_last=False, vocabulary_limit=1)) == []


def test_posts_with_term(names):
    assert [r["post_id"] for r in corpus.posts_with_term(names, "category", "portrait").collect()] == [1]


def test_throttle_counts_visitors_and_connections_apart(spark):
    """Six requests of one visitor over two connections, and a crowd behind a few connections, as one run in order of time."""
    import random

    r = random.Random(3)
    rows = [(i, "v", f"c{i % 2}", float(i)) for i in range(6)] + [(None, "n", "c9", 1.0), (7, "d", "c9", 2.0), (7, "d", "c9", 3.0)]
    rows += [(100 + i, f"w{r.randrange(30)}", f"x{r.randrange(4)}", 10.0 + i) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id long, visitor string, connection string, ts double")
    c = throttle.Counters(limit=3, window=50.0, transport=5)
    want = sorted((row[3], c.accept(row[1], row[2], row[3])) for row in sorted(rows, key=lambda x: (x[3], x[0] or 0)))
    got = sorted((row["ts"], row["accepted"]) for row in throttle.throttled(df, limit=3, window=50.0, transport=5).collect())
    assert got == want and sum(a for t, a in got if t < 6.5) == 3 + 3 and not all(a for _, a in got[9:])


def test_rebuild_follows_the_current_version(spark, posts, names, tmp_path):
    versions = maintain.Versions(spark, f"file://{tmp_path}/ix")
    some = posts.where("post_id <> 2")
    maintain.rebuild(versions, some, names, CFG)
    changes = spark.createDataFrame([(2, "post")], "post_id long, kind string").selectExpr("timestamp'2020-01-01' as event_time", "post_id", "kind", "cast(null as string) as old_status", "'publish' as new_status")
    for batch in (0, 1, 1):
        maintain.apply_batch(versions, changes, batch, lambda: (posts, names), CFG)
    assert versions.numbers() == [1, 2]
    maintain.rebuild(versions, some, names, CFG)
    assert versions.current().postings.where("post_id = 2").count() == 0
    maintain.apply_batch(versions, changes, 0, lambda: (posts, names), CFG)  # another checkpoint: batches start again
    assert versions.numbers()[-1] == 4 and versions.current().postings.where("post_id = 2").count() > 0


def test_hash_tells_of_shortcodes():
    assert replace(CFG, shortcodes=("box",)).pipeline_hash() != CFG.pipeline_hash() == replace(CFG, typeahead_max=3).pipeline_hash()


def test_type_scoping():
    assert corpus.allowed_types(None, CFG) == corpus.allowed_types("any", CFG) == ["post", "page"]
    assert corpus.allowed_types(["any", "page"], CFG) == corpus.allowed_types("page", CFG) == ["page"] and corpus.allowed_types(["any"], CFG) == []


def test_statistics_follow_deltas(spark, posts, names, index):
    """Deletes and edits leave the statistics of a build from scratch, down to none."""
    ids = spark.createDataFrame([(2,), (5,), (7,), (99,)], "post_id long")
    now = posts.where("post_id <> 2").withColumn("excerpt", F.when(F.col("post_id") == 5, "").otherwise(F.col("excerpt")))
    after = ix.upsert(index, ids, now, names, CFG)
    assert after.stats.first().asDict() == ix.build(now, names, CFG).stats.first().asDict()
    gone = ix.upsert(index, posts.select("post_id"), posts.where("false"), names, CFG).stats.first()
    assert (gone["doc_count"], gone["terms"], gone["field_tokens"], gone["field_docs"]) == (0, 0, {}, {})


def test_rows_that_share_an_id_are_one_post(spark):
    rows = [post(1, "red two", "alpha beta"), post(1, "red three", "alpha"), post(2, "two", "beta"), post(2, "four", "beta gamma beta"), post(3, "red"), post(None, "red"), post(None, "red")]
    index = ix.build(spark.createDataFrame(rows, POSTS), spark.createDataFrame([(1, "category", "cat")], "post_id long, taxonomy string, name string"), CFG)
    got = {(r["term"], r["post_id"], r["field"], r["dl"]): r["tf"] for r in index.postings.collect()}
    assert got[("red", 1, 0, 2)] == 2 and got[("alpha", 1, 1, 2)] == 1 and got[("alpha", 1, 1, 1)] == 1 and got[("beta", 2, 1, 3)] == 2 and got[("cat", 1, 3, 1)] == 2 and got[("red", None, 0, 1)] == 2
    # The same by what the postings hold, without marks.
    assert {tuple(r) for r in index.terms.collect()} == {tuple(r) for r in ix.vocabulary(index.postings).collect()}
    assert index.stats.first() == ix.statistics(index.postings, index.terms).first()


def test_terms_are_counted_without_a_shuffle(spark, posts, names):
    marked = ix.build(posts, names, CFG).marked._jdf.queryExecution().optimizedPlan().toString()
    assert marked.count("MapInArrow") == 1 and "Aggregate [post_id#" not in marked.partition("MapInArrow")[0] and "regexp_replace" not in marked


def test_prefixes_are_chosen_once_for_queries_that_share_a_token(spark, index):
    cfg = replace(CFG, max_expansions=1)
    tokens = spark.createDataFrame([(1, 0, "pho", True), (2, 3, "pho", True), (3, 0, "po", True), (4, 0, "pho", False)], "query_id long, group_ix int, token string, last boolean")
    found = search.prefix(tokens, index.terms, cfg)
    assert sorted(map(tuple, found.collect())) == [(1, 0, "photo", 2), (2, 3, "photo", 2), (3, 0, "portrait", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number() windowspecdefinition(token#") == 1


def test_search_does_not_shuffle_postings(spark, index, posts):
    plan = search.scores(search.expand(search.query_tokens(spark.createDataFrame([(1, "photo")], "query_id long, q string"), CFG), index.terms, CFG), index, CFG)
    assert plan.count() > 0
    found = search.search(spark.createDataFrame([(1, "photo studio")], "query_id long, q string"), index, posts, CFG)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=broadcast)") >= 2


def test_best_of_shards_are_the_first_of_all_hits(spark):
    from lumindex.operators import shards

    words = ["ant", "bee", "cat", "dog", "elk", "fox"]
    rows = [post(i, " ".join(words[j] for j in range(6) if i >> j & 1), "bee " * (i % 5), password="x" * (i % 13 == 0), day=1 + i % 9) for i in range(1, 64)]
    posts = spark.createDataFrame([*rows, post(9, "ant copy", day=20), post(10, "hidden twin", password="x", day=21), post(None, "ant")], POSTS)
    index, cfg = ix.build(posts, spark.createDataFrame([], "post_id long, taxonomy string, name string"), CFG), replace(CFG, fuzzy="off", prefix_last=False)
    queries = spark.createDataFrame([(1, "ant bee"), (2, "ant nosuch"), (3, "nosuch"), (4, "the"), (5, "cat dog elk fox"), (6, "ant bee")], "query_id long, q string")
    for c in (cfg, replace(cfg, or_fallback=False), replace(cfg, weight_title=0.0)):
        got = shards.top(queries, index, posts, c, 4)
        want = search.search(queries, index, posts, c).where("rank <= 4").select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = shards.top(queries, index, posts, cfg, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.partition("Window")[2] and "Aggregate [query_id" not in plan  # hits meet in no exchange


def test_shards_keep_what_rounding_may_lift():
    import numpy as np

    from lumindex.operators import shards

    scores = np.array([1.0, 1.0000004999999, 1.0000005, 0.5, 1.0, 1.0] + [0.1] * 20)
    kept = set(shards.best(scores, np.zeros(26), np.arange(26), 2))
    assert {1, 2, 4, 5} <= kept and 3 not in kept


def test_one_task_sorts_packs_of_requests_only(spark):
    rows = [(i, f"v{i % 7}", f"c{i % 3}", float(i * 37 % 1000)) for i in range(1000)]
    out = throttle.throttled(spark.createDataFrame(rows, "request_id long, visitor string, connection string, ts double"), limit=3, window=20.0, transport=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "request_id" not in plan.split("MapInArrow")[1].partition("Sort")[2]
    c = throttle.Counters(limit=3, window=20.0, transport=4)
    want = {r[0]: c.accept(r[1], r[2], r[3]) for r in sorted(rows, key=lambda r: (r[3], r[0]))}
    assert {r["request_id"]: r["accepted"] for r in out.collect()} == want
