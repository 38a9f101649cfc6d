import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs
from pyspark.sql import functions as F

import corpus_pipeline
from lumindex.llm import common, embedding_dedup, hnsw, minhash, suffix_dedup, warc

R = random.Random(11)


def closed(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 3), (9, 3), (50, 50)] + [(7, i) for i in range(200, 260)]
    nodes = {x for e in edges for x in e}
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), common.Scratch(spark, "t")).collect()}
    want = closed(nodes, edges)
    assert {n: got.get(n, n) for n in nodes} == want


def edited(words, n):
    out = list(words)
    for _ in range(n):
        out[R.randrange(len(out))] = f"x{R.randrange(10**6)}"
    return out


def corpus():
    texts = [None, "", "one", "One ", "a b", " \t\n"]
    for _ in range(6):
        base = [f"w{R.randrange(400)}" for _ in range(R.randint(30, 200))]
        texts += [" ".join(edited(base, R.randint(0, 7))) for _ in range(12)]
    texts += [" ".join(f"w{R.randrange(400)}" for _ in range(40)) for _ in range(30)]
    return texts + texts[10:14] + [texts[12].upper()]


def test_minhash_equals_brute_force(spark):
    texts = corpus()
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = closed(range(len(sets)), links)
    out = minhash.near_duplicates(docs(spark, texts), 3, 85, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_minhash_chains_through_members_of_a_star(spark):
    """A link that only two members have, each differently far from the centre, is found."""
    base = [f"w{i}" for i in range(120)]
    step = [" ".join([f"y{j}" for j in range(3 * i)] + base[3 * i :]) for i in range(12)]
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, step), 3, 85, 100).collect()}
    assert set(out.values()) == {0}


def test_minhash_truncated_copies_in_a_large_group(spark):
    """A copy cut too short for the group's centre is found through the one member it links with."""
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(102)]
        texts += [" ".join([*base[:94], *(f"g{g}c{j}t{i}" for i in range(8))]) for j in range(40)]
        texts += [" ".join(base[:94]), " ".join(base[:81])]
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), 3, 85, 100).collect()}
    assert out == {i: i // 42 * 42 for i in range(len(texts))}


def test_minhash_edges(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", None])
    odd = df.withColumn("doc_id", F.when(F.col("doc_id") == 2, None).otherwise(F.col("doc_id"))).withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(1))
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in minhash.near_duplicates(odd).collect() if r["doc_id"] is not None) == [(False, 0), (False, 0)]
    assert minhash.near_duplicates(df.where("false")).count() == 0
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == 2


def cut(texts, depth):
    seen, out = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if seen.setdefault(b[p : p + depth], i) < i:
                gone[p : p + depth] = b"\1" * depth
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def passages():
    shared = ["".join(R.choice("abcé ") for _ in range(R.randint(20, 150))) for _ in range(8)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 300, "ab" * 100, "ba" * 80]
    for _ in range(60):
        texts.append("".join(R.choice([*shared, "".join(R.choice("xyz") for _ in range(R.randint(1, 60)))]) for _ in range(R.randint(1, 6))))
    return texts + texts[20:24]


def test_suffix_dedup_equals_brute_force(spark):
    texts = passages()
    want = cut(texts, 50)
    out = suffix_dedup.removed_passages(docs(spark, texts).withColumn("kept", F.lit("clash"))).collect()
    assert len(out) == len(texts)
    for r in out:
        size = len((r["text"] or "").encode())
        assert (size, size - len(r["kept"]), len(r["starts"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) == want[r["doc_id"]], r["doc_id"]


def test_suffix_dedup_edges(spark):
    long = "".join(R.choice("abcdefgh") for _ in range(200))
    df = docs(spark, [long, long, long + "!"])
    same_id = df.withColumn("doc_id", F.when(F.col("doc_id") == 2, 0).when(F.col("doc_id") == 1, None).otherwise(F.col("doc_id")))
    assert all(len(r["starts"]) == 0 for r in suffix_dedup.removed_passages(same_id).collect())
    assert suffix_dedup.removed_passages(df.where("false")).count() == 0
    stage = suffix_dedup.without_passages(df)
    assert stage.columns == df.columns and {r["doc_id"]: r["text"] for r in stage.collect()} == {0: long, 1: "", 2: "!"}


def test_anchors_of_cut_texts_are_the_same(monkeypatch):
    b = "".join(R.choice("abc") for _ in range(5000)).encode()
    whole = suffix_dedup.anchors([b, b[:60]], 50)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    assert [sorted(map(tuple, np.array(x).T.tolist())) for x in [suffix_dedup.anchors([b, b[:60]], 50)]] == [sorted(map(tuple, np.array(whole).T.tolist()))]


def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(700):
        v = centres[i % 40] + rng.normal(size=16) * 0.12
        rows.append((i, [float(np.float32(x)) for x in v], i % 40 % 3))
    rows += [(700 + i, rows[5][1], 2) for i in range(60)]
    rows += [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] + [1.0] * 15, 1), (803, [None] + [1.0] * 15, 1), (804, rows[5][1], None), (805, [float("inf")] * 16, 1), (806, [], 1), (807, [1.0, 2.0], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("w", F.lit("clash")).repartition(3)


def test_embedding_links(spark):
    rows, df = vectors(spark)
    good = [(i, np.array(v), lab) for i, v, lab in rows if i < 800]
    m = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    lab = np.array([x for *_, x in good])
    link = (m @ m.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    got = np.array([out[i]["n_links"] for i, *_ in good])
    assert (got <= link.sum(axis=1)).all() and got.sum() >= 0.98 * link.sum() > 0
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i for i in range(800, 808))
    if got.sum() == link.sum():
        want = closed([i for i, *_ in good], [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(link), strict=True)])
        assert {i: out[i]["component_id"] for i in want} == want
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embedding_links_beside_a_hot_group(spark):
    """A third of the rows in one tight group does not set the limit for the others."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    triples = np.repeat(unit(rng.normal(size=(800, 64))), 3, axis=0)
    v = unit(np.concatenate([triples + rng.normal(size=triples.shape) * 0.029, unit(rng.normal(size=64)) + rng.normal(size=(1200, 64)) * 0.002]))
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(3)
    link = (v @ v.T >= 0.93).sum(axis=1) - 1
    out = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    got = np.array([out[i] for i in range(len(v))])
    assert link[:2400].sum() > 1000 and (got <= link).all()
    assert got[:2400].sum() >= 0.998 * link[:2400].sum() and (got[2400:] == link[2400:]).all()


def test_nearest(spark):
    rows, df = vectors(spark)
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    good = [(i, np.array(v)) for i, v, _ in rows if i < 800 or i == 804]
    m = np.array([v / np.linalg.norm(v) for _, v in good])
    out = {}
    for r in hnsw.nearest(df, q, 5, shard=200).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r)
    hit = total = 0
    for n, (i, _) in enumerate(good):
        if i % 50 == 0:
            s = m @ m[n]
            best = sorted((-s[k], j) for k, (j, _) in enumerate(good) if j != i)[:5]
            assert [r["rank"] for r in out[i]] == [1, 2, 3, 4, 5] and all(abs(r["score"] - s[[j for j, _ in good].index(r["vec_id"])]) < 1e-9 for r in out[i])
            hit += sum(-r["score"] <= best[-1][0] + 1e-12 for r in out[i])
            total += 5
    assert hit >= 0.9 * total
    assert set(out) == {i for i, _ in good if i % 50 == 0}
    assert hnsw.nearest(df.where("false"), q, 5).count() == 0
    assert hnsw.nearest(df.where("vec_id < 3"), q.where("query_id = 0"), 5).count() == 2


def test_warc_round_trip(spark, tmp_path):
    html = "<p>" + "é" * 60
    rows = [(3, "http://a/3", html), (1, "http://a/1\r\nX: y", html), (2, None, None), (4, "", "small"), (5, "u", "small"), (None, "n", html), (6, "big", "z" * 300_000)]
    warc.register(spark)
    folder = f"file://{tmp_path}/w"
    warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").load(folder)
    got = {r["page_id"]: r for r in back.collect()}
    assert len(got) == 7 and got[1]["record_type"] == "response" and got[3]["record_type"] == "revisit" and got[3]["refers_to"] == 1 and got[3]["payload"] is None
    assert bytes(got[1]["payload"]).decode() == html and got[3]["payload_bytes"] == 123 and got[3]["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
    assert got[2]["url"] is None and got[2]["payload_bytes"] == 0 and got[4]["record_type"] == got[5]["record_type"] == got[None]["record_type"] == "response"
    assert got[1]["url"] == "http://a/1%0D%0AX: y" and len(got[6]["payload"]) == 300_000
    few = spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'response' and page_id > 3")
    assert {(r["page_id"], r["payload"]) for r in few.collect()} == {(4, None), (5, None), (6, None)}
    empty = f"file://{tmp_path}/e"
    warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).write.format("warc").mode("append").save(empty)
    assert spark.read.format("warc").load(empty).count() == 0


def test_warc_streams_files_without_index(tmp_path):
    w = warc.Writer({"path": f"file://{tmp_path}/w"})
    rows = [{"page_id": i, "url": f"u{i}", "refers_to": 1 if i == 4 else None, "payload_digest": "d", "payload": b"\r\n\r\n" * i * 4000} for i in range(9)]
    w.commit([w.write(iter([pa.RecordBatch.from_pylist(rows)]))])
    for f in (tmp_path / "w").glob("*.idx"):
        f.unlink()
    r = warc.Reader({"path": f"file://{tmp_path}/w"})
    back = [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]
    assert [x["payload"] for x in back] == [None if i == 4 else row["payload"] for i, row in enumerate(rows)]


@pytest.mark.parametrize("n", [0, 1])
def test_pipeline_stages(spark, n):
    base = [" ".join(f"w{R.randrange(300)}" for _ in range(60)) for _ in range(6)]
    rows = docs(spark, [*base, base[0], " ".join([*base[1].split()[:-1], "end"]), "12 34", None]).where("doc_id >= 0" if n else "false")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, "")
        assert i == 4 or out.columns == rows.columns, name
        rows = common.Scratch(spark, "t").save(out, name)
        if n and name == "language_id":
            assert {r["doc_id"] for r in rows.collect()} == set(range(8))
        if n and name == "minhash_near_dedup":
            assert set(range(6)) <= {r["doc_id"] for r in rows.collect()}
    assert rows.count() >= 6 * n


def test_minhash_cut_and_grown_copies(spark):
    """A text, copies that each lack another block of it, and one that only the whole text links with: sizes differ too much for the centre."""
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(300)]
        texts += [" ".join(base[:at] + base[at + 38 :]) for at in (R.randrange(0, 262) for _ in range(40))]
        texts += [" ".join(base), " ".join(base + [f"g{g}n{i}" for i in range(48)])]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), 3, 85, 100).collect()}
    assert out == closed(range(len(texts)), links)


def test_minhash_size_chain(spark):
    """Each text has a few words more than the one before: neighbours link, the ends are far apart."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[: 60 + 6 * i]) for i in range(50)]
    out = minhash.near_duplicates(docs(spark, texts[::-1]), 3, 85, 100).collect()
    assert {r["component_id"] for r in out} == {0}


def test_minhash_rows_that_share_an_id(spark):
    """Rows of one doc_id connect what each of them links with; a very long text is shingled whole."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, a), (5, a), (5, b), (7, b), (8, b + " end"), (9, long), (10, long + " z"), (10, long + " z"), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    out = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect())
    assert out == [(1, 1), (5, 1), (5, 1), (7, 1), (8, 1), (9, 9), (10, 9), (10, 9), (11, 11)]


def test_nearest_ties_and_repeated_ids(spark):
    """Of equal scores the smaller id comes first; rows that share an id are one candidate at its best score; lengths do not mix."""
    rows = [(50, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [0.0, 2.0]), (1, [0.0, -1.0]), (7, [2.0, 0.0]), (7, [0.0, -3.0]), (4, [5.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    out = hnsw.nearest(df, df.where("vec_id = 50").withColumnRenamed("vec_id", "query_id"), 4).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in out] == [(4, 1.0), (7, 1.0), (1, 0.0), (3, 0.0)]


def test_graph_finds_what_it_was_built_from():
    """Insertion through the graph: every node is reached, lists stay in their width, and the same order gives the same graph."""
    v = np.random.default_rng(2).normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    g, again = hnsw.Graph(v), hnsw.Graph(v)
    assert all((a == b).all() for a, b in zip(g.links, again.links, strict=True))
    assert sum(i in g.search(v[i], 32) for i in range(len(v))) >= 0.99 * len(v)
    assert all((links[np.arange(links.shape[1]) < n[:, None]] >= 0).all() for links, n in zip(g.links, g.size, strict=True))
    assert hnsw.Graph(v[:0]).entry == -1 and list(hnsw.Graph(v[:1]).search(v[0], 8)) == [0]
