import hashlib
import random
import struct
import time
from collections import Counter

import pytest
from helpers import docs
from pyspark.sql import functions as F

import corpus_pipeline
from lumindex.llm import bpe, langid, line_dedup, packing, token_count

P = pytest.importorskip("public_tokenizers")
R = random.Random(5)
ODD = ["", "<|endoftext|>a <|endoftext|>", "a" * 3000, " " * 300 + "x", "\n\n \t x", "ß" * 700, "'s't're don't", "日本語" * 200, "\x00\x01é́🙂" * 50, "=-" * 500, "a \x1c b", "x\n y", "  a", "a  "]
ODD += ["".join(R.choice("aabbé \n'st0-=<|>") for _ in range(R.randint(1, 500))) for _ in range(120)]
ODD += ["".join(R.choice(["the", "ing", "aa", "ation"]) for _ in range(R.randint(100, 400))) for _ in range(15)]


def test_bpe_equals_the_library_and_round_trips():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    mine, lib = bpe.Transducer(path), Tokenizer.from_file(path)
    for t in ODD:
        ids = mine.encode(t)
        assert mine.count(t) == len(ids) and mine.digest(t)[:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert mine.decode(ids) == t == lib.decode(ids, skip_special_tokens=False)
    for _ in range(100):
        ids = [R.randrange(50257) for _ in range(30)]
        assert mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_pair_rule_equals_plain_merges():
    t = bpe.Transducer(P.path("byte_bpe_50k.json"))
    known = [i for i in range(256, 5000) if t.merged(t.bytes[i]) == [t.bytes[i]]]
    for _ in range(2000):
        a, b = R.choice(known), R.choice(known)
        assert t.fits(a, b) == (t.merged(t.bytes[a] + t.bytes[b]) == [t.bytes[a], t.bytes[b]])


def test_bpe_buffer_stays_small():
    t = bpe.Transducer(P.path("byte_bpe_50k.json"))
    chunk = b"ation" * 100
    seen = 0

    def chunks():
        nonlocal seen
        for _ in range(50):
            seen += len(chunk)
            yield chunk

    out = t.emit(chunks())
    next(out)
    assert seen < 5000  # the first tokens come long before the end


def test_bpe_of_long_words_and_texts_comes_in_short_lists():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    mine, lib = bpe.Transducer(path), Tokenizer.from_file(path)
    for t in ["ation\u00e9" * 60_000, "the word " * 40_000, " ".join(["x" * 70_000, "a  b\n\n c", "y" * 140_000]), "=-" * 100_000 + "\x1c" + "b" * 200]:
        assert mine.encode(t) == lib.encode(t, add_special_tokens=False).ids
        assert max(map(len, mine.pieces(t))) < 3 * bpe.SLICE and max(len(s) for some in mine.pieces(t) for s in some) < 10 * bpe.SLICE


def test_bpe_rows(spark):
    """Repeated rows, shared and null ids, and columns that clash."""
    path = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (2, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    out = bpe.digests(df, path).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == [(0, 1), (1, 1), (1, 2), (1, 2), (2, 0)]


def test_bpe_columns(spark):
    path = P.path("byte_bpe_50k.json")
    df = docs(spark, ["hello wörld", None, ""]).withColumn("ids", F.lit(1))
    out = bpe.decode(bpe.encode(df, path), path).orderBy("doc_id").collect()
    assert [r["decoded"] for r in out] == ["hello wörld", "", ""] and list(out[1]["ids"]) == []
    assert bpe.digests(df.where("false"), path).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram_twin(counter, path):
    """The file as a unigram model with the operator's scores, for the library to read."""
    msg = lambda f, v: varint(f << 3 | 2) + varint(len(v)) + v
    top = token_count.fields(open(path, "rb").read())
    out = b""
    for raw in top[1]:
        p = token_count.fields(raw)
        kind, name = p.get(3, [1])[0], p[1][0]
        score = counter.scores.get(name.decode(), 0.0) if kind == 1 else 0.0
        out += msg(1, msg(1, name) + bytes([0x15]) + struct.pack("<f", score) + bytes([0x18, kind]))
    trainer = top[2][0]
    assert trainer.count(b"tok_v0\x18\x02") == 1
    return out + msg(2, trainer.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01")) + msg(3, top[3][0])


def test_token_counts_equal_the_library():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    c = token_count.Counter(path)
    lib = sentencepiece.SentencePieceProcessor(model_proto=unigram_twin(c, path))
    for t in [*ODD, "Wh%%% thorinou&&& onnd*** " * 3000, "a&&&b" * 9000, "🙂x" * 4000]:
        assert c.count(t)[0] == len(lib.encode(t)), t[:50]


def test_token_counts_columns(spark):
    out = token_count.token_counts(docs(spark, ["a b", None, ""]).withColumn("n_tokens", F.lit("clash")), P.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in out] == [2, 0, 0] and out[1]["best_score"] == 0.0


EN = ["the cat and the dog were on the mat", "this is the house that was built", "she said that they were in the garden"]
DE = ["der hund und die katze sind im garten", "das ist das haus das gebaut wurde", "sie sagte dass es nicht so ist"]


def test_langid(spark):
    texts = (EN + DE) * 20
    df = docs(spark, texts, (["en"] * 3 + ["de"] * 3) * 20)
    model = langid.train(df)
    asked = docs(spark, ["the dog is in the house", "die katze und das haus", None, "123 !!", "", "gartenhaus"]).withColumn("score", F.lit("clash"))
    out = {r["doc_id"]: r for r in langid.identify(asked, model).collect()}
    assert [out[i]["lang_pred"] for i in range(6)] == ["en", "de", "und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[2]["score"] == 0.0
    assert langid.train(df.where("false")).langs == []
    assert langid.identify(asked, langid.train(df.where("false"))).where("lang_pred <> 'und'").count() == 0


def test_langid_learns_from_the_right_rows(spark):
    df = docs(spark, (EN + DE) * 20, (["en"] * 3 + ["de"] * 3) * 20)
    swapped = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert langid.train(swapped).langs == ["de", "en"]


def test_lines(spark):
    a, b = "one two three four five six seven eight nine ten", "other words are here to stay in place"
    texts = [f"{a}\n{b}\nshort line", f"{a.upper()}!\nkept line of its own words\nshort line", None, "", f"{a}\n{a}", "x"]
    df = docs(spark, texts).withColumn("n_lines", F.lit("clash"))
    out = {r["doc_id"]: r for r in line_dedup.repeated_lines(df).collect()}
    assert out[0]["text"] == texts[0] and out[1]["text"] == "kept line of its own words\nshort line"
    assert out[2]["text"] is None and out[3]["text"] == "" and out[4]["text"] == "" and out[4]["n_removed"] == 2 and out[5]["n_removed"] == 0
    assert line_dedup.repeated_lines(df.where("false")).count() == 0
    assert line_dedup.without_repeats(df).columns == df.columns


def test_short_lines_and_lines_without_spaces(spark):
    """Equal lines of one to three words go too, whatever the script; lines without letters stay."""
    texts = ["les\nand ornd\nof edti oner\n重复的一行没有空格\n--", "Les\nown\nand  ornd!\nof edti oner\n重复的一行没有空格\n--"]
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs(spark, texts)).collect()}
    assert out == {0: texts[0], 1: "own\n--"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def alike(a, b):
    """Edit similarity of at least 0.8; what the letters alone rule out is not measured."""
    most = max(len(a), len(b)) // 5
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total()) <= most and distance(a, b) <= most


def word():
    return "".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randint(2, 9)))


def removed_by_brute_force(lines):
    part = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j in range(i):
            if part[i] != part[j] and (x == lines[j] or (min(len(x.split()), len(lines[j].split())) >= 4 and alike(x, lines[j]))):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return {i for i, p in enumerate(part) if p != i}


def removed(spark, lines):
    out = line_dedup.repeated_lines(docs(spark, lines), least=1).select("doc_id", "n_removed").collect()
    assert len(out) == len(lines)
    return {r["doc_id"] for r in out if r["n_removed"]}


def test_fuzzy_lines_with_one_word_replaced(spark):
    """Twelve words of which one is another: all near copies go, and nothing else."""
    lines = [[word() for _ in range(12)] for _ in range(200)]
    near = [[*w[:i], word(), *w[i + 1 :]] for w in lines for i in [R.randrange(12)]]
    lines = [" ".join(w) for w in lines + near]
    want = removed_by_brute_force(lines)
    got = removed(spark, lines)
    assert got <= want and len(want) > 150 and len(got) >= 0.95 * len(want)


def test_fuzzy_lines_equal_brute_force(spark):
    """Words replaced, inserted, left out and misspelt in lines of all lengths, chains of such edits, and lines of one word."""
    lines = [[word() for _ in range(n)] for n in [1, 2, 3, 3, *range(4, 44)]]
    for _ in range(220):
        w = list(R.choice(lines))
        for _ in range(R.choice([1, 1, 1, 2])):
            i, kind = R.randrange(len(w)), R.randrange(4)
            w[i : i + 1] = [[word()], [w[i], word()], [], [w[i][:-1] + R.choice("xyz")]][kind]
            w = w or ["a"]
        lines.append(w)
    lines = [" ".join(w) for w in lines] + ["\u65e5\u672c\u8a9e\u306e\u4e00\u884c", "\u65e5\u672c\u8a9e\u306e\u4e00\u884c"]
    want, got = removed_by_brute_force(lines), removed(spark, lines)
    assert got <= want and len(got) >= 0.9 * len(want) > 100


def test_fuzzy_lines_with_edits_at_both_ends(spark):
    """Words replaced in the first six and the last six, or all over a long line, leave blocks between them."""
    lines = [[word() for _ in range(R.randint(40, 70))] for _ in range(60)]
    ends = [[word() if i in (1, 4, len(w) - 5, len(w) - 2) else x for i, x in enumerate(w)] for w in lines]
    spread = [[word() if i % 10 == 4 else x for i, x in enumerate(w)] for w in lines]
    got = removed(spark, [" ".join(w) for w in lines + ends + spread])
    assert got <= set(range(60, 180)) and len(got) >= 0.99 * 120


def test_fuzzy_lines_with_a_common_passage(spark):
    """A passage in lines that are unlike otherwise, and near copies of one line among them: only the copies go."""
    passage, base = [word() for _ in range(14)], [word() for _ in range(30)]
    lines = [[*(word() for _ in range(15)), *passage, *(word() for _ in range(15))] for _ in range(80)]
    lines += [base] + [[*base[:i], word(), *base[i + 1 :]] for i in range(0, 30, 2)]
    assert removed(spark, [" ".join(w) for w in lines]) == set(range(81, 96))


def test_fuzzy_lines_with_a_passage_at_other_places(spark, monkeypatch):
    """No alignment can match a passage at the beginning of one line with that at the end of another, so such pairs are not compared."""
    passage, pairs, compared = [word() for _ in range(20)], [], line_dedup.compared
    lines = [x for _ in range(30) for x in ([*passage, *(word() for _ in range(24))], [*(word() for _ in range(24)), *passage])]
    lines += [[*lines[i][:30], word(), *lines[i][31:]] for i in range(10)]

    def seen(those, *args):
        pairs.append(those.count())
        return compared(those, *args)

    monkeypatch.setattr(line_dedup, "compared", seen)
    assert removed(spark, [" ".join(w) for w in lines]) == set(range(60, 70))
    assert sum(pairs) < 0.7 * 70 * 69 / 2


def test_pairs_of_several_buckets_meet_once(spark):
    """All pairs of other components and neighbouring steps that share a bucket, however many they share, whatever its main component is."""
    own = random.Random(3)
    nodes = {i: (own.randint(1, 6), own.randint(0, 3), own.sample(range(9), own.randint(2, 5))) for i in range(40)}
    main = {k: own.randint(1, 6) for k in range(9)}
    rows = [(k, step, i, c, main[k], keys) for i, (c, step, keys) in nodes.items() for k in keys]
    df = spark.createDataFrame(rows, "key long, step byte, node long, c long, main long, keys array<long>")
    got = [(r["a"], r["b"]) for r in line_dedup.apart(df, F.lit(True), F.lit(True)).collect()]
    want = {(i, j) for i, x in nodes.items() for j, y in nodes.items() if i < j and x[0] != y[0] and abs(x[1] - y[1]) < 2 and set(x[2]) & set(y[2])}
    assert len(got) == len(set(got)) and set(got) == want


def test_fuzzy_lines_edges(spark):
    """Null ids, shared ids, ties, very long lines and chains."""
    long = " ".join(word() for _ in range(20_000))
    chain = [word() for _ in range(30)]
    steps = [" ".join([*(f"q{j}" for j in range(3 * i)), *chain[3 * i :]]) for i in range(8)]
    rows = [(None, long), (1, long), (2, long + " end"), (3, "a b c d e f\nA, b c d e f"), (3, "other\nown words only here"), (4, "own words only here")]
    rows += [(10 + i, t) for i, t in enumerate(steps)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("lang", F.lit("x"))
    out = sorted(((r["doc_id"] or 0, r["text"]) for r in line_dedup.without_repeats(df).collect()))
    assert out[:6] == [(0, long), (1, long), (2, ""), (3, "a b c d e f"), (3, "other\nown words only here"), (4, "")]
    assert [t for i, t in out if i >= 10] == [steps[0]] + [""] * 7
    assert line_dedup.without_repeats(df).columns == df.columns


def test_lines_leave_no_shuffle_files(spark):
    """What the tables of a run shuffled is gone once they are written."""
    files = lambda: {str(f): f.length() for f in (all_files.apply(i) for i in range(all_files.size())) if "shuffle_" in f.getName()}
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    all_files = disk.getAllFiles()
    before = set(files())
    lines = [" ".join(word() for _ in range(12)) for _ in range(2000)]
    line_dedup.repeated_lines(docs(spark, lines + lines[:500]), least=1)
    for _ in range(20):  # they are deleted in the background
        all_files = disk.getAllFiles()
        left = sum(n for f, n in files().items() if f not in before)
        if left < 20_000:
            break
        time.sleep(0.5)
    assert left < 20_000


def brute_bounds(hist, k):
    from itertools import combinations

    lengths = sorted(hist)
    best = None
    for n in range(1, k + 1):
        for cut in combinations(lengths[:-1], n - 1):
            bounds = [*cut, lengths[-1]]
            cost = sum(c * next(b for b in bounds if b >= x) for x, c in hist.items())
            best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    for _ in range(40):
        hist = {R.randint(1, 40): R.randint(1, 9) for _ in range(R.randint(1, 9))}
        k = R.randint(1, 4)
        bounds = packing.best_bounds(hist, k)
        assert len(bounds) <= k and bounds[-1] == max(hist)
        assert sum(c * next(b for b in bounds if b >= x) for x, c in hist.items()) == brute_bounds(hist, k)
    assert packing.best_bounds({}, 3) == []


def test_packing(spark):
    texts = ["w " * R.randint(0, 60) for _ in range(80)] + [None, ""]
    out = packing.packed(docs(spark, texts), max_len=25, n_buckets=3, budget=100).collect()
    assert sum(r["n_tokens"] for r in out) == sum(len((t or "").split()) for t in texts)
    by = {}
    for r in out:
        assert r["n_tokens"] <= r["bucket_len"] <= 25
        by.setdefault((r["bucket_len"], r["batch"]), []).append(r["slot"])
    for (size, batch), slots in by.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= 100 // size
        assert len(slots) == 100 // size or (size, batch + 1) not in by
    assert packing.packed(docs(spark, [None])).count() == 0


def test_registered_packing_counts_tokens(spark, tmp_path):
    texts = ["日本語" * 3000, "YWJjZGVm" * 2000, "two words", None, "", " " * 9000 + "x"]
    docs(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for out in (packing.op9(spark, f"file://{tmp_path}").collect(), corpus_pipeline.pack(spark, docs(spark, texts), "").collect()):
        by = {}
        for r in out:
            by[r["doc_id"]] = by.get(r["doc_id"], 0) + r["n_tokens"]
        assert by == {i: count(texts[i]) for i in (0, 1, 2, 5)} and by[0] > 2048 and max(r["n_tokens"] for r in out) == 2048
