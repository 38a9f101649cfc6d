import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumindex.config import SearchConfig
from lumindex.functions import analyze, stem
from lumindex.functions import text as tx


def one(spark, column, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def test_split_keeps_symbols_and_cuts_at_punctuation(spark):
    assert one(spark, tx.split(F.col("c0")), "a+b c++ $100 foo_bar don't e-mail") == ["a+b", "c++", "$100", "foo", "bar", "don", "t", "e", "mail"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>one</p><p>two</p>", "one two"), ("&lt;b&gt;", "<b>"), ('<!-- wp:p {"a":1} -->x<!-- /wp:p -->', "x"), ("<script>var a;</script>b<STYLE>c\nd</STYLE>", "b"),
        ("a &amp;lt; b", "a &lt; b"), (None, ""), ("  \n ", ""), ("<!-- a\nb -->t", "t"),
    ],
)
def test_clean(spark, html, text):
    assert one(spark, tx.clean(F.col("c0")), html) == text
    assert one(spark, tx.clean(F.col("c0"), general=True), html) == text


def test_clean_shortcodes_and_general_entities(spark):
    assert one(spark, tx.clean(F.col("c0"), shortcodes=("box",)), "a [box x=1]in[/box] [other] b") == "a [other] b"
    assert one(spark, tx.clean(F.col("c0"), general=True), "caf&eacute;") == "café"


def test_fold_and_tokens(spark):
    assert one(spark, F.lower(tx.fold(F.col("c0"))), "Été Straße ŒUVRE") == "ete strase oeuvre"
    assert one(spark, tx.fold(F.col("c0")), "Łódź Škoda őrség Ơn cafe\u0301 Ǝ £5 €5") == "Lodz Skoda orseg On cafe Ǝ 5 E5"
    cfg = SearchConfig()
    assert one(spark, tx.tokens(F.col("c0"), cfg), "the photo x Photo studio") == ["photo", "photo", "studio"]
    custom = SearchConfig(stopwords_mode="custom", stopwords_custom="Photo, été")
    assert one(spark, tx.tokens(F.col("c0"), custom), "the photo été") == ["the", "ete"]


def test_clamp_to_characters_and_bytes(spark):
    assert one(spark, tx.clamp(F.col("c0")), "a" * 100) == "a" * 64
    assert one(spark, tx.clamp(F.col("c0")), "я" * 60) == "я" * 32


def test_fuzzy_distance_by_bytes(spark):
    sizes = {w: one(spark, tx.fuzzy_distance(F.col("c0"), SearchConfig()), w) for w in ("abc", "abcd", "abcdefg", "abcdefgh")}
    assert list(sizes.values()) == [0, 1, 1, 2]
    assert one(spark, tx.fuzzy_distance(F.col("c0"), SearchConfig(fuzzy="one")), "abcdefgh") == 1
    assert one(spark, tx.fuzzy_distance(F.col("c0"), SearchConfig(fuzzy="off")), "abcdefgh") == 0


def test_snippet_marks_and_escapes(spark):
    text = "x " * 60 + "A photograph & more <b>"
    out = one(spark, tx.snippet(F.col("c0"), F.col("c1")), text, "photo photograph")
    assert out.startswith("…") and "A <mark>photograph</mark> &amp; more &lt;b&gt;" in out
    assert one(spark, tx.snippet(F.col("c0"), F.col("c1")), "", "photo") == ""
    assert one(spark, tx.snippet(F.col("c0"), F.col("c1")), "abc", "?") == "abc"
    assert one(spark, tx.highlight_words(F.col("c0")), "to a photo c++") == ["photo", "c++", "to"]


@pytest.mark.parametrize(("word", "want"), [("counter", "count"), ("partner", "partn"), ("ponies", "poni"), ("sky", "sky"), ("be", "be"), ("c++s", "c++s"), ("caresses", "caress"), ("happy", "happi")])
def test_stem(word, want):
    assert stem.stem(word) == want


@given(st.text("abcdeginosty", max_size=14))
def test_stem_is_never_longer_by_more_than_a_letter(word):
    assert len(stem.stem(word)) <= len(word) + 1


def test_config_ranges_and_hash():
    c = SearchConfig(bm25_k1=9, fuzzy="x", max_expansions=0, taxonomies=(), fields=("taxonomy",)).clamped()
    assert (c.bm25_k1, c.fuzzy, c.max_expansions, c.fields) == (3.0, "auto", 1, ("title",))
    assert SearchConfig().pipeline_hash() == SearchConfig(weight_title=9.0, post_types=("page", "post")).pipeline_hash()
    assert SearchConfig().pipeline_hash() != SearchConfig(stemming=True).pipeline_hash()


def test_general_entities_need_their_semicolon(spark):
    text = "a &amp b &ampc; &eacute;t&eacute &amp;lt; &#233; &#233 &nosuch; &&&amp"
    assert one(spark, tx.clean(F.col("c0"), general=True), text) == "a &amp b &ampc; ét&eacute &lt; é &#233 &nosuch; &&&amp"


def test_one_pass_gives_the_terms_of_the_columns(spark):
    texts = [
        "<p>one</p><P>Two</P> <!-- wp:p {\"a\":1} -->x<!-- /wp:p --> <ſcript>kept</ſcript><SCRIPT>gone</script>", "Æther straße ÉTÉ e\u0301te\u0301 İstanbul ΑΣ.Β ΟΔΟΣ", "the a b cc it's &amp;lt; &quot;q&quot; <b",
        "я" * 60 + " " + "x" * 70 + " " + "é" * 70 + " 😀" * 20, "a\u00a0b\u2003c\u200bd\u0085e\x1cf ࡰq \U0001f9ff", "[gone x]cut[/gone] [gones] <!-- open", "$100 c++ a+b foo_bar", "", " \n",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    for cfg in (SearchConfig(shortcodes=("gone",)), SearchConfig(stopwords_mode="none", min_token_length=1)):
        codes, known = [re.compile(rf"(?s)\[{n}\b[^\]]*\](?:.*?\[/{n}\])?", re.ASCII) for n in cfg.shortcodes], set(cfg.stopwords())
        separators = analyze.Separators(dict.fromkeys(map(ord, analyze.unknown(spark)), 32))
        for row in df.select("s", tx.tokens(tx.clean(F.col("s"), cfg.shortcodes), cfg).alias("want")).collect():
            got = [analyze.clamp(t) for t in analyze.words(analyze.clean(row["s"], codes, False), separators) if len(t) >= cfg.min_token_length and t not in known]
            assert got == row["want"]


def test_clamp_looks_at_its_text_once(spark):
    plan = spark.range(1).select(tx.clamp(F.replace(F.col("id").cast("string"), F.lit("1"), F.lit("2"))).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == 1
