"""Helpers of these tests."""


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None):
    """Documents numbered from 0 in the table's columns."""
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    return spark.createDataFrame(rows, DOCS).repartition(3)
