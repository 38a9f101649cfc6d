"""Language identification by words first, backing off to ever shorter character n-grams for unseen words.

Training counts words and n-grams of 4 to 1 characters (with word ends marked) on a sample of labelled rows of
about ``per_lang`` documents a language, chosen by a hash of doc_id; the most frequent ``max_words`` words and
``max_grams`` n-grams of each length and language make the model, whose size these parameters bound. Each word of a text
adds its log frequency in every language if the model knows the word; otherwise the mean log frequency of its n-grams
of the greatest length of which any is known; otherwise nothing. The score is the predicted language's share after a
softmax of the sums, tempered so that more than ``TEMPER`` words count as that many.

Defined results: ``und`` with score 0 for a null text, a text without a letter and any text if nothing was learned; ties
go to the language first in order. Repeated rows get the same answer. Rows without doc_id are never learned from. Only
``text`` is looked at in a prediction; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
LENGTHS = (4, 3, 2, 1)
TEMPER = 12
MEMO = 300_000  # unseen words whose scores a worker remembers at a time


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; number-like characters do not make a word on their own."""
    found = WORD.findall((text or "").lower())
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """langs in order; for n = 0 (words) and each n-gram length, term -> log frequencies by language."""

    langs: list[str]
    tables: dict[int, dict[str, tuple[float, ...]]]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A worker's view of the model: known words as rows of a matrix, unseen ones appended as they come."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.langs)
        words = model.tables.get(0, {})
        self.known = {w: i for i, w in enumerate(words)}
        self.rows = np.array(list(words.values()), dtype=np.float64).reshape(len(words), self.width)
        self.memo: dict[str, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        got = self.memo.get(word)
        if got is None:
            got = np.zeros(self.width)
            for n in LENGTHS:
                table = self.model.tables.get(n, {})
                found = [table[g] for g in grams(word, n) if g in table]
                if found:
                    got = np.mean(found, axis=0)
                    break
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.width:
            return UNKNOWN, 0.0
        get = self.known.get
        at = [get(w, -1) for w in words]
        index = np.array(at)
        total = self.rows[index[index >= 0]].sum(axis=0)
        for w, n in Counter(w for w, i in zip(words, at, strict=True) if i < 0).items():
            total = total + n * self.unseen(w)
        total = total * (min(len(words), TEMPER) / len(words))
        best = int(np.argmax(total))
        return self.model.langs[best], float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum())


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's text is divisible by 5, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, per_lang: int = 4000, max_words: int = 20_000, max_grams: int = 5_000) -> Model:
    """Fit on the rows of ``docs(doc_id, text, lang)`` that are not held out and have text and lang."""
    common.small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], {})
    langs = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])

    def count(batches):
        for b in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            out = [(lang, 0, w, c) for lang, ws in seen.items() for w, c in ws.items()]
            for lang, ws in seen.items():
                for n in LENGTHS:
                    of_n: Counter = Counter()
                    for w, c in ws.items():
                        for g in grams(w, n):
                            of_n[g] += c
                    out += [(lang, n, g, c) for g, c in of_n.items()]
            for i in range(0, len(out), 50_000):
                cols = list(zip(*out[i : i + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["lang", "n", "term", "c"])

    terms = sample.select("text", "lang").mapInArrow(count, "lang string, n int, term string, c long").groupBy("lang", "n", "term").agg(F.sum("c").alias("c"))
    per = Window.partitionBy("lang", "n")
    keep = (
        terms.withColumn("total", F.sum("c").over(per))
        .withColumn("rank", F.row_number().over(per.orderBy(F.desc("c"), "term")))
        .where((F.col("c") > 1) & (F.col("rank") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams)))
        .select("lang", "n", "term", "c", "total")
        .collect()
    )
    at = {lang: i for i, lang in enumerate(langs)}
    totals: dict[tuple[int, int], int] = {}
    raw: dict[int, dict[str, dict[int, int]]] = {}
    for r in keep:
        totals[r["n"], at[r["lang"]]] = r["total"]
        raw.setdefault(r["n"], {}).setdefault(r["term"], {})[at[r["lang"]]] = r["c"]
    tables = {
        n: {t: tuple(math.log((by.get(i, 0) + 0.5) / (totals.get((n, i), 0) + 1.0)) for i in range(len(langs))) for t, by in terms_.items()}
        for n, terms_ in raw.items()
    }
    return Model(langs, tables)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by train()'s parameters
    base = docs.drop("lang_pred", "score")
    at = base.columns.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = shared.value.scorer()
        for b in batches:
            got = [scorer.predict(t) for t in b.column(at).to_pylist()]
            extra = [pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows in which a language was found, with the columns they came with."""
    names = docs.columns
    model = train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score") if c in names}), model).where(F.col("lang_pred") != UNKNOWN).drop("lang_pred", "score").withColumnsRenamed({f"__{c}": c for c in ("lang_pred", "score") if c in names})


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
