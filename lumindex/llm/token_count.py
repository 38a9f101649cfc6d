"""Counts of unigram tokens without tokens: Aho-Corasick names the vocabulary matches, Viterbi keeps score and count.

The pieces of a sentencepiece file are the vocabulary. A unigram file's scores are used as they are; a file of another
kind has no log probabilities, so Zipf's rule gives them: ``-ln(rank + 2)`` for a piece's rank among the pieces. A text is
normalised as the file says (a leading space, spaces as U+2581); the best segmentation is the one that the tokenizer
finds: sums are rounded to single precision after every piece, and of equal sums the one whose last piece starts first
is kept; once the sum at a start is below -100,000 it counts from 0 again. Characters without a piece cost the lowest score less 10 and count as their UTF-8 bytes.

No piece of such a vocabulary holds U+2581 after another character, nor a character that is in no piece, so texts fall
apart there and a worker remembers stretches: the scores of the best path, its number of pieces and the margin by which
the path won. A sum so far can change a stretch's path only by rounding, so a stretch whose margin is above what rounding
can add up to only has its scores added, rounded one by one; any other is computed afresh from that sum.

Defined results: null and empty texts have 0 tokens and score 0; each row is counted on its own, repeated or not; only
``text`` is read. Vocabularies without byte pieces, with positive scores, with another normaliser or with pieces that
hold a space inside raise ValueError.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import frexp, inf, ldexp, log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

SPACE = "▁"
PENALTY = 10.0  # what an unknown character costs beyond the lowest score (the tokenizer's fixed value)
RESET = -100_000.0  # below this sum the tokenizer counts from 0 again, to keep its precision (its fixed value)
MEMO = 400_000  # stretches that a worker remembers at a time
SHORT = 64  # characters of a stretch that is remembered
EXACT = 1 << 24  # float spacings in a power of two of single precision
MAGIC = 1.5 * (1 << 52)  # added to a double, leaves no digits after the point


def single(x: float) -> float:
    return float(np.float32(x))


def fields(data: bytes) -> dict[int, list]:
    """Top-level fields of a protocol buffer message: number -> values."""
    out: dict[int, list] = {}
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, i = data[i : i + n], i + n
        out.setdefault(tag >> 3, []).append(value)
    return out


class Counter:
    """Counts for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = fields(f.read())
        norm = fields(top[3][0]) if 3 in top else {}
        if norm.get(2, [b""])[0] or norm.get(4, [1])[0] or not norm.get(5, [1])[0]:
            raise ValueError(f"{path}: only the identity normaliser that keeps and escapes spaces is supported")
        unigram = fields(top[2][0]).get(3, [1])[0] == 1 if 2 in top else True
        self.prefix = bool(norm.get(3, [1])[0])
        self.scores, has_bytes = {}, False
        for rank, raw in enumerate(top[1]):
            p = fields(raw)
            kind = p.get(3, [1])[0]
            has_bytes |= kind == 6
            if kind == 1:
                own = float(np.frombuffer(p[2][0], "<f4")[0]) if 2 in p else 0.0
                self.scores[p[1][0].decode()] = own if unigram else single(-log(rank + 2))
        if not has_bytes or max(self.scores.values()) > 0 or any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError(f"{path}: a vocabulary with byte pieces, scores up to 0 and spaces at the start of pieces is needed")
        self.unknown = single(min(self.scores.values()) - PENALTY)
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        chars = "".join(re.escape(c) for c in sorted(set("".join(self.scores)) - {SPACE}))
        #: A run of spaces with what follows it, or one character that no piece has.
        self.split = re.compile(f"{SPACE}*[{chars}]+|{SPACE}+|.", re.DOTALL)
        self.chars = set("".join(self.scores))
        self.memo: dict[str, tuple[tuple[float, ...], int, float]] = {}

    def viterbi(self, text: str, base: float, rounded) -> tuple[list[float], list[int], list[int], list[float]]:
        """For each end: the best sum from ``base`` on, its pieces, its last piece's start, and its lead over the second."""
        n = len(text)
        best, count, start, lead = [base] * (n + 1), [0] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        ends = self.automaton.iter(text)
        end, found = next(ends, (n, None))
        for at in range(n):
            top = second = None
            pieces = begin = 0
            alone = False
            while end == at:  # the longest piece, so the earliest start, comes first
                size, score = found
                alone |= size == 1
                s = rounded(best[at + 1 - size] + score)
                if top is None or s > top:
                    second, top, begin = top, s, at + 1 - size
                    pieces = count[begin] + 1
                elif second is None or s > second:
                    second = s
                end, found = next(ends, (n, None))
            if not alone:
                s = rounded(best[at] + self.unknown)
                if top is None or s > top:
                    second, top, begin = top, s, at
                    pieces = count[at] + len(text[at].encode("utf-8", "surrogatepass"))
                elif second is None or s > second:
                    second = s
            at += 1
            best[at], count[at], start[at] = top, pieces, begin
            lead[at] = inf if second is None else top - second
        return best, count, start, lead

    def remember(self, text: str) -> tuple[tuple[float, ...], int, float]:
        best, count, start, lead = self.viterbi(text, 0.0, float)
        path, least, end = [], inf, len(text)
        while end:
            piece = text[start[end] : end]
            path.append(self.scores.get(piece, self.unknown))
            least = min(least, lead[end])
            end = start[end]
        got = tuple(path[::-1]), count[-1], least / (2 * len(text) + 2)
        if len(text) <= SHORT:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = got
        return got

    def count(self, text: str | None) -> tuple[int, float]:
        """Number of tokens and best sum of a text."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        base, gone, total, memo = 0.0, 0.0, 0, self.memo.get
        # Sums down to -edge are multiples of unit in single precision; adding and taking away magic rounds to them.
        edge, unit, magic = 0.0, 0.0, 0.0
        for part in self.split.findall(SPACE + text if self.prefix else text):
            if len(part) == 1 and part not in self.chars:
                path, n, lead = (self.unknown,), len(part.encode("utf-8", "surrogatepass")), inf
            else:
                path, n, lead = memo(part) or self.remember(part)
            after = base
            for s in path:
                after = after + s + magic - magic
            if after <= -edge:  # the sum has left its power of two: round one by one
                after = base
                for s in path:
                    after = single(after + s)
                edge = ldexp(1.0, frexp(after)[1]) if after else 0.0
                unit = edge / EXACT
                magic = unit * MAGIC
            if after < RESET:
                after, n, lost = self.crossing(part, base)
                gone += lost
            elif lead <= unit:
                best, count, *_ = self.viterbi(part, base, single)
                after, n = best[-1], count[-1]
            if after < RESET or lead <= unit or after > base:
                if after < RESET:
                    gone, after = gone + after, 0.0
                edge = ldexp(1.0, frexp(after)[1]) if after else 0.0
                unit = edge / EXACT
                magic = unit * MAGIC
            base, total = after, total + n
        return total, base + gone

    def crossing(self, text: str, base: float) -> tuple[float, int, float]:
        """A stretch in which sums fall below ``RESET``: the tokenizer then counts from 0 again, taking the sum at that start from all sums ahead."""
        n, by, gone = len(text), {}, 0.0
        for end, (size, score) in self.automaton.iter(text):
            by.setdefault(end + 1 - size, []).append((size, score))
        longest = max((size for found in by.values() for size, _ in found), default=1)
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = base
        for at in range(n):
            if best[at] < RESET:
                less = best[at]
                gone += less
                for k in range(at, min(n, at + longest) + 1):
                    if best[k] is not None:
                        best[k] = single(best[k] - less)
            found = by.get(at, [])
            if all(size > 1 for size, _ in found):
                found = [*found, (1, None)]
            for size, score in found:
                s = single(best[at] + (self.unknown if score is None else score))
                if best[at + size] is None or s > best[at + size]:
                    best[at + size] = s
                    count[at + size] = count[at] + (len(text[at].encode("utf-8", "surrogatepass")) if score is None else 1)
        return best[-1], count[-1], gone


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``best_score``; columns of these names are replaced."""
    common.small_batches(docs.sparkSession)
    base = docs.drop("n_tokens", "best_score")
    at = base.columns.index(text)
    schema = T.StructType([*base.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("best_score", T.DoubleType())])

    def run(batches):
        c = counter(path)
        for b in batches:
            got = [c.count(x) for x in b.column(at).to_pylist()]
            extra = [pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "n_tokens", "best_score"])

    return base.mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "best_score")
