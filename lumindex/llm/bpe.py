"""Byte-level BPE as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if each adjacent pair is stable, that is
if the merges, run on the bytes of the pair alone, give the pair back. So every prefix has one last token, and
the encodings of all prefixes form a tree. No token is longer than the merge list's longest one, so whatever bytes
follow, the final path runs through one of the last ``lookahead`` positions; tokens before the common
ancestor of these positions can no longer change and are emitted. The buffer holds only the rest.

Decoding feeds token bytes to an incremental UTF-8 decoder, which keeps at most three pending bytes and replaces
ill-formed sequences by U+FFFD.

The tokenizer file is a parameter. Ids come in short lists, and hashes and decoded text are taken from them as they come, so beside
the text itself memory follows neither a text's length nor that of its longest word.

Defined results: null texts are read as empty; empty texts give no ids; an empty table gives no rows; repeated rows and rows that
share a doc_id are encoded each on its own; null doc_ids stay; of a pair's equal ranks the leftmost merges first, as in the library;
``encode`` and ``decode`` pass other columns through and replace one of their output's name, the digests return their own columns only.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

# The published byte-level pre-tokenizer pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000  # entries that a worker's word and pair memos may hold before they are emptied
WORD = 64  # bytes; longer pieces go through the streaming buffer and are not memoised
SLICE = 1 << 16  # characters of a text without longer white space that are taken at a time
STEP = 4096  # strings of ids, or ids, that are handed on at a time
NEVER = 1 << 60  # the rank of a pair that no merge joins
RUN = re.compile(r"\s\s+")
ODD = re.compile("[\x1c-\x1f]")  # white space to one of the regular-expression libraries only


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: Latin-1's visible characters stand for themselves, the rest follow from 256 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
        # Only tokens that the merges can produce end a prefix; the longest of them bounds the lookahead.
        made = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.size = [0] * (max(self.ids.values()) + 1)
        self.automaton = ahocorasick.Automaton()  # over Latin-1 characters, which stand for bytes
        for b, i in self.ids.items():
            if b in made:
                self.size[i] = len(b)
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lookahead = max(self.size)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        for content, i in self.added.items():
            self.bytes[i] = content.encode()
        self.split_added = regex.compile("|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.find = regex.compile(PATTERN)
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in self.rank:
            self.made.setdefault(a + b, (a, b))
        self.edges: tuple[dict, dict] = ({}, {})
        self.stable: dict[int, bool] = {}
        self.chunks: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.memo: dict[str, tuple[str, int]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merges run plainly on ``data``: the lowest-ranked adjacent pair first, the leftmost of equals first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
            if (best := min(ranks)) == NEVER:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at the right (1) or left (0) end of ``token`` while it is merged, from its byte up, each with the rank that absorbs it."""
        known = self.edges[side].get(token)
        if known is None:
            out, until = [], NEVER
            part = token
            while True:
                out.append((part, until))
                if part not in self.made:
                    break
                pair = self.made[part]
                until, part = self.rank[pair], pair[side]
            known = self.edges[side][token] = out[::-1]
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave the pair as it is: no merge across the boundary comes before the parts beside it are absorbed."""
        if len(self.stable) >= CACHE:
            self.stable.clear()
        a, b, i, j, rank = self.edge(self.bytes[left], 1), self.edge(self.bytes[right], 0), 0, 0, self.rank
        while True:
            (x, px), (y, py) = a[i], b[j]
            across = rank.get((x, y), NEVER)
            # Of equal ranks the leftmost goes first: the one in the left token, then the one across.
            if across != NEVER and across < px and across <= py:
                known = False
                break
            if px == py == NEVER:
                known = True
                break
            if px <= py:
                i += 1
            else:
                j += 1
        self.stable[left << 32 | right] = known
        return known

    def extend(self, buf: str, last: list[int]) -> None:
        """Find the last token of each further prefix of ``buf``; ``last`` has those of the first ones.

        The automaton names the tokens that end at each byte, the longest first; the first that fits is the one.
        """
        size, fits, stable, done = self.size, self.fits, self.stable.get, len(last) - 1
        at = max(0, done - self.lookahead)
        for end, t in self.automaton.iter(buf, at):
            if end < done:
                continue
            start = end + 1 - size[t]
            if start < 0:
                continue
            before = last[start]
            if before >= 0:
                known = stable(before << 32 | t)
                if not (known or known is None and fits(before, t)):
                    continue
            last.append(t)
            done = end + 1

    def emit(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token whose bytes arrive in chunks, each id as soon as it is stable."""
        buf, last = "", [-1]  # last[i]: the last token of the first i bytes of buf; last[0]: the one before buf
        for chunk in chunks:
            buf += chunk.decode("latin-1")
            self.extend(buf, last)
            if len(buf) > 4 * self.lookahead and (cut := self.settled(last)):
                yield from self.path(last, cut)
                last = last[cut:]
                buf = buf[cut:]
        yield from self.path(last, len(buf))

    def settled(self, last: list[int]) -> int:
        """The largest position on the path of each of the last ``lookahead`` positions: all before it is stable."""
        at = set(range(max(0, len(last) - self.lookahead), len(last)))
        while len(at) > 1:
            top = max(at)
            at.discard(top)
            at.add(max(0, top - self.size[last[top]]))
        return at.pop()

    def path(self, last: list[int], end: int) -> list[int]:
        out, size = [], self.size
        while end > 0:
            out.append(last[end])
            end -= size[last[end]]
        return out[::-1]

    def spelt(self, piece: str) -> str:
        """A pre-token's ids joined by commas."""
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) <= WORD:
            last = [-1]
            self.extend(data.decode("latin-1"), last)
            return ",".join(map(str, self.path(last, len(data))))
        step = 4 * self.lookahead
        return ",".join(map(str, self.emit(data[i : i + step] for i in range(0, len(data), step))))

    def word(self, piece: str) -> str:
        """The same, remembered."""
        got = self.spelt(piece)
        if len(piece) <= WORD:
            if len(self.memo) >= CACHE // 2:
                self.memo.clear()
            self.memo[piece] = got
        return got

    def chunk(self, text: str) -> str:
        """Ids of a short stretch, joined by commas; remembered for two generations, so that frequent stretches stay."""
        got = self.before.get(text)
        if got is None:
            parts = self.find.findall(text)
            got = self.spelt(text) if len(parts) == 1 else ",".join([self.memo.get(p) or self.word(p) for p in parts])
        if len(text) <= WORD:
            if len(self.chunks) >= CACHE:
                self.before, self.chunks = self.chunks, {}
            self.chunks[text] = got
        return got

    def ordinary(self, text: str) -> Iterator[list[str]]:
        """Id strings of a text without added tokens, stretch by stretch.

        A pre-token holds a space at its start only, so single spaces start new stretches. Longer runs of white space
        are pre-tokens but for their last character, which belongs to what follows if it is a space.
        """
        if ODD.search(text):
            yield from self.pretokens(text)
            return
        at = 0
        for m in RUN.finditer(text):
            yield from self.stretch(text, at, m.start())
            at = m.end()
            if at < len(text):
                at -= 1
            yield from self.pretokens(text[m.start() : at])
        yield from self.stretch(text, at, len(text))

    def stretch(self, text: str, at: int, end: int) -> Iterator[list[str]]:
        """``SLICE`` characters and the rest of a word at a time."""
        get, chunk = self.chunks.get, self.chunk
        while at < end:
            cut = end if end - at <= SLICE else text.find(" ", at + SLICE, end)
            cut = end if cut < 0 else cut
            if cut - at > 2 * SLICE:  # a word without end
                yield from self.pretokens(text[at:cut])
            else:
                first, *rest = text[at:cut].split(" ")
                if first:
                    yield [get(first) or chunk(first)]
                yield [get(w) or chunk(w) for w in [" " + w for w in rest]]
            at = cut

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """The same by the pattern, and long pre-tokens through the buffer."""
        if len(text) <= WORD:
            yield [self.chunks.get(text) or self.chunk(text)] if text else []
            return
        out = []
        for m in self.find.finditer(text):
            piece = m.group()
            if len(piece) <= WORD:
                out.append(self.memo.get(piece) or self.word(piece))
                if len(out) < STEP:
                    continue
            yield out
            out = []
            if len(piece) > WORD:
                ids = self.emit(piece[i : i + WORD].encode("utf-8", "surrogatepass") for i in range(0, len(piece), WORD))
                while some := list(islice(ids, STEP)):
                    yield [",".join(map(str, some))]
        yield out

    def parts(self, text: str) -> Iterator[str | int]:
        """Stretches of ordinary text and ids of added tokens, in order."""
        if not self.split_added:
            yield text
            return
        at = 0
        for m in self.split_added.finditer(text):
            if m.start() > at:
                yield text[at : m.start()]
            yield self.added[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """All ids of a text in order, as lists of strings of ids joined by commas; a list follows neither the text nor its longest word in size."""
        out: list[str] = []
        for part in self.parts(text):
            if isinstance(part, int):
                out.append(str(part))
                continue
            for some in self.ordinary(part):
                out.extend(some)
                if len(out) >= STEP:
                    yield out
                    out = []
        if out:
            yield out

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for some in self.pieces(text or "") for x in ",".join(some).split(",")]

    def count(self, text: str | None) -> int:
        """Number of ids."""
        return sum(",".join(some).count(",") + 1 for some in self.pieces(text or ""))

    def decode(self, ids: Iterable[int], step: int = STEP) -> str:
        """Text of ids: ``step`` tokens at a time through the incremental UTF-8 machine."""
        return "".join(self.decoded(iter(lambda it=iter(ids): list(islice(it, step)), [])))

    def decoded(self, lists: Iterable[list[int]]) -> Iterator[str]:
        """Text of lists of ids as they come: the machine holds back at most three bytes."""
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes
        for ids in lists:
            yield machine.decode(b"".join(map(table.__getitem__, ids)))
        yield machine.decode(b"", True)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text they decode to, all gathered while the ids come."""
        total, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()

        def lists():
            nonlocal total
            for some in self.pieces(text or ""):
                s = ",".join(some)
                ids_sha.update((("," if total else "") + s).encode())
                ids = list(map(int, s.split(",")))
                total += len(ids)
                yield ids

        for part in self.decoded(lists()):
            text_sha.update(part.encode())
        return total, ids_sha.hexdigest(), text_sha.hexdigest()


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the array of ids of each text. A clashing column of that name is replaced."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):
        t = transducer(path)
        return texts.map(lambda x: t.encode(x))

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text of each id array; null ids give an empty text."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(rows):
        t = transducer(path)
        return rows.map(lambda x: t.decode([int(i) for i in x] if x is not None else []))

    return df.withColumn(out, text(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ids counted and hashed, then decoded and hashed, a text at a time."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        t = transducer(path)
        for b in batches:
            n, ids_sha, text_sha = zip(*map(t.digest, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
