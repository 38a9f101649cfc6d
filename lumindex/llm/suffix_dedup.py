"""Repeated passages across documents by a depth-limited most-significant-digit radix sort of suffixes.

Every byte covered by a ``depth``-byte string that also starts in a document with a smaller doc_id is removed. A full
sort of all suffixes would shuffle many times the input, so suffixes enter the sort by anchors: each ``depth``-byte
window has a smallest ``GRAM``-byte hash, equal windows have equal ones at equal offsets, and these anchors (about one in
17 bytes) stand for the windows around them. The sort's digits are then dealt out:

1. anchors go to the bucket of their hash's low bits (as window minima they have even low bits only); anchors that a second document has are sent back to their documents;
2. these return with a hash of their context, all bytes that a window with the anchor can have: in a
   group of equal contexts every document but the smallest is covered throughout; contexts that differ are asked for;
3. their suffixes, one for each window around the anchor, are ordered through ``depth`` bytes only, eight bytes a pass
   from the first on; a suffix whose group has one document leaves after each pass. Groups that remain are the
   repeated windows: all but the smallest document's are covered.

Rows travel as packed blobs; documents are dealt over slots once and each round meets them there (Spark reuses the
exchange). Exact copies of a document with a smaller id are settled beforehand by a digest of the text.

Defined results: null texts are empty; texts shorter than ``depth`` bytes stay; rows with null doc_id stay whole and cover
nothing; rows that share a doc_id never cover each other; further columns pass through. Added columns ``kept`` (bytes),
``starts`` and ``ends`` (removed runs) replace columns of these names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .minhash import mix

DEPTH = 50
GRAM = 16  # bytes of an anchor
PIECE = 1 << 20  # bytes of text hashed at a time
LANES = 8  # bytes that one pass orders by
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOB = "key int, n long, data binary"


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of ``width`` neighbours, by doubling."""
    n = 1
    while n * 2 <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings (GRAM is a power of two)."""
    h, n, p = b.astype(np.uint64) + np.uint64(1), 1, BASE
    while n < GRAM:
        h = h[:-n] * p + h[n:]
        with np.errstate(over="ignore"):
            p = p * p
        n *= 2
    return mix(h)


def anchors(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and position of every anchor. Long texts are cut with enough overlap to give the same anchors."""
    parts: list[tuple[int, int, int, bytes]] = []  # text, offset of the slice, first own position in it, slice
    for i, t in enumerate(texts):
        if len(t) >= depth:
            for at in range(0, len(t), PIECE):
                lo = max(0, at - depth)
                parts.append((i, lo, at - lo, t[lo : at + PIECE + depth]))
    out, group, size = [], [], 0
    for p in [*parts, None]:
        if group and (p is None or size + len(p[3]) > PIECE):
            out.append(anchors_of(group, depth))
            group, size = [], 0
        if p is not None:
            group.append(p)
            size += len(p[3])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors_of(parts, depth: int):
    b = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    size = np.array([len(p[3]) for p in parts])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    part = np.repeat(np.arange(len(parts)), size)
    h = gram_hashes(b)
    width = depth - GRAM + 1
    low = slide(h, width, np.minimum)
    low[part[: len(low)] != part[depth - 1 : depth - 1 + len(low)]] = 0  # no window crosses two texts
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == slide(np.concatenate([edge, low, edge]), width, np.maximum))
    of = part[at]
    inside = at - first[of]
    own = np.array([p[2] for p in parts])[of]
    mine = (inside >= own) & (inside < own + PIECE)
    at, of, inside = at[mine], of[mine], inside[mine]
    return h[at], np.array([p[0] for p in parts])[of], inside + np.array([p[1] for p in parts])[of]


def pack(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Whole numbers as byte planes, low bytes first; planes of zeros compress away in the shuffle."""
    return b"".join(c.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, widths, strict=True))


def unpack(blobs, sizes, widths: list[int]) -> list[np.ndarray]:
    total = int(sum(sizes))
    out = [np.zeros((total, 8), np.uint8) for _ in widths]
    at = 0
    for blob, n in zip(blobs, sizes, strict=True):
        raw, i = np.frombuffer(blob, np.uint8), 0
        for o, w in zip(out, widths, strict=True):
            o[at : at + n, :w] = raw[i : i + n * w].reshape(w, n).T
            i += n * w
        at += n
    return [o.reshape(-1).view("<i8") for o in out]


def dealt(keys: np.ndarray, columns: list[np.ndarray], widths: list[int]) -> pa.Table:
    """One row (key, n, data) for each key."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(keys)) + 1
    begin, end = np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [len(keys)]]).astype(int)
    spans = [(a, z) for a, z in zip(begin, end, strict=True) if z > a]
    return pa.table({
        "key": pa.array([int(keys[a]) for a, _ in spans], pa.int32()),
        "n": pa.array([int(z - a) for a, z in spans], pa.int64()),
        "data": pa.array([pack([c[a:z] for c in columns], widths) for a, z in spans], pa.binary()),
    })


def blobs(table: pa.Table, widths: list[int]) -> list[np.ndarray]:
    return unpack([x.as_buffer() for x in table.column("data").combine_chunks()] if table.num_rows else [], table.column("n").to_pylist(), widths)


def slot_of(doc: np.ndarray, slots: int) -> np.ndarray:
    return (doc ^ (doc >> 7) ^ (doc >> 17)) % slots


def slot_column(doc: Column, slots: int) -> Column:
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 7)).bitwiseXOR(F.shiftright(doc, 17)), F.lit(slots)).cast("int")


def starts_of(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(sorted_keys[0])
    if not n:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def runs(begin: np.ndarray, n: int) -> np.ndarray:
    """Number of the run of each of n positions."""
    return np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))


class Slot:
    """The documents of one slot as one buffer."""

    def __init__(self, table: pa.Table, depth: int):
        self.reach = depth - GRAM
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.doc = np.array(table.column("__doc").to_pylist(), np.int64)
        self.tag = np.array([zlib.crc32(t) for t in self.texts], np.int64)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        pad = bytes(depth)
        self.buffer = np.frombuffer(pad + b"".join(self.texts) + pad, np.uint8)
        self.first = depth + np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)

    def rows(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row with the id of an entry: the entry and the row."""
        order = np.argsort(self.doc, kind="stable")
        ids = self.doc[order]
        lo, hi = np.searchsorted(ids, doc), np.searchsorted(ids, doc, "right")
        entry = np.repeat(np.arange(len(doc)), hi - lo)
        nth = np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        return entry, order[lo[entry] + nth]

    def contexts(self, row: np.ndarray, pos: np.ndarray):
        """Bytes from ``reach`` before each anchor to the end of the last window, blanked outside the text, and the parts' lengths."""
        width = 2 * self.reach + GRAM
        left = np.minimum(pos, self.reach)
        right = np.minimum(self.size[row] - pos, GRAM + self.reach)
        out = np.zeros((len(row), (width + 7) // 8 * 8), np.uint8)
        at = self.first[row] + pos - self.reach
        for i in range(width):
            inside = (i >= self.reach - left) & (i < self.reach + right)
            out[:, i] = np.where(inside, self.buffer[np.clip(at + i, 0, len(self.buffer) - 1)], 0)
        return out, left, right


def folded(lanes: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = mix(seed.astype(np.uint64) + BASE)
    for i in range(lanes.shape[1]):
        h = mix(h * BASE + lanes[:, i])
    return h


def removed_passages(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``kept``, ``starts`` and ``ends``."""
    if depth < GRAM + 2:
        raise ValueError(f"depth must be at least {GRAM + 2}")
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.drop("kept", "starts", "ends", "__doc", "__slot", "__digest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots, bits = 2 * parts + 1, max(1, (parts - 1).bit_length())
    reach = depth - GRAM
    # The low bits: anchors are the smallest hashes of their windows, so that their high bits are mostly zeros.
    digit = lambda h: (h & np.uint64((1 << bits) - 1)).astype(np.int64)
    added = [T.StructField("kept", T.BinaryType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))]
    whole = lambda df, gone: df.withColumn("kept", F.lit(b"") if gone else F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).withColumn("starts", F.array(F.lit(0).cast("long")) if gone else F.array().cast("array<long>")).withColumn("ends", F.array(F.octet_length("text").cast("long")) if gone else F.array().cast("array<long>"))

    docs = docs.withColumn("__doc", F.col("doc_id").cast("long"))
    digest = F.md5(F.encode("text", "UTF-8"))
    long_enough = F.octet_length("text") >= depth
    known = docs.where(long_enough & F.col("__doc").isNotNull()).groupBy(digest.alias("__digest")).agg(F.min("__doc").alias("__first"), F.max("__doc").alias("last")).where("__first < last").drop("last")
    known = common.Scratch(spark, "copies").save(known, "known")
    marked = docs.withColumn("__digest", F.when(long_enough & F.col("__doc").isNotNull(), digest)).join(common.small(known), "__digest", "left").drop("__digest")
    copy = F.coalesce(F.col("__first") < F.col("__doc"), F.lit(False))
    copies = whole(marked.where(copy).drop("__first", "__doc"), True)
    loose = whole(docs.where(F.col("__doc").isNull()).drop("__doc"), False)
    texts = marked.where(F.col("__doc").isNotNull() & ~copy).drop("__first").withColumn("__slot", slot_column(F.col("__doc"), slots))

    def first(batches):
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), np.int64)
            h, row, pos = anchors([(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()], depth)
            if len(h):
                yield from dealt(digit(h), [(h >> np.uint64(16)).view(np.int64), ids[row], pos], [6, 8, 5]).to_batches()

    def shared(table: pa.Table) -> pa.Table:
        h, doc, pos = blobs(table, [6, 8, 5])
        order = np.argsort(h, kind="stable")
        h, doc, pos = h[order], doc[order], pos[order]
        begin = starts_of([h])
        several = (np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin))[runs(begin, len(h))]
        doc, pos = doc[several], pos[several]
        return dealt(slot_of(doc, slots), [doc, pos], [8, 5])

    def in_context(left: pa.Table, right: pa.Table) -> pa.Table:
        slot = Slot(left, depth)
        doc, pos = blobs(right, [8, 5])
        entry, row = slot.rows(doc)
        pos = pos[entry]
        fits = pos + GRAM <= slot.size[row]
        row, pos = row[fits], pos[fits]
        found = []
        for i in range(0, len(row), 20_000):
            r, p = row[i : i + 20_000], pos[i : i + 20_000]
            c, before, after = slot.contexts(r, p)
            gram = np.ascontiguousarray(c[:, reach : reach + GRAM]).view("<u8")
            found.append((folded(gram, np.zeros(len(r))), folded(c.view("<u8"), before * 1000 + after)))
        if not found:
            return dealt(np.empty(0, np.int64), [np.empty(0, np.int64)] * 5, [6, 8, 8, 5, 4])
        h, context = (np.concatenate(x) for x in zip(*found, strict=True))
        return dealt(digit(h), [(h >> np.uint64(16)).view(np.int64), context.view(np.int64), slot.doc[row], pos, slot.tag[row]], [6, 8, 8, 5, 4])

    def settled(table: pa.Table) -> pa.Table:
        h, context, doc, pos, tag = blobs(table, [6, 8, 8, 5, 4])
        order = np.lexsort((context, h))
        h, context, doc, pos, tag = (x[order] for x in (h, context, doc, pos, tag))
        group, same = starts_of([h]), starts_of([h, context])
        least = np.minimum.reduceat(doc, same)[runs(same, len(h))]
        covered = doc > least
        # Contexts whose smallest documents differ may still share some windows.
        open_ = (np.minimum.reduceat(least, group) != np.maximum.reduceat(least, group))[runs(group, len(h))] & ~covered
        keep = covered | open_
        return dealt(slot_of(doc[keep], slots), [doc[keep], pos[keep], tag[keep], open_[keep].astype(np.int64)], [8, 5, 4, 1])

    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        slot = Slot(left, depth)
        doc, pos, tag, is_open = blobs(right, [8, 5, 4, 1])
        entry, row = slot.rows(doc)
        mine = tag[entry] == slot.tag[row]
        entry, row = entry[mine], row[mine]
        pos, is_open = pos[entry], is_open[entry].astype(bool)
        r, p = row[~is_open], pos[~is_open]
        lo, hi = p - np.minimum(p, reach), p + np.minimum(slot.size[r] - p, GRAM + reach)
        long = hi - lo >= depth
        r, lo, hi = union(r[long], lo[long], hi[long])
        done = dealt((1 << bits) + slot_of(slot.doc[r], slots), [slot.doc[r], slot.tag[r], lo, hi], [8, 4, 5, 5]) if len(r) else None
        r, p = row[is_open], pos[is_open]
        if not len(r):
            return done if done is not None else dealt(np.empty(0, np.int64), [np.empty(0, np.int64)], [8])
        tables = [] if done is None else [done]
        c, before, after = slot.contexts(r, p)
        h = folded(np.ascontiguousarray(c[:, reach : reach + GRAM]).view("<u8"), np.zeros(len(r)))
        lanes = list(np.ascontiguousarray(c.view("<i8").T))
        tables.append(dealt(digit(h), [(h >> np.uint64(16)).view(np.int64), slot.doc[r], slot.tag[r], p, before, after, *lanes], [6, 8, 4, 5, 2, 2, *[8] * len(lanes)]))
        return pa.concat_tables(tables)

    def ordered(table: pa.Table) -> pa.Table:
        if table.column("key")[0].as_py() >= 1 << bits:  # settled before: on to its slot
            return table.set_column(0, "key", pa.array([k - (1 << bits) for k in table.column("key").to_pylist()], pa.int32()))
        n_lanes = (2 * reach + GRAM + 7) // 8
        h, doc, tag, pos, before, after, *lanes = blobs(table, [6, 8, 4, 5, 2, 2, *[8] * n_lanes])
        c = np.ascontiguousarray(np.stack(lanes, axis=1)).view(np.uint8)
        order = np.argsort(h, kind="stable")
        begin = starts_of([h[order]])
        group = np.empty(len(h), np.int64)
        group[order] = runs(begin, len(h))
        out = []
        for offset in range(reach + 1):
            at = np.flatnonzero((offset >= reach - before) & (offset + depth <= reach + after))
            g = group[at]
            for digit_at in range(0, depth + LANES, LANES):  # the first pass orders by anchor, the next ones by eight bytes each
                if digit_at:
                    lane = np.zeros((len(at), LANES), np.uint8)
                    width = min(LANES, depth - digit_at + LANES)
                    lane[:, :width] = c[at, offset + digit_at - LANES : offset + digit_at - LANES + width]
                    key = lane.view(">u8").reshape(-1)
                    order = np.lexsort((key, g))
                    at, g, key = at[order], g[order], key[order]
                    begin = starts_of([g, key])
                else:
                    order = np.argsort(g, kind="stable")
                    at, g = at[order], g[order]
                    begin = starts_of([g])
                if not len(at):
                    break
                d = doc[at]
                run = runs(begin, len(at))
                least = np.minimum.reduceat(d, begin)[run]
                several = (np.maximum.reduceat(d, begin)[run] != least)
                at, g, least = at[several], run[several], least[several]
                if not len(at):
                    break
            if len(at):
                hit = at[doc[at] > least]
                out.append((doc[hit], tag[hit], pos[hit] - reach + offset))
        if not out:
            return dealt(np.empty(0, np.int64), [np.empty(0, np.int64)], [8])
        doc, tag, lo = (np.concatenate(x) for x in zip(*out, strict=True))
        return dealt(slot_of(doc, slots), [doc, tag, lo, lo + depth], [8, 4, 5, 5])

    plain = [c for c in texts.columns if c not in ("__doc", "__slot")]
    schema = T.StructType([*[texts.schema[c] for c in plain], *added])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        slot = Slot(left, depth)
        doc, tag, lo, hi = blobs(right, [8, 4, 5, 5])
        entry, row = slot.rows(doc)
        mine = tag[entry] == slot.tag[row]
        row, lo, hi = union(row[mine], lo[entry[mine]], hi[entry[mine]])
        by: dict[int, list[tuple[int, int]]] = {}
        for r, a, z in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
            by.setdefault(r, []).append((a, z))
        kept, starts, ends = [], [], []
        for i, t in enumerate(slot.texts):
            spans, at, rest = by.get(i, []), 0, []
            for a, z in spans:
                rest.append(t[at:a])
                at = z
            rest.append(t[at:])
            kept.append(b"".join(rest))
            starts.append([a for a, _ in spans])
            ends.append([z for _, z in spans])
        out = left.select(plain)
        for name, values, kind in (("kept", kept, pa.binary()), ("starts", starts, pa.list_(pa.int64())), ("ends", ends, pa.list_(pa.int64()))):
            out = out.append_column(name, pa.array(values, kind))
        return out

    r1 = texts.select("__doc", "text").mapInArrow(first, BLOB).groupBy("key").applyInArrow(shared, BLOB)
    r2 = texts.groupBy("__slot").cogroup(r1.groupBy("key")).applyInArrow(in_context, BLOB).groupBy("key").applyInArrow(settled, BLOB)
    r3 = texts.groupBy("__slot").cogroup(r2.groupBy("key")).applyInArrow(asked, BLOB).groupBy("key").applyInArrow(ordered, BLOB)
    done = texts.groupBy("__slot").cogroup(r3.groupBy("key")).applyInArrow(cut, schema)
    return done.unionByName(copies).unionByName(loose)


def union(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch, by row."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    wide = int(hi.max()) + 2
    reached = np.maximum.accumulate(row * wide + hi)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] * wide + lo[1:] > reached[:-1]
    begin = np.flatnonzero(new)
    return row[begin], lo[begin], np.maximum.reduceat(hi, begin)


def without_passages(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Pipeline stage: texts without their repeated passages (a character cut in two is left out), in the columns they came with."""
    out = removed_passages(docs, depth)
    valid = F.make_valid_utf8(F.col("kept").cast("string"))
    mark = "\ufffd"  # stands for what is left of a cut character, unless the text had such marks of its own
    text = F.when(F.size("starts") == 0, F.col("text")).when(F.contains("text", F.lit(mark)), valid).otherwise(F.replace(valid, F.lit(mark), F.lit("")))
    return out.withColumn("text", text).select(docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed_passages(common.documents(spark, sf_dir).select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
