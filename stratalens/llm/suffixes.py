"""Exact repeated-substring removal on sampled suffixes.

Every string of `length` bytes has one anchor: the leftmost start of the least GRAM-byte hash inside
it. It depends on the string alone, so equal strings have equal anchors at equal offsets; all starts
that share an anchor form a block. A start repeats if and only if the string there equals one of
another start with the same leading GRAM bytes after its anchor.

1. Blocks are counted by (hash of the leading bytes, hash of the block): a block that occurs twice
   repeats at each of its starts. The counts are aggregated before the shuffle.
2. Where different blocks share leading bytes, one copy of each is fetched. Their suffixes, from the
   anchor on, are range-partitioned by leading bytes with sampled splitters and sorted in each
   bucket; suffixes with equal leading bytes never part, so no neighbour is across a boundary. In
   each run the strings at all starts of a block are compared by rolling hashes.
3. The repeated starts return to their documents, whose covered bytes are then cut.

Hashes are 64-bit polynomials over random byte values; blocks are told apart by two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

LENGTH = 400
GRAM = 32
#: Bytes of a text that are hashed at once; a longer text is read in overlapping pieces.
PIECE = 1 << 21
#: Bytes of blocks compared at once, unless one run of equal leading bytes is larger.
BATCH = 8 << 20

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for n places at least."""
    if not _powers or _powers[0].size < n:
        size = 1 << max(16, (n - 1).bit_length())
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _prefix(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power_tables(raw.size + 1)[0][: raw.size], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (van Herk: prefix and suffix minima of aligned parts)."""
    n = v.size
    x = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = v
    x = x.reshape(-1, w)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def blocks_of(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of the bytes of one text: first start, number of starts, anchor, hash of the anchor's leading
    bytes and hash of the block, for each block. Empty for texts shorter than length."""
    found = []
    mask = np.uint64((1 << 24) - 1)
    for at in range(0, max(0, raw.size - length + 1), PIECE):
        part = raw[at : at + PIECE + length - 1]
        p, inverse = _prefix(part), _power_tables(part.size + 1)[1]
        n = part.size - GRAM + 1
        gram = _mix((p[GRAM:] - p[:n]) * inverse[:n])
        least = _window_min((gram & ~mask) | np.arange(n, dtype=np.uint64), length - GRAM + 1) & mask
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        count = np.diff(np.r_[first, least.size])
        anchor = least[first].astype(np.int64)
        end = first + count + length - 1
        block = _mix((p[end] - p[first]) * inverse[first] + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        found.append((first + at, count, anchor + at, gram[anchor], block))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def repeated_starts(raws: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each block's bytes a mask of its starts whose string also occurs at another start."""
    hashes = []
    for raw in raws:
        p, n = _prefix(raw), raw.size - length + 1
        hashes.append(_mix((p[length:] - p[:n]) * _power_tables(raw.size + 1)[1][:n]))
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(every)
    same = every[order][1:] == every[order][:-1]
    twice = np.zeros(every.size, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.split(twice, np.cumsum([h.size for h in hashes])[:-1]) if hashes else []


def _intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    d = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))


def merged(starts: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte spans that strings at the given half-open ranges of starts cover, joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + length)
        else:
            out.append([a, b - 1 + length])
    return [(a, b) for a, b in out]


def _bytes(column: pa.Array) -> Iterator[bytes]:
    return (b"" if x is None else x for x in column.cast(pa.binary()).to_pylist())


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, body (the text) and starts (array of half-open ranges a to b) of all
    strings of `length` bytes that also start anywhere else, in this document or another; null for none.

    Null texts are empty, and texts shorter than length have none. Equal rows are different
    documents, so both repeat. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), body).alias("uid"), body.alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, uids = [], []
            for uid, text in zip(b.column(0).to_pylist(), _bytes(b.column(1)), strict=True):
                got = blocks_of(np.frombuffer(text, np.uint8), length)
                parts.append(got)
                uids.append(np.full(got[0].size, uid, np.int64))
            first, count, anchor, gram, block = map(np.concatenate, zip(*parts, strict=True))
            cols = [gram.view(np.int64), block.view(np.int64), np.concatenate(uids), first, count.astype(np.int32), (anchor - first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["gram", "block", "uid", "first", "count", "off"])

    long = rows.where(F.octet_length("body") >= length).select("uid", "body")
    blocks = materialise(long.mapInArrow(cut, "gram long, block long, uid long, first long, count int, off int"), "blocks")
    kinds = blocks.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "first", "count", "off")).alias("one"))
    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("n")).where("kinds > 1 or n > 1")
    known = materialise(kinds.join(several.select("gram", "kinds"), "gram"), "kinds")

    # One copy of each different block of runs that hold several; a text's list is bounded by its length.
    asked = known.where("kinds > 1").groupBy("one.uid").agg(F.collect_list(F.struct("gram", "block", "n", "one.first", "one.count", "one.off")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, want in zip(_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                for w in want:
                    a, e = w["first"], w["first"] + w["count"] + length - 1
                    for c, x in zip(out, (w["gram"], w["block"], w["n"] == 1, w["off"], text[a : a + w["off"]], text[a + w["off"] : e]), strict=True):
                        c.append(x)
            kinds_ = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds_, strict=True)], names=["gram", "block", "single", "off", "left", "suffix"])

    texts = rows.select("uid", "body").join(asked, "uid").select("body", "asked")
    suffixes = materialise(texts.mapInArrow(fetch, "gram long, block long, single boolean, off int, left binary, suffix binary"), "suffixes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out(rows_: list[tuple]) -> pa.RecordBatch:
            masks = repeated_starts([np.frombuffer(left + suffix, np.uint8) for _, _, _, left, suffix in rows_], length)
            found = [(g, k, _intervals(m)) for (g, k, single, _, _), m in zip(rows_, masks, strict=True) if single and m.any()]
            spans = pa.array([[{"a": a, "b": b} for a, b in x[2]] for x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), spans], names=["gram", "block", "starts"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if size > BATCH and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + len(row[4])
        if held:
            yield out(held)

    # Suffixes with one hash of leading bytes stand together: equal hashes have, collisions apart, equal bytes, and the hash is the second key.
    placed = suffixes.withColumn("lead", F.substring("suffix", 1, 8)).repartitionByRange("lead").sortWithinPartitions("lead", "gram", "suffix")
    fine = placed.select("gram", "block", "single", "left", "suffix").mapInArrow(compare, "gram long, block long, starts array<struct<a:int,b:int>>")
    whole = known.where("n > 1").select("gram", "block", F.array(F.struct(F.lit(0).alias("a"), F.col("one.count").alias("b"))).alias("starts"))
    marks = whole.unionByName(fine)
    starts = F.transform("starts", lambda s: F.struct((F.col("first") + s.a).alias("a"), (F.col("first") + s.b).alias("b")))
    by_text = blocks.select("gram", "block", "uid", "first").join(marks, ["gram", "block"]).groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list(starts))).alias("starts"))

    return rows.join(by_text, "uid", "left").select("doc_id", "body", "starts")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed, in bytes of the input), kept (the bytes that stay)."""
    found = repeated_ranges(docs, id_col, text_col, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for b in batches:
            sizes, spans, kept = [], [], []
            for text, starts in zip(_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                gone = merged([(x["a"], x["b"]) for x in starts or ()], length)
                edges = [0, *(x for s in gone for x in s), len(text)]
                sizes.append(len(text))
                spans.append([{"from": a, "to": e} for a, e in gone])
                kept.append(b"".join(text[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary")
