"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. The perfect [23,12,7] Golay
code has exactly one codeword within distance 3 of each 23-bit word, and five more at distance 4
when the nearest one is at distance 3. Two words at distance 2 or less have a common codeword
within distance 4 (that of the word halfway between them). Of at most four differing bits, two of
the three segments hold at most two together, so two linked fingerprints share a codeword in both
segments of some pair. Each pair of codeword indices (24 bits) and the pair's number form a join
key; every candidate is verified by counting its differing bits.

Only different fingerprints enter the join; copies follow their class. Inside a bucket links are
emitted as a spanning forest, never as all pairs, which leaves the components unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_runs
from .components import connected_components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Offset and width in bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A run of more fingerprints than this is searched breadth-first instead of pair by pair.
LONG_RUN = 48
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a whole text as an unsigned integer: 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split(): exactly \x20 \x09-\x0d
    if not w:
        return 0
    if len(w) <= words:
        h = [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    else:
        flat = b" ".join(w)
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = [0, *ends[: len(w) - words].tolist()]
        digest, seed = xxhash.xxh64_intdigest, SEED
        h = [digest(flat[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    # Counted in blocks, so a very long text needs no more than one block of bits.
    counts, n = np.zeros(64, np.int64), len(h)
    for i in range(0, n, 1 << 16):
        block = np.array(h[i : i + (1 << 16)], np.uint64)
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null texts count as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(run, "doc_id long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """parity of each 12-bit message; by 11-bit syndrome: the message part of the coset leader; and
    up to six offsets (message parts) to codewords within distance 4, -1 where there are fewer."""
    generator = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which divides x^23 - 1
    parity = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= generator << (k - 11)
        parity[m] = r
    words = (np.arange(4096) << 11) | parity
    weight = np.bitwise_count(words.astype(np.uint64))
    assert sorted(set(weight.tolist())) == [0, 7, 8, 11, 12, 15, 16, 23]
    sevens = words[weight == 7].tolist()
    lead = np.full(2048, -1, np.int64)
    offsets = np.full((2048, 6), -1, np.int64)
    bits = [1 << i for i in range(23)]
    leaders = [0, *bits]
    leaders += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    leaders += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    for e in leaders:
        s = int(parity[e >> 11]) ^ (e & 2047)
        assert lead[s] < 0
        lead[s] = e >> 11
        more = [w for w in sevens if w & e == e] if e.bit_count() == 3 else []
        offsets[s, : 1 + len(more)] = [0, *(w >> 11 for w in more)]
    return parity, lead, offsets


def near_codewords(v: np.ndarray) -> np.ndarray:
    """For 23-bit words: the indices of all codewords within distance 4, padded with -1 to six."""
    parity, lead, offsets = _golay()
    top, s = v >> 11, parity[v >> 11] ^ (v & 2047)
    o = offsets[s]
    return np.where(o < 0, -1, (top ^ lead[s])[:, None] ^ o)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of unsigned fingerprints, and the row of each key."""
    lists = [near_codewords(((fp >> np.uint64(o)) & np.uint64((1 << n) - 1)).astype(np.int64)) for o, n in SEGMENTS]
    keys, rows = [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = (lists[i][:, :, None] << 12) | lists[j][:, None, :]
        ok = (lists[i][:, :, None] >= 0) & (lists[j][:, None, :] >= 0)
        r, _, _ = np.nonzero(ok)
        keys.append(both[ok] | (k << 24))
        rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


def _forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that span the components of one bucket: breadth-first, each vertex linked once."""
    left, out = fp, []
    while left.size > 1:
        front, left = [left[0]], left[1:]
        while front and left.size:
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                found = left[near]
                out += [(x, y) for y in found]
                front += list(found)
                left = left[~near]
    return out


def bucket_links(key: np.ndarray, fp: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Links (pairs of unsigned fingerprints) among rows sorted by key."""
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    runs = np.diff(np.r_[new, key.size])
    out = []
    short = np.repeat(runs <= LONG_RUN, runs)
    for d in range(1, min(LONG_RUN, int(runs.max(initial=0)))):
        i = np.flatnonzero((key[d:] == key[:-d]) & short[d:])
        if not i.size:
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most]
        out.append(np.stack([fp[i], fp[i + d]], 1))
    for a, n in zip(new[runs > LONG_RUN], runs[runs > LONG_RUN], strict=True):
        if pairs := _forest(np.unique(fp[a : a + n]), most):
            out.append(np.array(pairs, np.uint64))
    links = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
    links = links[links[:, 0] != links[:, 1]]
    return np.unique(np.sort(links, axis=1), axis=0) if len(links) else links


def links(distinct: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(a, b): links that span the components of different fingerprints (column fp)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 2048):
                key, row = keys_of(fp[i : i + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 2048][row].view(np.int64))], names=["key", "fp"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in whole_runs(batches):
            found = bucket_links(key, fp.view(np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i].astype(np.uint64).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    keyed = distinct.select("fp").mapInArrow(explode, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(match, "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, kept.

    component_id is the least doc_id reachable by links of at most four differing bits; kept marks
    the row that stays (several rows of that very doc_id: all). Null and empty texts have
    fingerprint zero and are linked like any other; a null doc_id gets a component but names none.
    An empty table gives an empty result. Other columns of docs are ignored.
    """
    fps = materialise(fingerprints(docs, id_col, text_col), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    classes = materialise(classes, "classes")
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
