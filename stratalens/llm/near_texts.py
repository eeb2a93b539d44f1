"""SimHash near-duplicates by similarity: wide fingerprints through the same Golay keys, verified exactly.

Four differing bits of 64 mean nearly equal texts. For a Jaccard similarity of 0.8 of word shingles
one bit in seven may differ, so the fingerprint is wider: 24 segments of 23 bits, each a word of the
perfect Golay code's space. A segment is decoded to all codewords within distance 4; the pairs of
codeword indices of two neighbouring segments are join keys, 12 pairs in all. Texts of similarity 0.8
share a key with probability 0.995 (0.85: 0.9995, 0.9: 1); unlike texts meet in a key by chance, and
differ in too many bits to go on. Candidates whose fingerprints are near are verified by the exact
similarity of their shingle sets.

In a first round each text of a key is compared with the one most like it; in a second one the pairs
left are those of different components so far, so a group of near copies does not yield all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_runs
from .components import connected_components
from .simhash import _LOWER, SEED, near_codewords

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Segments of a fingerprint, bits of each, longs that hold them, and how many of those go with a key.
SEGMENTS, BITS, LONGS, WITH_KEY = 24, 23, 9, 2
#: Deviations by which the differing bits of two similar texts may exceed their mean: in whole fingerprints and
#: in the words that go with a key (0.999 of pairs are within each), and for the first round's comparisons.
DEVIATIONS, OF_KEY, FIRST = 3.0, 3.0, 1.5
#: Places of a run, in the order of its texts' names, within which the first round looks.
REACH = 48
#: The most similar ones of those that a text is compared with in the first round.
HEADS = 8
#: Rows that a text's keys are gathered in for the second round.
PARTS = 8
#: Rows of names are broadcast up to this many (32 bytes each), else joined by shuffle.
BROADCAST_ROWS = 500_000


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes (signed) of the different shingles of a text; a text of fewer words is one shingle, without words too."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = max(len(w) - words + 1, 1)
    flat = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts, stops = [0, *ends[: n - 1].tolist()], [*(ends[words - 1 :] - 1).tolist()] if len(w) > words else [len(flat)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n).view(np.int64))


@cache
def _salts() -> np.ndarray:
    return np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """LONGS words; bit i is set where over half of the shingles, hashed for each word anew, have it."""
    counts = np.zeros(64 * LONGS, np.int64)
    for i in range(0, len(s), 4096):
        h = s[i : i + 4096, None].view(np.uint64) ^ _salts()
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(s), bitorder="little").view(np.uint64)


def _codewords(fp: np.ndarray) -> np.ndarray:
    """Of fingerprints (rows of LONGS words) the indices of the near codewords of each segment, -1 for none."""
    bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")[:, : SEGMENTS * BITS].reshape(-1, SEGMENTS, BITS)
    return near_codewords((bits @ (1 << np.arange(BITS))).ravel()).reshape(len(fp), SEGMENTS, 6)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints (rows of LONGS words), and the row of each key."""
    near = _codewords(fp)
    left, right = near[:, 0::2, :, None], near[:, 1::2, None, :]
    row, pair, i, j = np.nonzero((left >= 0) & (right >= 0))
    return (pair << 24) | (near[row, 2 * pair, i] << 12) | near[row, 2 * pair + 1, j], row


def differing(similarity: float, bits: int, deviations: float = DEVIATIONS) -> int:
    """Bits in which the fingerprints of two texts of that similarity differ: the mean and so many deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + deviations * np.sqrt(bits * p * (1 - p)))


def _read(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(id, h, c, n, fp): hash of the text, class (hash of the shingle set), the set's size, the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [shingles(t.as_py(), words) for t in part.column(2)]
                fps = np.concatenate([wide_fingerprint(s) for s in sets]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * LONGS, pa.int32()), pa.array(fps))
                names = pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), names, pa.array(map(len, sets), pa.int32()), lists], names=["id", "h", "c", "n", "fp"])

    return docs.select(F.col("__id").alias("id"), F.col("__h").alias("h"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, h long, c long, n int, fp array<long>")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (c, fp) a row (key, c, w0, w1) for each key, with the fingerprint's first words."""
    for b in batches:
        c, fp = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, LONGS)
        for i in range(0, len(c), 1024):
            key, row = keys_of(np.ascontiguousarray(fp[i : i + 1024]))
            cols = [key.astype(np.int32), c[i + row], *(fp[i + row, w] for w in range(WITH_KEY))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["key", "c", *(f"w{w}" for w in range(WITH_KEY))])


def _bits(words: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which rows i and j differ (words unsigned: of signed ones the magnitude's bits would count)."""
    return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int32) for w in words)


def _nearest(most: int, close: int):  # noqa: ANN202  a function for mapInArrow
    """Of rows (key, c, words) sorted by key, those that have a near one in their run: (key, c, head, bits), where head is
    the most similar one before them within REACH, if it differs in `close` bits at most, or else themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, c, *words in whole_runs(batches):
            words = [w.view(np.uint64) for w in words]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[new, len(key)])
            keep, head, best = np.zeros(len(key), bool), c.copy(), np.full(len(key), close + 1)
            for d in range(1, min(REACH, int(size.max(initial=0)))):
                i = np.flatnonzero(key[d:] == key[:-d])
                bits = _bits(words, i, i + d)
                i, bits = i[bits <= most], bits[bits <= most]
                keep[i] = keep[i + d] = True
                nearer = bits < best[i + d]
                i, bits = i[nearer], bits[nearer]
                head[i + d], best[i + d] = c[i], bits
            for lo, n in zip(new[size > REACH], size[size > REACH], strict=True):  # what is near to none so far may be near to one farther off
                left = lo + np.flatnonzero(~keep[lo : lo + n])
                for at in range(lo, lo + n, 4096):
                    others = np.arange(at, min(at + 4096, lo + n))
                    for i in range(0, len(left), 64):
                        part = left[i : i + 64]
                        near = _bits(words, part[:, None], others[None]) <= most
                        near &= part[:, None] != others
                        keep[part[near.any(1)]] = True
                        keep[others[near.any(0)]] = True
                    left = left[~keep[left]]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, c, head, best.astype(np.int32))], names=["key", "c", "head", "bits"])

    return run


def _between(most: int, whole: int, share: Fraction):  # noqa: ANN202  a function for mapInArrow
    """Of rows (key, c, root, n, words of the fingerprint) sorted by key, pairs (a, b) of different roots whose sizes and
    fingerprints allow the similarity: `most` bits of the first words and `whole` of all differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, c, root, n, *words in whole_runs(batches):
            words = [w.view(np.uint64) for w in words]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            end = np.repeat(np.r_[new[1:], len(key)], np.diff(np.r_[new, len(key)]))
            for lo in range(0, len(key), 64):  # each row with the later ones of its run, a block of rows at a time
                rows = np.arange(lo, min(lo + 64, len(key)))
                if (root[rows] == root[rows[0]]).all() and (root[lo : end[rows[-1]]] == root[lo]).all():
                    continue
                for at in range(lo + 1, int(end[rows[-1]]), 4096):
                    others = np.arange(at, min(at + 4096, int(end[rows[-1]])))
                    near = (key[rows, None] == key[others]) & (root[rows, None] != root[others]) & (rows[:, None] < others)
                    i, j = (rows[0] + x if k == 0 else at + x for k, x in enumerate(np.nonzero(near)))
                    ok = _bits(words[:WITH_KEY], i, j) <= most
                    ok &= share.denominator * np.minimum(n[i], n[j]) >= share.numerator * np.maximum(n[i], n[j])
                    i, j = i[ok], j[ok]
                    ok = _bits(words, i, j) <= whole
                    i, j = i[ok], j[ok]
                    if i.size:
                        new = _first_meets(i, j, key, words)
                        x, y = c[i[new]], c[j[new]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _first_meets(i: np.ndarray, j: np.ndarray, key: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Of pairs of rows in runs of keys, those for which this is the first key that they share."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    near = _codewords(np.ascontiguousarray(np.stack([w[rows] for w in words], axis=1)))
    a, b, pair, new = at[: len(i)], at[len(i) :], key[i] >> 24, np.ones(len(i), bool)

    def common(k: np.ndarray, s: np.ndarray | int) -> np.ndarray:
        """The least codeword that pairs k share in segment s; 4096 for none."""
        x = near[a[k], s]
        shared = (x[:, :, None] == near[b[k], s][:, None, :]).any(axis=2) & (x >= 0)
        return np.where(shared, x, 4096).min(axis=1)

    for t in range(int(pair.max())):
        k = np.flatnonzero(new & (pair > t))
        new[k[(common(k, 2 * t) < 4096) & (common(k, 2 * t + 1) < 4096)]] = False
    k = np.flatnonzero(new)
    return k[(common(k, 2 * pair[k]) << 12 | common(k, 2 * pair[k] + 1)) == key[i[k]] & ((1 << 24) - 1)]


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _similar(pairs: DataFrame, classes: DataFrame, marked: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) of classes, those whose sets have the similarity."""
    share = Fraction(str(similarity))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("fp").alias(f"f{x}")), x)
    bits = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    sized = share.denominator * F.least("na", "nb") >= share.numerator * F.greatest("na", "nb")
    pairs = materialise(pairs.where(sized & (bits <= differing(similarity, 64 * LONGS))).select("a", "b", "na", "nb"), "pairs")
    ends = materialise(pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct().join(classes, "c").select("c", "least.id", "least.h"), "ends")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = [shingles(t.as_py(), words) for t in b.column(1).slice(i, 256)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, part)]), pa.int32()), pa.array(np.concatenate(part)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 256), lists], names=["c", "s"])

    ends = _small(ends)
    texts = marked.join(ends, marked["__id"].eqNullSafe(ends["id"]) & (marked["__h"] == ends["h"])).select("c", F.col(text_col).cast("string").alias("t"))
    whole = materialise(texts.mapInArrow(sets, "c long, s array<long>"), "sets").dropDuplicates(["c"])
    for x in "ab":
        pairs = pairs.join(whole.select(F.col("c").alias(x), F.col("s").alias(f"s{x}")), x)
    common = F.size(F.array_intersect("sa", "sb"))
    enough = (share.denominator + share.numerator) * common >= share.numerator * (F.col("na") + F.col("nb"))
    return materialise(pairs.where(enough).select("a", "b"), "near")


def near_texts(marked: DataFrame, text_col: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """marked: __id, __h (hash of the text) and the text. Rows read (id, h, c, n, fp), and of each class c of equal
    shingle sets (c, n, least, root): root names its component, least is the struct (none, id, h) of its least row."""
    rows = materialise(_read(marked, text_col, words), "fingerprints")
    classes = materialise(rows.groupBy("c").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("least")), "classes")
    most, close = (differing(similarity, 64 * WITH_KEY, d) for d in (OF_KEY, FIRST))
    keyed = classes.select("c", "fp").mapInArrow(_keyed, "key int, c long" + "".join(f", w{w} long" for w in range(WITH_KEY))).repartition("key").sortWithinPartitions("key", "c")
    keyed = materialise(keyed.mapInArrow(_nearest(most, close), "key int, c long, head long, bits int"), "near-keys")
    known = lambda pairs: _similar(pairs, classes, marked, text_col, words, similarity)
    # A text has a few hundred keys, and so many heads at most.
    heads = keyed.where("head <> c").groupBy("c").agg(F.slice(F.array_sort(F.collect_set(F.struct("bits", "head"))), 1, HEADS).alias("heads"))
    near = known(heads.select(F.col("c").alias("b"), F.inline("heads")).select(F.col("head").alias("a"), "b"))
    root: Column = F.coalesce("root", "c").alias("root")
    # Roots and fingerprints are joined to parts of a text's keys, a few hundred in all, which are then dealt out evenly.
    parts = keyed.groupBy("c", F.pmod(F.hash("key"), F.lit(PARTS)).alias("part")).agg(F.collect_list("key").alias("keys"))
    words_ = [f"w{i}" for i in range(LONGS)]
    stars = connected_components(near)
    told = parts.join(stars.withColumnRenamed("node", "c"), "c", "left").select("c", "part", "keys", root)
    told = told.join(classes.select("c", "n", *(F.col("fp")[i].alias(w) for i, w in enumerate(words_))), "c").repartition("c", "part")
    told = told.select(F.explode("keys").alias("key"), "c", "root", "n", *words_).repartition("key").sortWithinPartitions("key", "c")
    pairs = told.mapInArrow(_between(most, differing(similarity, 64 * LONGS), Fraction(str(similarity))), "a long, b long")
    # The components so far stand for their pairs: few rounds are left to do.
    roots = connected_components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(known(pairs))).withColumnRenamed("node", "c")
    return rows, classes.join(roots, "c", "left").select("c", "n", "least", root)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs, with its columns, of each component of texts linked by the similarity: that of the least id
    (null ids last), and of the least hash of the text there. Rows are told apart by their texts, not by their
    ids; null texts count as empty ones, which are near each other. An empty table gives no rows."""
    marked = docs.withColumns({"__id": F.col(id_col).cast("long"), "__h": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    rows, classes = near_texts(marked, text_col, words, similarity)
    classes = materialise(classes, "components")
    least = classes.groupBy("root").agg(F.min("least").alias("first"))
    named = classes.join(least, "root").select("c", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"))
    # Rows to drop, and rows to keep that stand there more than once.
    each = rows.groupBy("id", "h").agg(F.any_value("c").alias("c"), F.count(F.lit(1)).alias("times")).join(named, "c")
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    marks = materialise(each.where(~stays | (F.col("times") > 1)).select("id", "h", stays.alias("stays")), "marks")
    is_row = lambda m: marked["__id"].eqNullSafe(m["id"]) & (marked["__h"] == m["h"])
    every, again = _small(marks), marks.where("stays")
    out = marked.join(every, is_row(every), "left_anti")
    if again.isEmpty():
        return out.select(docs.columns)
    again = _small(again)
    return out.unionByName(marked.join(again, is_row(again), "left_semi").dropDuplicates(["__id", "__h"])).select(docs.columns)
