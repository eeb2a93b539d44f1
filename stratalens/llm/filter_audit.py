"""Audit of how filters interact: what each removes in every order they could be applied in.

A packed bitmap index: each task packs its rows' filters, labels and parts into NumPy bitsets, block by
block. For every filter and every set of filters that may stand before it, AND-NOT and popcount give what it
removes; the counts of blocks and tasks are summed. An order's step is one such set, so all orders are read off
the sums: nothing is computed an order at a time, and the sums do not grow with the rows.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS = 100, 80, 10
MARKS = b"#$%&*|"
#: Orders are listed in full, so there are at most so many filters.
MOST_FILTERS = 7
#: Parts whose sums a task holds before it gives them out.
PARTS = 4096
_CAPITALS = string.ascii_uppercase.encode()


def text_flags(docs: DataFrame, part_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, part, A to E (booleans, true where the document fails).

    A: under 100 words; B: distinct words under 80 % of the words; C: A-Z over 10 % of the code points; D: one of
    #$%&*| occurs; E: the text equals that of a smaller doc_id. Words are maximal runs without ASCII white
    space. A null text is empty and equals other empty texts; a null part is the empty one. A null doc_id is
    neither smaller nor greater than any, and rows of one doc_id are not smaller than each other, so these do
    not fail E among themselves. Whole texts are read once; later steps shuffle a digest of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags, digests = np.zeros((b.num_rows, 4), bool), []
            for i, value in enumerate(b.column(2).cast(pa.large_binary())):
                text = value.as_py() or b""
                words = text.split()  # of bytes: exactly the six ASCII signs part words
                capitals = len(text) - len(text.translate(None, _CAPITALS))
                points = int(np.count_nonzero(np.frombuffer(text, np.int8) >= -64))  # all but continuation bytes
                marked = len(text.translate(None, MARKS)) < len(text)
                flags[i] = len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT * len(words), 100 * capitals > CAPITALS * points, marked
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(flags[:, k]) for k in range(4)), pa.array(digests, pa.binary())], ["doc_id", "part", *"ABCD", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    told = materialise(rows.mapInArrow(run, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"), "flags")
    # A text that stands very often is one row a task here, and on the join's other side adaptive execution parts it.
    least = told.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return told.join(least, "digest", "left").select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))


def with_labels(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """flags with booleans good (some label row says quality 1) and toxic (some says toxic 1); without a label, neither."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good or toxic")
    return flags.join(told, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def prefixes(n: int) -> list[tuple[int, int]]:
    """Every filter with every set of others, as (set, filter): the set's bits are the filters in it."""
    return [(s, f) for f in range(n) for s in range(1 << n) if not s >> f & 1]


def _packed(columns: np.ndarray) -> np.ndarray:
    """Bitsets of the columns of a boolean matrix, as rows of 64-bit words."""
    bits = np.packbits(columns, axis=0).T
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def count_block(fails: np.ndarray, labels: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Counts of one block: of each part and (set, filter), those kept by set and filter, removed by the filter
    after the set, failing both, and removed with each label. The arguments are boolean matrices, a row each."""
    f, y, p = map(_packed, (fails, labels, parts))
    n = len(f)
    before = np.zeros((1 << n, f.shape[1]), np.uint64)
    for s in range(1, 1 << n):
        low = s & -s
        before[s] = before[s ^ low] | f[low.bit_length() - 1]
    out = np.zeros((len(p), n << (n - 1), 3 + len(y)), np.int64)
    for k, (s, i) in enumerate(prefixes(n)):
        removed = f[i] & ~before[s]
        for j, bits in enumerate((~(before[s] | f[i]), removed, f[i] & before[s], *(removed & label for label in y))):
            out[:, k, j] = np.bitwise_count(p & bits).sum(1, dtype=np.int64)
    return out


def set_counts(rows: DataFrame, filters: str, labels: tuple[str, ...]) -> DataFrame:
    """(part, before, filter, kept, removed, redundant, a column for each label), summed over all rows: for each part
    2^(n-1) rows for each of the n filters. `before` is the set of filters applied earlier, as bits."""
    at, names = prefixes(len(filters)), ["kept", "removed", "redundant", *labels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for part, counts in held.items():
                cols = [pa.array([part] * len(at)), pa.array([s for s, _ in at], pa.int32()), pa.array([f for _, f in at], pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(counts[:, j]) for j in range(len(names)))], ["part", "before", "filter", *names])
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            bits = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1).astype(bool)
            codes, here = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            for i in range(0, len(here), 64):  # so many parts' bitsets at a time
                counts = count_block(bits[:, : len(filters)], bits[:, len(filters) :], codes[:, None] == np.arange(i, min(i + 64, len(here))))
                for part, c in zip(here[i : i + 64], counts, strict=True):
                    held[part] = held[part] + c if part in held else c
            if len(held) > PARTS:
                yield from drain()
        yield from drain()

    schema = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in names)
    found = rows.select("part", *filters, *labels).mapInArrow(run, schema)
    return found.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in names))


def interaction_audit(rows: DataFrame, filters: str = FILTERS, labels: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """For each part, order of the filters and step (from 1): part, filter_order, step, kept (after the step), removed
    (by it), redundant (failing its filter, removed earlier), unique_fails (failing its filter only), <label>_lost
    (removed by it with that label) and shapley (removed by its filter at any step, summed over all orders).

    rows: part (string, not null), a boolean column for each one-letter filter (true: fails) and each label,
    none of them null. Parts are those of the rows; steps that remove nothing are listed too. An empty table
    gives no rows; equal rows count each.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS or len(set(filters)) < n:
        raise ValueError(f"from 1 to {MOST_FILTERS} different filters")
    counts = materialise(set_counts(rows, filters, labels), "set-counts")
    every = (1 << n) - 1
    size = F.bit_count("before")
    orders: Column = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), size + 1)  # that begin with the set, then the filter
    alone = F.max(F.when(F.col("before") == F.lit(every) - F.pow(F.lit(2), F.col("filter")), F.col("removed")))
    whole = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"), alone.alias("unique_fails"))
    steps = [("".join(filters[i] for i in o), k + 1, sum(1 << i for i in o[:k]), o[k]) for o in permutations(range(n)) for k in range(n)]
    listed = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")
    told = counts.join(whole, ["part", "filter"]).join(F.broadcast(listed), ["before", "filter"])  # n * n! rows, n at most MOST_FILTERS
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(F.col(c).alias(f"{c}_lost") for c in labels), "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters over documents, by language."""
    return interaction_audit(with_labels(text_flags(docs), labels))
