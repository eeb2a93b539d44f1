"""Minimax contiguous partition of atomic groups into shards, with DataFrame operations only.

Groups (equal texts) are ordered by the 64-bit hash of their text. The smallest feasible capacity is
found by binary search, with a greedy check for each capacity: every shard takes groups in order
while they fit. The check needs, for a target of bytes, the last group boundary at or below it. The
driver answers that from sums over hash prefixes, refined only along the paths that checks ask for:
each refinement is one small aggregation whose result has at most FANOUT rows for each of the few
prefixes asked for, whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

#: Bits of the hash that each level of prefixes adds.
LEVELS = (12, 8, 8, 8, 8, 8, 12)
FANOUT = 1 << max(LEVELS)
#: The binary search fetches the nodes between its bounds at once when they are no more than this.
AT_ONCE = 64
HALF = 1 << 63


class Prefixes:
    """Cumulative bytes at hash prefixes, fetched level by level. Hashes count as unsigned: h + 2^63."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups, self.children = groups, {}
        self.fetch(0, [0])

    @staticmethod
    def shift(level: int) -> int:
        return 64 - sum(LEVELS[:level])

    def fetch(self, level: int, prefixes: list[int]) -> None:
        """Sums of the children of nodes (level, prefix): names, running bytes, groups in each."""
        want = sorted({p for p in prefixes if (level, p) not in self.children})
        for i in range(0, len(want), AT_ONCE):
            self._fetch(level, want[i : i + AT_ONCE])

    def _fetch(self, level: int, want: list[int]) -> None:
        df, up, down = self.groups, self.shift(level), self.shift(level + 1)
        if level:  # ranges of h, which reach the sorted Parquet row groups
            df = df.where(reduce(or_, (F.col("h").between((p << up) - HALF, ((p + 1) << up) - 1 - HALF) for p in want)))
        prefix = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-HALF)), down)
        sums = df.groupBy(prefix.alias("p")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        for p in want:
            self.children[level, p] = ([], [0], [])
        for p, size, n in sorted((p % (1 << 64), size, n) for p, size, n in sums):
            names, ends, counts = self.children[level, p >> LEVELS[level]]
            names.append(p)
            ends.append(ends[-1] + size)
            counts.append(n)

    @property
    def total(self) -> int:
        return self.children[0, 0][1][-1]

    def boundary(self, target: int) -> tuple[int, int]:
        """The last group boundary at or below target bytes: (bytes before it, first hash after it,
        unsigned; 2^64 when all groups lie before it)."""
        before, p = 0, 0
        for level in range(len(LEVELS)):
            self.fetch(level, [p])
            names, ends, counts = self.children[level, p]
            k = bisect_right(ends, target - before) - 1
            if k == len(names):
                return before + ends[k], (p + 1) << self.shift(level)
            before, p = before + ends[k], names[k]
            if before == target or counts[k] == 1 or level == len(LEVELS) - 1:
                return before, p << self.shift(level + 1)
        raise AssertionError


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity with which greedy filling needs at most `shards` shards, and the first hash
    (unsigned) of shards 1, 2, ... groups: h (long, one row for each group), bytes (long)."""
    sums = Prefixes(groups)
    if not sums.total:
        return 0, [1 << 64] * (shards - 1)

    def greedy(capacity: int) -> list[tuple[int, int]]:
        cuts, before = [], 0
        for _ in range(shards):
            cuts.append(sums.boundary(before + capacity))
            before = cuts[-1][0]
        return cuts

    largest = groups.agg(F.max("bytes")).first()[0]
    low = max(largest, -(-sums.total // shards))
    high = low + largest  # a shard that closes holds more than its capacity less the largest group
    ends = [greedy(low), greedy(high)]
    while low < high:
        s = sums.shift(1)
        spans = [range(a >> s, min(b >> s, FANOUT - 1) + 1) for (_, a), (_, b) in zip(*ends, strict=True)]
        if sum(map(len, spans)) <= 4 * AT_ONCE:
            sums.fetch(1, [p for span in spans for p in span])
        middle = (low + high) // 2
        cuts = greedy(middle)
        if cuts[-1][0] >= sums.total:
            high, ends[1] = middle, cuts
        else:
            low, ends[0] = middle + 1, cuts
    return low, [h for _, h in greedy(low)[:-1]]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Sizes are UTF-8 bytes plus one; a null text counts as empty. Equal texts are one atomic group and
    share a shard, so the largest shard is as small as contiguous cuts allow. Slots are gapless from 0
    in each shard, in the order of a hash of doc_id and text hash; ties are identical rows. An empty
    table gives no rows; one text that holds most of the bytes fills a shard of its own.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = materialise(rows, "shard-rows")
    groups = materialise(rows.groupBy("h").agg(F.sum("size").alias("bytes")).sortWithinPartitions("h"), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)

    reached: Column = F.lit(0)
    for cut in cuts:
        reached = reached + (F.lit(False) if cut >= 1 << 64 else F.col("h") >= F.lit(cut - HALF)).cast("int")
    # Slots: rows are dealt to many buckets by a hash of the row, so no group of copies meets in one;
    # a bucket's offset is a running sum over the (few) buckets of its shard.
    buckets = max(64, 4 * shuffle_partitions(spark))
    placed = rows.select("*", reached.alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "h"))
    return (
        placed.withColumn("number", number)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
