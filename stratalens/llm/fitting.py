"""Packing of whole documents into fixed windows by exact complements, then best fit.

Only lengths matter for which pieces share a window, and there are at most as many lengths as a window
has places. So the driver plans on a histogram of lengths, whose size is the window's and not the
corpus's: a plan is a list of patterns (a multiset of lengths) and how often each is used. Tasks then
look up, by a piece's length and its rank among the pieces of that length, the window it goes to.

The planner takes lengths from the longest down. The gap that a piece leaves is looked up in an index of the
lengths at hand, of the sums of pairs of them and, through those, of triples; a combination that fills the
gap exactly is used as often as the counts allow. What finds no complement is packed by best fit.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 2048
END_ID = 0
#: Chunks of text whose ids a Python worker remembers, in each of two generations (about 200 bytes a chunk).
CHUNKS = 500_000
#: Chunks between two looks at the number remembered; pieces in a batch that goes out.
SLICE, OUT = 100_000, 4096


class Chunks(dict):
    """Ids of chunks, those of the older generation first."""

    def __init__(self, older: dict[str, bytes], encode) -> None:
        self.older, self.encode = older, encode

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        found = self[chunk] = self.encode(chunk) if found is None else found
        return found


class ChunkEncoder:
    """Ids of whole texts for a BPE with word ends that drops white space, as little-endian unsigned 32-bit ids.

    No token reaches across a space or a line break, so ids are made chunk by chunk between those. Chunks of
    printable Latin-1 signs go through the same vocabulary in a quicker BPE, in which a byte that no
    text holds stands for the word's end, so ranks are ids; other chunks go to the tokenizer itself, and so
    do whole texts with a special token's string. Tests hold the ids to the tokenizer's.
    """

    def __init__(self, path: str, chunks: int = CHUNKS) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        end, ranks = "</w>", {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token not in special:
                ranks[bytes(byte[c] for c in token.removesuffix(end)) + b"\xff" * token.endswith(end)] = i
        self.piece = tiktoken.Encoding("word-bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        # Fixed value: the tokenizer's own pattern of words.
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[\x21-\x7e\xa1-\xff]*").fullmatch
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)").search
        self.limit, self.chunks = chunks, Chunks({}, self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and (chunk.isascii() or self.plain(chunk)):
            ids = self.piece(chunk.lower().encode() + b"\xff")
            return pack(f"<{len(ids)}I", *ids)
        if chunk[-1:] in ",." and chunk[:-1].isalpha() and self.plain(chunk):
            return self.chunks[chunk[:-1]] + self.chunks[chunk[-1]]
        if self.plain(chunk):
            ids = [i for part in self.parts(chunk.lower()) for i in self.piece(part.encode() + b"\xff")]
            return pack(f"<{len(ids)}I", *ids)
        return self._whole(chunk)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.special(text):
            return self._whole(text)
        try:  # in Latin-1 a small letter does not depend on those around it
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        chunks, out = text.replace("\n", " ").split(" "), []
        for i in range(0, len(chunks), SLICE):
            if len(self.chunks) >= self.limit:
                self.chunks.older = {}  # the generation before goes; nothing is copied
                self.chunks = Chunks(self.chunks, self._chunk)
            out += map(self.chunks.__getitem__, chunks[i : i + SLICE])
        return b"".join(out)


@cache
def encoder(path: str, chunks: int) -> ChunkEncoder:
    return ChunkEncoder(path, chunks)


class Planner:
    """Patterns for a histogram of lengths; have[n] pieces of length n are not placed yet."""

    def __init__(self, counts: dict[int, int], window: int) -> None:
        self.window, self.have = window, np.zeros(window + 1, np.int64)
        for n, k in counts.items():
            self.have[n] = k
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._index()

    def _index(self) -> None:
        """Sums of two lengths at hand (how often one length is needed is not looked at here)."""
        there = np.fft.rfft(self.have > 0, 2 * len(self.have))
        self.pairs = np.fft.irfft(there * there)[: len(self.have)] > 0.5

    def _pair(self, gap: int) -> tuple[int, ...] | None:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = np.flatnonzero((self.have[a] > 0) & (self.have[gap - a] > 0) & ((2 * a != gap) | (self.have[a] > 1)))
        return (int(a[ok[0]]), int(gap - a[ok[0]])) if len(ok) else None

    def complement(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """No, one, two or three lengths at hand (`most` of them) whose sum is the gap; None where there are none."""
        if gap == 0:
            return ()
        if self.have[gap]:
            return (gap,)
        if most > 1 and self.pairs[gap] and (found := self._pair(gap)):
            return found
        if most < 3:
            return None
        a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for first in a[(self.have[a] > 0) & self.pairs[gap - a]].tolist():
            self.have[first] -= 1
            found = self._pair(gap - first)
            self.have[first] += 1
            if found:
                return (first, *found)
        return None

    def _use(self, pieces: tuple[int, ...], times: int) -> None:
        self.patterns.append((pieces, times))
        for n, k in Counter(pieces).items():
            self.have[n] -= k * times

    def exact(self, most: int) -> None:
        """Full windows: each length in turn opens some, as long as its gap has a complement of `most` pieces at most. With
        three, a gap that has none takes the longest piece that fits, and the smaller gap is looked up again."""
        for first in range(self.window, 0, -1):
            while self.have[first]:
                pieces, gap, fill = [first], self.window - first, None
                self.have[first] -= 1
                while (fill := self.complement(gap, most)) is None:
                    fits = np.flatnonzero(self.have[: min(gap, first) + 1]) if most == 3 else ()
                    if not len(fits):
                        break
                    pieces.append(int(fits[-1]))
                    self.have[fits[-1]] -= 1
                    gap -= pieces[-1]
                for n in pieces:
                    self.have[n] += 1
                if fill is None:
                    break
                whole = (*pieces, *fill)
                self._use(whole, min(int(self.have[n]) // k for n, k in Counter(whole).items()))
                if not all(self.have[n] for n in whole):
                    self._index()

    def best_fit(self) -> None:
        """The rest, longest first, each into the window with the least gap that holds it. Windows with the same pieces are
        one row with a number."""
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        gaps: list[int] = []  # sorted

        def put(pieces: tuple[int, ...], times: int) -> None:
            gap = self.window - sum(pieces)
            if gap not in open_:
                gaps.insert(int(np.searchsorted(gaps, gap)), gap)
            open_.setdefault(gap, []).append((pieces, times))

        for n in range(self.window, 0, -1):
            left = int(self.have[n])
            while left:
                at = int(np.searchsorted(gaps, n))
                if at < len(gaps):
                    pieces, times = open_[gaps[at]].pop()
                    if not open_[gaps[at]]:
                        del open_[gaps.pop(at)]
                else:
                    pieces, times = (), left
                each = min((self.window - sum(pieces)) // n, left)
                used = min(times, left // each)
                if used < times and pieces:
                    put(pieces, times - used)
                put((*pieces, *[n] * each), used)
                left -= used * each
            self.have[n] = 0
        self.patterns += [row for gap in gaps for row in open_[gap]]


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first, in one window) and how often each is used. The pieces are those counted.

    Complements of up to three pieces may use up short pieces that long ones would need later, so plans with smaller
    complements are made too, unless the first one reaches the least number of windows that could do.
    """
    least, best = -(-sum(n * k for n, k in counts.items()) // window), None
    for most in (3, 2, 1):
        planner = Planner(counts, window)
        planner.exact(most)
        planner.best_fit()
        windows = sum(times for _, times in planner.patterns)
        if best is None or windows < best[0]:
            best = windows, planner.patterns
        if windows == least:
            break
    return [(tuple(sorted(pieces, reverse=True)), times) for pieces, times in best[1]]


#: Ranks within one length are told apart from the lengths by so many bits.
RANKS = 48


class Places:
    """For a piece's length and rank, its window and its place there: a sorted table of runs of ranks, one for
    each pattern and length in it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        used, rows, window = Counter(), [], 0
        for pieces, times in patterns:
            at = 0
            for n, k in Counter(pieces).items():  # equal lengths stand together
                rows.append((n << RANKS | used[n], k, window, at, n))
                used[n], at = used[n] + k * times, at + n * k
            window += times
        self.windows = window
        self.starts, self.each, self.first, self.at, self.length = np.array(sorted(rows), np.int64).reshape(-1, 5).T

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = lengths.astype(np.int64) << RANKS | ranks
        i = np.searchsorted(self.starts, key, "right") - 1
        k = key - self.starts[i]
        return self.first[i] + k // self.each[i], self.at[i] + k % self.each[i] * self.length[i]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, chunks: int = CHUNKS) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, ids (with_ids), and where they were made: task
    and nth, the piece's number among those of its length in that task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path, chunks).encode, np.array([end_id], "<u4").tobytes()
        task, seen, out = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), []
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * with_ids]

        def drain() -> pa.RecordBatch:
            doc, piece, start, length, crc, nth, ids = zip(*out, strict=True)
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array([task] * len(doc), pa.int32()), pa.array(nth, pa.int64())]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * window)):
                    part = ids[at : at + 4 * window]
                    n = len(part) // 4
                    out.append((doc, piece, at // 4, n, zlib.crc32(part), int(seen[n]), part if with_ids else b""))
                    seen[n] += 1
                    if len(out) >= (OUT // 8 if with_ids else OUT):
                        yield drain()
        if out:
            yield drain()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def fit_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, chunks: int = CHUNKS) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids (with_ids), ids_crc32, sequence_id,
    offset.

    A document's ids are those of its text and end_id; a null text is empty, so it is end_id alone. Only
    documents of more than `window` ids are cut, into pieces of that length and a rest. Sequences are numbered
    from 0 without gaps, and a sequence's pieces follow each other from 0 without gaps. Repeated rows, and rows with a
    null doc_id, are packed each for itself. An empty table gives no rows.

    The driver holds one count for each length; tasks hold the plan, whose rows the window bounds (a pattern uses up a
    length's pieces or is the best fit's, and names a few lengths). Texts are read once; only the narrow
    rows of pieces are joined, with the number of pieces of their length in earlier tasks.
    """
    made = materialise(pieces(docs, tokenizer_path, id_col, text_col, window, end_id, with_ids, chunks), "pieces")
    tasks = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # One row for each task: a common length's tasks are ordered, never its pieces.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = materialise(tasks.select("task", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "piece-ranks")
    counts = {r[0]: r[1] for r in based.groupBy("length").agg(F.sum("n")).collect()}  # at most `window` rows
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(n).to_numpy() for n in ("length", "nth", "before")}
            sequence, offset = places.value.find(col["length"], col["nth"] + col["before"])
            kept = [n for n in b.schema.names if n not in ("nth", "before")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    ids = ["ids"] * with_ids
    ranked = made.join(based.drop("n"), ["task", "length"]).select("doc_id", "piece", "start", "length", *ids, "ids_crc32", "nth", "before")
    schema = "doc_id long, piece int, start long, length long, " + "ids array<int>, " * with_ids + "ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
