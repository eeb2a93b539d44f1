"""Packing of tokenised documents into fixed windows by minimum bin slack.

Every task packs the rows it reads, in one pass and without a shuffle: whole windows are cut off
each document, and what remains of it waits in a bounded pool. When the pool is full, windows are
filled one by one: the longest waiting piece opens a window, and a bitset dynamic programme over
the multiset of waiting lengths finds the fill closest to capacity, backtracked into counts of each
length. At the end of a task, what cannot fill a window is cut into sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
#: Waiting pieces of one task; below LOW the pool only empties at the end of the task.
POOL, LOW = 4096, 1024
#: Different words whose ids a Python worker remembers, in each of two generations (about 200 bytes a word).
WORDS = 600_000
#: Words of a text between two looks at the number remembered; pieces in a batch that goes out.
SLICE, OUT = 100_000, 512


class Words(dict):
    """Ids of words, those of the older generation first."""

    def __init__(self, older: dict[str, bytes], quick) -> None:
        self.older, self.quick = older, quick

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.older.get(word) or np.array(self.quick(word), "<u4").tobytes()
        return found


class WordEncoder:
    """Ids of whole texts, word by word. Values are little-endian unsigned 32-bit ids.

    A byte-level BPE splits before each single space that a non-space follows and on both sides of
    a lone line break, so the ids of the words between are those of the whole text. Texts with other
    runs of white space are encoded as a whole, and so are texts with a special token's string, by the
    tokenizer itself. New words go to the same vocabulary and merge order in a quicker BPE, whose ranks
    are the ids of the tokenizer's file; tests hold its ids to the tokenizer's.
    """

    def __init__(self, path: str, words: int = WORDS) -> None:
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if token not in special}
        self.quick = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = regex.compile(r"\s\s|^\s|\s$|\x00").search
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)").search
        self.limit, self.words = words, Words({}, self.quick)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.odd(text):
            return np.array(self.quick(text), "<u4").tobytes()
        words, out = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"), []
        for i in range(0, len(words), SLICE):
            if len(self.words) >= self.limit:
                self.words.older = {}  # the generation before goes; nothing is copied
                self.words = Words(self.words, self.quick)
            out += map(self.words.__getitem__, words[i : i + SLICE])
        return b"".join(out)


@cache
def encoder(path: str, words: int) -> WordEncoder:
    return WordEncoder(path, words)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of each length (at most those given) whose sum is as close to room as it can be.

    reach[k] is the bitset of sums of the first k layers; a length with count c gives layers of
    1, 2, 4, ... pieces. It stops when room itself is reached, then walks back through the layers.
    """
    full, goal = (1 << (room + 1)) - 1, 1 << room
    reach, layers = [1], []
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[n], room // n), 1
        while left:
            k = min(take, left)
            now = (reach[-1] | reach[-1] << (n * k)) & full
            reach.append(now)
            layers.append((n, k))
            left, take = left - k, take * 2
            if now & goal:
                left = -1
                break
        if left < 0:
            break
    at, out = reach[-1].bit_length() - 1, {}
    for i in range(len(layers), 0, -1):
        if not reach[i - 1] >> at & 1:
            n, k = layers[i - 1]
            at -= n * k
            out[n] = out.get(n, 0) + k
    return out


class Packer:
    """Packs pieces (row, start, ids) into windows; row is any value that names the document."""

    def __init__(self, window: int = WINDOW, pool: int = POOL, low: int = LOW) -> None:
        self.window, self.pool, self.low = window, pool, min(low, pool - 1)
        self.waiting: dict[int, list] = {}
        self.size, self.tokens, self.sequences, self.out = 0, 0, 0, []

    def add(self, row, ids: bytes) -> None:
        whole = len(ids) // 4 // self.window * self.window
        for start in range(0, whole, self.window):
            self._emit([(row, start, ids[4 * start : 4 * (start + self.window)])])
        if rest := ids[4 * whole :]:
            self._wait((row, whole, rest))
            if self.size >= self.pool:
                while self.size > self.low and self.tokens >= self.window:
                    self._fill()

    def _wait(self, piece) -> None:
        n = len(piece[2]) // 4
        self.waiting.setdefault(n, []).append(piece)
        self.size, self.tokens = self.size + 1, self.tokens + n

    def _take(self, n: int):
        pieces = self.waiting[n]
        piece = pieces.pop()
        if not pieces:
            del self.waiting[n]
        self.size, self.tokens = self.size - 1, self.tokens - n
        return piece

    def _emit(self, pieces: list) -> None:
        at = 0
        for row, start, ids in pieces:
            self.out.append((row, start, ids, self.sequences, at))
            at += len(ids) // 4
        self.sequences += 1

    def _fill(self) -> None:
        """One full window, opened by the longest waiting piece; a slack is filled by cutting a piece. At
        least a window of ids must be waiting."""
        pieces = [self._take(max(self.waiting))]
        room = self.window - len(pieces[0][2]) // 4
        for n, k in best_fill({n: len(p) for n, p in self.waiting.items()}, room).items():
            pieces += [self._take(n) for _ in range(k)]
            room -= n * k
        if room:  # whatever waits is longer than the slack, or the fill would hold it
            row, start, ids = self._take(max(self.waiting))
            pieces.append((row, start, ids[: 4 * room]))
            self._wait((row, start + room, ids[4 * room :]))
        self._emit(pieces)

    def close(self) -> None:
        """Fills windows while there is enough; then lengths of powers of two, longest first."""
        while self.tokens >= self.window:
            self._fill()
        left, size, room, pieces = self.tokens, self.window, 0, []
        while left or room:
            if not room:
                while size > left:
                    size //= 2
                room, pieces, left = size, [], left - size
            row, start, ids = self._take(max(self.waiting))
            n = min(room, len(ids) // 4)
            pieces.append((row, start, ids[: 4 * n]))
            if rest := ids[4 * n :]:
                self._wait((row, start + n, rest))
            room -= n
            if not room:
                self._emit(pieces)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, words: int = WORDS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (with_ids), ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and end_id; a null text is empty, so it is end_id alone.
    Every id lies in exactly one piece. Sequences hold at most window ids; each is full or a power of
    two long. sequence_id is the task's number times 2^33 plus a count from 0: unique, not gapless.
    Repeated rows are packed each for itself, under the same doc_id. An empty table gives no rows.
    A task holds one batch of texts, the pool and the remembered words (twice `words` at most, which a
    worker keeps for its next task), whatever the table's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path, words).encode, Packer(window)
        base, end = TaskContext.get().partitionId() << 33, np.array([end_id], "<u4").tobytes()

        def drain() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(packer.out), OUT):
                part = packer.out[i : i + OUT]
                cols = {
                    "doc_id": pa.array([p[0][0] for p in part], pa.int64()),
                    "start": pa.array([p[1] for p in part], pa.int64()),
                    "length": pa.array([len(p[2]) // 4 for p in part], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p[2]) for p in part], pa.int64()),
                    "doc_tokens": pa.array([p[0][1] for p in part], pa.int64()),
                    "sequence_id": pa.array([base + p[3] for p in part], pa.int64()),
                    "offset": pa.array([p[4] for p in part], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([np.frombuffer(p[2], "<u4").astype(np.int32) for p in part], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)
            packer.out.clear()

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                packer.add((doc.as_py(), len(ids) // 4), ids)
                if len(packer.out) >= OUT:
                    yield from drain()
        packer.close()
        yield from drain()
        pa.default_memory_pool().release_unused()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
