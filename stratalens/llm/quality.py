"""Nearest-neighbour quality voting over latent-semantic vectors.

Terms of a text are hashed byte trigrams of its lower-cased form, trigrams of character classes
(their Unicode categories) and how often a word repeats the one before it. Each
block of log counts is weighted by inverse document frequency and scaled to unit length; a truncated
SVD of a bounded sample of labelled texts gives the latent space. The sample's latent vectors are
broadcast (their number is bounded by a parameter) and compared with every document in blocks by
exact cosine products; the nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents the classifier is fitted on: those of the least hash of doc_id.
SAMPLE = 4000
RANK = 48
NEIGHBOURS = 15
POWER = 8.0
BLOCK = 256
TRIGRAMS = 2048
#: Character classes of bytes: 0 for those beyond ASCII, else the Unicode category, numbered in order of name.
_KINDS = sorted({category(chr(b)) for b in range(128)})
_CLASS = np.zeros(256, np.uint16)
_CLASS[:128] = [1 + _KINDS.index(category(chr(b))) for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
CLASSES = 16**3
WIDTH = CLASSES + TRIGRAMS + 2
_BLOCKS = (slice(0, CLASSES), slice(CLASSES, CLASSES + TRIGRAMS), slice(CLASSES + TRIGRAMS, WIDTH))
_PIECE = 1 << 20


def terms(text: str | None) -> np.ndarray:
    """Term counts of a whole text (float32, WIDTH)."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    for i in range(0, max(1, raw.size - 2), _PIECE):
        part = raw[i : i + _PIECE + 2]
        c, b = _CLASS[part], _LOWER[part]
        if part.size >= 3:
            out[_BLOCKS[0]] += np.bincount((c[:-2] << 8) | (c[1:-1] << 4) | c[2:], minlength=CLASSES)
            h = (b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35).astype(np.uint32)
            out[_BLOCKS[1]] += np.bincount(h >> np.uint32(21), minlength=TRIGRAMS)
    words = text.split()
    again = sum(map(eq, words, words[1:]))
    out[-2:] = again, len(words) - again
    return out


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted counts, each block of unit length; in place, so that a sample is held once."""
    again = counts[:, _BLOCKS[2]].copy()
    x = np.log1p(counts, out=counts)
    x *= idf
    x[:, _BLOCKS[2]] = again
    for b in _BLOCKS:
        n = np.sqrt(np.einsum("ij,ij->i", x[:, b], x[:, b]))[:, None]
        x[:, b] /= np.where(n > 0, n, 1)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Scores of rows of term counts; a row without terms gets the share of label 1."""
        v = _unit(_scaled(counts.copy(), self.idf) @ self.basis)
        sims = v @ self.vectors.T
        k = min(NEIGHBOURS, sims.shape[1])
        if not k:
            return np.full(len(counts), self.prior)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        w = np.clip(np.take_along_axis(sims, near, 1), 0, 1) ** POWER
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1), self.prior).round(6)


def fit(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """The latent space and the labelled vectors; without labelled rows every score is 0.5. Overwrites counts."""
    n = len(labels)
    df = np.count_nonzero(counts, axis=0)
    idf = np.where(df >= 2, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)
    x = _scaled(counts, idf)
    rng = np.random.default_rng(0)
    basis = np.zeros((WIDTH, 0), np.float32)
    if n:
        # Randomised range finder with power iterations; columns are the leading right singular vectors.
        q = np.linalg.qr(x.T @ rng.standard_normal((n, min(n, rank + 16))).astype(np.float32))[0]
        for _ in range(4):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        basis = (q @ vt.T)[:, :rank].astype(np.float32)
    return Model(idf, basis, _unit(x @ basis), labels.astype(np.float64), float(labels.mean()) if n else 0.5)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents that are not held out, chosen by a hash of doc_id.

    Labels other than 0 and 1, and rows without a document, say nothing. Of several labels of a doc_id the greatest
    counts, and of several texts that of the least hash, chosen before the driver gets any: it gets `sample` rows at
    most, however often a document is repeated.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    @F.pandas_udf("struct<at:binary,n:binary>")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            c = terms(t)
            at = np.flatnonzero(c)
            rows.append((at.astype("<u2").tobytes(), c[at].astype("<f4").tobytes()))
        return pd.DataFrame(rows, columns=["at", "n"])

    # The broadcast side is the sample, bounded by its parameter; one text of each document goes on.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = rows.select("doc_id", F.col("quality").cast("double").alias("quality"), sparse("text").alias("terms")).select("doc_id", "quality", "terms.*").toArrow()  # `sample` rows at most
    got = got.sort_by("doc_id")
    counts = np.zeros((len(got), WIDTH), np.float32)
    for i in range(len(got)):
        counts[i, np.frombuffer(got["at"][i].as_py(), "<u2")] = np.frombuffer(got["n"][i].as_py(), "<f4")
    quality = got["quality"].to_numpy()
    del got
    return fit(counts, quality)


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each whole text, 0 to 1. Null and empty texts get the share of label 1 in the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for i in range(0, len(texts), BLOCK):
            out[i : i + BLOCK] = shared.value.score(np.stack([terms(t) for t in texts[i : i + BLOCK]]))
        return pd.Series(out)

    return score(F.col(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    scored = docs.select("doc_id", score_column(docs, train(docs, labels, sample)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with its columns, whose score is at least 0.5."""
    return docs.where(score_column(docs, train(docs, labels, sample)) >= 0.5)
