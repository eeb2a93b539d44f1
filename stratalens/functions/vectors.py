"""Vectors: cosine, norms, the deterministic embedder and a provider interface."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOCK_SIZE = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either norm is zero; unequal lengths raise."""

    def of(p: Column) -> Column:
        x, y = p["a"], p["b"]
        sums = F.aggregate(
            F.zip_with(x, y, lambda u, v: F.struct(u.cast("double").alias("u"), v.cast("double").alias("v"))),
            F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t")),
            lambda s, p: F.struct((s["d"] + p["u"] * p["v"]).alias("d"), (s["s"] + p["u"] * p["u"]).alias("s"), (s["t"] + p["v"] * p["v"]).alias("t")),
            lambda s: F.coalesce(F.try_divide(s["d"], F.sqrt(s["s"]) * F.sqrt(s["t"])), F.lit(0.0)),
        )
        return F.when(F.size(x) != F.size(y), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(sums)

    return bind(F.struct(a.alias("a"), b.alias("b")), of)


def array_of(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def clamp01(c: Column) -> Column:
    """Between 0 and 1; NaN counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(c.cast("double"), F.lit(0.0))))


def mock_embed(text: str, size: int = MOCK_SIZE) -> list[float]:
    """The deterministic test embedder: one value for each of the first `size` UTF-16 units, normalised."""
    raw = text.encode("utf-16-le", "surrogatepass")[: 2 * size]
    units = [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]
    v = [(u % 101 + 1) / 101 for u in units] + [0.0] * (size - len(units))
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def mock_vector(text: Column, size: int = MOCK_SIZE) -> Column:
    """mock_embed as a column expression, for texts in the basic plane; stays on the JVM."""
    one = lambda h, i: F.when(i <= F.length(h), (F.ascii(F.substring(h, i, F.lit(1))) % 101 + 1) / F.lit(101.0)).otherwise(F.lit(0.0))
    raw = bind(F.substring(text, 1, size), lambda h: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: one(h, i)))
    return bind(raw, lambda r: bind(norm(r), lambda n: F.when(n == 0, r).otherwise(F.transform(r, lambda x: x / n))))


Provider = Callable[[list[str]], list[list[float]]]


def embed_column(text: Column, provider: Provider, batch: int = 32) -> Column:
    """Vectors from any provider, in Arrow batches; the provider is created once for each task."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = []
            texts = s.fillna("").tolist()
            for i in range(0, len(texts), batch):
                out += provider(texts[i : i + batch])
            yield pd.Series(out)

    return run(text)


def merge_pieces(vectors: Column, weights: Column) -> Column:
    """Mean of equally long vectors weighted by lengths (1 at least), not normalised again."""
    w = F.transform(weights, lambda x: F.greatest(x, F.lit(1)).cast("double"))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    size = F.size(vectors[0])
    return F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.aggregate(F.zip_with(vectors, w, lambda v, x: F.get(v, k).cast("double") * x), F.lit(0.0), lambda s, x: s + x) / total)
