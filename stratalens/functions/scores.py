"""Scores of the ranked lanes as column expressions over a document and a query string."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CAMEL, camel_terms, query_terms
from .vectors import clamp01


def contains_phrase(text: Column, query: str) -> Column:
    q = query.strip().lower()
    return F.contains(F.lower(text), F.lit(q)) if q else F.lit(False)


def substring_coverage(text: Column, query: str, share: float = 0.82, phrase: float = 0.18) -> Column:
    """Share of the query's different terms that are substrings, plus a boost for the whole phrase."""
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0)
    low = F.lower(text)
    hits = reduce(add, (F.contains(low, F.lit(t)).cast("int") for t in terms))
    return clamp01(hits / len(terms) * share + F.when(contains_phrase(text, query), phrase).otherwise(0.0))


def matched_substrings(text: Column, query: str) -> Column:
    low = F.lower(text)
    return F.sort_array(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in query_terms(query)), F.lit(None).cast("string"))))


def keyword_score(path: Column, header: Column, symbols: Column, content: Column, query: str) -> Column:
    """The file lane: 0.65 of term coverage, 0.2 of that by matched symbols, 0.15 for the phrase."""
    terms = query_terms(query, CAMEL)
    if not terms:
        return F.lit(0.0)
    q = F.array(*map(F.lit, terms))
    text = F.concat_ws(" ", path, header, F.array_join(symbols, " "), content)
    matched = F.filter(symbols, lambda s: F.arrays_overlap(camel_terms(s), q))
    cover = lambda c: F.size(F.array_intersect(q, camel_terms(c))) / len(terms)
    return clamp01(cover(text) * 0.65 + cover(F.array_join(matched, " ")) * 0.2 + F.when(contains_phrase(text, query), 0.15).otherwise(0.0))


def combined_score(semantic: Column, other: Column, semantic_weight: float = 0.72, other_weight: float = 0.28) -> Column:
    """Weighted mean of a semantic score (negative: 0) and another one; both weights 0: the semantic one."""
    s, total = F.greatest(semantic, F.lit(0.0)), semantic_weight + other_weight
    return clamp01((s * semantic_weight + other * other_weight) / total) if total > 0 else s


def fuse(file: Column, chunk: Column, identifier: Column, structure: Column, weights: tuple[float, float, float, float] = (0.20, 0.22, 0.24, 0.18)) -> Column:
    """The evidence kinds of a candidate in one score."""
    parts, total = (file, chunk, identifier, structure), sum(weights)
    return clamp01(reduce(add, (p * w for p, w in zip(parts, weights, strict=True))) / total) if total > 0 else clamp01(reduce(add, parts))


def fraction(value: float | None, default: float) -> float:
    """A threshold as a fraction: over 1 it is a percentage; none or not finite: the default."""
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return default
    return min(max(value / 100 if value > 1 else value, 0.0), 1.0)


def change_risk(reverse: Column, exports: Column, dependencies: Column) -> Column:
    high = (reverse >= 3) | (exports >= 3) | (dependencies >= 5)
    return F.when(high, "high").when((reverse > 0) | (exports > 0) | (dependencies >= 3), "medium").otherwise("low")


def module_risk(incoming: Column, exported: Column, files: Column) -> Column:
    high = (incoming >= 3) | (exported >= 4) | (files >= 5)
    return F.when(high, "high").when((incoming > 0) | (exported > 0) | (files >= 3), "medium").otherwise("low")
