"""Tokenizers and text helpers as column expressions, and driver-side twins for query strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What separates terms in each tokenizer, and the limits of lexical terms.
COMMON, CAMEL, EXACT = "[^a-z0-9_]+", "[\\s_-]+", "[^a-z0-9_./-]+"
MAX_TERM, MAX_TERMS = 64, 256


def _humps(c: Column) -> Column:
    """Camel-case words parted by spaces, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2"))


def _terms(c: Column, separator: str) -> Column:
    return F.filter(F.split(_humps(c), separator), lambda t: F.length(t) > 1)


def common_terms(c: Column) -> Column:
    """Terms of letters, digits and underscores (the tokenizer of lexical retrieval)."""
    return _terms(c, COMMON)


def camel_terms(c: Column) -> Column:
    """Terms parted by white space, underscore and hyphen only; other signs stay (the file lane)."""
    return _terms(c, CAMEL)


def exact_terms(c: Column) -> Column:
    """Terms that keep dots, slashes and hyphens (exact lookups)."""
    return _terms(c, EXACT)


def lookup_tokens(c: Column) -> Column:
    """exact_terms and the whole text, trimmed and lower-cased."""
    return F.array_distinct(F.filter(F.concat(F.array(F.lower(F.trim(c))), exact_terms(c)), lambda t: t != ""))


def query_terms(text: str, separator: str = COMMON) -> list[str]:
    """Different terms of a query string, in order: the driver-side twin of the tokenizers."""
    t = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", text)).lower()
    return list(dict.fromkeys(x for x in re.split(separator, t, flags=re.ASCII) if len(x) > 1))


def register(spark: SparkSession) -> None:
    """The tokenizers as SQL functions, all on the JVM side."""
    for name, separator in (("common_terms", COMMON), ("camel_terms", CAMEL), ("exact_terms", EXACT)):
        humps = "lower(regexp_replace(regexp_replace(s, '([a-z])([A-Z])', '$1 $2'), '([A-Z])([A-Z][a-z])', '$1 $2'))"
        body = f"filter(split({humps}, r'{separator}'), t -> length(t) > 1)"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS ARRAY<STRING> RETURN {body}")


def slugify(c: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def normal_path(c: Column) -> Column:
    """Slashes for backslashes, no leading ./"""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")


def snippet(c: Column, most: int = 120) -> Column:
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 3), F.lit("..."))).otherwise(one)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def directory(path: Column) -> Column:
    """Path of the directory, '.' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_pattern(path: Column) -> Column:
    """Aggregate: common directory prefix and/or base name of a group's paths; null for fewer than two or neither.
    Made of minima, maxima and a count, so no task gathers a group's paths."""
    first, last = F.split(F.min(path), "/"), F.split(F.max(path), "/")
    n = F.min(F.size(F.split(path, "/"))) - 1
    # What the least and the greatest path share, all paths share.
    same = F.aggregate(
        F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit("").alias("p"), F.lit(True).alias("on")),
        lambda a, i: F.struct(F.when(a.on & (first[i - 1] == last[i - 1]), F.concat(a.p, first[i - 1], F.lit("/"))).otherwise(a.p).alias("p"), (a.on & (first[i - 1] == last[i - 1])).alias("on")),
        lambda a: a.p,
    )
    base = F.min(base_name(path))
    one = base == F.max(base_name(path))
    return F.when(F.count(path) > 1, F.when(same != "", F.concat(same, F.when(one, base).otherwise("*"))).when(one, F.concat(F.lit("*/"), base)))


def cluster_label(segment: Column) -> Column:
    """Two words at most, first letters raised, the rest as it is."""
    words = F.filter(F.split(F.regexp_replace(segment, "[-_]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def dependency_hash(paths: Column, hashes: Column) -> Column:
    """SHA-256 of the sorted lines path:hash of a file's dependencies."""
    return F.sha2(F.array_join(F.array_sort(F.zip_with(paths, hashes, lambda p, h: F.concat_ws(":", p, h))), "\n"), 256)


def cache_key(provider: str, model: str, content: Column) -> Column:
    """The key under which a text's vector is kept: one for each provider, model and content."""
    return F.sha2(F.concat_ws("\n", F.lit(provider), F.lit(model), content), 256)


def token_estimate(c: Column) -> Column:
    """A fourth of the characters, rounded up."""
    return F.ceil(F.length(c) / 4)


def pieces(c: Column, size: int) -> Column:
    """Slices of at most size characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(c) / size) - 1, F.lit(0)).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size)))
