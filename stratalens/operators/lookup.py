"""Exact lookups: symbols, paths, words, outlines and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup_tokens, snippet


def symbol_tokens(symbols: DataFrame) -> DataFrame:
    """symbols: path, name, kind, line, signature. One row for each lookup token of each symbol's name."""
    return symbols.withColumn("token", F.explode(lookup_tokens(F.col("name"))))


def lookup_symbol(tokens: DataFrame, query: str, k: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """Symbols with the token; kinds are filtered after the cut to k, as exact search does."""
    found = tokens.where(F.col("token") == query.strip().lower()).drop("token").dropDuplicates(["path", "name", "line"])
    found = found.orderBy("path", "line", "name").limit(k)
    return found.where(F.lower("kind").isin([x.lower() for x in kinds])) if kinds else found


def lookup_path(paths: DataFrame, query: str, k: int = 10) -> DataFrame:
    """An exact path alone, else paths with the query as a token or as a substring; lower case counts alike."""
    q = query.strip().lower()
    exact = F.col("path") == q
    loose = F.array_contains(lookup_tokens(F.col("path")), q) | F.contains(F.lower("path"), F.lit(q))
    one = paths.where(exact).select("path").distinct()
    hit = F.broadcast(one.limit(1).select(F.lit(True).alias("hit")))  # one row at most
    rest = paths.where(loose).select("path").distinct().join(hit, F.lit(True), "left_anti")
    return one.unionByName(rest).orderBy("path").limit(k)


def word_hits(symbols: DataFrame, files: DataFrame, identifiers: DataFrame | None = None) -> DataFrame:
    """(token, kind, path, line, title, score, context). Of several scores of one hit the first source's
    holds: path, header, symbol name, signature, content, identifier.

    files: path, header, content; symbols: path, name, kind, line, signature; identifiers as symbols.
    """

    def hits(df: DataFrame, order: int, text, kind: str, title, line, whole: float, part: float, context) -> DataFrame:
        raw = F.lower(F.trim(text))
        rows = df.select("path", F.lit(kind).alias("kind"), line.cast("int").alias("line"), title.alias("title"), snippet(context).alias("context"), raw.alias("raw"), F.explode(lookup_tokens(text)).alias("token"))
        score = F.when(F.col("token") == F.col("raw"), whole).otherwise(part)
        return rows.select("token", "kind", "path", "line", "title", "context", score.alias("score"), F.lit(order).alias("source"))

    one, path = F.lit(1), F.col("path")
    out = hits(files, 0, path, "path", path, one, 1.0, 0.82, path)
    out = out.unionByName(hits(files, 1, F.col("header"), "content", path, one, 0.72, 0.72, F.col("header")))
    name, sig, line = F.col("name"), F.col("signature"), F.col("line")
    # A signature's tokens that are the name's too score as the name's, so a symbol has each token once.
    none = F.array().cast("array<string>")
    own = F.coalesce(lookup_tokens(name), none)
    told = symbols.select("path", line.cast("int").alias("line"), name.alias("title"), snippet(sig).alias("context"), F.lower(F.trim(name)).alias("raw"), own.alias("own"), F.array_except(F.coalesce(lookup_tokens(sig), none), own).alias("more"))
    tokens = F.concat(F.transform("own", lambda x: F.struct(x.alias("token"), F.lit(2).alias("source"))), F.transform("more", lambda x: F.struct(x.alias("token"), F.lit(3).alias("source"))))
    told = told.select("path", "line", "title", "context", "raw", F.inline(tokens))
    score = F.when(F.col("source") == 3, 0.74).when(F.col("token") == F.col("raw"), 1.0).otherwise(0.88)
    out = out.unionByName(told.select("token", F.lit("symbol").alias("kind"), "path", "line", "title", "context", score.alias("score"), "source"))
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    out = out.unionByName(hits(lines, 4, F.col("text"), "content", path, F.col("line"), 0.58, 0.58, F.col("text")))
    if identifiers is not None:
        out = out.unionByName(hits(identifiers, 5, name, "symbol", name, line, 0.96, 0.76, sig))
    first = out.groupBy("token", "kind", "path", "line", "title").agg(F.min(F.struct("source", "score", "context")).alias("first"))
    return first.select("token", "kind", "path", "line", "title", "first.score", "first.context")


#: Kinds that word hits on symbols count as.
WORD_KINDS = ("symbol", "function", "class", "method", "variable")


def lookup_word(hits: DataFrame, query_tokens: list[str], k: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """Best score of each hit over the query's tokens; ties by path, line, kind, title. With kinds, after the cut
    to k, hits on symbols stay only if a kind is one of WORD_KINDS; other hits always do."""
    found = hits.where(F.col("token").isin(query_tokens)).groupBy("kind", "path", "line", "title").agg(F.max("score").alias("score"))
    found = found.orderBy(F.desc("score"), "path", "line", "kind", "title").limit(k)
    return found if not kinds or {x.lower() for x in kinds} & {*WORD_KINDS} else found.where(F.col("kind") != "symbol")


def path_content(files: DataFrame, query: str) -> DataFrame:
    """(path, content) of the first path that the lookup finds."""
    first = lookup_path(files, query, 1)  # one row at most
    return files.select("path", "content").join(F.broadcast(first), "path")


def outline(symbols: DataFrame, path: str) -> DataFrame:
    """Symbols of one file in order; the path must match exactly."""
    return symbols.where(F.col("path") == path).orderBy("line", "name")


def dependency_info(edges: DataFrame, target: str) -> DataFrame:
    """edges: path, dep. One row: path, direct (sorted), reverse (sorted)."""
    near = edges.where((F.col("path") == target) | (F.col("dep") == target))
    lists = near.agg(
        F.array_sort(F.collect_set(F.when(F.col("path") == target, F.col("dep")))).alias("direct"),
        F.array_sort(F.collect_set(F.when(F.col("dep") == target, F.col("path")))).alias("reverse"),
    )
    return lists.select(F.lit(target).alias("path"), "direct", "reverse")
