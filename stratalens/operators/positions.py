"""Indexes of where words and parts of words stand, so that usages and substrings are looked up, not searched for.

Both are long tables sorted by what they are looked up by (a word, a gram): a filter on it is pushed to the
scan, and Parquet's statistics of row groups and pages skip the rest. A common word is many rows, never one
long list, so no task has to hold its places.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, vectors
from .retrieval import definition_pattern, settled, usage_pattern

#: A place where a word begins or ends.
_EDGE = r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"
#: Candidate files are pushed to the scan of lines as a list up to so many, else joined.
FETCH = 1000
GRAM = 3


def word_positions(lines: DataFrame) -> DataFrame:
    """lines: path, line, content. (word, path, line, pos, called) for each word of each line: pos counts words and what is
    between them, called says that a bracket opens behind it. Words are ASCII letters, digits and underscores."""
    parts = lines.select("path", "line", F.split("content", _EDGE).alias("parts"))
    told = F.transform("parts", lambda x, i: F.struct(x.alias("word"), i.alias("pos"), F.coalesce(F.get("parts", i + 1).rlike(r"^\s*\("), F.lit(False)).alias("called")))
    rows = parts.select("path", "line", F.inline(F.filter(told, lambda s: s.word.rlike("^[A-Za-z0-9_]"))))
    return rows.select("word", "path", "line", "pos", "called")


def _words(name: str) -> list[str]:
    return re.findall(r"[A-Za-z0-9_]+", name)


def _fetched(lines: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of lines (sorted by path) at places (path, line). Few files are read alone; many are joined."""
    paths = [r.path for r in places.select("path").distinct().limit(FETCH + 1).collect()]
    rows = lines.where(F.col("path").isin(paths)) if len(paths) <= FETCH else lines
    return rows.join(places, ["path", "line"], "left_semi")


def usage_lines(positions: DataFrame, lines: DataFrame, name: str, call: bool = False) -> DataFrame:
    """(path, line) of the lines that use a name, as usage_pattern tells. A name that is one word is answered by positions
    alone; another one by the lines that hold its first word, each read and matched. A name without a word is
    searched for in all lines."""
    words = _words(name)
    if not words:
        return lines.where(F.col("content").rlike(usage_pattern(name, call))).select("path", "line")
    hits = positions.where(F.col("word") == words[0])
    if words == [name]:
        return (hits.where("called") if call else hits).select("path", "line").distinct()
    held = hits.select("path", "line").distinct()  # what is between a name's words parts them in a line too
    return _fetched(lines, held).where(F.col("content").rlike(usage_pattern(name, call))).select("path", "line")


def blast_radius(positions: DataFrame, lines: DataFrame, name: str, defined_in: str | None = None, call: bool = False) -> DataFrame:
    """retrieval.blast_radius without its scan of all lines: path, usages, context, total, files, low_usage. Lines are
    read for the defining file and, for the context, one of each file with usages."""
    used = usage_lines(positions, lines, name, call)
    if defined_in is not None:
        own = lines.where((F.col("path") == defined_in) & F.col("content").rlike(definition_pattern(name))).select("path", "line")
        used = used.join(own, ["path", "line"], "left_anti")
    per = used.groupBy("path").agg(F.count(F.lit(1)).alias("usages"), F.min("line").alias("line"))
    total = per.agg(F.sum("usages").alias("total"), F.count(F.lit(1)).alias("files"))
    context = _fetched(lines, per.select("path", "line")).select("path", "line", F.trim(F.substring("content", 1, 120)).alias("context"))
    told = per.join(context, ["path", "line"]).select("path", "usages", "context")
    return told.join(F.broadcast(total)).withColumn("low_usage", F.col("total") <= 1)  # one row on the broadcast side


def call_sites(symbols: DataFrame, positions: DataFrame, lines: DataFrame, query: str, n: int = 10, query_vector: list[float] | None = None, vector: Column | None = None, semantic_weight: float = 0.82, keyword_weight: float = 0.18) -> DataFrame:
    """retrieval.call_sites over positions: the best n using lines of each symbol, total before the cut. Names meet
    positions by their first word; only lines with one are read. A symbol's lines are counted and cut in each task before
    they meet, so a symbol that a third of all lines use is no task's alone."""
    named = symbols.select("symbol_id", "name", F.regexp_extract("name", "[A-Za-z0-9_]+", 0).alias("word")).where("word <> ''")
    words = [r.word for r in named.select("word").distinct().limit(FETCH + 1).collect()]
    hits = positions.where(F.col("word").isin(words)) if len(words) <= FETCH else positions
    places = hits.join(named, "word").select("symbol_id", "name", "path", "line").distinct()
    rows = _fetched(lines, places.select("path", "line")).join(places, ["path", "line"])
    rows = rows.where(F.expr(r"content rlike concat('(?<![A-Za-z0-9_])\\Q', name, '\\E(?![A-Za-z0-9_])')"))
    rows = rows.select("symbol_id", "name", "path", "line", "content", scores.substring_coverage(F.col("content"), query, 1.0, 0.0).alias("keyword_score"))
    totals = rows.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("total"))
    per = Window.partitionBy("symbol_id")
    rank = F.row_number().over(per.orderBy(F.desc("keyword_score"), "path", "line"))
    wide = n if query_vector is None else max(30, 4 * n)
    ranked = rows.withColumn("rank", rank).where(F.col("rank") <= wide)
    if query_vector is not None:
        semantic = F.greatest(settled(vectors.cosine(vector, vectors.array_of(query_vector))), F.lit(0.0))
        ranked = ranked.withColumn("semantic_score", semantic)
        ranked = ranked.withColumn("score", settled(scores.combined_score(F.col("semantic_score"), F.col("keyword_score"), semantic_weight, keyword_weight)))
        rank = F.row_number().over(per.orderBy(F.desc("score"), F.desc("keyword_score"), "path", "line"))
        ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= n)
    return ranked.join(totals, "symbol_id")


def gram_positions(texts: DataFrame, id_col: str = "path", text_col: str = "path", size: int = GRAM) -> DataFrame:
    """(gram, id, pos): the `size` characters that begin at each place of each different text, lower-cased; fewer at its end."""
    rows = texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("t")).where("t <> ''").distinct()
    grams = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.struct(F.substring(F.col("t"), i, F.lit(size)).alias("gram"), (i - 1).alias("pos")))
    return rows.select("id", F.inline(grams)).select("gram", "id", "pos")


def holding(grams: DataFrame, text: str, size: int = GRAM) -> DataFrame:
    """(id) of the texts that hold a string, whatever its case: its grams, side by side and the last one, at places that fit.
    That is exact where an id has one text, so none is read. A string shorter than a gram is the beginning of one. An empty string is
    in every text."""
    q = text.lower()
    if len(q) < size:
        return grams.where(F.startswith("gram", F.lit(q))).select("id").distinct()
    offsets = {q[i : i + size]: [] for i in (*range(0, len(q) - size, size), len(q) - size)}
    for i in (*range(0, len(q) - size, size), len(q) - size):
        offsets[q[i : i + size]].append(i)
    hits = grams.where(F.col("gram").isin([*offsets]))
    if len(offsets) == 1 and len(next(iter(offsets.values()))) == 1:
        return hits.select("id").distinct()
    at = F.lit(None).cast("array<int>")
    for gram, places in offsets.items():
        at = F.when(F.col("gram") == gram, F.array(*map(F.lit, places))).otherwise(at)
    starts = hits.select("id", "pos", F.explode(at).alias("off")).groupBy("id", (F.col("pos") - F.col("off")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return starts.where(F.col("n") >= sum(map(len, offsets.values()))).select("id").distinct()


def lookup_path(paths: DataFrame, grams: DataFrame, query: str, k: int = 10) -> DataFrame:
    """lookup.lookup_path over gram positions of the paths: an exact path alone, else the paths that hold the query. A path's
    lookup tokens are parts of it, so a path with the query as a token holds it."""
    q = query.strip().lower()
    one = paths.where(F.col("path") == q).select("path").distinct()
    hit = F.broadcast(one.limit(1).select(F.lit(True).alias("hit")))  # one row at most
    rest = holding(grams, q).select(F.col("id").alias("path")).join(hit, F.lit(True), "left_anti")
    return one.unionByName(rest).orderBy("path").limit(k)


def find_hub(hubs: DataFrame, grams: DataFrame, name: str) -> DataFrame:
    """ranking.find_hub over gram positions of hubs' base names and titles (id is the hub): only hubs that hold the name
    in one of them are ranked."""
    from .ranking import find_hub as ranked

    held = holding(grams, name.strip())
    return ranked(hubs.join(held.select(F.col("id").alias("hub")), "hub", "left_semi"), name)


def hub_grams(hubs: DataFrame) -> DataFrame:
    """Gram positions of hubs (hub, title): of their whole paths and their titles."""
    both = hubs.select("hub", F.explode(F.array("hub", "title")).alias("text")).where("text is not null")
    return gram_positions(both, "hub", "text")
