"""Ranked retrieval: lexical candidates, vectors, hybrid search, the file lane and call sites."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, vectors
from ..functions.text import CAMEL, camel_terms, query_terms


def settled(score: Column) -> Column:
    """A score to 10 places, so that the order of additions decides no rank."""
    return F.round(score, 10)


def _terms(postings: DataFrame, query: str) -> DataFrame:
    return postings.where(F.col("term").isin(query_terms(query)))  # a pushed-down filter in place of a join with one query's terms


def lexical_candidates(postings: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """postings: id, term, frequency. docs: id, lexical_text, ...; each document that shares a term, with
    lexical_score and matched_terms. A posting without its document fails the query."""
    n = max(1, len(query_terms(query)))
    boost = F.least(F.lit(0.12), F.col("frequency") * 0.04)
    hits = _terms(postings, query).groupBy("id").agg(F.sum(boost).alias("boost"), F.array_sort(F.collect_set("term")).alias("matched_terms"))  # bounded by the query's terms
    known = docs.withColumn("_known", F.lit(True))
    joined = hits.join(known, "id", "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("posting without document: "), F.col("id").cast("string"))).cast("double"))
    phrase = F.when(scores.contains_phrase(F.col("lexical_text"), query), 0.18).otherwise(0.0)
    score = checked.otherwise(settled(vectors.clamp01(F.size("matched_terms") / n * 0.72 + F.col("boost") + phrase)))
    return joined.withColumn("lexical_score", score).drop("_known", "boost")


def vector_topk(items: DataFrame, query: list[float], k: int, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """The k rows of the greatest cosine with one query vector; ties by id."""
    scored = items.withColumn("score", settled(vectors.cosine(F.col(vector_col), vectors.array_of(query))))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def hybrid_search(postings: DataFrame, docs: DataFrame, query: str, query_vector: list[float] | None, k: int = 5, semantic_weight: float = 0.68, lexical_weight: float = 0.32, dense_candidates: bool = False) -> DataFrame:
    """docs: id, path, lexical_text, vector. Lexical candidates, the best max(12k, 64) of them by lexical
    score and path, then the best k by score, lexical and semantic score; ties by id.

    Weight 0 for one side gives keyword or semantic mode; in any mode candidates share a term with the
    query, unless dense_candidates asks for all documents. A candidate without a vector fails the query,
    but in keyword mode.
    """
    found = lexical_candidates(postings, docs, query)
    if dense_candidates:
        rest = docs.join(found.select("id"), "id", "left_anti").withColumns({"lexical_score": F.lit(0.0), "matched_terms": F.array().cast("array<string>")})
        found = found.unionByName(rest)
    return fuse_candidates(found, query_vector, k, semantic_weight, lexical_weight, None if dense_candidates else width(k))


def width(k: int) -> int:
    """How many lexical candidates are ranked again for k results."""
    return max(12 * k, 64)


def fuse_candidates(found: DataFrame, query_vector: list[float] | None, k: int = 5, semantic_weight: float = 0.68, lexical_weight: float = 0.32, most: int | None = None) -> DataFrame:
    """found: lexical candidates. hybrid_search's second half: the best `most` of them by lexical score, ranked by both."""
    keyword_only = semantic_weight <= 0 or query_vector is None
    if most is not None:
        found = found.orderBy(F.desc("lexical_score"), "path", "id").limit(most)
    if keyword_only:
        semantic: Column = F.lit(0.0)
    else:
        missing = F.raise_error(F.concat(F.lit("no vector for "), F.col("id").cast("string"))).cast("double")
        semantic = F.when(F.col("vector").isNull(), missing).otherwise(F.greatest(settled(vectors.cosine(F.col("vector"), vectors.array_of(query_vector))), F.lit(0.0)))
    found = found.withColumn("semantic_score", semantic)
    w = 0.0 if keyword_only else semantic_weight
    found = found.withColumn("score", settled(scores.combined_score(F.col("semantic_score"), F.col("lexical_score"), w, lexical_weight)))
    return found.orderBy(F.desc("score"), F.desc("lexical_score"), F.desc("semantic_score"), "id").limit(k)


def search_counts(postings: DataFrame, query: str, k: int = 5) -> DataFrame:
    """One row of what hybrid_search meets: lexical_candidates, how many of them are ranked again, and results."""
    n = F.count_distinct("id")
    return _terms(postings, query).agg(n.alias("lexical_candidates"), F.least(n, F.lit(width(k))).alias("reranked"), F.least(n, F.lit(k)).alias("results"))


def vector_coverage(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """One row: requested, loaded, missing, ratio (1 when nothing was asked for). Both: column id."""
    found = wanted.select("id").distinct().join(present.select("id").distinct().withColumn("has", F.lit(1)), "id", "left")
    n, has = F.count(F.lit(1)), F.count("has")
    return found.agg(n.alias("requested"), has.alias("loaded"), (n - has).alias("missing"), F.coalesce(F.try_divide(has, n), F.lit(1.0)).alias("ratio"))


def file_search(files: DataFrame, query: str, query_vector: list[float], k: int = 5, semantic_weight: float = 0.72, keyword_weight: float = 0.28, min_semantic: float | None = None, min_keyword: float | None = None, min_combined: float | None = None, require_keyword: bool = False, require_semantic: bool = False, tie: str = "path") -> DataFrame:
    """files: path, header, symbols, content, vector. Every file by combined score, over the thresholds; ties by path, then `tie`."""
    semantic = settled(vectors.cosine(F.col("vector"), vectors.array_of(query_vector)))
    keyword = settled(scores.keyword_score(F.col("path"), F.col("header"), F.col("symbols"), F.col("content"), query))
    # Generated, so that thresholds and the order read the two scores and do not make them again.
    ranked = files.select("*", F.inline(F.array(F.struct(semantic.alias("semantic_score"), keyword.alias("keyword_score")))))
    ranked = ranked.withColumn("score", settled(scores.combined_score(F.col("semantic_score"), F.col("keyword_score"), semantic_weight, keyword_weight)))
    ranked = ranked.where(F.greatest("semantic_score", F.lit(0.0)) >= scores.fraction(min_semantic, 0.0)).where(F.col("keyword_score") >= scores.fraction(min_keyword, 0.0)).where(F.col("score") >= scores.fraction(min_combined, 0.1))
    if require_keyword:
        ranked = ranked.where("keyword_score > 0")
    if require_semantic:
        ranked = ranked.where("semantic_score > 0")
    return ranked.orderBy(F.desc("score"), F.desc("keyword_score"), F.desc("semantic_score"), "path", tie).limit(k)


def identifier_search(identifiers: DataFrame, query: str, query_vector: list[float], k: int = 5, kinds: list[str] | None = None, semantic_weight: float = 0.78, keyword_weight: float = 0.22) -> DataFrame:
    """identifiers: id, name, kind, text, vector. Brute force, kinds filtered first; keyword score is the
    share of the query's terms among those of the text."""
    terms = query_terms(query, CAMEL)
    rows = identifiers.where(F.lower("kind").isin([x.lower() for x in kinds])) if kinds else identifiers
    q = F.array(*map(F.lit, terms)).cast("array<string>")
    keyword = F.size(F.array_intersect(q, camel_terms(F.col("text")))) / max(1, len(terms))
    semantic = F.greatest(settled(vectors.cosine(F.col("vector"), vectors.array_of(query_vector))), F.lit(0.0))
    rows = rows.withColumns({"semantic_score": semantic, "keyword_score": keyword})
    rows = rows.withColumn("score", settled(scores.combined_score(F.col("semantic_score"), F.col("keyword_score"), semantic_weight, keyword_weight)))
    return rows.orderBy(F.desc("score"), F.desc("keyword_score"), F.desc("semantic_score"), "id").limit(k)


def usage_pattern(name: str, call: bool = False) -> str:
    """A word-bounded pattern of a symbol; of calls: with an opening bracket. Boundaries are ASCII."""
    return rf"(?<![A-Za-z0-9_]){re.escape(name)}" + (r"\s*\(" if call else r"(?![A-Za-z0-9_])")


def definition_pattern(name: str) -> str:
    """Lines that define a symbol rather than use it."""
    n = re.escape(name)
    return rf"(?:function|class|interface|type|enum|struct|trait|def|fn|func|const|let|var|impl)\s+(?:\([^)]*\)\s*)?{n}(?![A-Za-z0-9_])"


def blast_radius(lines: DataFrame, name: str, defined_in: str | None = None, call: bool = False) -> DataFrame:
    """lines: path, line, content. Usages by file: path, usages (matching lines), total, files, low_usage
    (one at most in all). Definition lines are left out only in the file given."""
    used = lines.where(F.col("content").rlike(usage_pattern(name, call)))
    if defined_in is not None:
        used = used.where(~((F.col("path") == defined_in) & F.col("content").rlike(definition_pattern(name))))
    per = used.groupBy("path").agg(F.count(F.lit(1)).alias("usages"), F.min_by(F.trim(F.substring("content", 1, 120)), "line").alias("context"))
    total = per.agg(F.sum("usages").alias("total"), F.count(F.lit(1)).alias("files"))
    return per.join(F.broadcast(total)).withColumn("low_usage", F.col("total") <= 1)  # one row on the broadcast side


def call_sites(symbols: DataFrame, lines: DataFrame, query: str, n: int = 10, query_vector: list[float] | None = None, vector: Column | None = None, semantic_weight: float = 0.82, keyword_weight: float = 0.18) -> DataFrame:
    """symbols: symbol_id, name. lines: path, line, content. The best n using lines of each symbol by the
    share of the query's terms they hold; total counts all before the cut. With a query vector, the best
    max(30, 4n) lines by that share get a vector each (the column given) and are ranked anew by both.

    Names are first matched as whole words through a hash join on the words of each line, then as a
    pattern with word bounds; a name of several words is joined by its first one.
    """
    words = F.array_distinct(F.filter(F.split("content", "[^A-Za-z0-9_]+"), lambda w: w != ""))
    by_word = lines.select("path", "line", "content", F.explode(words).alias("word"))
    named = symbols.select("symbol_id", "name", F.regexp_extract("name", "[A-Za-z0-9_]+", 0).alias("word")).where("word <> ''")
    hit = by_word.join(named, "word").where(F.expr(r"content rlike concat('(?<![A-Za-z0-9_])\\Q', name, '\\E(?![A-Za-z0-9_])')"))
    score = scores.substring_coverage(F.col("content"), query, 1.0, 0.0)
    per = Window.partitionBy("symbol_id")
    ranked = hit.withColumn("keyword_score", score).withColumn("total", F.count(F.lit(1)).over(per))
    rank = F.row_number().over(per.orderBy(F.desc("keyword_score"), "path", "line"))
    wide = n if query_vector is None else max(30, 4 * n)
    ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= wide).drop("word")
    if query_vector is None:
        return ranked
    semantic = F.greatest(settled(vectors.cosine(vector, vectors.array_of(query_vector))), F.lit(0.0))
    ranked = ranked.withColumn("semantic_score", semantic)
    ranked = ranked.withColumn("score", settled(scores.combined_score(F.col("semantic_score"), F.col("keyword_score"), semantic_weight, keyword_weight)))
    rank = F.row_number().over(per.orderBy(F.desc("score"), F.desc("keyword_score"), "path", "line"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= n)
