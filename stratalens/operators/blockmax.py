"""The best lexical candidates from posting blocks, without scoring every match.

Documents are dealt to blocks; a term's postings in a block are one row, with the most that any of them adds to
a score. The blocks whose terms promise most are scored first; what the last wanted document has there is a
bound that every block whose promise is less is skipped by, unread, and every document that cannot reach it is
left out before its text is fetched for the phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, vectors
from ..functions.text import query_terms
from .retrieval import fuse_candidates, settled
from .retrieval import width as width_of

#: What a term, its frequency and the phrase add to a lexical score.
SHARE, STEP, MOST, PHRASE = 0.72, 0.04, 0.12, 0.18
#: First come at most so many blocks, until they promise so many times the documents that are wanted.
FIRST, ENOUGH = 64, 4
#: Blocks, and documents, are pushed to a scan as a list up to so many, else joined.
FETCH = 2000
#: Scores are settled at ten places; bounds give way by more than that.
SLACK = 1e-9


def boost(frequency: Column) -> Column:
    return F.least(F.lit(MOST), frequency * STEP)


def posting_blocks(postings: DataFrame, block: Column) -> DataFrame:
    """postings: id, term, frequency. (term, block, n, most, entries): block is any long that deals documents to blocks of
    bounded size, so a row's entries are bounded by it. Documents of one place should share a block: their terms are
    alike, and more blocks promise little."""
    rows = postings.select("term", block.alias("block"), "id", "frequency")
    return rows.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max(boost(F.col("frequency"))).alias("most"), F.collect_list(F.struct("id", "frequency")).alias("entries"))


def promises(blocks: DataFrame, query: str) -> DataFrame:
    """(block, bound, n): the most a document of the block can score without the phrase, and how many it has at least. Reads no
    entries."""
    terms = query_terms(query)
    rows = blocks.where(F.col("term").isin(terms)).select("block", "n", "most")
    return rows.groupBy("block").agg(F.round(F.sum(F.lit(SHARE / max(1, len(terms))) + F.col("most")), 10).alias("bound"), F.max("n").alias("n"))


def _scored(blocks: DataFrame, query: str) -> DataFrame:
    """(id, matched_terms, boost, base): lexical scores without the phrase, of all documents in these blocks."""
    terms = query_terms(query)
    rows = blocks.where(F.col("term").isin(terms)).select("term", F.inline("entries"))
    hits = rows.groupBy("id").agg(F.sum(boost(F.col("frequency"))).alias("boost"), F.array_sort(F.collect_set("term")).alias("matched_terms"))  # bounded by the query's terms
    return hits.withColumn("base", settled(vectors.clamp01(F.size("matched_terms") / max(1, len(terms)) * SHARE + F.col("boost"))))


def first_blocks(told: DataFrame, width: int) -> list[int]:
    """The blocks that promise most, until they hold enough documents."""
    out, held = [], 0
    for r in told.orderBy(F.desc("bound"), "block").limit(FIRST).collect():
        if held >= ENOUGH * width:
            break
        out.append(r.block)
        held += r.n
    return out


def threshold(blocks: DataFrame, first: list[int], query: str, width: int) -> float:
    """The base score of the last wanted document among those of the first blocks; -1 where these hold too few."""
    best = _scored(blocks.where(F.col("block").isin(first)), query).select("base").orderBy(F.desc("base")).limit(width).collect()
    return best[-1].base if len(best) == width else -1.0


def surviving(told: DataFrame, least: float) -> DataFrame:
    return told.where(F.col("bound") + PHRASE >= least - SLACK)


def _only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    some = [r[0] for r in keys.select(key).distinct().limit(FETCH + 1).collect()]
    return df.where(F.col(key).isin(some)) if len(some) <= FETCH else df.join(keys.select(key), key, "left_semi")


def top_candidates(blocks: DataFrame, docs: DataFrame, query: str, width: int) -> DataFrame:
    """retrieval.lexical_candidates, of those documents only that can be among the first `width` by lexical score,
    whatever parts ties. docs: id, lexical_text, ...; a candidate without its document fails the query."""
    told = promises(blocks, query)
    least = threshold(blocks, first_blocks(told, width), query, width)
    hits = _scored(_only(blocks, surviving(told, least), "block"), query).where(F.col("base") + PHRASE >= least - SLACK)
    known = _only(docs, hits, "id").withColumn("_known", F.lit(True))
    joined = hits.join(known, "id", "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("posting without document: "), F.col("id").cast("string"))).cast("double"))
    phrase = F.when(scores.contains_phrase(F.col("lexical_text"), query), PHRASE).otherwise(0.0)
    n = max(1, len(query_terms(query)))
    score = checked.otherwise(settled(vectors.clamp01(F.size("matched_terms") / n * SHARE + F.col("boost") + phrase)))
    return joined.withColumn("lexical_score", score).drop("_known", "boost", "base")


def block_counts(blocks: DataFrame, query: str, width: int) -> DataFrame:
    """One row: blocks with a term of the query, those scored first, those read in all, and those skipped."""
    told = promises(blocks, query)
    first = first_blocks(told, width)
    least = threshold(blocks, first, query, width)
    read = F.count_if(F.col("bound") + PHRASE >= least - SLACK)
    return told.agg(F.count(F.lit(1)).alias("blocks"), F.lit(len(first)).cast("long").alias("first"), read.alias("read"), (F.count(F.lit(1)) - read).alias("skipped"))


def hybrid_search(blocks: DataFrame, docs: DataFrame, query: str, query_vector: list[float] | None, k: int = 5, semantic_weight: float = 0.68, lexical_weight: float = 0.32) -> DataFrame:
    """retrieval.hybrid_search, the same rows, from posting blocks."""
    return fuse_candidates(top_candidates(blocks, docs, query, width_of(k)), query_vector, k, semantic_weight, lexical_weight, width_of(k))
