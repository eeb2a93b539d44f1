"""Term frequencies, postings and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MAX_TERM, MAX_TERMS, common_terms


def term_frequencies(docs: DataFrame, id_col: str, text: Column, most: int = MAX_TERMS) -> DataFrame:
    """(id, term, frequency): at most `most` terms of each document, by frequency, then term.

    Terms over 64 characters and terms without a letter or underscore do not count. Texts are dealt once by id, before they are
    split: they are shorter than their terms, and a document's terms are then counted and ranked where they are.
    """
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).repartition("id")
    terms = texts.select("id", F.explode(common_terms(F.col("text"))).alias("term"))
    terms = terms.where((F.length("term") <= MAX_TERM) & F.col("term").rlike("[a-z_]"))
    counts = terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("frequency"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("frequency"), "term"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def postings_summary(postings: DataFrame) -> DataFrame:
    """(term, documents, occurrences, best_id): best_id heads the posting list (frequency, then id)."""
    best = F.max_by("id", F.struct("frequency", -F.col("id")))
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("frequency").alias("occurrences"), best.alias("best_id"))


def unique_terms(postings: DataFrame) -> DataFrame:
    return postings.agg(F.countDistinct("term").alias("unique_terms"), F.countDistinct("id").alias("documents"), F.count(F.lit(1)).alias("postings"))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, content), lines from 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "content"))
    return rows.select("id", (F.col("pos") + 1).alias("line"), "content")


def slice_lines(text: Column, first: Column, last: Column, most: int = 6000) -> Column:
    """Lines first to last (from 1, both included) of a text, cut and trimmed."""
    return F.trim(F.substring(F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n"), 1, most))


def chunks(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files: path, header, content. symbols: path, name, kind, line, end_line, signature, parent_name.

    A chunk for each symbol with content; a fallback chunk for each file without any, if it has content.
    """
    spans = symbols.join(files.select("path", "header", "content"), "path")
    named = spans.select(
        F.concat_ws(":", "path", "line", "end_line", "name", "signature").alias("id"),
        "path", "header", F.lit("symbol").alias("chunk_type"), "name", "kind", "signature",
        F.array_compact(F.array("parent_name", "name")).alias("symbol_path"), "line", "end_line",
        slice_lines(F.col("content"), F.col("line"), F.col("end_line")).alias("content"),
    ).where("content <> ''").dropDuplicates(["id"])
    n = F.size(F.split("content", "\n"))
    rest = files.join(named.select("path").distinct(), "path", "left_anti")
    whole = rest.select(
        F.concat_ws(":", "path", F.lit(1), n, F.lit("file"), F.lit("")).alias("id"),
        "path", "header", F.lit("file-fallback").alias("chunk_type"), F.lit(None).cast("string").alias("name"), F.lit("file").alias("kind"),
        F.lit(None).cast("string").alias("signature"), F.array().cast("array<string>").alias("symbol_path"), F.lit(1).alias("line"), n.alias("end_line"),
        slice_lines(F.col("content"), F.lit(1), n).alias("content"),
    ).where("content <> ''")
    return named.unionByName(whole)


def chunk_text() -> Column:
    """Lexical text of a chunk; a fallback chunk leaves its content out."""
    full = F.concat_ws(" ", "path", "header", "name", "kind", "signature", F.array_join("symbol_path", " "), "content")
    return F.trim(F.when(F.col("chunk_type") == "file-fallback", F.concat_ws(" ", "path", "header", "kind", "signature")).otherwise(full))


def identifier_text() -> Column:
    return F.trim(F.concat_ws(" ", "path", "header", "name", "kind", "signature", "parent_name", "text"))
