"""Line dedup by a segment-partition edit join, with DataFrame operations only.

Of two lines within max_edits edits, some segment of the shorter one stands unchanged in the longer
one, with as many edits before it as segments at most. Segments are cut by a length rounded down, so
that lines of almost any two near lengths share a partition: the first segments are counted from
the line's start, the last ones from its end, which leaves no move to try for the outermost. So a
line is indexed under max_edits + 1 keys, and probes the moves of its inner segments, and those of
the next lower partition where a line that much shorter would lie in it. Keys are hashes of rounded length,
segment number and text. Candidates are verified on the texts by edit distance with a threshold (a
banded computation).

Keys are aggregated before they are shuffled: the least and greatest line of a key tell whether it
has several, so a line that stands a million times costs a row a task. Pairs are counted where they are
found and never written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

MAX_EDITS = 2
MIN_CHARS = 20
#: Keys that several lines share, and places of candidates, are broadcast up to so many (24 bytes each at most).
BROADCAST_ROWS = 1_000_000
#: Lines of one key that one task compares with the others of the key.
SPLIT = 512


def _rounded(n: Column, edits: int, min_chars: int) -> Column:
    """n rounded down to a power of two between a sixteenth and a quarter of it, which is over `edits`; at least min_chars."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(n)) - 3, F.lit(max(2, edits.bit_length())))).cast("int")
    return F.greatest(n - n % step, F.lit(min_chars))


def _keys(edits: int, min_chars: int) -> Column:
    """Keys of a line, null for one under min_chars: first its own segments', max_edits + 1 of them, then probes.
    Columns line, n (its length), own and lower (n and n - edits, rounded)."""
    line, n, own, lower = map(F.col, ("line", "n", "own", "lower"))
    key = lambda m, k, at, size: F.xxhash64(m, F.lit(k), F.substring(line, at + 1, size))

    def pieces(m: Column, k: int, moves: range) -> list[Column]:
        size = ((m - m % (edits + 1)) / (edits + 1)).cast("int")
        from_start = 2 * k <= edits
        places = [(size * k if from_start else n - size * (edits - k + 1)) + (d if from_start else -d) for d in moves]
        return [F.when((at >= 0) & (at + size <= n), key(m, k, at, size)) for at in places]

    def moves(k: int) -> range:
        before, after = (k, edits - k) if 2 * k <= edits else (edits - k, k)
        return range(-min(before, after), before + 1)

    index = [p for k in range(edits + 1) for p in pieces(own, k, range(1))]
    moved = [p for k in range(edits + 1) for d in moves(k) if d for p in pieces(own, k, range(d, d + 1))]
    below = [p for k in range(edits + 1) for p in pieces(lower, k, moves(k))]
    many = F.when((lower < own) & (lower >= min_chars), F.array_compact(F.array(*index, *moved, *below))).otherwise(F.array_compact(F.array(*index, *moved)))
    return F.when(n >= min_chars, many)


def _measured(parts: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(doc_id, line_no, line, n, own, lower) of lines that are not blank. Each value is computed once: they come out of one generator."""
    lines = F.transform("parts", lambda x, i: F.struct(i.alias("line_no"), F.trim(x).alias("line")))
    lines = F.transform(F.filter(lines, lambda s: s.line != ""), lambda s: F.struct(s.line_no.alias("line_no"), s.line.alias("line"), F.length(s.line).alias("n")))
    rounded = lambda n: _rounded(n, edits, min_chars)
    lines = F.transform(lines, lambda s: F.struct(s.line_no.alias("line_no"), s.line.alias("line"), s.n.alias("n"), rounded(s.n).alias("own"), rounded(F.greatest(s.n - edits, F.lit(1))).alias("lower")))
    return parts.select("doc_id", F.inline(lines))


def _lines(docs: DataFrame, name: Column, text_col: str) -> DataFrame:
    """(doc_id, parts): the lines of each text as they are; name is any value that orders documents."""
    return docs.select(name.alias("doc_id"), F.split(F.col(text_col).cast("string"), "\n").alias("parts"))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def similar_lines(lines: DataFrame, parts: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """lines: h1, h2 (which name a line), at (struct of doc_id, line_no), keys; all occurrences. parts: doc_id, parts.
    Each line that links to another: h1, h2, first (its earliest place), near_first (the earliest of those it links
    to), n_links.

    Only hashes are shuffled to find candidates; texts are fetched for candidates alone. A pair is verified at one key, the
    least that leads to it, and is added up at its two lines where it is found: no pair is shuffled or
    written. Lines of a key over SPLIT meet in several tasks.
    """
    spark = lines.sparkSession
    rows = lines.where("keys is not null").select("h1", "h2", "at", F.posexplode("keys").alias("k", "key"))
    # Keys that different lines share, and that one of them has as its own segment's.
    shared = rows.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.min("k").alias("k")).where(f"x <> y and k <= {max_edits}").select("key")
    shared = _small(materialise(shared, "shared-keys"))
    active = rows.join(shared, "key", "left_semi").groupBy("key", "h1", "h2", (F.col("k") <= max_edits).alias("own")).agg(F.min("at").alias("first"))
    active = materialise(active, "line-keys")
    # first is the earliest place of a line in every row: all its occurrences have the same keys. ord numbers the lines in that order.
    keyed = active.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.collect_set(F.when(F.col("own"), F.col("key"))).alias("owns"), F.collect_set("key").alias("all"))  # a line has a dozen keys
    ordered = keyed.repartitionByRange(shuffle_partitions(spark), "first").sortWithinPartitions("first").withColumn("ord", F.monotonically_increasing_id())
    ordered = materialise(ordered, "line-places")
    places = _small(ordered.select("h1", "h2", "ord", F.col("first.doc_id").alias("id"), F.col("first.line_no").alias("line_no")))
    found = parts.join(places, parts["doc_id"].eqNullSafe(places["id"])).select("h1", "h2", F.trim(F.get("parts", "line_no")).alias("line"))
    texts = found.where((F.xxhash64("line") == F.col("h1")) & (F.hash("line", F.length("line")) == F.col("h2"))).groupBy("h1", "h2").agg(F.any_value("line").alias("line"))
    crowds = active.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT).select("key", F.ceil(F.col("n") / SPLIT).cast("int").alias("lots"))
    told = active.select("key", "h1", "h2", "own").join(materialise(texts, "line-texts").join(ordered.select("h1", "h2", "ord", "owns", "all"), ["h1", "h2"]), ["h1", "h2"])
    told = told.join(_small(materialise(crowds, "line-crowds")), "key", "left").withColumn("lots", F.coalesce("lots", F.lit(1))).drop("h1", "h2")
    dealt = told.where("own").withColumn("lot", F.pmod(F.col("ord"), F.col("lots")).cast("int"))
    met = told.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    left, right = (side.select(*(F.col(c).alias(f"{x}_{c}") for c in ("key", "lot", "own", "ord", "line", "owns", "all"))) for x, side in (("a", dealt), ("b", met)))
    once = F.when(F.col("b_own"), F.col("a_ord") < F.col("b_ord")).otherwise((F.col("a_ord") != F.col("b_ord")) & ~F.array_contains("b_owns", F.col("b_key")))
    least = F.array_min(F.array_union(F.array_intersect("a_owns", "b_all"), F.array_intersect("b_owns", "a_all"))) == F.col("a_key")
    linked = (F.col("a_key") == F.col("b_key")) & (F.col("a_lot") == F.col("b_lot")) & once & least & (F.levenshtein("a_line", "b_line", max_edits) >= 0)
    both = F.array(F.struct(F.col("a_ord").alias("ord"), F.col("b_ord").alias("other")), F.struct(F.col("b_ord").alias("ord"), F.col("a_ord").alias("other")))
    ends = left.join(right, linked).select(F.inline(both)).groupBy("ord").agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("n_links"))
    ends = materialise(ends, "line-links")
    whole = ordered.select("h1", "h2", "first", "ord").join(ends, "ord")
    return whole.join(ordered.select(F.col("ord").alias("other"), F.col("first").alias("near_first")), "other").select("h1", "h2", "first", "near_first", "n_links")


def repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line that repeats an earlier one: doc_id, line_no, first_doc_id, first_line_no,
    exact, n_links.

    Lines are the parts between line breaks, without surrounding spaces; blank ones never repeat, and those under
    min_chars characters (at least max_edits + 1) are compared exactly only. They are ordered by (doc_id,
    line_no). first_* is the earliest of the line's own first occurrence and those of the lines it links
    to; exact says that this very line stood earlier; n_links counts the different lines within max_edits
    edits. Null texts have no lines. Repeated rows of a doc_id are one document; an empty table gives no rows.
    """
    found = _repeats(_lines(docs, F.col(id_col).cast("long"), text_col), max_edits, min_chars)
    return found.select("at.doc_id", "at.line_no", F.col("keeps.doc_id").alias("first_doc_id"), F.col("keeps.line_no").alias("first_line_no"), "exact", "n_links")


def _repeats(parts: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """(at, keeps, exact, n_links): a line that repeats an earlier one, and the place of that one."""
    if min_chars <= max_edits:
        raise ValueError("min_chars must be over max_edits: each segment needs a character")
    every = _measured(parts, max_edits, min_chars).select(F.xxhash64("line").alias("h1"), F.hash("line", "n").alias("h2"), F.struct("doc_id", "line_no").alias("at"), _keys(max_edits, min_chars).alias("keys"))
    lines = materialise(every, "lines")
    firsts = lines.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = materialise(lines.select("h1", "h2", "at").join(firsts, ["h1", "h2"]).where("at > first"), "later-lines")
    linked = materialise(similar_lines(lines, parts, max_edits), "linked-lines")

    again = later.join(linked.select("h1", "h2", "near_first", "n_links"), ["h1", "h2"], "left")
    again = again.select("at", F.least("first", "near_first").alias("keeps"), F.lit(True).alias("exact"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    near = linked.where("near_first < first").select(F.col("first").alias("at"), F.col("near_first").alias("keeps"), F.lit(False).alias("exact"), "n_links")
    return again.unionByName(near).distinct()


def drop_repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows of docs, with its columns; repeated lines are cut out of text and n_chars follows.

    A row is named by its doc_id and its text, and ordered so (a null doc_id first), so rows with one doc_id, or
    with none, and other texts are documents of their own: of a line in both the first row keeps it. Rows with the same
    doc_id and text are one document and stay alike.
    """
    name = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    gone = _repeats(_lines(docs, name, "text"), max_edits, min_chars).groupBy("at.doc_id").agg(F.collect_set("at.line_no").alias("__gone"))  # bounded by the document's lines
    gone = gone.select(F.col("doc_id.id").alias("__id"), F.col("doc_id.h").alias("__h"), "__gone")
    parts = F.split(F.col("text"), "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(parts, i)), "\n"))
    out = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h")), "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
