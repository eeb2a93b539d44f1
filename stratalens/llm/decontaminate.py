"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

Numbers, units and names become typed slots, so a re-parameterised question keeps its template.
Windows of words, and of template words, are hash-joined with those of the benchmark; then the slots that hits on
one alignment fill must be consistent: equal values stay equal and different ones different. Where they
are not, windows with the item's own values count, and each stretch that is consistent by itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window; shorter items are one window each, by their template if they have at least LEAST words.
WINDOW, LEAST = 8, 5
#: A template window needs so many words that are not slots.
LITERALS = 4
#: Share of an item's windows that a document must hold, or the run of its words.
COVERAGE, RUN = 0.5, 13
#: The benchmark side is broadcast up to this many windows, else joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: Documents' windows are chosen by anchor words up to so many of these.
ANCHORS = 50_000
#: Unit words, in natural order.
UNITS = "cm mm km kg mg ml lb lbs oz ft mph kmh kph mi hz khz mhz ghz kb mb gb tb percent dollars euros pounds cents meters metres miles inches feet hours minutes seconds days weeks months years grams kilograms liters litres degrees"
#: Values of an item's slots (a) and of a document's (b).
PAIRS = "array<struct<a:string,b:string>>"
#: Slot marks, from the private use area: name, number, unit.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"


def canonical(text: Column) -> Column:
    """The words of a text, lower-cased, parted by single spaces, signs dropped; a slot is its mark followed
    by its value. A name is a capitalised word inside a sentence; a unit is a unit word after a number.

    Each pattern begins with the character that is rarest in it, so it looks around at few places.
    """
    steps = (
        (r"[.,](?<=\p{N}[.,])(?=\p{N})", ""),
        (r" (?<=[\p{Ll}\p{N},;] )(\p{Lu}\p{Ll}+)", f" {NAME}$1"),
        (r"(\p{N})(?<!\p{L}\p{N})(\p{N}*)", f" {NUMBER}$1$2 "),
        (rf"({NUMBER}\p{{N}}+ {{1,3}})({UNITS.replace(' ', '|')}|%)(?!\p{{L}})", f"$1{UNIT}$2"),
    )
    t = reduce(lambda t, s: F.regexp_replace(t, *s), steps, F.coalesce(text.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{N}}%{NAME}{NUMBER}{UNIT}]+", " "))


def _slot(w: Column) -> Column:
    return F.substring(w, 1, 1).between(NAME, UNIT)


def _tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, words, form, marked): canonical text, its words without marks, its template's words, and the words with
    marks, at the same places. The arrays come out of a generator, so each is made once a text and not in each window."""
    t = df.select(F.col(id_col).cast("long").alias("id"), canonical(F.col(text_col)).alias("t")).where("t <> ''")
    form = F.split(F.regexp_replace("t", rf"([{NAME}{NUMBER}{UNIT}])[^ ]*", "$1"), " ")
    words = F.split(F.regexp_replace("t", rf"[{NAME}{NUMBER}{UNIT}]", ""), " ")
    return t.select("id", "t", F.inline(F.array(F.struct(words.alias("words"), form.alias("form"), F.split("t", " ").alias("marked")))))


def _window(i: Column, size: int) -> Column:
    """(pos, hash, slots) of the template window that starts at place i (from 0); slots are its values, joined by a space."""
    form = F.slice("form", i + 1, size)
    return F.struct(i.alias("pos"), F.xxhash64(form).alias("h"), _values(i, size).alias("slots"))


def _values(i: Column, size: int | Column) -> Column:
    return F.array_join(F.filter(F.slice("marked", i + 1, size), _slot), " ")


def _starts(words: str, size: int, anchors: list[str] | None) -> Column:
    """Places where a window starts in a column of words: all of them, or those of windows that hold an anchor word."""
    last = F.size(words) - size
    none = F.array().cast("array<int>")
    if anchors is None:
        return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(none)
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(anchors))
    near = F.transform(at, lambda i: F.sequence(F.greatest(i - (size - 1), F.lit(0)), F.greatest(F.least(i, last), F.greatest(i - (size - 1), F.lit(0)))))
    return F.when(last >= 0, F.filter(F.array_distinct(F.flatten(near)), lambda i: i <= last)).otherwise(none)


def _plain(size: int) -> Callable:
    return lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("words", i + 1, size)).alias("h"))


def _template(size: int) -> Callable:
    return lambda i: _window(i, size)


def _anchor(words: str) -> Column:
    """The longest of an array of words."""
    return F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).w


def _anchors(windows: DataFrame) -> dict[int, list[str] | None]:
    """By size of the windows, their anchor words; None where there are more than ANCHORS in all."""
    rows = windows.select("size", "anchor").distinct().limit(ANCHORS + 1).collect()
    if len(rows) > ANCHORS:
        return {r[0]: None for r in windows.select("size").distinct().collect()}  # at most WINDOW
    return {n: sorted(w for k, w in rows if k == n) for n in sorted({k for k, _ in rows})}


def _found(tokens: DataFrame, words: str, anchors: dict[int, list[str] | None], window: Callable) -> DataFrame:
    """The windows of documents, of all sizes in one reading."""
    parts = [F.transform(_starts(words, n, at), window(n)) for n, at in anchors.items()]
    return tokens.select(F.col("id").alias("doc_id"), F.inline(F.concat(*parts)))


def _longest(at: Column) -> Column:
    """Length of the longest stretch of consecutive numbers in a sorted array of different ones."""
    step = lambda s, i: F.struct(i.alias("to"), F.when(i == s.to + 1, s.n + 1).otherwise(1).alias("n"), F.greatest(s.best, F.when(i == s.to + 1, s.n + 1).otherwise(1)).alias("best"))
    return F.aggregate(at, F.struct(F.lit(-2).alias("to"), F.lit(0).alias("n"), F.lit(0).alias("best")), step, lambda s: s.best)


def _clash(p: Column, q: Column) -> Column:
    """Whether two arrays of (a, b) give equal values different ones, or different values equal ones."""
    return F.exists(p, lambda x: F.exists(q, lambda y: (x.a == y.a) != (x.b == y.b)))


def _pairs(ws: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(ws, lambda w: w.pairs)))


def _consistent(ws: Column) -> Column:
    """Sets of windows whose slots map one to one, of an alignment's windows sorted by place: all of them, where
    that holds; else the literal ones, and each longest stretch that holds, with the literal ones that fit it."""
    none = F.filter(ws, lambda w: F.lit(False))

    def step(s: Column, w: Column) -> Column:
        last = F.array_max(F.transform(F.filter(s.now, lambda x: _clash(x.pairs, w.pairs)), lambda x: x.ipos))
        kept = F.filter(s.now, lambda x: last.isNull() | (x.ipos > last))
        return F.struct(F.concat(kept, F.array(w)).alias("now"), F.when(last.isNull(), s.done).otherwise(F.concat(s.done, F.array(s.now))).alias("done"))

    stretches = F.aggregate(ws, F.struct(none.alias("now"), F.slice(F.array(none), 1, 0).alias("done")), step, lambda s: F.concat(s.done, F.array(s.now)))
    literal = F.filter(ws, lambda w: ~F.exists(w.pairs, lambda p: p.a != p.b))
    more = F.transform(stretches, lambda s: F.array_union(s, F.filter(literal, lambda w: ~_clash(w.pairs, _pairs(s)))))
    every = _pairs(ws)
    return F.when(~_clash(every, every), F.array(ws)).otherwise(F.concat(F.array(literal), more))


def _evidence(ws: Column, n_words: Column, parted: Column) -> Column:
    """(n, hs, run, n_slots, changed) of a consistent set. Where an alignment is parted into several, the slots that
    changed are no evidence among the words of the run."""
    hs = F.array_distinct(F.transform(ws, lambda w: F.struct(w.h.alias("h"), w.usable.alias("usable"))))
    changed = F.size(F.filter(_pairs(ws), lambda p: p.a != p.b))
    run = F.least(_longest(F.array_sort(F.array_distinct(F.transform(ws, lambda w: w.ipos)))) + WINDOW - 1, n_words)
    run = F.when(F.size(ws) == 0, 0).otherwise(F.when(parted, run - changed).otherwise(run))
    return F.struct(F.size(hs).alias("n"), hs.alias("hs"), run.alias("run"), F.size(_pairs(ws)).alias("n_slots"), changed.alias("changed"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, n_windows (of the item, different),
    item_windows, coverage, run (longest stretch of the item's words, by matched windows in one
    alignment), n_slots, changed (slots with other values).

    Windows of the words themselves, lower-cased, find verbatim copies of every item, whatever its length
    and its share of slots; windows of the template find copies with other values in the slots, for items of
    LEAST words or more and windows with LITERALS words outside slots. coverage is the greater share, of all
    windows or of those that templates may match. Null texts and texts without any word, letter or number, on
    either side, match nothing. Repeated rows of a document count once.

    A document's windows are made where a word stands that is the longest of some benchmark window:
    every match holds such a word. With more than ANCHORS of these, all windows are made.
    """
    items = _tokens(benchmark, item_col, text_col).dropDuplicates(["id", "t"]).withColumn("n_words", F.size("words"))
    items = items.withColumn("size", F.least(F.col("n_words"), F.lit(WINDOW)))
    items = items.withColumn("ipos", F.explode(F.sequence(F.lit(0), F.col("n_words") - F.col("size"))))
    part = lambda c: F.slice(c, F.col("ipos") + 1, F.col("size"))
    items = items.select(F.col("id").alias("item_id"), "size", "ipos", "n_words", part("words").alias("words"), part("form").alias("form"), _values(F.col("ipos"), F.col("size")).alias("item_slots"))
    items = items.withColumn("literals", F.filter("form", lambda w: ~_slot(w))).withColumn("usable", (F.col("size") >= LEAST) & (F.size("literals") >= LITERALS)).withColumn("w", F.xxhash64("words"))
    given = ["item_id", "size", "ipos", "n_words", "w", "usable", "item_slots"]
    plain = items.select(*given, F.col("w").alias("h"), _anchor("words").alias("anchor"))
    template = items.where(F.col("usable") & (F.col("item_slots") != "")).select(*given, F.xxhash64("form").alias("h"), _anchor("literals").alias("anchor"))
    totals = items.groupBy("item_id").agg(F.countDistinct("w").alias("all_windows"), F.countDistinct(F.when(F.col("usable"), F.col("w"))).alias("usable_windows"))
    near = F.broadcast if items.count() <= BROADCAST_WINDOWS else (lambda df: df)

    tokens = _tokens(docs, doc_col, text_col)
    found = _found(tokens, "words", _anchors(plain) or {WINDOW: []}, _plain)
    shift = F.when(F.col("n_words") <= WINDOW, 0).otherwise(F.col("pos") - F.col("ipos"))  # a single window: its place says nothing
    hits = found.join(near(plain.drop("size", "anchor")), "h").withColumns({"slots": F.col("item_slots"), "shift": shift})
    if anchors := _anchors(template):
        got = _found(tokens, "form", anchors, _template).where("slots <> ''").join(near(template.drop("size", "anchor")), "h")
        hits = hits.unionByName(got.where("slots <> item_slots").withColumn("shift", F.col("pos") - F.col("ipos")))

    pairs = F.when(F.col("slots") == "", F.array().cast(PAIRS)).otherwise(F.array_distinct(F.zip_with(F.split("item_slots", " "), F.split("slots", " "), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    window = F.struct("ipos", F.col("w").alias("h"), "usable", pairs.alias("pairs"))
    aligned = hits.groupBy("doc_id", "item_id", "shift").agg(F.array_sort(F.collect_set(window)).alias("ws"), F.first("n_words").alias("n_words"))  # bounded by one item's words
    judged = aligned.withColumn("sets", _consistent(F.filter("ws", lambda w: ~_clash(w.pairs, w.pairs))))
    sets = F.transform("sets", lambda s: _evidence(s, F.col("n_words"), F.size("sets") > 1))
    held = (
        judged.select("doc_id", "item_id", sets.alias("sets"))
        .select("doc_id", "item_id", F.array_max("sets").alias("best"), F.array_max(F.transform("sets", lambda s: s.run)).alias("run"))
        .groupBy("doc_id", "item_id")
        .agg(F.array_distinct(F.flatten(F.collect_set("best.hs"))).alias("hs"), F.max("run").alias("run"), F.max("best.n_slots").alias("n_slots"), F.max("best.changed").alias("changed"))
        .join(near(totals), "item_id")
    )
    different = lambda hs: F.size(F.array_distinct(F.transform(hs, lambda h: h.h)))
    share = lambda hs, n: F.when(F.col(n) > 0, F.struct(F.round(different(hs) / F.col(n), 4).alias("coverage"), different(hs).alias("n_windows"), F.col(n).alias("item_windows")))
    held = held.withColumn("share", F.greatest(share("hs", "all_windows"), share(F.filter("hs", lambda h: h.usable), "usable_windows")))
    return held.select("doc_id", "item_id", "share.n_windows", "share.item_windows", "share.coverage", "run", "n_slots", "changed").where((F.col("coverage") >= COVERAGE) | (F.col("run") >= RUN))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, that hold no item of the benchmark. Each row is judged by its own text,
    whatever other rows share its doc_id, and with a null one too."""
    key = F.xxhash64("text")
    found = contamination(docs.select(key.alias("__key"), "text"), benchmark, "__key").select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(found, "__key", "left_anti").select(docs.columns)
