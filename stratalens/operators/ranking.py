"""Unified ranking: lanes merged into candidates, structure evidence, fusion and research selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, vectors
from ..functions.text import query_terms
from . import blockmax, retrieval
from .postings import identifier_text

LANE = "id string, entity_type string, path string, title string, kind string, line int, file double, chunk double, identifier double, semantic double, lexical double, matched_terms array<string>, chunk_id string, identifier_id string"


def lane(df: DataFrame, source: str) -> DataFrame:
    """Evidence rows of one lane: df has path, title, kind, line, entity_type, score, semantic_score,
    lexical_score, matched_terms, id. Each hit also counts for its file."""
    zero, none = F.lit(0.0), F.lit(None).cast("string")
    evidence = {k: (F.col("score") if k == source else zero) for k in ("file", "chunk", "identifier")}
    base = [
        *(evidence[k].alias(k) for k in evidence),
        F.col("semantic_score").alias("semantic"), F.col("lexical_score").alias("lexical"), "matched_terms",
        (F.col("id").cast("string") if source == "chunk" else none).alias("chunk_id"),
        (F.col("id").cast("string") if source == "identifier" else none).alias("identifier_id"),
    ]
    file_row = df.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("entity_type"), "path", F.col("path").alias("title"), F.lit("file").alias("kind"), F.lit(1).alias("line"), *base)
    if source == "file":
        return file_row
    symbols = df.where("entity_type = 'symbol'")
    own = symbols.select(F.concat_ws(":", F.lit("symbol"), "path", "title", "line").alias("id"), "entity_type", "path", "title", "kind", F.col("line").cast("int").alias("line"), *base)
    return own.unionByName(file_row)


def merge_lanes(*lanes: DataFrame) -> DataFrame:
    """One candidate for each id: the maximum of each score, the union of terms and supporting ids."""
    rows = lanes[0]
    for x in lanes[1:]:
        rows = rows.unionByName(x)
    top = [F.max(c).alias(c) for c in ("file", "chunk", "identifier", "semantic", "lexical")]
    first = [F.min(c).alias(c) for c in ("entity_type", "path", "title", "kind", "line")]
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("matched_terms")))).alias("matched_terms"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("identifier_id")).alias("identifier_ids")]
    return rows.groupBy("id").agg(*first, *top, *lists)  # lists are bounded by the lanes' own cuts


def add_structure(candidates: DataFrame, files: DataFrame, symbols: DataFrame, query: str, mode: str = "both") -> DataFrame:
    """files: path, module, structure_text. symbols: path, name, line, module, structure_text.

    Files first: coverage of their structure text, 0.12 more with chunk or identifier evidence. Symbols by
    (path, name, line), else the first of (path, name); they also take 0.7 of their file's file score,
    its semantic and 0.85 of its lexical score where these are higher.
    """
    text_score = (lambda c: F.lit(0.0)) if mode == "semantic" else (lambda c: scores.substring_coverage(c, query))
    hybrid = (F.col("chunk") > 0) | (F.col("identifier") > 0)
    boost = F.when(hybrid, 0.12).otherwise(0.0)
    per_file = files.select("path", F.col("module").alias("file_module"), F.col("structure_text").alias("file_text"))
    exact = symbols.select("path", F.col("name").alias("title"), "line", F.col("module").alias("exact_module"), F.col("structure_text").alias("exact_text")).dropDuplicates(["path", "title", "line"])
    loose = symbols.groupBy("path", F.col("name").alias("title")).agg(F.min(F.struct("line", F.col("module").alias("module"), F.col("structure_text").alias("text"))).alias("loose"))
    c = candidates.join(per_file, "path", "left").join(exact, ["path", "title", "line"], "left").join(loose, ["path", "title"], "left")
    is_file = F.col("entity_type") == "file"
    text = F.when(is_file, F.col("file_text")).otherwise(F.coalesce("exact_text", "loose.text"))
    structure = vectors.clamp01(F.when(text.isNull(), 0.0).otherwise(text_score(text)) + boost)
    c = c.withColumn("structure", structure).withColumn("module", F.when(is_file, F.col("file_module")).otherwise(F.coalesce("exact_module", "loose.module")))
    own = candidates.where("entity_type = 'file'").select("path", F.col("file").alias("f_file"), F.col("semantic").alias("f_semantic"), F.col("lexical").alias("f_lexical"))
    c = c.join(own, "path", "left")
    take = lambda name, share: F.when(is_file, F.col(name)).otherwise(F.greatest(F.col(name), F.coalesce(F.col(f"f_{name}") * share, F.lit(0.0))))
    more = {"file": take("file", 0.7), "semantic": take("semantic", 1.0), "lexical": take("lexical", 0.85)}
    return c.withColumns(more).drop("file_module", "file_text", "exact_module", "exact_text", "loose", "f_file", "f_semantic", "f_lexical")


def structure_texts(files: DataFrame, symbols: DataFrame, deps: DataFrame, imports: DataFrame, exports: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What add_structure reads, made once for an index: (path, module, structure_text) of files and (path, name, line, module,
    structure_text) of symbols. Each file's lists are sorted and bounded by that file."""
    joined = lambda df, c, name: df.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set(c)), " ").alias(name))
    parts = files.select("path", "header", "module", "language").join(joined(deps, F.col("dep"), "d"), "path", "left")
    parts = parts.join(joined(imports, F.concat_ws(" ", "source", F.array_join("names", " ")), "i"), "path", "left")
    parts = parts.join(joined(exports, F.concat_ws(" ", "name", "kind"), "e"), "path", "left")
    parts = parts.join(joined(calls, F.concat_ws(" ", "caller", "callee"), "c"), "path", "left")
    parts = parts.join(joined(symbols, F.concat_ws(" ", "name", "kind", "signature", "parent_name"), "s"), "path", "left")
    per_file = parts.select("path", "module", F.concat_ws(" ", "path", "header", "module", "language", "d", "i", "e", "c", "s").alias("structure_text"))
    told = symbols.join(parts.select("path", "module", "header", "d"), "path")
    return per_file, told.select("path", "name", "line", "module", F.concat_ws(" ", "path", "module", "name", "kind", "signature", "parent_name", "header", "d").alias("structure_text"))


def unified_search(tables: Callable[[str], DataFrame], query: str, query_vector: list[float], mode: str = "both", k: int = 5, kinds: list[str] | None = None, entity_types: list[str] | None = None) -> DataFrame:
    """The whole ranked search over an index's tables: the file, chunk and identifier lanes, merged, with evidence of structure.

    tables: file_docs, chunks, posting_blocks, identifiers, identifier_blocks, file_structure and symbol_structure by name. The
    lanes' own cuts bound the candidates, a few hundred at most; these come to the driver once, so structure is read for
    their paths alone, by a filter that the scan of the sorted table takes.
    """
    v = None if mode == "keyword" else query_vector
    weights = {"semantic": (1.0, 0.0), "keyword": (0.0, 1.0)}
    file_hits = retrieval.file_search(tables("file_docs"), query, query_vector, max(8 * k, 20), *weights.get(mode, (0.72, 0.28)))
    no_terms = F.array().cast("array<string>")
    file_rows = file_hits.select(F.col("path").alias("id"), "path", F.col("path").alias("title"), F.lit("file").alias("kind"), F.lit(1).alias("line"), F.lit("file").alias("entity_type"), "score", F.greatest("semantic_score", F.lit(0.0)).alias("semantic_score"), F.col("keyword_score").alias("lexical_score"), no_terms.alias("matched_terms"))
    wide = max(10 * k, 40)
    c = tables("chunks").withColumns({"title": F.coalesce("name", F.lit("file")), "entity_type": F.when(F.col("chunk_type") == "symbol", "symbol").otherwise("file")})
    chunk_hits = blockmax.hybrid_search(tables("posting_blocks"), c, query, v, wide, *weights.get(mode, (0.68, 0.32)))
    ids = tables("identifiers").withColumns({"title": F.col("name"), "entity_type": F.lit("symbol"), "lexical_text": identifier_text()})
    id_hits = blockmax.hybrid_search(tables("identifier_blocks"), ids, query, v, wide, *weights.get(mode, (0.68, 0.32)))
    merged = merge_lanes(lane(file_rows, "file"), lane(chunk_hits, "chunk"), lane(id_hits, "identifier"))
    found = merged.collect()
    merged = merged.sparkSession.createDataFrame(found, merged.schema)
    paths = sorted({r.path for r in found})
    own = lambda name: tables(name).where(F.col("path").isin(paths))
    return rank(add_structure(merged, own("file_structure"), own("symbol_structure"), query, mode), k, entity_types, kinds)


def rank(candidates: DataFrame, k: int = 5, entity_types: list[str] | None = None, kinds: list[str] | None = None, weights: tuple[float, float, float, float] = (0.20, 0.22, 0.24, 0.18)) -> DataFrame:
    """Filters by entity type and, for symbols, kind; then the best k by fused score, identifier, chunk and
    file evidence; ties by path, title and id."""
    c = candidates
    if entity_types:
        c = c.where(F.col("entity_type").isin(entity_types))
    if kinds:
        c = c.where((F.col("entity_type") == "file") | F.lower("kind").isin([x.lower() for x in kinds]))
    c = c.withColumn("score", F.round(scores.fuse(F.col("file"), F.col("chunk"), F.col("identifier"), F.col("structure"), weights), 10))
    return c.orderBy(F.desc("score"), F.desc("identifier"), F.desc("chunk"), F.desc("file"), "path", "title", "id").limit(k)


def related_hits(hits: DataFrame, contexts: DataFrame, k: int = 6) -> DataFrame:
    """hits: path. contexts: path, related, score, source. Contexts of the hits, without the hits themselves."""
    top = hits.select("path").distinct()
    rows = contexts.join(top, "path", "left_semi").join(top.select(F.col("path").alias("related")), "related", "left_anti")
    best = rows.groupBy("related").agg(F.max(F.struct(vectors.clamp01(F.col("score")).alias("score"), "source")).alias("b"))
    return best.select("related", "b.score", "b.source").orderBy(F.desc("score"), "related").limit(k)


def module_hits(hits: DataFrame, cards: DataFrame) -> DataFrame:
    """hits: path, score. cards: path, module. The best score of each module."""
    return hits.groupBy("path").agg(F.max("score").alias("score")).join(cards, "path").groupBy("module").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "module")


def overlap_score(cards: DataFrame, members: DataFrame, hits: DataFrame, query: str, coverage: float, overlap: float) -> DataFrame:
    """cards: id, text. members: id, path. Substring coverage of the text and the share of hit paths that
    are members, weighted; only positive scores. Subsystems take 0.7 and 0.3, hubs 0.6 and 0.4."""
    terms = query_terms(query)
    top = hits.select("path").distinct()
    n = top.agg(F.count(F.lit(1)).alias("n"))
    shared = members.select("id", "path").distinct().join(top, "path").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    cover = scores.substring_coverage(F.col("text"), query, 1.0, 0.0) if terms else F.lit(0.0)
    c = cards.join(shared, "id", "left").join(F.broadcast(n))  # one row on the broadcast side
    share = F.coalesce(F.try_divide(F.coalesce("shared", F.lit(0)), F.col("n")), F.lit(0.0))
    return c.withColumn("score", vectors.clamp01(cover * coverage + share * overlap)).where("score > 0").drop("shared", "n")


def rank_hubs(hubs: DataFrame, query: str, query_vector: list[float] | None = None, mode: str = "both") -> DataFrame:
    """hubs: hub, search_text, vector (but in keyword mode). All with a positive score, best first."""
    keyword = scores.substring_coverage(F.col("search_text"), query, 0.8, 0.2)
    semantic = F.lit(0.0) if mode == "keyword" else F.greatest(vectors.cosine(F.col("vector"), vectors.array_of(query_vector)), F.lit(0.0))
    h = hubs.withColumns({"keyword_score": keyword, "semantic_score": semantic})
    score = {"keyword": F.col("keyword_score"), "semantic": F.col("semantic_score")}.get(mode, vectors.clamp01(F.col("semantic_score") * 0.65 + F.col("keyword_score") * 0.35))
    return h.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("keyword_score"), F.desc("semantic_score"), "hub")


def find_hub(hubs: DataFrame, name: str) -> DataFrame:
    """hubs: hub, title. The hub whose base name or title is the name, else the first that holds it."""
    q = name.strip().lower()
    base = F.regexp_replace(F.lower(F.element_at(F.split("hub", "/"), -1)), r"\.md$", "")
    order = F.when((base == q) | (F.lower("hub") == q) | (F.lower("title") == q), 0).when(F.contains(base, F.lit(q)) | F.contains(F.lower("title"), F.lit(q)), 1)
    return hubs.withColumn("order", order).where("order is not null").orderBy("order", "hub").limit(1).drop("order")


def file_cards(files: DataFrame, risks: DataFrame) -> DataFrame:
    """files: path, module, header, n_symbols. Explanation cards with purpose, ownership and risk texts."""
    c = files.join(risks, "path", "left").fillna(0, ["n_exports", "n_dependencies", "n_reverse"]).fillna("low", ["risk"])
    purpose = F.concat(F.lit("Purpose: "), F.coalesce(F.when(F.col("header") != "", F.col("header")), F.lit("no header")), F.lit("."))
    owner = F.format_string("Ownership: module %s owns this file and %d symbol(s).", F.coalesce("module", F.lit(".")), F.col("n_symbols"))
    note = F.format_string("Change risk: %s; exports=%d, direct dependencies=%d, reverse dependencies=%d.", "risk", "n_exports", "n_dependencies", "n_reverse")
    return c.select("path", "module", purpose.alias("purpose"), owner.alias("ownership"), note.alias("change_risk"))


def listed(values, most: int = 3):
    """The first few of a sorted array as text, with the number left out."""
    n = F.size(values)
    return F.when(n == 0, "none").otherwise(F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(n > most, F.concat(F.lit(" +"), (n - most).cast("string"), F.lit(" more"))).otherwise("")))


def api_card(exports: DataFrame, files: DataFrame, most: int = 4) -> DataFrame:
    """exports: path, name, kind. files: path. (path, api): the exported symbols in order of name, the first few of them."""
    rows = exports.groupBy("path").agg(F.array_sort(F.collect_set(F.format_string("%s (%s)", "name", "kind"))).alias("names"))  # bounded by a file's exports
    text = F.when(F.size("names") > 0, F.concat(F.lit("Public API: "), listed(F.col("names"), most), F.lit("."))).otherwise("Public API: no exported symbols.")
    return files.select("path").distinct().join(rows, "path", "left").select("path", text.alias("api"))


def _first_few(edges: DataFrame, by: str, other: str, name: str, most: int) -> DataFrame:
    """The first few of the other ends of each node in order, and their number: no whole neighbour list is gathered."""
    pairs = edges.select(by, other).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(other))
    first = pairs.withColumn("rank", rank).where(F.col("rank") <= most).groupBy(by).agg(F.array_sort(F.collect_list(other)).alias(name))
    return first.join(pairs.groupBy(by).agg(F.count(F.lit(1)).alias(f"n_{name}")), by).withColumnRenamed(by, "path")


def few(names, n):
    """Names as text, with the number left out; "none" without any."""
    names, n = F.coalesce(names, F.array().cast("array<string>")), F.coalesce(n, F.lit(0))
    more = n - F.size(names)
    return F.when(n == 0, "none").otherwise(F.concat(F.array_join(names, ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise("")))


def neighbourhood_cards(files: DataFrame, edges: DataFrame, calls: DataFrame, most: int = 3) -> DataFrame:
    """files: path, module, n_symbols. edges: path, dep. calls: path, callee. (path, neighbourhood, hot_path)."""
    direct, reverse = _first_few(edges, "path", "dep", "direct", most), _first_few(edges, "dep", "path", "reverse", most)
    told = files.join(direct, "path", "left").join(reverse, "path", "left").join(_first_few(calls, "path", "callee", "callees", most + 1), "path", "left")
    near = F.concat(F.lit("Dependency neighborhood: depends on "), few(F.col("direct"), F.col("n_direct")), F.lit(". Imported by "), few(F.col("reverse"), F.col("n_reverse")), F.lit("."))
    led = F.concat(F.lit("Hot path: imported by "), F.col("n_reverse").cast("string"), F.lit(" file(s), led by "), few(F.col("reverse"), F.col("n_reverse")), F.lit("."))
    busy = F.concat(F.lit("Hot path: calls "), few(F.col("callees"), F.col("n_callees")), F.lit(" from "), F.col("n_symbols").cast("string"), F.lit(" symbol(s)."))
    alone = F.concat(F.lit("Hot path: isolated to module "), F.coalesce("module", F.lit(".")), F.lit(" with no downstream imports yet."))
    return told.select("path", near.alias("neighbourhood"), F.when(F.col("n_reverse") > 0, led).when(F.col("n_callees") > 0, busy).otherwise(alone).alias("hot_path"))


def module_cards(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """modules: module, n_files, n_symbols, n_exports. edges: from_module, to_module, one a cross-module import. (module,
    ownership, hot_path, change_risk)."""
    e = edges.where("from_module <> to_module")
    into = e.groupBy(F.col("to_module").alias("module")).agg(F.count(F.lit(1)).alias("n_in"))
    out = e.groupBy(F.col("from_module").alias("module")).agg(F.count(F.lit(1)).alias("n_out"))
    m = modules.join(into, "module", "left").join(out, "module", "left").fillna(0, ["n_in", "n_out"])
    shared = F.format_string("Hot path: %s is a shared dependency for %d cross-module import edge(s).", "module", "n_in")
    fans = F.format_string("Hot path: %s fans out across %d cross-module import edge(s).", "module", "n_out")
    alone = F.format_string("Hot path: %s is currently self-contained.", "module")
    risk = F.when((F.col("n_in") >= 3) | (F.col("n_exports") >= 4) | (F.col("n_files") >= 5), "high").when((F.col("n_in") > 0) | (F.col("n_exports") > 0) | (F.col("n_files") >= 3), "medium").otherwise("low")
    note = F.format_string("Change risk: %s; files=%d, exported symbols=%d, incoming module imports=%d.", risk, "n_files", "n_exports", "n_in")
    owns = F.format_string("Ownership: owns %d file(s) and %d symbol(s).", "n_files", "n_symbols")
    return m.select("module", owns.alias("ownership"), F.when(F.col("n_in") > 0, shared).when(F.col("n_out") > 0, fans).otherwise(alone).alias("hot_path"), note.alias("change_risk"))


def best_per_path(hits: DataFrame, k: int) -> DataFrame:
    """hits: path, score, id. The k best of each path."""
    order = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", order).where(F.col("rank") <= k)
