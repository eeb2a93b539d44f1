"""Dependency, module and link graphs: joins and aggregations over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import change_risk, module_risk
from ..functions.text import directory
from ..functions.vectors import clamp01

#: Extensions tried for a local import, in order, and those that may stand for another.
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json"]
RUNTIME_EXTENSIONS = [".js", ".jsx", ".mjs", ".cjs"]
#: Pieces of a module whose pairs are made apart, and the tasks that they are dealt to.
PIECES, TASKS = 32, 96


def normal_join(base: Column, relative: Column) -> Column:
    """A relative path against a directory, with . and .. resolved."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(base == ".", F.lit("")).otherwise(base), relative), "/"), lambda p: (p != "") & (p != "."))
    step = lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p == "..", a).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def base_candidates(base: Column) -> Column:
    """Paths that the path of a local import may mean, in order."""
    extension = F.regexp_extract(base, r"(\.[A-Za-z0-9]+)$", 1)
    stem = F.regexp_replace(base, r"\.[A-Za-z0-9]+$", "")
    exts = F.array(*map(F.lit, EXTENSIONS))
    swapped = F.when(extension.isin(RUNTIME_EXTENSIONS), F.transform(exts, lambda e: F.concat(stem, e))).otherwise(F.array().cast("array<string>"))
    added = F.flatten(F.transform(exts, lambda e: F.array(F.concat(base, e), F.concat(base, F.lit("/index"), e))))
    return F.concat(F.array(base), F.when(extension != "", swapped).otherwise(added))


def import_candidates(path: Column, source: Column) -> Column:
    """Paths a local import may mean, in order; empty for other imports."""
    return F.when(F.startswith(source, F.lit(".")), base_candidates(normal_join(directory(path), source))).otherwise(F.array().cast("array<string>"))


def resolve_first(candidates: DataFrame, targets: DataFrame, by: list[str], key: str = "candidate") -> DataFrame:
    """candidates: by..., pos, key. The first candidate of each group that is a target (column key).

    Targets grow with the table and shrink well in Parquet, so their size is not guessed: they are never broadcast."""
    hit = candidates.join(targets.select(key).distinct().hint("merge"), key)
    return hit.groupBy(*by).agg(F.min_by(key, "pos").alias("resolved"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports: path, source. (path, source, dep) of those that mean a file of files(path). Imports that lead to one place are
    resolved once."""
    local = imports.where(F.startswith("source", F.lit("."))).select("path", "source").distinct()
    local = local.withColumn("base", normal_join(directory(F.col("path")), F.col("source")))
    rows = local.select("base").distinct().select("base", F.posexplode(base_candidates(F.col("base"))).alias("pos", "candidate"))
    found = resolve_first(rows, files.select(F.col("path").alias("candidate")), ["base"])
    return local.join(found.hint("merge"), "base").select("path", "source", F.col("resolved").alias("dep"))


def reverse_dependencies(edges: DataFrame, source: str = "path", target: str = "dep") -> DataFrame:
    """(target, dependents sorted, n): lists grow with a target's dependents; use the edge table itself for hot targets."""
    pairs = edges.select(F.col(target), F.col(source)).distinct()
    return pairs.groupBy(target).agg(F.array_sort(F.collect_list(source)).alias("dependents"), F.count(F.lit(1)).alias("n"))


def module_peers(files: DataFrame, k: int | None = None) -> DataFrame:
    """files: path, module. (path, peer) of files in one module, of each file its k least peers; without k all pairs, whose
    number is quadratic in a module. A ranking of k places at one score for all peers needs no more than k of them."""
    other = files.select("module", F.col("path").alias("peer"))
    if k is None:
        # A module's files are dealt to pieces, each of which meets all its peers, so that a large module is no task's alone.
        piece = F.pmod(F.xxhash64("path"), F.lit(PIECES)).cast("int").alias("piece")
        a = files.select("module", "path", piece).repartition(TASKS, "module", "piece")
        b = other.select("module", "peer", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece")).repartition(TASKS, "module", "piece")
        return a.join(b.hint("merge"), ["module", "piece"]).where("path <> peer").select("path", "peer")
    rank = F.row_number().over(Window.partitionBy("module").orderBy("peer"))
    least = other.withColumn("rank", rank).where(F.col("rank") <= k + 1)  # cut in each task before the shuffle
    # The last of the k + 1 stands in for a file that is itself among the first k.
    return files.select("module", "path").join(least, "module").where("path <> peer").where((F.col("rank") <= k) | (F.col("path") < F.col("peer"))).select("path", "peer")


def exported_symbols(symbols: DataFrame, exports: DataFrame) -> DataFrame:
    return symbols.join(exports.select("path", "name").distinct(), ["path", "name"], "left_semi")


def orphans(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files, but for Markdown, that no hub links to. links: path."""
    return files.where(~F.endswith("path", F.lit(".md"))).join(links.select("path").distinct(), "path", "left_anti")


def resolve_links(links: DataFrame, files: DataFrame, target: str = "target", path: str = "path") -> DataFrame:
    """links with whether their target is a file (resolved), and the files' other columns, null for missing ones."""
    known = files.dropDuplicates([path]).withColumnRenamed(path, "_known")
    found = links.join(known, links[target] == known["_known"], "left")
    return found.withColumn("resolved", F.col("_known").isNotNull()).drop("_known")


def ownership_edges(symbols: DataFrame) -> DataFrame:
    """symbols: path, name, kind, line, parent_name. (path, owner, owner_kind, name, line): each symbol and what owns it, its
    parent of that name in the file, or the file itself."""
    kind = F.when(F.col("parent_name").isNull(), "file").otherwise("symbol")
    return symbols.select("path", F.coalesce("parent_name", "path").alias("owner"), kind.alias("owner_kind"), "name", "line")


def removed(previous: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    return previous.join(current.select(key).distinct(), key, "left_anti")


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "path", mark: str = "fingerprint") -> DataFrame:
    """(key, change): added, removed or changed rows of two snapshots."""
    a, b = previous.select(key, F.col(mark).alias("was"), F.lit(1).alias("old")), current.select(key, F.col(mark).alias("is"), F.lit(1).alias("new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def module_summary(files: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """files: path, module. edges: path, dep. symbols: path, name. Sorted, distinct lists of each module."""
    sets = lambda df, col, name: df.groupBy("module").agg(F.array_sort(F.collect_set(col)).alias(name))
    out = sets(files, "path", "file_paths")
    out = out.join(sets(files.join(edges, "path"), "dep", "dependency_paths"), "module", "left")
    out = out.join(sets(files.join(symbols, "path"), "name", "symbol_names"), "module", "left")
    none = F.array().cast("array<string>")
    return out.select("module", "file_paths", *(F.coalesce(c, none).alias(c) for c in ("dependency_paths", "symbol_names")))


def module_import_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, from_module, to_module), different, across modules; path is the importing file."""
    a, b = files.select("path", F.col("module").alias("from_module")), files.select(F.col("path").alias("dep"), F.col("module").alias("to_module"))
    return edges.join(a, "path").join(b, "dep").where("from_module <> to_module").select("path", "from_module", "to_module").distinct()


def module_edge_counts(module_edges: DataFrame) -> DataFrame:
    """(module, outgoing, incoming) edges."""
    rows = module_edges.select(F.explode(F.array(F.struct(F.col("from_module").alias("module"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_module").alias("module"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return rows.groupBy("module").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def file_risk(files: DataFrame, edges: DataFrame, exports: DataFrame) -> DataFrame:
    """(path, n_exports, n_dependencies, n_reverse, risk)."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("path")).agg(F.count(F.lit(1)).alias(name))
    e = edges.select("path", "dep").distinct()
    out = files.select("path").join(count(exports, "path", "n_exports"), "path", "left").join(count(e, "path", "n_dependencies"), "path", "left").join(count(e, "dep", "n_reverse"), "path", "left").fillna(0)
    return out.withColumn("risk", change_risk(F.col("n_reverse"), F.col("n_exports"), F.col("n_dependencies")))


def modules_at_risk(summary: DataFrame, edge_counts: DataFrame) -> DataFrame:
    """summary: module, n_files, n_exported."""
    out = summary.join(edge_counts, "module", "left").fillna(0)
    return out.withColumn("risk", module_risk(F.col("incoming"), F.col("n_exported"), F.col("n_files")))


def related_contexts(contexts: list[tuple[DataFrame, str, float | None]], k: int = 8) -> DataFrame:
    """contexts: (path, related[, score]) tables, their source and fixed score. The best context of each
    related path, the first table winning ties, and the best k of each path.

    A table gives each path its own best k at most: what is behind k others there is behind them in all. They are cut in each
    task before they meet, so a path that everything leads to is no task's alone."""
    every = None
    for order, (df, source, score) in enumerate(contexts):
        rows = df.select("path", "related", (clamp01(F.col("score")) if score is None else F.lit(score)).alias("score"))
        if score is None:
            rows = rows.groupBy("path", "related").agg(F.max("score").alias("score"))
        place = F.dense_rank().over(Window.partitionBy("path").orderBy(F.desc("score"), "related"))
        rows = rows.withColumn("place", place).where(F.col("place") <= k).drop("place").withColumns({"source": F.lit(source), "first": F.lit(-order)})
        every = rows if every is None else every.unionByName(rows)
    best = every.groupBy("path", "related").agg(F.max(F.struct("score", "first", "source")).alias("b")).select("path", "related", "b.score", "b.source")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "related"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_graph(items: DataFrame, least: float = 0.35, k: int = 3, blocks: int = 1, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, related, score): the k nearest others with cosine of at least `least`, scores to 4 places.

    Exact, over normalised vectors. Pairs are compared block by block: each block of rows meets each other
    one in one task, through an equi-join on block pairs and a matrix product in Arrow batches, so no
    task holds more than two blocks; a partial top k of each block pair is merged at the end.
    """
    import numpy as np
    import pandas as pd

    from ..functions.vectors import norm

    n = norm(F.col(vector_col))
    unit = items.select(F.col(id_col).alias("id"), F.when(n > 0, F.transform(vector_col, lambda x: x.cast("double") / n)).otherwise(F.transform(vector_col, lambda x: F.lit(0.0))).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("b"))
    sides = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = unit.select("id", "v", F.col("b").alias("x"), F.explode(sides).alias("y"))
    right = unit.select(F.col("id").alias("other"), F.col("v").alias("w"), F.explode(sides).alias("x"), F.col("b").alias("y"))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "related": [], "score": []})
        b = b.sort_values("other", ignore_index=True)
        va, vb = np.stack(a["v"].to_numpy()), np.stack(b["w"].to_numpy())
        out = []
        for i in range(0, len(a), 512):
            sims = va[i : i + 512] @ vb.T
            ids = a["id"].to_numpy()[i : i + 512]
            sims[ids[:, None] == b["other"].to_numpy()[None, :]] = -2
            order = np.argsort(-sims.round(10), axis=1, kind="stable")[:, :k]
            r = np.repeat(np.arange(len(ids)), order.shape[1])
            s = np.take_along_axis(sims, order, 1).ravel()
            keep = s >= least
            out.append(pd.DataFrame({"id": ids[r][keep], "related": b["other"].to_numpy()[order.ravel()][keep], "score": s[keep]}))
        return pd.concat(out)

    kind = dict(items.dtypes)[id_col]
    part = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(nearest, f"id {kind}, related {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 10)), "related"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "related", F.round("score", 4).alias("score"))
