"""Clusters of vectors: the exact loop on one group, its distributed form, hierarchy and hubs' suggestions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cluster_label, slugify
from ..functions.vectors import array_of, bind, cosine, norm
from ..lineage import cut
from .segments import kmeans_nodes

MAX_CLUSTERS, MAX_ROUNDS, LEAF, DEPTH = 20, 20, 20, 3
#: Files of a node that one task may split.
ONE_TASK = 50_000


def cluster_count(n: int, most: int = MAX_CLUSTERS) -> int:
    """Singletons up to `most` rows; else a 24th of them, between 2 and `most`."""
    return n if n <= max(1, most) else min(most, max(2, math.ceil(n / 24)))


def cluster_array(vectors: np.ndarray, most: int = MAX_CLUSTERS) -> np.ndarray:
    """Labels of rows by cosine k-means: farthest-first seeds from row 0, at most 20 rounds, empty clusters
    dropped, labels in order of first appearance. Deterministic; first index wins ties."""
    n = len(vectors)
    if n <= max(1, most):
        return np.arange(n)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    x = vectors / np.where(length > 0, length, 1)
    seeds = [0]
    gap = 1 - x @ x[0]
    while len(seeds) < cluster_count(n, most):
        far = int(gap.argmax())
        if gap[far] <= 1e-10:
            break
        seeds.append(far)
        gap = np.minimum(gap, 1 - x @ x[far])
    centers, labels = x[seeds], None
    for _ in range(MAX_ROUNDS):
        raw = (x @ centers.T).argmax(1)
        _, first = np.unique(raw, return_index=True)
        order = raw[np.sort(first)]
        new = np.empty(raw.max() + 1, int)
        new[order] = np.arange(len(order))
        now = new[raw]
        if labels is not None and (now == labels).all():
            break
        labels = now
        centers = np.stack([x[labels == c].mean(0) for c in range(labels.max() + 1)])
        size = np.linalg.norm(centers, axis=1, keepdims=True)
        centers = centers / np.where(size > 0, size, 1)
    return labels


def cluster_group(items: DataFrame, group: list[str], most: int = MAX_CLUSTERS, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """cluster_array of each group, rows in order of id; a group is one task's, so groups must be bounded
    (leaves of a hierarchy are). For one large set use cluster_assign with sampled centers."""
    kinds = dict(items.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, ignore_index=True)
        return pdf[[*group, id_col]].assign(cluster=cluster_array(np.stack(pdf[vector_col].to_numpy()).astype(float), most))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, id_col]) + ", cluster int"
    return items.select(*group, id_col, vector_col).groupBy(*group).applyInPandas(run, schema)


def assign(items: DataFrame, centers: list[list[float]], id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, cluster, score): the center of the greatest cosine, the first winning ties; stays on the JVM."""
    sims = F.array(*(cosine(F.col(vector_col), array_of(c)) for c in centers))
    best = F.array_max("sims")
    return items.select(id_col, sims.alias("sims")).select(id_col, (F.array_position("sims", best) - 1).cast("int").alias("cluster"), best.alias("score"))


def centroids(items: DataFrame, cluster_col: str = "cluster", vector_col: str = "vector") -> DataFrame:
    """(cluster, pos, value): component means, then scaled to unit length."""
    rows = items.select(cluster_col, F.posexplode(vector_col).alias("pos", "x"))
    means = rows.groupBy(cluster_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
    total = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(cluster_col)))
    return means.select(cluster_col, "pos", F.when(total > 0, F.col("value") / total).otherwise(0.0).alias("value"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def farthest_first(items: DataFrame, k: int, id_col: str = "id", vector_col: str = "v") -> list[list[float]]:
    """Seeds for a large set of unit vectors: the row whose nearest seed is farthest, the least id winning
    ties. One pass a seed; each task gives back one row."""
    first = items.orderBy(id_col).select(vector_col).first()
    if first is None:
        return []
    seeds = [list(map(float, first[0]))]
    kind = dict(items.dtypes)[id_col]
    while len(seeds) < k:
        have = np.array(seeds)

        def far(batches: Iterator[pd.DataFrame], have: np.ndarray = have) -> Iterator[pd.DataFrame]:
            best = None
            for b in batches:
                if len(b):
                    gap = (1 - (_matrix(b[vector_col]) @ have.T).max(1)).round(12)
                    top = b[gap == gap.max()].sort_values(id_col).head(1).assign(gap=gap.max())
                    if best is None or (top["gap"].iloc[0], best[id_col].iloc[0]) > (best["gap"].iloc[0], top[id_col].iloc[0]):
                        best = top
            if best is not None:
                yield best[["gap", id_col, vector_col]]

        rows = items.select(id_col, vector_col).mapInPandas(far, f"gap double, `{id_col}` {kind}, `{vector_col}` array<double>").collect()
        best = min(rows, key=lambda r: (-r["gap"], r[id_col]))
        if best["gap"] <= 1e-10:
            break
        seeds.append(list(map(float, best[vector_col])))
    return seeds


def kmeans(items: DataFrame, most: int = MAX_CLUSTERS, rounds: int = MAX_ROUNDS, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, cluster, score). The distributed form: the same seeds, assignments and means as cluster_array,
    summed in another order. A round is one pass; each task gives back the sums of its clusters, so the
    driver holds at most `most` rows of each task."""
    n = items.count()
    if n <= max(1, most):
        rank = F.row_number().over(Window.orderBy(id_col)) - 1  # at most `most` rows
        return items.select(id_col, rank.cast("int").alias("cluster"), F.lit(1.0).alias("score"))
    kind = dict(items.dtypes)[id_col]
    unit = items.select(id_col, bind(F.transform(vector_col, lambda v: v.cast("double")), lambda r: bind(norm(r), lambda x: F.transform(r, lambda v: F.coalesce(F.try_divide(v, x), F.lit(0.0))))).alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    centers = np.array(farthest_first(unit, cluster_count(n, most), id_col))
    for _ in range(rounds):

        def sums(batches: Iterator[pd.DataFrame], centers: np.ndarray = centers) -> Iterator[pd.DataFrame]:
            total, n, first = np.zeros_like(centers), np.zeros(len(centers), np.int64), {}
            for b in batches:
                if len(b):
                    x = _matrix(b["v"])
                    label = (x @ centers.T).argmax(1)
                    np.add.at(total, label, x)
                    n += np.bincount(label, minlength=len(centers))
                    least = b[id_col].groupby(label).min()
                    first |= {c: min(v, first.get(c, v)) for c, v in least.items()}
            for c in first:  # once a task, whatever its batches
                yield pd.DataFrame({"cluster": [int(c)], "n": [int(n[c])], "first": [first[c]], "total": [total[c].tolist()]})

        rows = unit.mapInPandas(sums, f"cluster int, n long, first {kind}, total array<double>").collect()
        order = sorted({r["cluster"] for r in rows}, key=lambda c: min(r["first"] for r in rows if r["cluster"] == c))
        total = np.stack([np.sum([r["total"] for r in rows if r["cluster"] == c], axis=0) for c in order])
        size = np.linalg.norm(total, axis=1, keepdims=True)  # the mean's direction is the sum's
        new = total / np.where(size > 0, size, 1)
        done = new.shape == centers.shape and np.allclose(new, centers, atol=1e-12)
        centers = new
        if done:
            break

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sims = _matrix(b["v"]) @ centers.T
                yield pd.DataFrame({id_col: b[id_col], "cluster": sims.argmax(1).astype("int32"), "score": sims.max(1)})

    unit.unpersist()  # the rounds are over; what follows reads the items once more
    return unit.mapInPandas(told, f"`{id_col}` {kind}, cluster int, score double")


def hierarchy(items: DataFrame, most: int = MAX_CLUSTERS, leaf: int = LEAF, depth: int = DEPTH, one_task: int = ONE_TASK) -> DataFrame:
    """items: path, vector. (path, node, depth): nodes carry path ids such as 0/3/1, so none collide. A node
    of at most `leaf` files is not split; the top one of a small set parts by the first two path segments.

    Nodes of at most `one_task` files are split side by side, each in a task of its own; the larger ones all together,
    a job for each round, with the same seeds and rounds. Each level is written before the next one reads it."""
    nodes = cut(items.select("path", "vector", F.lit("0").alias("node")))
    done = None
    for level in range(depth):
        sizes = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")))
        told = nodes.join(sizes, "node")
        small, big = told.where(F.col("n") <= leaf).select("path", "node"), told.where(F.col("n") > leaf)
        if level == 0:
            small = small.withColumn("node", F.concat_ws("/", "node", F.array_join(F.slice(F.split("path", "/"), 1, F.least(F.size(F.split("path", "/")) - 1, F.lit(2))), "+")))
        rest = small.select("path", "node", F.lit(level).alias("depth"))
        done = rest if done is None else done.unionByName(rest)
        labels = cluster_group(big.where(F.col("n") <= one_task), ["node"], most, "path")
        if sizes.where(F.col("n") > max(leaf, one_task)).limit(1).count():
            labels = labels.unionByName(kmeans_nodes(big.where(F.col("n") > one_task).select("node", "path", "vector"), most, MAX_ROUNDS))
        nodes = cut(big.join(labels.hint("merge"), ["node", "path"]).select("path", "vector", F.concat_ws("/", "node", "cluster").alias("node")))
    return done.unionByName(nodes.select("path", "node", F.lit(depth).alias("depth")))


def suggestion_labels(members: DataFrame) -> DataFrame:
    """members: suggestion, path. (suggestion, segment, label, slug, n_files): the first part of its pattern (the part that its
    paths begin with, if they share one, else the first path's) as a label of two words."""
    first = F.split_part("path", F.lit("/"), F.lit(1))
    rows = members.groupBy("suggestion").agg(F.min("path").alias("first_path"), F.min(first).alias("low"), F.max(first).alias("high"), F.count(F.lit(1)).alias("n_files"))
    segment = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.split_part("first_path", F.lit("/"), F.lit(1)))
    rows = rows.withColumn("segment", segment).withColumn("label", cluster_label(F.col("segment")))
    return rows.select("suggestion", "segment", "label", slugify(F.col("label")).alias("slug"), "n_files")


def overlapping_nodes(members: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """members: suggestion, path. nodes: node, path. (suggestion, node, rank): the first k nodes, in order of their path ids,
    that hold a file of the suggestion. A node's files are also its ancestors', so every ancestor of a leaf counts."""
    parts = F.split("node", "/")
    every = nodes.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("node"))
    pairs = members.select("suggestion", "path").join(every, "path").select("suggestion", "node").distinct()
    rank = F.row_number().over(Window.partitionBy("suggestion").orderBy("node"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def feature_tags(tags: DataFrame, k: int = 3) -> DataFrame:
    """tags: suggestion, tag. The k most frequent tags of each suggestion but 'none', by count, then tag."""
    counts = tags.where((F.col("tag") != "") & (F.lower("tag") != "none")).groupBy("suggestion", "tag").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("suggestion").orderBy(F.desc("n"), "tag"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def feature_groups(ranked: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """ranked: feature_tags. members: suggestion, path. labels: suggestion, label. Groups by slug of the tag,
    for tags counted twice in a suggestion, or that are its label."""
    kept = ranked.join(labels, "suggestion").where((F.col("n") >= 2) | (F.col("tag") == F.col("label"))).withColumn("slug", slugify(F.col("tag")))
    return kept.join(members, "suggestion").groupBy("slug").agg(F.array_sort(F.collect_set("suggestion")).alias("suggestions"), F.array_sort(F.collect_set("path")).alias("paths"))


def suggestion_links(members: DataFrame, related: DataFrame, k: int = 4) -> DataFrame:
    """members: suggestion, path. related: path, related. (suggestion, linked): suggestions that some related
    edge leads to, the first k by name."""
    a = members.select("suggestion", "path").join(related, "path").select("suggestion", "related")
    b = members.select(F.col("suggestion").alias("linked"), F.col("path").alias("related"))
    pairs = a.join(b, "related").where("suggestion <> linked").select("suggestion", "linked").distinct()
    rank = F.row_number().over(Window.partitionBy("suggestion").orderBy("linked"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


