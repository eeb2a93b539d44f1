"""k-means of many groups at once: sums are keyed by group and center, so a round is one job, however many groups there are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bind, norm
from ..lineage import cut

#: Rows of a group that one task compares with its centers.
PIECE = 20_000


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _centers(state: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(c, float) for c in state["centers"].iloc[0]])


class _Groups:
    """Unit vectors dealt once to pieces of their group; centers meet them there, one copy for each piece."""

    def __init__(self, items: DataFrame, id_col: str, vector_col: str, most: int, rows_of: int) -> None:
        self.kind = dict(items.dtypes)[id_col]
        unit = bind(F.transform(vector_col, lambda v: v.cast("double")), lambda r: bind(norm(r), lambda x: F.transform(r, lambda v: F.coalesce(F.try_divide(v, x), F.lit(0.0)))))
        rows = items.select("node", F.col(id_col).alias("id"), unit.alias("v"))
        n = F.count(F.lit(1))
        # The number of centers as clusters.cluster_count has it for more than `most` rows.
        k = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(n / 24))).cast("int")
        sizes = rows.groupBy("node").agg(k.alias("k"), F.ceil(n / rows_of).cast("int").alias("pieces"))
        self.sizes = cut(sizes)
        dealt = rows.join(self.sizes.select("node", "pieces"), "node").select("node", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "v")
        partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        self.dealt = dealt.repartition(partitions, "node", "piece").persist(StorageLevel.MEMORY_AND_DISK)

    def meet(self, state: DataFrame, what, schema: str) -> DataFrame:
        """what(rows of a piece, its group's centers), of all pieces."""

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            return what(a.sort_values("id", ignore_index=True), _centers(b))

        pieces = state.join(self.sizes.select("node", "pieces"), "node").select(F.col("node").alias("at"), "centers", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"))
        return self.dealt.groupBy("node", "piece").cogroup(pieces.groupBy("at", "part")).applyInPandas(run, schema)


def _seeds(groups: _Groups) -> DataFrame:
    """(node, centers): farthest-first seeds of each group from its least id; a pass for each further seed, of all groups."""
    state = cut(groups.dealt.groupBy("node").agg(F.array(F.min_by("v", "id")).alias("centers")))
    most = groups.sizes.agg(F.max("k")).first()[0] or 0

    def far(rows: pd.DataFrame, centers: np.ndarray) -> pd.DataFrame:
        gap = (1 - (_matrix(rows["v"]) @ centers.T).max(1)).round(12)
        i = int(gap.argmax())
        return pd.DataFrame({"node": [rows["node"][i]], "gap": [gap[i]], "id": [rows["id"][i]], "v": [rows["v"][i]]})

    for _ in range(most - 1):
        found = groups.meet(state, far, f"node string, gap double, id {groups.kind}, v array<double>")
        best = found.groupBy("node").agg(F.min_by(F.struct("gap", "v"), F.struct(-F.col("gap"), F.col("id"))).alias("b"))
        more = (F.col("b.gap") > 1e-10) & (F.size("centers") < F.col("k"))
        told = state.join(groups.sizes.select("node", "k"), "node").join(best, "node")
        told = cut(told.select("node", F.when(more, F.concat("centers", F.array("b.v"))).otherwise(F.col("centers")).alias("centers"), more.alias("grew")))
        state = told.drop("grew")
        if not told.where("grew").limit(1).count():
            break
    return state


def kmeans_nodes(items: DataFrame, most: int, rounds: int, id_col: str = "path", vector_col: str = "vector", rows_of: int = PIECE) -> DataFrame:
    """items: node, an id and a vector. (node, id, cluster): in each node what cluster_array gives, with the same seeds and
    rounds, summed in another order. Every node must have more than `most` rows.

    A round is one job over all nodes: pieces of a node give back a row for each of its centers, which meet by
    node. Neither the driver nor a broadcast holds the nodes' centers.
    """
    groups = _Groups(items, id_col, vector_col, most, rows_of)
    state = _seeds(groups)

    def sums(rows: pd.DataFrame, centers: np.ndarray) -> pd.DataFrame:
        x = _matrix(rows["v"])
        label = (x @ centers.T).argmax(1)
        total = np.zeros_like(centers)
        np.add.at(total, label, x)
        here = np.unique(label)
        first = [rows["id"][int(np.flatnonzero(label == c)[0])] for c in here]  # rows are sorted by id
        return pd.DataFrame({"node": rows["node"][0], "cluster": here.astype("int32"), "first": first, "total": [total[c].tolist() for c in here]})

    def moved(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """New centers of a node, in order of their first ids; a is its sums, b its centers."""
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "centers": [], "moved": []})
        was = _centers(b)
        found = sorted(((g["first"].min(), np.sum(np.stack(g["total"].to_numpy()), axis=0)) for _, g in a.groupby("cluster")), key=lambda t: t[0])
        new = np.stack([t for _, t in found])
        size = np.linalg.norm(new, axis=1, keepdims=True)  # the mean's direction is the sum's
        new = new / np.where(size > 0, size, 1)
        same = new.shape == was.shape and np.allclose(new, was, atol=1e-12)
        return pd.DataFrame({"node": [a["node"].iloc[0]], "centers": [new.tolist()], "moved": [not same]})

    for _ in range(rounds):
        partial = groups.meet(state, sums, f"node string, cluster int, first {groups.kind}, total array<double>")
        told = cut(partial.groupBy("node").cogroup(state.select(F.col("node").alias("at"), "centers").groupBy("at")).applyInPandas(moved, "node string, centers array<array<double>>, moved boolean"))
        state = told.drop("moved")
        if not told.where("moved").limit(1).count():
            break

    def assign(rows: pd.DataFrame, centers: np.ndarray) -> pd.DataFrame:
        return rows[["node", "id"]].assign(cluster=(_matrix(rows["v"]) @ centers.T).argmax(1).astype("int32"))

    out = cut(groups.meet(state, assign, f"node string, id {groups.kind}, cluster int"))
    groups.dealt.unpersist()
    return out.withColumnRenamed("id", id_col)
