"""An inverted file of vectors: nearest neighbours from coarse cells.

Centers are fitted on a bounded sample; every row lies in the cell of its nearest center and looks into the few cells
nearest to it. An audit of some rows, before any row is sent anywhere, tells how many cells hold their neighbours; where that
is more than a few, all rows are compared with all others by blocks. Both ways are exact: a cell's radius tells whether it may hold
a neighbour nearer than those that a row has found, and the row looks into each further cell that may, or, where these are many, meets
all rows. Equal vectors are one row with the least of their ids, so copies meet nothing among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm
from .graph import knn_graph

#: Rows of a cell on average, cells at most, and sampled rows for each center.
CELL, CELLS, SAMPLED = 1024, 2048, 32
#: Cells looked into at first; rows audited, and the share of their neighbours that must be found.
PROBES, AUDITED, RECALL = 8, 256, 0.99
#: A cell of more rows than this is compared in several tasks.
PART = 4096
ROUNDS = 6
#: More cells than this are not looked into: a row would be sent to as many tasks as it is by stripes.
MOST_PROBES = 16
#: Stripes that rows are dealt to, so each is sent to as many tasks at any size; rows of one at least, and at most, beyond which there are more.
STRIPES, LEAST_STRIPE, MOST_STRIPE = 12, 1024, 1 << 18
#: Rows, columns and held candidates of a matrix product.
ROW_BLOCK, COLUMN_BLOCK, HELD = 512, 4096, 1 << 21


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def fit_centers(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centers by a few rounds of cosine k-means from evenly spaced rows; at most as many as different rows."""
    centers = np.unique(sample[:: max(1, len(sample) // cells)][:cells], axis=0)
    for _ in range(ROUNDS):
        label = np.concatenate([(sample[i : i + 4096] @ centers.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(centers)
        np.add.at(total, label, sample)
        held = np.linalg.norm(total, axis=1) > 0
        centers = _unit(total[held])
    return centers


def _best(sims: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row, the first of equal ones winning; others are sorted."""
    order = np.argsort(-sims.round(10), axis=1, kind="stable")[:, :k]
    return others[order], np.take_along_axis(sims, order, 1)


def _pairs(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, k: int, least: float) -> pd.DataFrame:
    found, score = _best(sims, others, k)
    keep = score.ravel() >= least
    return pd.DataFrame({"id": np.repeat(ids, found.shape[1])[keep], "other": found.ravel()[keep], "score": score.ravel()[keep]})


def _merged(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 10)), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _radii(unit: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The greatest angle between each center and the rows of its cell; a row as near to several centers counts for each."""
    shared = unit.sparkSession.sparkContext.broadcast(centers)

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = np.full(len(shared.value), -1.0)
        for b in batches:
            for i in range(0, len(b), 1024):
                sims = np.stack(b["v"].to_numpy()[i : i + 1024]) @ shared.value.T
                r, c = np.nonzero(sims >= sims.max(1, keepdims=True) - 1e-9)
                np.maximum.at(most, c, np.arccos(np.clip(sims[r, c], -1, 1)))
        yield pd.DataFrame({"cell": np.flatnonzero(most >= 0).astype(np.int32), "angle": most[most >= 0]})

    out = np.full(len(centers), -1.0)
    for r in unit.select("v").mapInPandas(angles, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("angle")).collect():  # CELLS rows at most
        out[r.cell] = r.angle
    return out


def may_hold(v: np.ndarray, centers: np.ndarray, radii: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """For each unit row of v whether each cell may hold a row whose dot product with it reaches its floor: none is nearer than its angle
    to the center, less the radius. Margins are wider than what doubles and the rounding of scores are off."""
    gap = np.arccos(np.clip(v @ centers.T, -1, 1)) - radii - 1e-7
    return (radii >= 0) & ~(np.cos(np.clip(gap, 0, np.pi)) < floor[:, None] - 1e-9)


def _looked_up(unit: DataFrame, centers: np.ndarray, probes: int, k: int, least: float, kind: str) -> DataFrame:
    """(id, other, score): the k nearest of each row among all, itself among them. Rows look into the `probes` cells nearest to them, then into each
    other one that may hold something nearer than what they have; a row for which these are over MOST_PROBES meets all rows."""
    shared = unit.sparkSession.sparkContext.broadcast((centers, _radii(unit, centers)))  # CELLS rows at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i : i + 1024]
                sims = np.stack(part["v"].to_numpy()) @ shared.value[0].T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "cells": list(near.astype(np.int32))})

    placed = unit.mapInPandas(place, f"id {kind}, v array<double>, cells array<int>").persist(StorageLevel.MEMORY_AND_DISK)
    own = placed.select("id", "v", F.get("cells", F.lit(0)).alias("cell"))
    found = _in_cells(placed, own, k, least, kind).persist(StorageLevel.MEMORY_AND_DISK)
    floors = found.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i : i + 1024]
                floor = np.fmax(part["floor"].to_numpy(dtype=np.float64), least)  # none where there are fewer than k
                may = may_hold(np.stack(part["v"].to_numpy()), *shared.value, floor)
                np.put_along_axis(may, np.stack(part["cells"].to_numpy()), False, axis=1)
                at = np.flatnonzero(may.any(1))
                cells = [np.flatnonzero(row).astype(np.int32) if row.sum() <= MOST_PROBES else None for row in may[at]]
                yield pd.DataFrame({"id": part["id"].iloc[at], "v": part["v"].iloc[at], "cells": pd.Series(cells, dtype=object, index=part.index[at])})

    rest = placed.join(floors, "id", "left").mapInPandas(further, f"id {kind}, v array<double>, cells array<int>").persist(StorageLevel.MEMORY_AND_DISK)
    some, many = rest.agg(F.count("cells"), F.count_if(F.col("cells").isNull())).first()
    if some:
        found = found.unionByName(_in_cells(rest.where("cells is not null"), own, k, least, kind))
    if many:
        found = found.unionByName(_with_all(rest.where("cells is null").select("id", "v"), many, unit, k, least, kind))
    return _merged(found.groupBy("id", "other").agg(F.max("score").alias("score")), k) if some or many else found


def _in_cells(asked: DataFrame, own: DataFrame, k: int, least: float, kind: str) -> DataFrame:
    """(id, other, score): the k nearest of each asked row (id, v, cells) in its cells. own: id, v, cell."""
    sizes = own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # CELLS rows at most
    members = own.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("other"), F.col("v").alias("w"))
    asking = asked.select("id", "v", F.explode("cells").alias("cell")).join(sizes, "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # Queries of a crowded cell are dealt to several tasks, each of which gets the part's members.
    lots = 1 + F.floor(F.count(F.lit(1)) / PART).cast("int")
    crowd = F.broadcast(asking.groupBy("cell", "part").agg(lots.alias("lots")))  # a row for each part: rows over PART, and CELLS
    asking = asking.join(crowd, ["cell", "part"]).withColumn("lot", F.pmod(F.xxhash64("id", F.lit(1)), F.col("lots")).cast("int"))
    members = members.join(crowd, ["cell", "part"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "score": []})
        b = b.sort_values("other", ignore_index=True)
        w, others, ids = np.stack(b["w"].to_numpy()), b["other"].to_numpy(), a["id"].to_numpy()
        return pd.concat([_pairs(ids[i : i + 512], others, np.stack(a["v"].to_numpy()[i : i + 512]) @ w.T, k, least) for i in range(0, len(a), 512)])

    keys = ["cell", "part", "lot"]
    found = asking.select(*keys, "id", "v").groupBy(*keys).cogroup(members.select(*keys, "other", "w").groupBy(*keys)).applyInPandas(nearest, f"id {kind}, other {kind}, score double")
    return _merged(found, k)


def top_of(v: np.ndarray, w: np.ndarray, others: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of v, other, score): for each unit row of v the k rows of w with the greatest dot products of at least `least`, rounded at
    ten places, the first of equal ones winning; others are sorted. Products in single precision leave out what cannot be among them; scores
    are of double precision."""
    off = 2e-7 * (v.shape[1] + 8)  # more than a product in single precision is off
    w32 = np.ascontiguousarray(w, dtype=np.float32)
    for i in range(0, len(v), ROW_BLOCK):
        part = v[i : i + ROW_BLOCK]
        part32, floor = part.astype(np.float32), np.full((len(part), 1), least - off, np.float32)
        rows, columns, scores, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), []

        def settle() -> None:
            nonlocal rows, columns, scores
            if not held:
                return
            at, col = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            s = np.concatenate([np.einsum("ij,ij->i", part[at[j : j + 65536]], w[col[j : j + 65536]]) for j in range(0, len(at), 65536)])
            ok = s >= least
            rows, columns, scores = np.r_[rows, at[ok]], np.r_[columns, col[ok]], np.r_[scores, s[ok]]
            order = np.lexsort((columns, -scores.round(10), rows))
            rows, columns, scores = rows[order], columns[order], scores[order]
            first = np.searchsorted(rows, rows)
            best = np.arange(len(rows)) - first < k
            rows, columns, scores = rows[best], columns[best], scores[best]

        waiting = 0
        for j in range(0, len(w), COLUMN_BLOCK):
            sims = part32 @ w32[j : j + COLUMN_BLOCK].T
            hit = np.flatnonzero(sims >= floor)
            if len(hit) > 16 * k * len(part) and sims.shape[1] > k:
                floor = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k, None] - np.float32(2 * off))
                hit = np.flatnonzero(sims >= floor)
            held.append((hit // sims.shape[1], hit % sims.shape[1] + j))
            waiting += len(hit)
            if waiting > HELD:
                settle()
                waiting = 0
        settle()
        yield rows + i, others[columns], scores


def _stripes(count: int) -> int:
    return max(min(STRIPES, count // LEAST_STRIPE), -(-count // MOST_STRIPE), 1)


def _with_all(asked: DataFrame, n_asked: int, unit: DataFrame, k: int, least: float, kind: str) -> DataFrame:
    """(id, other, score): the k nearest of each asked row (id, v) among all. Both are dealt to stripes, each of which meets each of the others in a task."""
    a, b = _stripes(n_asked), _stripes(unit.count())
    stripe = lambda n, name: F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).cast("int").alias(name)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "v", stripe(a, "a"), every(b).alias("b"))
    right = unit.select("id", "v", stripe(b, "b"), every(a).alias("a"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": [], "other": [], "score": []})
        if not len(x) or not len(y):
            return none
        y = y.sort_values("id", ignore_index=True)
        ids = x["id"].to_numpy()
        best = top_of(np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy()), y["id"].to_numpy(), k, least)
        out = [pd.DataFrame({"id": ids[at], "other": other, "score": s}) for at, other, s in best if len(at)]
        return pd.concat(out or [none])

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, f"id {kind}, other {kind}, score double")
    return _merged(found, k)


def _compared(unit: DataFrame, count: int, k: int, least: float, kind: str) -> DataFrame:
    """(id, other, score): the k nearest of each row among all, itself among them. Rows are dealt to stripes, and each two stripes, or one with
    itself, meet in a task of their own, whatever the number of rows; a task gives the k best of each of its rows."""
    stripes = _stripes(count)
    own = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(stripes)).cast("int").alias("stripe")
    sent = unit.select("id", "v", own).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    sent = sent.select("id", "v", "stripe", F.least("stripe", "y").alias("a"), F.greatest("stripe", "y").alias("b"))

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = key
        rows = rows.sort_values("id", ignore_index=True)
        ids, v, mine = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()), rows["stripe"].to_numpy() == a
        sides = [(mine, mine)] if a == b else [(mine, ~mine), (~mine, mine)]
        out = [pd.DataFrame({"id": [], "other": [], "score": []})]
        for x, y in sides:
            if x.any() and y.any():
                own_ids = ids[x]
                out += [pd.DataFrame({"id": own_ids[at], "other": other, "score": s}) for at, other, s in top_of(v[x], v[y], ids[y], k, least) if len(at)]
        return pd.concat(out[1:] or out)

    return _merged(sent.groupBy("a", "b").applyInPandas(meet, f"id {kind}, other {kind}, score double"), k)


def _cells_needed(unit: DataFrame, centers: np.ndarray, queries: pd.DataFrame, truth: set[tuple], recall: float, kind: str) -> int:
    """Cells that each of the audited rows has to look into, so that a share of `recall` of their neighbours is found; more than
    there are where no number of cells is enough."""
    shared = unit.sparkSession.sparkContext.broadcast(centers)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "cell": (np.stack(b["v"].to_numpy()) @ shared.value.T).argmax(1).astype(np.int32)})

    wanted = unit.sparkSession.createDataFrame([(x,) for x in sorted({o for _, o in truth})], f"id {kind}")  # a few of each audited row
    cell = {r.id: r.cell for r in unit.join(F.broadcast(wanted), "id", "left_semi").select("id", "v").mapInPandas(place, f"id {kind}, cell int").collect()}
    order = np.argsort(-(np.stack(queries["v"].to_numpy()) @ centers.T), axis=1, kind="stable")
    turn = {x: {int(c): n + 1 for n, c in enumerate(row)} for x, row in zip(queries["id"].tolist(), order, strict=True)}
    needed = sorted(turn[x][cell[o]] for x, o in truth)
    last = int(np.ceil(recall * len(needed))) - 1
    return 1 if last < 0 else needed[last] if last < len(needed) else len(centers) + 1


def _exact(unit: DataFrame, queries: pd.DataFrame, k: int, least: float, kind: str) -> set[tuple]:
    """(id, other) of the k nearest of AUDITED rows at most, over all rows."""
    shared = unit.sparkSession.sparkContext.broadcast((queries["id"].to_numpy(), np.stack(queries["v"].to_numpy())))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, v = shared.value
        for b in batches:
            if len(b):
                b = b.sort_values("id", ignore_index=True)
                yield _pairs(ids, b["id"].to_numpy(), v @ np.stack(b["v"].to_numpy()).T, k, least)

    return {(r.id, r.other) for r in _merged(unit.mapInPandas(near, f"id {kind}, other {kind}, score double"), k).collect()}


def knn_cells(items: DataFrame, least: float = 0.35, k: int = 3, cell: int = CELL, probes: int = PROBES, recall: float = RECALL, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """knn_graph, (id, related, score), from cells of about `cell` rows. A table of less than two cells is compared whole.

    The same rows as knn_graph's. Where a share of `recall` of the neighbours of AUDITED rows is found in few cells, rows look into these first, and
    then into all others that may hold neighbours; else all rows are compared with all. Rows of equal vectors have one another first, the
    least ids winning, as everywhere: a class gives its k + 1 least ids, behind which none can be among the k nearest of a row.
    """
    kind = dict(items.dtypes)[id_col]
    rows = items.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("raw"))
    rows = rows.withColumn("key", F.sha2(F.array_join(F.transform("raw", lambda x: F.hex(x.cast("string").cast("binary"))), ","), 256))
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    firsts = rows.withColumn("place", place).where(F.col("place") <= k + 1)  # cut in each task before the shuffle
    classes = firsts.groupBy("key").agg(F.min_by("id", "place").alias("id"), F.any_value("raw").alias("raw"), F.array_sort(F.collect_list("id")).alias("ids"))
    n = norm(F.col("raw"))
    unit = classes.select("key", "id", "ids", F.when(n > 0, F.transform("raw", lambda x: x / n)).otherwise(F.transform("raw", lambda x: F.lit(0.0))).alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    # Rows that can be neighbours: a vector of zeros has the product 0 with all, one that is not finite has none.
    live = unit.where(F.forall("v", lambda x: ~F.isnan(x)) & (F.exists("v", lambda x: x != 0) if least > 0 else F.lit(True))).select("id", "v")
    count = live.count()
    cells = min(CELLS, count // cell)
    if cells < 2:
        unit.unpersist()
        return knn_graph(items, least, k, 1, id_col, vector_col)
    sample = live.orderBy(F.xxhash64("id")).limit(SAMPLED * cells).toPandas()  # bounded by CELLS
    centers = fit_centers(np.stack(sample["v"].to_numpy()), cells)
    audited = sample.head(AUDITED)
    truth = _exact(live, audited, k + 1, least, kind)
    needed = _cells_needed(live, centers, audited, truth, recall, kind)
    while probes < needed:
        probes *= 2
    if probes > MOST_PROBES or 2 * probes >= len(centers):
        found = _compared(live, count, k + 1, least, kind)
    else:
        found = _looked_up(live, centers, probes, k + 1, least, kind)
    # From classes to rows: a class stands for the least of its ids, its own for those beside the row itself.
    near = found.join(unit.select(F.col("id").alias("other"), "ids"), "other").select(F.col("id").alias("of"), "score", F.explode("ids").alias("related"))
    near = near.unionByName(unit.where(F.size("ids") > 1).select(F.col("id").alias("of"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("score"), F.explode("ids").alias("related")).where(F.col("score") >= least))
    near = near.groupBy("of", "related").agg(F.max("score").alias("score"))  # a class finds itself in its own cell too
    best = F.row_number().over(Window.partitionBy("of").orderBy(F.desc(F.round("score", 10)), "related"))
    near = near.withColumn("best", best).where(F.col("best") <= k + 1).drop("best")
    members = rows.select("id", "key").join(unit.select("key", F.col("id").alias("of")), "key").select("id", "of")
    pairs = members.join(near, "of").where("id <> related")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 10)), "related"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "related", F.round("score", 4).alias("score"))
