"""Numbers and running sums within groups of any size.

A window over a group puts the whole group into one task. Here rows are range-partitioned by group and
order together, so a group may span many tasks; each task numbers what it holds in one pass, and what a
group has in earlier tasks is added afterwards. Only groups that a task begins with can have any, so what is
brought back is a row or two for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

#: Running sums are exact in this type; they are kept in two halves in tasks, which 64 bits hold.
SUM = "decimal(38,0)"


def numbered(rows: DataFrame, key: str, order: list[str], value: str | None = None) -> DataFrame:
    """rows with nth (from 1, within key by order) and, if a value is given (a long from 0 to 2^32 - 1), total: the sum
    of nth * value through this row, as a decimal.

    key is a long and not null. Rows that agree in key and order are numbered by their place in a written table, so a task
    that runs again numbers them alike; no group, and no set of equal rows, has to fit into one task.
    """
    spark = rows.sparkSession
    placed = materialise(rows, "to-number")
    names = placed.columns
    # Ties, however many, are parted by the row's place in its file.
    placed = placed.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    at = [key, *order, "__file", "__row"]
    ordered = placed.repartitionByRange(shuffle_partitions(spark), *at).sortWithinPartitions(*at).select(*names)
    where = names.index(key)
    weigh = names.index(value) if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first = TaskContext.get().partitionId(), None
        group, n, low, high, plain = None, 0, 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(where).to_numpy()
            if first is None:
                first = group = keys[0]
            starts = np.flatnonzero(np.r_[keys[0] != group, keys[1:] != keys[:-1]])
            run_of = np.searchsorted(starts, np.arange(len(keys)), "right")  # 0: goes on from the last batch
            begin = np.r_[-n, starts][run_of]
            nth = np.arange(len(keys)) - begin + 1
            cols = [*b.columns, pa.array(np.full(len(keys), task, np.int32)), pa.array(keys == first), pa.array(nth)]
            if weigh is not None:
                x = b.column(weigh).to_numpy().astype(np.int64)
                # nth * x = (high half of x) * nth * 2^16 + (low half) * nth: sums of a task's rows stay in 64 bits.
                def since(c: np.ndarray, held: int) -> np.ndarray:
                    c = np.r_[0, np.cumsum(c)]
                    return c[1:] - np.r_[-held, c[starts]][run_of]

                lows, highs, plains = since((x & 0xFFFF) * nth, low), since((x >> 16) * nth, high), since(x, plain)
                low, high, plain = int(lows[-1]), int(highs[-1]), int(plains[-1])
                cols += [pa.array(lows), pa.array(highs), pa.array(plains)]
            group, n = keys[-1], int(nth[-1])
            yield pa.RecordBatch.from_arrays(cols, [*names, *more])

    more = ["__task", "__first", "nth", *(["__low", "__high", "__plain"] if value else [])]
    types = dict(zip(more, ("int", "boolean", "long", "long", "long", "long"), strict=False))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in names] + [f"{n} {types[n]}" for n in more])
    local = materialise(ordered.mapInArrow(run, schema), "numbered")
    # What groups that a task begins with have in each task; they are as many as tasks, and so are the groups' tasks in sum.
    begun = local.where("__first").select(key).distinct()
    parts = local.join(F.broadcast(begun), key, "left_semi").groupBy(key, "__task")
    before = Window.partitionBy(key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    if value:
        sums = parts.agg(F.max("nth").alias("n"), F.max(F.col("__low") + F.col("__high").cast(SUM) * 65536).alias("s"), F.max("__plain").cast(SUM).alias("p"))
        base = sums.withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        base = base.withColumn("__carry", F.coalesce(F.sum(F.col("s") + F.col("__base") * F.col("p")).over(before), F.lit(0)).cast(SUM))
    else:
        base = parts.agg(F.max("nth").alias("n")).withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = base.where("__base > 0").select(key, "__task", "__base", *["__carry"] * bool(value))
    out = local.join(F.broadcast(base), [key, "__task"], "left").withColumn("__base", F.coalesce("__base", F.lit(0)))
    columns = [*names, (F.col("nth") + F.col("__base")).alias("nth")]
    if value:
        total = F.coalesce("__carry", F.lit(0).cast(SUM)) + F.col("__low") + F.col("__high").cast(SUM) * 65536 + F.col("__base").cast(SUM) * F.col("__plain")
        columns.append(total.cast(SUM).alias("total"))
    return out.select(*columns)
