"""Tables that several queries read, built once a session and published like a generation's.

A query reads what a build has prepared: postings, lookup tokens and vectors are not made anew each
time. Tables go to the folder in spark.checkpoint.dir, sorted by the column they are looked up by, so
that a filter on it reads few row groups; where no shared folder is named, a temporary one serves in
local mode, and elsewhere the table is simply computed in each query.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut

_PUBLISHED: dict[tuple[str, str, str], str] = {}
_LOCAL: list[tempfile.TemporaryDirectory] = []


def folder(spark: SparkSession) -> str | None:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="stratalens-prepared-"))  # removed when Python ends
        return "file://" + _LOCAL[0].name
    return None


def published(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], by: str) -> DataFrame:
    """The table that build makes of the tables in `source`, written at its first use in this application."""
    where = folder(spark)
    if where is None:
        return build()
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _PUBLISHED:
        path = f"{where}/stratalens-prepared/{key[0]}/{len(_PUBLISHED)}-{name}"
        df = cut(build())  # the ranges are found by a sample, for which the build would run a second time
        # A frequent value is many ranges, not one task's: the hash parts its rows.
        df.repartitionByRange(by, F.xxhash64(*df.columns)).sortWithinPartitions(by).write.option("parquet.block.size", 8 << 20).parquet(path)
        _PUBLISHED[key] = path
    return spark.read.parquet(_PUBLISHED[key])
