"""URL filtering by dated lists, with DataFrame operations only.

The entries of one pattern become validity intervals: each holds from its date until the next entry
of that pattern. A capture is matched, as of its fetch time, with the intervals of its host, of each
parent domain and of each path prefix; the most specific active one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals are broadcast up to this many rows, else joined by shuffle.
BROADCAST_ROWS = 200_000
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def patterns(url: Column) -> Column:
    """Patterns that cover a URL, least specific first: parent domains, the host, its path prefixes
    (whole segments; those before the last end in a slash)."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    parts = F.split(F.regexp_extract(url, PATH, 1), "/")  # the first is empty
    m = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(m, F.lit(2))), lambda k: F.concat(h, F.array_join(F.slice(parts, 1, k), "/"), F.when(k < m, "/").otherwise("")))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, F.when(m >= 2, prefixes).otherwise(F.array().cast("array<string>")))))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: pattern, action ('block' or 'allow'), dated. One row for each stretch: pattern, action,
    valid_from, valid_to (excluded; null: still valid). Null patterns, actions or dates say nothing; of
    several entries on one date 'block' holds."""
    whole = entries.where("pattern is not null and action is not null and dated is not null")
    one = whole.groupBy("pattern", "dated").agg(F.max("action").alias("action"))
    following = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    return one.select("pattern", "action", F.col("dated").alias("valid_from"), following.alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """captures: page_id, url, fetched_at. One row for each different capture: page_id, url, fetched_at,
    pattern, valid_from (of the deciding entry; null without one), blocked.

    Of the active patterns the longest decides. A null or unparsable url and a null fetched_at match
    nothing and are not blocked. Repeated captures count once; empty tables give no rows.
    """
    dated = intervals(entries)
    dated = F.broadcast(dated) if dated.count() <= BROADCAST_ROWS else dated
    keys = captures.select(F.col(id_col).alias("page_id"), "url", "fetched_at", F.explode_outer(patterns(F.col("url"))).alias("pattern"))
    active = (keys.pattern == dated.pattern) & (keys.fetched_at >= dated.valid_from) & (dated.valid_to.isNull() | (keys.fetched_at < dated.valid_to))
    found = F.when(dated.pattern.isNotNull(), F.struct(F.length(dated.pattern).alias("n"), dated.pattern.alias("pattern"), dated.valid_from.alias("valid_from"), dated.action.alias("action")))
    best = keys.join(dated, active, "left").groupBy("page_id", "url", "fetched_at").agg(F.max(found).alias("best"))
    return best.select("page_id", "url", "fetched_at", "best.pattern", "best.valid_from", F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"))
