"""Rule findings, scores, nesting, percentiles and other report aggregates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comment signs of checked files, the header's fields, the line limit and the depth limit.
COMMENTS = {".ts": "//", ".tsx": "//", ".js": "//", ".jsx": "//", ".mjs": "//", ".cjs": "//", ".go": "//", ".rs": "//", ".java": "//", ".py": "#", ".sh": "#", ".rb": "#"}
FIELDS, MAX_LINES, MAX_NESTING = ("summary", "inputs", "outputs"), 1000, 6


def rule_score(errors: Column, warnings: Column, failed_tools: Column | int = 0) -> Column:
    """100 less 18 an error, 6 a warning and 25 a failed tool, between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - errors * 18 - warnings * 6 - failed_tools * 25))


def _full(name: str):
    return lambda s: F.lower(s).rlike(rf"^{name}:\s*\S")


def _named(name: str):
    return lambda s: F.startswith(F.lower(s), F.lit(f"{name}:"))


def findings(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """files: path, content. (path, line, rule, severity): too short a header, no feature tag, empty fields, length."""
    from ..sources.files import extension

    prefix = F.create_map(*(F.lit(x) for kv in COMMENTS.items() for x in kv))[extension(F.col("path"))]
    # Only the head is parted into lines: a file's other lines are counted.
    n_lines = F.octet_length("content") - F.octet_length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    f = files.withColumn("prefix", prefix).where("prefix is not null")
    f = f.withColumns({"n_lines": n_lines, "first": F.when(F.startswith("content", F.lit("#!")), 1).otherwise(0)})
    at_break = F.instr("content", "\n")
    rest = F.when(F.col("first") == 0, F.col("content")).when(at_break > 0, F.substring(F.col("content"), at_break + 1, F.length("content"))).otherwise("")
    f = f.withColumn("rest", rest)
    told = F.lit(None).cast("string")
    for sign in sorted(set(COMMENTS.values())):  # up to the first line that does not begin with the sign
        told = F.when(F.col("prefix") == sign, F.split("rest", rf"(?<![^\n])(?!{re.escape(sign)})", 2)[0]).otherwise(told)
    told = F.when(F.startswith("rest", F.col("prefix")), F.split(F.regexp_replace(told, r"\n\z", ""), "\n")).when(F.col("rest").isNotNull(), F.array().cast("array<string>"))
    head = F.transform(told, lambda s: F.trim(F.substring(s, F.length("prefix") + 1, F.length(s))))
    f = f.withColumn("head", head)
    short = F.size("head") < 2
    at = F.col("first") + 1
    item = lambda cond, line, rule, severity: F.when(cond, F.struct(line.cast("int").alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    out = [item(short, at, "header", "error"), item(~short & ~F.exists("head", lambda s: F.contains(F.upper(s), F.lit("FEATURE:"))), at + 1, "feature-tag", "warning")]
    for name in FIELDS:
        full = F.exists("head", _full(name))
        row = F.array_position(F.transform("head", _named(name)), True)
        out.append(item(~short & ~full, F.when(row == 0, at).otherwise(F.col("first") + row), f"{name}-header", "warning"))
    limit = F.coalesce(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("path")], F.lit(MAX_LINES)) if limits else F.lit(MAX_LINES)
    out.append(item(F.col("n_lines") > limit, limit + 1, "file-length", "warning"))
    return f.select("path", F.inline(F.array_compact(F.array(*out))))


def file_scores(found: DataFrame) -> DataFrame:
    per = found.groupBy("path").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("warnings"))
    return per.withColumn("score", rule_score(F.col("errors"), F.col("warnings"))).orderBy("score", F.desc("errors"), F.desc("warnings"), "path")


def nesting(lines: DataFrame, id_col: str = "path") -> DataFrame:
    """lines: id, line, content. Deepest nesting of braces, taken after each line (0 at least)."""
    step = F.length(F.regexp_replace("content", "[^{]", "")) - F.length(F.regexp_replace("content", "[^}]", ""))
    depth = F.sum(step).over(Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select(id_col, depth.alias("depth")).groupBy(id_col).agg(F.greatest(F.max("depth"), F.lit(0)).alias("max_nesting")).withColumn("too_deep", F.col("max_nesting") > MAX_NESTING)


def latency_percentiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Nearest-rank percentiles to 2 places: samples, p50, p95, p99, max."""
    p = lambda f: F.round(F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY `{value}`)"), 2)
    return rows.groupBy(*by).agg(F.count(value).alias("samples"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.max(value), 2).alias("max"))


def confusion(rows: DataFrame, truth: str, told: str) -> DataFrame:
    """tp, tn, fp, fn and their rates to 4 places (0 without cases)."""
    n = lambda a, b: F.count_if((F.col(truth) == a) & (F.col(told) == b))
    c = rows.agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    rate = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x), F.col(x) + F.col(y)), F.lit(0.0)), 4)
    return c.select("*", rate("fp", "tn").alias("fp_rate"), rate("fn", "tp").alias("fn_rate"))


def throughput(count: Column, ms: Column) -> Column:
    """Per second, to 2 places; null for no time."""
    return F.round(F.try_divide(count.cast("double"), ms.cast("double")) * 1000, 2)


def marker_counts(files: DataFrame, marker: str, id_col: str = "path", text_col: str = "content") -> DataFrame:
    n = (F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit(marker), F.lit("")))) / len(marker)
    return files.select(id_col, n.cast("long").alias("markers")).where("markers > 0")


def status_summary(status: DataFrame) -> DataFrame:
    """status: index, worktree (one-letter codes). Overlapping counts of a working tree's states."""
    i, w = F.col("index"), F.col("worktree")
    either = lambda x: F.count_if((i == x) | (w == x))
    return status.agg(
        F.count_if(~i.isin(" ", "?")).alias("staged"), F.count_if(~w.isin(" ", "?")).alias("unstaged"), either("?").alias("untracked"), either("U").alias("conflicted"),
        either("M").alias("modified"), F.count_if((i == "A") | (w == "A") | (i == "?")).alias("created"), either("D").alias("deleted"), either("R").alias("renamed"),
    )
