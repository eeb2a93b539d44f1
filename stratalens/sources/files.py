"""Source trees as a table of files, with ignore rules compiled on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that are never listed, and extensions by use.
IGNORED_NAMES = ["node_modules", ".git", ".svn", ".hg", "__pycache__", ".DS_Store", "dist", "build", ".next", ".nuxt", "target", "coverage", ".cache", ".turbo", ".parcel-cache"]
TEXT_EXTENSIONS = [".md", ".txt", ".json", ".jsonc", ".geojson", ".csv", ".tsv", ".ndjson", ".yaml", ".yml", ".toml", ".lock", ".env"]
DATA_EXTENSIONS = [".json", ".jsonc", ".geojson", ".csv", ".tsv", ".ndjson", ".yaml", ".yml", ".toml", ".lock", ".env"]
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp"}
MAX_TEXT, MAX_FILE = 4000, 50 * 1024


def ignore_pattern(rules: str) -> tuple[str, str]:
    """Regular expressions for paths that .gitignore rules drop and take back; empty: none.

    Comments, negation, anchoring, directory marks, *, ?, ** and character classes are understood.
    """
    drop, keep = [], []
    for line in rules.splitlines():
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        into = keep if rule.startswith("!") else drop
        rule = rule.lstrip("!")
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        rule = rule.lstrip("/")
        out, i = "", 0
        while i < len(rule):
            if rule.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif rule.startswith("**", i):
                out, i = out + ".*", i + 2
            elif rule[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif rule[i] == "?":
                out, i = out + "[^/]", i + 1
            elif rule[i] == "[" and "]" in rule[i:]:
                end = rule.index("]", i)
                out, i = out + rule[i : end + 1].replace("[!", "[^"), end + 1
            else:
                out, i = out + re.escape(rule[i]), i + 1
        into.append(("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"))
    return "|".join(drop), "|".join(keep)


def visible(path: Column, rules: str = "") -> Column:
    """Whether a relative path is listed: no ignored name, no dotfile or dot folder, no ignore rule."""
    names = "|".join(map(re.escape, IGNORED_NAMES))
    seen = ~path.rlike(rf"(?:^|/)(?:{names})(?:/|$)") & ~path.rlike(r"(?:^|/)\.")
    drop, keep = ignore_pattern(rules)
    if drop:
        seen = seen & (~path.rlike(drop) | (path.rlike(keep) if keep else F.lit(False)))
    return seen


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def _read(fs, path) -> bytes:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def read_tree(spark: SparkSession, root: str, rules: str | None = None, depth: int = 0, hidden: bool = False) -> DataFrame:
    """files: path, content, size, mtime_ms, depth. The root's .gitignore is read when no rules are given;
    depth 0 is unlimited; hidden files too with hidden. A missing root is an empty table.

    Executors read the files, but for those with a name or folder that begins with an underscore (or with
    a dot, when hidden): Spark's listing leaves these out, so the driver lists the tree and reads them.
    """
    schema = "path string, content string, size long, mtime_ms long, depth int"
    make = spark._jvm.org.apache.hadoop.fs.Path
    base = make(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return spark.createDataFrame([], schema)
    top = fs.makeQualified(base).toUri().getPath().rstrip("/")
    if rules is None:
        listed = make(f"{root.rstrip('/')}/.gitignore")
        rules = _read(fs, listed).decode() if fs.exists(listed) else ""

    special, walk = [], fs.listFiles(base, True)
    while walk.hasNext():
        status = walk.next()
        path = status.getPath().toUri().getPath()[len(top) + 1 :]
        if re.search(r"(?:^|/)_" if not hidden else r"(?:^|/)[_.]", path) and not any(x in IGNORED_NAMES for x in path.split("/")):
            special.append((path, _read(fs, status.getPath()).decode("utf-8", "replace"), status.getLen(), status.getModificationTime()))

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace(F.col("path"), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")
    files = raw.select(F.substring(F.url_decode(F.regexp_replace(plain, r"\+", "%2B")), len(top) + 2, 1 << 20).alias("path"), F.decode("content", "utf-8").alias("content"), F.col("length").alias("size"), F.unix_millis(F.col("modificationTime")).alias("mtime_ms"))
    if special:
        files = files.unionByName(spark.createDataFrame(special, "path string, content string, size long, mtime_ms long"))
    files = files if hidden else files.where(visible(F.col("path"), rules))
    level = F.size(F.split("path", "/")) - 1
    files = files.where(level < depth) if depth else files
    return files.withColumn("depth", level.cast("int"))


def directories(files: DataFrame) -> DataFrame:
    """(directory, depth, n_files) from path prefixes."""
    parts = F.split("path", "/")
    rows = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("directory"))
    return rows.groupBy("directory").agg(F.count(F.lit(1)).alias("n_files")).withColumn("depth", F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/"))))


def language(path: Column) -> Column:
    ext = extension(path)
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(known[ext], F.when(ext != "", F.substring(ext, 2, 100)), F.lit("unknown"))


def navigable(path: Column) -> Column:
    return ~extension(path).isin(DATA_EXTENSIONS)


def header(content: Column) -> Column:
    """The first two lines of the first ten with words: comment signs dropped, no imports or directives."""
    first = F.slice(F.split(content, "\n"), 1, 10)
    bare = F.transform(first, lambda line: F.trim(F.regexp_replace(line, r"^//\s?|^#\s?|^--\s?|^\*\s?|^/\*\*?\s?|\*/$", "")))
    told = F.filter(bare, lambda s: (s != "") & ~F.startswith(s, F.lit("!")) & ~F.startswith(s, F.lit("use ")) & ~F.startswith(s, F.lit("import ")))
    return F.array_join(F.slice(told, 1, 2), " | ")


def text_documents(files: DataFrame, most_bytes: int = MAX_FILE) -> DataFrame:
    """Documents of text files: path, header (two lines that are not blank, cut at 120), symbols (none), content."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    head = F.array_join(F.transform(F.slice(lines, 1, 2), lambda s: F.substring(s, 1, 120)), " | ")
    rows = files.where(extension(F.col("path")).isin(TEXT_EXTENSIONS) & (F.col("size") <= max(1024, most_bytes)))
    return rows.select("path", head.alias("header"), F.array().cast("array<string>").alias("symbols"), F.substring("content", 1, MAX_TEXT).alias("content"))


def source_documents(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Documents of source files: path, header, symbols (names in order), content (signatures)."""
    entries = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "signature"))).alias("s"))
    out = files.join(entries, "path").select("path", header(F.col("content")).alias("header"), F.col("s.name").alias("symbols"), F.array_join("s.signature", " ").alias("content"))
    return out


def feature_tag(content: Column) -> Column:
    """Value of the first FEATURE: comment line; null without one."""
    tag = F.trim(F.regexp_extract(content, r"(?m)^(?://|#|--)\s*FEATURE:\s*(.+)$", 1))
    return F.when(tag != "", tag)


# The forms of links between hub pages.
LINK = r"\[\[([^\]|]+(?:\|[^\]]*)?)\]\]"
CROSS_LINK = r"@linked-to\s+\[\[([^\]]+)\]\]"


def wiki_links(pages: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(id, target, description, pos): the first link to each target; @linked-to links are left out."""
    clean = F.regexp_replace(text_col, CROSS_LINK, "")
    found = F.regexp_extract_all(clean, F.lit(LINK), 1)
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(found).alias("pos", "link"))
    rows = rows.select("id", "pos", F.trim(F.split_part("link", F.lit("|"), F.lit(1))).alias("target"), F.when(F.contains("link", F.lit("|")), F.trim(F.regexp_extract("link", r"\|(.*)$", 1))).alias("description"))
    first = rows.groupBy("id", "target").agg(F.min(F.struct("pos", "description")).alias("f"))
    return first.select("id", "target", "f.description", "f.pos")


def cross_links(pages: DataFrame, id_col: str = "path", text_col: str = "content") -> DataFrame:
    found = F.regexp_extract_all(text_col, F.lit(CROSS_LINK), 1)
    return pages.select(F.col(id_col).alias("id"), F.explode(found).alias("hub")).withColumn("hub", F.trim("hub"))


def hubs(files: DataFrame) -> DataFrame:
    """Markdown files with a wiki link: hub, title (first heading, else base name), content."""
    title = F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1)
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    rows = files.where(F.endswith("path", F.lit(".md")) & F.col("content").rlike(r"\[\[[^\]|]+"))
    return rows.select(F.col("path").alias("hub"), F.when(title != "", F.trim(title)).otherwise(base).alias("title"), "content")
