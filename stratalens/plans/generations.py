"""Immutable generations of index tables with one pointer.

A build writes a pending generation's tables, validates them and then publishes by writing the pointer
last; readers see one generation from start to end. Publishing renames a new pointer over the old one in
one call, so a crash leaves the old one or the new one; on object stores a pointer write replaces it as a
whole. One mutation at a time holds the store's lock, a file that only one writer can create.

Generations share files. A manifest names the folders that make up each table; tables whose rows belong to one
key (a file's path) are dealt to buckets by it, a folder each, so a refresh writes the buckets that it touches
and names the folders of an earlier generation for the rest.
"""

from __future__ import annotations

import json
import os
import socket
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION, CONTRACT_VERSION, ARTIFACT_VERSION = 4, 13, 17
#: Stages: what they need and which tables they write. 'full' builds run all, 'core' ones the first three.
STAGES = {
    "bootstrap": ((), ("files", "path_grams")),
    "file-search": (("bootstrap",), ("symbols", "symbol_tokens", "file_docs")),
    "identifier-search": (("bootstrap", "file-search"), ("identifiers", "identifier_postings", "identifier_blocks", "word_hits", "source_lines", "word_positions")),
    "full-artifacts": (("bootstrap", "file-search", "identifier-search"), ("chunks", "postings", "posting_blocks", "imports", "exports", "calls", "deps", "modules", "module_edges", "file_structure", "symbol_structure", "related", "cluster_nodes", "hubs", "hub_links", "hub_grams", "cards", "module_cards", "ownership")),
}
CORE = ("bootstrap", "file-search", "identifier-search")
#: Buckets of a table by its key: this many, or more where they would hold more rows than this each. Tasks that write one.
BUCKETS, BUCKET_ROWS, SPREAD = 16, 50_000, 4


@dataclass
class Pointer:
    active: int = 0
    pending: int = 0
    latest: int = 0
    freshness: str = "fresh"
    reason: str = ""


@dataclass
class Manifest:
    generation: int
    mode: str
    tables: dict[str, int] = field(default_factory=dict)
    stages: dict[str, str] = field(default_factory=dict)
    provider: str = "mock"
    since: int = 0
    reused: dict[str, int] = field(default_factory=dict)
    #: Folders (under the root) and schema of tables that are made up of several.
    folders: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    buckets: int = 0
    schema_version: int = SCHEMA_VERSION
    contract_version: int = CONTRACT_VERSION
    artifact_version: int = ARTIFACT_VERSION


class Store:
    """Tables of generations under one root, on any file system that Spark's session can write."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError as e:
            raise ValueError(f"{name} is malformed") from e
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> None:
        target, temp = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{name}.new")
        out = self._fs.create(temp, True)
        out.write(json.dumps(value, sort_keys=True).encode())
        out.close()
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(temp), self._fs.makeQualified(target), over)

    @contextmanager
    def lock(self, what: str = "mutation", stale_s: float = 6 * 3600) -> Iterator[None]:
        """Holds the store for one writer; raises if another one does. A lock older than stale_s is taken over, and its
        owner is never stopped."""
        path = self._path(f"{self.root}/{what}.lock")
        if self._fs.exists(path) and time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 > stale_s:
            self._fs.delete(path, False)
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            raise RuntimeError(f"{what} is locked by {self._read(f'{what}.lock')}") from e
        out.write(json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "since": time.time()}).encode())
        out.close()
        try:
            yield
        finally:
            self._fs.delete(path, False)

    def pointer(self) -> Pointer:
        return Pointer(**(self._read("pointer.json") or {}))

    def reserve(self) -> int:
        """A new pending generation: one more than any seen."""
        p = self.pointer()
        p.pending = p.latest = max(p.latest, p.active, p.pending) + 1
        self._write("pointer.json", asdict(p))
        return p.pending

    def activate(self, generation: int) -> None:
        p = self.pointer()
        p.active, p.pending, p.freshness, p.reason = generation, 0, "fresh", ""
        self._write("pointer.json", asdict(p))

    def clear_pending(self) -> None:
        p = self.pointer()
        if p.pending:
            self._fs.delete(self._path(f"{self.root}/generation-{p.pending}"), True)
        p.pending = 0
        self._write("pointer.json", asdict(p))

    def mark(self, freshness: str, reason: str = "") -> None:
        """Freshness of the active generation: fresh, dirty or blocked, with its reason."""
        if freshness not in ("fresh", "dirty", "blocked"):
            raise ValueError(freshness)
        p = self.pointer()
        p.freshness, p.reason = freshness, reason
        self._write("pointer.json", asdict(p))

    def retain(self, keep: int = 2) -> None:
        """Deletes generations older than the last `keep` below the active one, but for the folders that a kept one names;
        never the pending one."""
        p = self.pointer()
        found = {int(n[11:]): s.getPath() for s in self._fs.listStatus(self._path(self.root)) if (n := s.getPath().getName()).startswith("generation-")}
        kept = {g for g in found if g >= p.active - keep + 1 or g == p.pending}
        named = {f for g in kept if (m := self.manifest(g)) for folders in m.folders.values() for f in folders}
        for g in found.keys() - kept:
            if not any(f.startswith(f"generation-{g}/") for f in named):
                self._fs.delete(found[g], True)
                continue
            for table in self._fs.listStatus(found[g]):
                if f"generation-{g}/{table.getPath().getName()}" in named:
                    continue
                parts = self._fs.listStatus(table.getPath()) if table.isDirectory() else []
                own = {f"generation-{g}/{table.getPath().getName()}/{x.getPath().getName()}": x.getPath() for x in parts}
                if not own.keys() & named:
                    self._fs.delete(table.getPath(), True)
                for folder in own.keys() - named if own.keys() & named else ():
                    self._fs.delete(own[folder], True)

    def table_path(self, generation: int, table: str) -> str:
        return f"{self.root}/generation-{generation}/{table}"

    def save(self, generation: int, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.table_path(generation, table))

    def save_parts(self, made: Manifest, table: str, df: DataFrame, key: str = "path", only: list[int] | None = None, shared: list[str] | None = None) -> None:
        """Writes df by buckets of its key and names the folders in the manifest. only: the buckets that are written; shared: folders
        of earlier generations for the others."""
        where = self.table_path(made.generation, table)
        rows = df.withColumn("_bucket", bucket_of(F.col(key), made.buckets))
        rows = rows if only is None else rows.where(F.col("_bucket").isin(only))
        rows.repartition("_bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(SPREAD))).sortWithinPartitions("_bucket", key).write.mode("overwrite").partitionBy("_bucket").parquet(where)
        own = sorted(n for s in self._fs.listStatus(self._path(where)) if (n := s.getPath().getName()).startswith("_bucket="))
        made.folders[table] = [*(shared or []), *(f"generation-{made.generation}/{table}/{n}" for n in own)]
        made.schemas[table] = df.schema.json()

    def shared_folders(self, m: Manifest, table: str, touched: list[int]) -> list[str]:
        """The folders of a table's buckets that are not touched."""
        return [f for f in m.folders.get(table, []) if int(f.rsplit("=", 1)[1]) not in touched]

    def adopt(self, made: Manifest, was: Manifest, table: str) -> None:
        """Takes a whole table of an earlier generation over, by naming its folders."""
        made.folders[table] = was.folders.get(table) or [f"generation-{was.generation}/{table}"]
        made.schemas[table] = was.schemas.get(table) or self.read(was, was.generation, table).schema.json()
        made.tables[table] = was.tables[table]

    def read(self, m: Manifest | None, generation: int, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A generation's table, of some of its buckets if told."""
        if m is None or table not in m.folders:
            return self.spark.read.parquet(self.table_path(generation, table))
        schema = StructType.fromJson(json.loads(m.schemas[table]))
        folders = [f for f in m.folders[table] if buckets is None or int(f.rsplit("=", 1)[1]) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def table(self, table: str, generation: int | None = None) -> DataFrame:
        g = self.pointer().active if generation is None else generation
        if not g:
            raise LookupError("there is no active generation; build an index first")
        return self.read(self.manifest(g), g, table)

    def has(self, generation: int, table: str) -> bool:
        m = self.manifest(generation)
        if m and table in m.folders:
            return all(self._fs.exists(self._path(f"{self.root}/{f}")) for f in m.folders[table])
        return self._fs.exists(self._path(f"{self.table_path(generation, table)}/_SUCCESS"))

    def save_manifest(self, m: Manifest) -> None:
        self._write(f"generation-{m.generation}/manifest.json", asdict(m))

    def manifest(self, generation: int) -> Manifest | None:
        found = self._read(f"generation-{generation}/manifest.json")
        return Manifest(**found) if found else None

    def vectors(self, table: str, ids: DataFrame | None = None, id_col: str = "id") -> DataFrame:
        """(id, vector) of one of the active generation's tables: all, or those of ids (column id)."""
        return vectors_of(self.table(table).select(F.col(id_col).alias("id"), "vector"), ids)


def vectors_of(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """rows (id, vector) of the ids asked for, or all."""
    return rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")


def replace_namespace(current: DataFrame, namespace: str, rows: DataFrame, column: str = "namespace") -> DataFrame:
    """current with all rows of one namespace replaced."""
    return current.where(F.col(column) != namespace).unionByName(rows.withColumn(column, F.lit(namespace)).select(current.columns))


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """current with the rows of changes in place of those with their keys."""
    return current.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)


def delete(current: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return current.join(keys.select(*key).distinct(), key, "left_anti")


def diff_merge(current: DataFrame, wanted: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, action): insert, update, delete or keep, to bring current to wanted."""
    a, b = current.select(key, F.col(mark).alias("was"), F.lit(1).alias("a")), wanted.select(key, F.col(mark).alias("is"), F.lit(1).alias("b"))
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(F.col("was").eqNullSafe(F.col("is")), "keep").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched_buckets(changed: DataFrame, buckets: int, key: str = "path") -> list[int]:
    """The buckets of changed keys: at most `buckets` numbers."""
    return sorted(r[0] for r in changed.select(bucket_of(F.col(key), buckets)).distinct().collect())


def apply_merge(store: Store, since: Manifest, made: Manifest, table: str, wanted: DataFrame, key: str, mark: str) -> DataFrame:
    """Brings a table to `wanted` in the generation `made`: only buckets with a row to insert, update or delete are written, those
    where diff_merge says keep throughout are taken over as they are. Returns the table's actions (key, action)."""
    current = store.read(since, since.generation, table)
    made.buckets = since.buckets
    actions = diff_merge(current, wanted, key, mark)
    touched = touched_buckets(actions.where("action <> 'keep'"), made.buckets, key)
    store.save_parts(made, table, wanted, key, touched, store.shared_folders(since, table, touched))
    return actions


def reuse(previous: DataFrame, current: DataFrame, key: list[str], made: list[str]) -> tuple[DataFrame, DataFrame]:
    """current rows whose key (say path and content hash) is in previous, with its columns `made`; and the rest, to be built."""
    had = previous.select(*key, *made).dropDuplicates(key)
    return current.join(had, key), current.join(had.select(*key), key, "left_anti")


def validate(store: Store, generation: int, mode: str = "full", scan: bool = True) -> list[tuple[str, str]]:
    """Issues (code, message) of a generation; none: it is valid. Without scan only the pointer, the manifest and the folders
    are looked at: that is what a query asks of a generation that was scanned when it was published."""
    issues: list[tuple[str, str]] = []
    p, m = store.pointer(), store.manifest(generation)
    if generation == p.active and p.freshness != "fresh":
        issues.append(("serving-generation-not-fresh", f"generation {generation} is {p.freshness}: {p.reason}"))
    if m is None:
        return [*issues, ("missing-manifest", f"generation {generation} has no manifest")]
    for name, is_, want in (("schema", m.schema_version, SCHEMA_VERSION), ("contract", m.contract_version, CONTRACT_VERSION), ("artifact", m.artifact_version, ARTIFACT_VERSION)):
        if is_ != want:
            issues.append((f"{name}-version-mismatch", f"{name} version {is_}, expected {want}"))
    if m.generation != generation:
        issues.append(("generation-mismatch", f"manifest of generation {m.generation} in generation {generation}"))
    if mode == "full" and m.mode != "full":
        issues.append(("mode-mismatch", f"a {m.mode} build cannot serve full queries"))
    for stage in CORE if mode == "core" else STAGES:
        if m.stages.get(stage) != "completed":
            issues.append(("stage-incomplete", f"{stage} is {m.stages.get(stage, 'missing')}"))
        for t in STAGES[stage][1]:
            if not store.has(generation, t):
                issues.append(("missing-table", f"{t} is missing"))
            elif scan and (n := store.read(m, generation, t).count()) != m.tables.get(t):
                issues.append(("row-count-mismatch", f"{t} has {n} rows, the manifest says {m.tables.get(t)}"))
    for stage in m.stages:
        if stage not in STAGES:
            issues.append(("unknown-stage", f"{stage} is no stage"))
        elif missing := [d for d in STAGES[stage][0] if m.stages.get(d) != "completed"]:
            issues.append(("stage-dependency", f"{stage} is complete without {', '.join(missing)}"))
    if p.pending and p.pending == generation and p.active == generation:
        issues.append(("pointer-conflict", f"generation {generation} is pending and active"))
    if issues or not scan:
        return issues
    if store.table("files", generation).where(F.col("path").isNull() | (F.col("path") == "")).limit(1).count():
        issues.append(("missing-path", "a file has no path"))
    if mode == "full":
        lost = store.table("postings", generation).select("id").distinct().join(store.table("chunks", generation).select("id"), "id", "left_anti").limit(1).count()
        if lost:
            issues.append(("orphan-postings", "postings name chunks that are missing"))
    return issues
