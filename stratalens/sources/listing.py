"""A tree of files as a Python data source: executors walk folders, and filters cut the walk short.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("root", "/src").load().where("depth <= 2 and path like 'src/%'")

Rows are (path, depth, size, mtime_ms): a listing, no contents. The driver lists only as many folders as it takes to deal the tree
to partitions; a filter on depth or on a path's beginning is taken by the walk, which does not enter folders that
it, an ignore rule or an ignored name leaves out. The root may be any that pyarrow's file systems read.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from .files import IGNORED_NAMES, ignore_pattern

SCHEMA = "path string, depth int, size long, mtime_ms long"
#: Partitions, and folders that the driver lists at most to deal the tree to them.
PARTITIONS, LISTED = 64, 1000


@dataclass
class Folders(InputPartition):
    """Folders to walk whole, and folders of which only the files are meant."""

    whole: tuple[str, ...]
    flat: tuple[str, ...] = ()


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options.get("root") or options["path"]
        self.drop, self.keep = ignore_pattern(options.get("rules", ""))
        self.hidden = str(options.get("hidden", "false")).lower() == "true"
        self.partitions_asked = int(options.get("partitions", PARTITIONS))
        self.most, self.least, self.prefix = None, 0, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of depth and one beginning of path; gives back the rest."""
        for f in filters:
            match f:
                case LessThanOrEqual(("depth",), n):
                    self.most = n if self.most is None else min(self.most, n)
                case LessThan(("depth",), n):
                    self.most = n - 1 if self.most is None else min(self.most, n - 1)
                case GreaterThanOrEqual(("depth",), n):
                    self.least = max(self.least, n)
                case GreaterThan(("depth",), n):
                    self.least = max(self.least, n + 1)
                case EqualTo(("depth",), n):
                    self.most, self.least = n if self.most is None else min(self.most, n), max(self.least, n)
                case StringStartsWith(("path",), text) if text.startswith(self.prefix):
                    self.prefix = text
                case _:
                    yield f

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + posixpath.abspath(self.root))

    def _enters(self, path: str, depth: int) -> bool:
        """Whether files below a folder can be asked for."""
        if self.most is not None and depth + 1 > self.most:
            return False
        return path.startswith(self.prefix) or self.prefix.startswith(path + "/")

    def _seen(self, path: str, folder: bool) -> bool:
        name = posixpath.basename(path)
        if name in IGNORED_NAMES or not self.hidden and name.startswith("."):
            return False
        if not self.drop or not re.search(self.drop, path + "/" * folder):
            return True
        return bool(self.keep) if folder else bool(self.keep and re.search(self.keep, path))  # a rule may take back what is in a folder

    def _list(self, system, base: str, folder: str) -> tuple[list[str], list[tuple]]:
        """The folders in a folder that are entered, and the rows of its files."""
        from pyarrow import fs

        folders, rows = [], []
        depth = folder.count("/") + 1 if folder else 0
        for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True)):
            path = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type == fs.FileType.Directory:
                if self._seen(path, True) and self._enters(path, depth):
                    folders.append(path)
            elif info.type == fs.FileType.File and depth >= self.least and (self.most is None or depth <= self.most) and path.startswith(self.prefix) and self._seen(path, False):
                rows.append((path, depth, info.size, int(info.mtime.astimezone(UTC).timestamp() * 1000)))
        return sorted(folders), sorted(rows)

    def partitions(self) -> list[InputPartition]:
        system, base = self._system()
        queue, flat = [""], []
        while queue and len(queue) < self.partitions_asked and len(flat) < LISTED:
            folder = queue.pop(0)
            flat.append(folder)
            queue += self._list(system, base, folder)[0]
        n = self.partitions_asked
        return [Folders(tuple(queue[i::n]), tuple(flat[i::n])) for i in range(n) if queue[i::n] or flat[i::n]]

    def read(self, partition: Folders) -> Iterator[tuple]:
        system, base = self._system()
        for folder in partition.flat:
            yield from self._list(system, base, folder)[1]
        stack = list(reversed(partition.whole))
        while stack:
            folders, rows = self._list(system, base, stack.pop())
            stack += reversed(folders)
            yield from rows


class TreeSource(DataSource):
    """Format "tree": options root, rules (lines of an ignore file), hidden, partitions."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)
