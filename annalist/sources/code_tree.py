"""A source tree on disk as rows (SRC7). Spark's file sources skip names that begin with a dot or underscore; this one doesn't."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Part(InputPartition):
    """A directory that a task walks, or the files beside it."""

    def __init__(self, paths: list[str], walk: bool):
        self.paths, self.walk = paths, walk


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.depth = options["path"], int(options.get("depth", "2"))

    def partitions(self) -> list[_Part]:
        """The directories `depth` levels down, and the files above them; the driver looks no deeper."""
        parts, here = [], [self.root]
        for _ in range(self.depth):
            below = []
            for d in here:
                with os.scandir(d) as entries:
                    own = sorted(entries, key=lambda e: e.name)
                below += [e.path for e in own if e.is_dir(follow_symlinks=False)]
                files = [e.path for e in own if e.is_file()]
                parts += [_Part(files, False)] if files else []
            here = below
        return [*parts, *(_Part([d], True) for d in here)] or [_Part([], False)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for top in partition.paths:
            paths = (os.path.join(d, f) for d, dirs, files in os.walk(top) if dirs.sort() is None for f in sorted(files)) if partition.walk else (top,)
            for p in paths:
                with open(p, "rb") as f:
                    yield os.path.relpath(p, self.root), f.read().decode("utf-8", "replace")


class CodeTree(DataSource):
    """spark.dataSource.register(CodeTree); spark.read.format("code_tree").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return "file_path string, content string"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)
