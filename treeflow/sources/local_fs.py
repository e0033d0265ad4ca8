"""Listing of a directory tree that all executors can see, as a Python data source: ``spark.read.format("treeflow_fs")``.

Top-level directories are partitions; each is walked with ``os.scandir``. Links aren't followed. Listing a directory is tried
``attempts`` times; one that can't be read has the reason in ``error`` and no children, so that a run can mark it as failed.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import LISTING, require

PAUSE = 0.1


class _Top(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, attempts: int = 1):
        self.root, self.attempts = os.path.abspath(root), max(1, attempts)

    def partitions(self):
        with os.scandir(self.root) as entries:
            tops = sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
        return [_Top(self.root, False), *(_Top(t, True) for t in tops)]

    def _entries(self, path: str) -> tuple[list, str | None]:
        """What is in a directory, and why it couldn't be read."""
        for left in range(self.attempts - 1, -1, -1):
            try:
                with os.scandir(path) as entries:
                    return sorted(entries, key=lambda e: e.name), None
            except OSError as e:
                reason = e.strerror or type(e).__name__
                if left:
                    time.sleep(PAUSE)
        return [], reason

    def _row(self, path: str, is_dir: bool, info, error: str | None = None) -> tuple:
        rel = os.path.relpath(path, self.root)
        own = "/" if rel == "." else "/" + rel.replace(os.sep, "/")
        parent = "" if own == "/" else os.path.dirname(own)
        mtime = datetime.fromtimestamp(int(info.st_mtime), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        return own, parent, parent, own, "" if own == "/" else os.path.basename(path), "folder" if is_dir else "file", None if is_dir else info.st_size, mtime, error

    def read(self, partition: _Top) -> Iterator[tuple]:
        open_dirs = [partition.path]
        while open_dirs:
            here = open_dirs.pop()
            entries, error = self._entries(here)
            yield self._row(here, True, os.stat(here, follow_symlinks=False), error)
            for e in entries:
                if not e.is_dir(follow_symlinks=False):
                    yield self._row(e.path, False, e.stat(follow_symlinks=False))
                elif partition.deep:
                    open_dirs.append(e.path)


class LocalTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treeflow_fs"

    def schema(self):
        return StructType([*LISTING.fields, StructField("error", StringType())])

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("the option path is missing")
        return _Reader(self.options["path"], int(self.options.get("attempts", 1)))


def listing(spark: SparkSession, root: str, attempts: int = 1) -> DataFrame:
    spark.dataSource.register(LocalTree)
    return spark.read.format("treeflow_fs").option("path", root).option("attempts", attempts).load()


def open_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    """A listing by the name of its adapter; raises for an unknown one."""
    from . import simulator, star_tree

    kind = service_type({"kind": kind})
    if kind == "local":
        return listing(spark, options["root"], options.get("attempts", 1))
    if kind == "simulator":
        world = options.pop("world", "primary")
        return simulator.listing(spark, simulator.TreeSpec(**options), world)
    if kind == "star":
        return (star_tree.src_listing if options.get("side", "SRC") == "SRC" else star_tree.dst_listing)(spark, options["sf_dir"])
    if kind == "parquet":
        listed = spark.read.parquet(options["path"])
        require(listed, LISTING)  # more columns, such as ``error``, may follow
        return listed
    raise ValueError(f"unsupported adapter: {kind}")


def service_type(options: dict | None) -> str:
    """The kind of service that an adapter's options name; unknown without any."""
    return str((options or {}).get("kind") or "unknown").lower()


def same_service(a: dict | None, b: dict | None) -> bool:
    """Whether two adapters share one simulated service; directories and tables are never taken for one."""
    return service_type(a) == service_type(b) == "simulator"
