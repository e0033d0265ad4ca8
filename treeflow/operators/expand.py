"""Expansion of one level: the frontier's folders joined with their listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import node_id, normalise_path
from ..schema import NODES


def child_status(kind: Column) -> Column:
    """A folder waits for its own expansion; a file needs none."""
    return F.when(kind == "folder", F.lit("pending")).otherwise(F.lit("successful"))


def root_node(side: str, listing: DataFrame) -> DataFrame:
    """The pending root of a side, named by its listing."""
    root = listing.where(F.col("path") == "/").limit(1)
    return as_nodes(root, side, F.lit(""), F.lit(""), F.lit(0), F.lit("pending"), F.lit(""))


def as_nodes(rows: DataFrame, side: str, parent_id: Column, parent_service_id: Column, depth: Column, status: Column, copy_status: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """Listing rows as node rows, with ``more`` of their columns; folders have no size."""
    return rows.select(
        F.lit(side).alias("side"), node_id(side, F.col("path")).alias("id"), "service_id", parent_id.alias("parent_id"), parent_service_id.alias("parent_service_id"),
        F.when(F.col("path") == "/", F.lit("")).otherwise(normalise_path(F.col("parent_path"))).alias("parent_path"), "name", "path", "type",
        F.when(F.col("type") == "folder", F.lit(None)).otherwise(F.coalesce("size", F.lit(0))).cast("long").alias("size"), "mtime", depth.cast("int").alias("depth"),
        status.alias("traversal_status"), copy_status.alias("copy_status"), F.lit(False).alias("explicit_excluded"), F.lit(False).alias("inherited_excluded"), *more,
    ).select(*[f.name for f in NODES], *more)


def frontier(nodes: DataFrame) -> DataFrame:
    """Pending folders."""
    return nodes.where((F.col("traversal_status") == "pending") & (F.col("type") == "folder"))


def expand(folders: DataFrame, listing: DataFrame, side: str) -> DataFrame:
    """Children of ``folders`` as node rows one level below; depths and parents come from the frontier, not the listing."""
    parents = folders.select(F.col("service_id").alias("_ps"), F.col("id").alias("_pid"), F.col("depth").alias("_pd"))
    rows = listing.join(parents, listing["parent_service_id"] == F.col("_ps")).where(F.col("path") != "/")
    copy = F.lit("pending") if side == "SRC" else F.lit("")
    return as_nodes(rows, side, F.col("_pid"), F.col("_ps"), F.col("_pd") + 1, child_status(F.col("type")), copy)


def as_tasks(nodes: DataFrame) -> DataFrame:
    """Nodes as work items: the folder's or file's own service id, its kind, path and round."""
    kind = F.col("type")
    return nodes.select(
        "id", F.when(kind == "folder", F.col("service_id")).otherwise(F.lit("")).alias("folder_id"), F.when(kind == "file", F.col("service_id")).otherwise(F.lit("")).alias("file_id"),
        "side", "name", "path", "parent_path", "parent_service_id", "mtime", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("depth").alias("round"),
    )


def task_identifier(folder_id: Column, file_id: Column) -> Column:
    return F.coalesce(F.nullif(folder_id, F.lit("")), F.nullif(file_id, F.lit("")), F.lit(""))


def from_tasks(tasks: DataFrame) -> DataFrame:
    """Work items as nodes: a given id stays, folders have size 0, the depth is the round; the parent is found later."""
    folder = F.col("folder_id") != ""
    made = node_id(F.col("side"), F.col("path"))
    return tasks.select(
        "side", F.coalesce(F.nullif(F.col("id"), F.lit("")), made).alias("id"), task_identifier(F.col("folder_id"), F.col("file_id")).alias("service_id"), F.lit("").alias("parent_id"), "parent_service_id",
        normalise_path(F.col("parent_path")).alias("parent_path"), "name", "path", F.when(folder, "folder").otherwise("file").alias("type"), F.when(folder, F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"),
        "mtime", F.col("round").cast("int").alias("depth"),
    )


def normalise_root(roots: DataFrame, now: Column) -> DataFrame:
    """Roots as the loop needs them: a service id (an error without one), its name or else the id, path ``/``, a folder."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return roots.select(
        F.when(empty("service_id"), F.raise_error(F.lit("a root needs a service id"))).otherwise(F.col("service_id")).alias("service_id"), F.when(empty("name"), F.col("service_id")).otherwise(F.col("name")).alias("name"),
        F.lit("/").alias("path"), F.lit("").alias("parent_path"), F.lit("folder").alias("type"), F.when(empty("mtime"), now).otherwise(F.col("mtime")).alias("mtime"),
    )
