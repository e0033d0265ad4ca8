"""Scans and lookups over node, pair and log tables. Each is a filter or an equi-join; limits are part of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import level_index, path_hash


def status_scan(nodes: DataFrame, depth: int, status: str, limit: int | None = None) -> DataFrame:
    """Nodes of one level and status in id order."""
    out = nodes.where((F.col("depth") == depth) & (F.col("traversal_status") == status)).orderBy("id")
    return out.limit(limit) if limit is not None else out


def node_scan(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    out = nodes.orderBy("id")
    return out.limit(limit) if limit is not None else out


def level_scan(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.where(F.col("depth") == depth)


def pending_folders(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    out = nodes.where("traversal_status = 'pending' AND type = 'folder'")
    return out if depth is None else out.where(F.col("depth") == depth)


def exists(nodes: DataFrame) -> bool:
    return not nodes.limit(1).isEmpty()


def by_id(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.where(F.col("id") == key)


def by_path(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == path)


def by_path_hash(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(path_hash(F.col("path")) == F.sha2(F.lit(path), 256))


def by_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Ids of the paths found."""
    hashed = paths.select(path_hash(F.col("path")).alias("path_hash")).distinct()
    return nodes.select("id", "path", path_hash(F.col("path")).alias("path_hash")).join(hashed, "path_hash")


def root(nodes: DataFrame) -> DataFrame:
    return nodes.where("depth = 0")


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_semi").select(*nodes.columns)


def excluded(nodes: DataFrame) -> DataFrame:
    return nodes.where("explicit_excluded OR inherited_excluded")


def top_level_folders(nodes: DataFrame) -> DataFrame:
    return nodes.where("depth = 1 AND type = 'folder'")


def partner(pairs: DataFrame, ids: DataFrame, of: str = "SRC") -> DataFrame:
    """The other side's id for each id; empty where there is none."""
    mine, other = ("src_id", "dst_id") if of == "SRC" else ("dst_id", "src_id")
    return ids.select("id").join(pairs.select(F.col(mine).alias("id"), F.col(other).alias("other_id")), "id", "left").withColumn("other_id", F.coalesce("other_id", F.lit("")))


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of the children of the ids given."""
    return nodes.join(parents.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select(*nodes.columns)


def child_lists(nodes: DataFrame) -> DataFrame:
    """``parent_id, child_ids``: a JSON list in id order for each parent."""
    return nodes.where("parent_id <> ''").groupBy("parent_id").agg(F.to_json(F.sort_array(F.collect_list("id"))).alias("child_ids"))


def owning_side(src: DataFrame, dst: DataFrame, ids: DataFrame) -> DataFrame:
    """The side of each id, the source first."""
    both = src.select("id", F.lit(1).alias("o")).unionByName(dst.select("id", F.lit(2).alias("o"))).groupBy("id").agg(F.min("o").alias("o"))
    return ids.select("id").distinct().join(both, "id").select("id", F.when(F.col("o") == 1, F.lit("SRC")).otherwise(F.lit("DST")).alias("side"))


def sample(nodes: DataFrame, n: int = 100) -> DataFrame:
    """``n`` nodes by the order of a hash of their ids: the same ones each time."""
    return nodes.orderBy(F.sha2("id", 256)).limit(n)


def fresh(rows: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't taken yet."""
    return rows.join(taken.select(key).distinct(), key, "left_anti").select(*rows.columns)


def not_stale(rows: DataFrame, depth: int) -> DataFrame:
    return rows.where(F.col("depth") >= depth)


def logs_from(logs: DataFrame, least: str) -> DataFrame:
    """Log rows of at least a level; unknown levels are dropped."""
    return logs.where(level_index(F.col("level")) >= level_index(F.lit(least)))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row for each key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
