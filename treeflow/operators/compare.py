"""Comparison of one level of the destination with the source, by (parent, type, name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import newer, node_id


def one_each(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: that of the smallest id."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where("_n = 1").drop("_n")


def expected_children(matched: DataFrame, src_nodes: DataFrame) -> DataFrame:
    """Source children of the destination folders in ``matched`` (``dst_id, src_id``); folders without a pair expect none."""
    if "src_path" in matched.columns:  # ids follow from paths
        folders = matched.where("type = 'folder'").select(F.col("src_path").alias("parent_path"), "dst_path")
        kids = src_nodes.where("path <> '/'").select("parent_path", "path", "type", "name", "mtime").join(folders, "parent_path")
        return kids.select(node_id("DST", F.col("dst_path")).alias("dst_id"), node_id("SRC", F.col("parent_path")).alias("src_id"), node_id("SRC", F.col("path")).alias("child_id"), "type", "name", "mtime")
    kids = src_nodes.select(F.col("parent_id").alias("src_id"), F.col("id").alias("child_id"), "type", "name", "mtime")
    return matched.select("dst_id", "src_id").join(kids, "src_id")


def compare_level(actual: DataFrame, matched: DataFrame, src_nodes: DataFrame) -> DataFrame:
    """``actual`` (destination children) with ``match_id``, ``src_copy`` and their status.

    A match continues as pending (folder) or is done (file) and tells the source's copy status: a folder is there; a file
    counts as copied if the destination's is strictly newer. What the source doesn't have is ``not_on_src``. Names match
    within a type only; of equal names under one parent the smallest id counts.
    """
    expected = expected_children(matched, src_nodes)
    expected = expected.withColumn("_n", F.row_number().over(Window.partitionBy("dst_id", "type", "name").orderBy("child_id"))).where("_n = 1")
    expected = expected.select(F.col("dst_id").alias("parent_id"), "type", "name", F.col("child_id").alias("match_id"), F.col("mtime").alias("src_mtime"))
    out = one_each(actual, "parent_id", "type", "name").join(expected, ["parent_id", "type", "name"], "left")
    hit, folder = F.col("match_id").isNotNull(), F.col("type") == "folder"
    return out.withColumns({
        "traversal_status": F.when(~hit, F.lit("not_on_src")).when(folder, F.lit("pending")).otherwise(F.lit("successful")),
        "src_copy": F.when(hit & folder, F.lit("successful")).when(hit, F.when(newer(F.col("mtime"), F.col("src_mtime")), F.lit("successful")).otherwise(F.lit("pending"))),
    }).drop("src_mtime")


def missing_on_dst(src_nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Source nodes below the root without a counterpart."""
    return src_nodes.where("depth > 0").join(pairs, src_nodes["id"] == pairs["src_id"], "left_anti")
