"""Counts and reports over node tables. Each is one aggregate; none depends on cached counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket_path, level_name

STATUSES = ("pending", "successful", "failed", "not_on_src", "excluded")


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("side").agg(F.count("*").alias("nodes"))


def status_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("side", "depth", "traversal_status").agg(F.count("*").alias("nodes"))


def copy_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type", "copy_status").agg(F.count("*").alias("nodes"))


def bucket_stats(nodes: DataFrame, pairs: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """``bucket_path, count``: nodes, status, copy status and children buckets of each side, and the pair maps. ``parents``: ``side`` and
    the number ``n`` of its nodes with children, where that is counted already."""
    level = level_name(F.col("depth"))
    parts = [
        nodes.select(bucket_path("Traversal-Data", F.col("side"), "nodes").alias("bucket_path")),
        nodes.select(bucket_path("Traversal-Data", F.col("side"), "levels", level, "traversal", F.col("traversal_status"))),
        nodes.where("side = 'SRC' AND copy_status <> ''").select(bucket_path("Traversal-Data", F.col("side"), "levels", level, "copy", F.col("copy_status"))),
        None if parents is not None else nodes.where("parent_id <> ''").select("side", "parent_id").distinct().select(bucket_path("Traversal-Data", F.col("side"), "children")),
        pairs.select(F.lit("Traversal-Data/SRC/src-to-dst")), pairs.select(F.lit("Traversal-Data/DST/dst-to-src")),
    ]
    counted = [p.toDF("bucket_path").groupBy("bucket_path").agg(F.count("*").alias("count")) for p in parts if p is not None]
    if parents is not None:
        counted.append(parents.groupBy(bucket_path("Traversal-Data", F.col("side"), "children").alias("bucket_path")).agg(F.sum("n").alias("count")))
    out = counted[0]
    for p in counted[1:]:
        out = out.unionByName(p)
    return out


def migration_status(nodes: DataFrame) -> DataFrame:
    """One row: totals, pending, failed and smallest pending depth of each side."""
    def of(side: str):
        mine = F.col("side") == side
        low = side.lower()
        return [
            F.count_if(mine).alias(f"{low}_total"), F.count_if(mine & (F.col("traversal_status") == "pending")).alias(f"{low}_pending"),
            F.count_if(mine & (F.col("traversal_status") == "failed")).alias(f"{low}_failed"), F.min(F.when(mine & (F.col("traversal_status") == "pending"), F.col("depth"))).alias(f"{low}_min_pending_depth"),
        ]

    return nodes.agg(*of("SRC"), *of("DST"))


def status_flags(nodes: DataFrame) -> DataFrame:
    s = migration_status(nodes)
    pending = F.col("src_pending") + F.col("dst_pending")
    total = F.col("src_total") + F.col("dst_total")
    return s.select((total == 0).alias("empty"), (pending > 0).alias("has_pending"), (F.col("src_failed") + F.col("dst_failed") > 0).alias("has_failed"), ((total > 0) & (pending == 0)).alias("complete"))


def verification(nodes: DataFrame, allow_pending: bool = False, allow_not_on_src: bool = False) -> DataFrame:
    """One row: totals, pending, failed, not on source; success by the allow-flags. Failures don't fail it."""
    s = nodes.agg(
        F.count_if(F.col("side") == "SRC").alias("src_total"), F.count_if(F.col("side") == "DST").alias("dst_total"), F.count_if(F.col("traversal_status") == "pending").alias("pending"),
        F.count_if(F.col("traversal_status") == "failed").alias("failed"), F.count_if((F.col("side") == "DST") & (F.col("traversal_status") == "not_on_src")).alias("not_on_src"),
    )
    return s.withColumn("success", (F.lit(allow_pending) | (F.col("pending") == 0)) & (F.lit(allow_not_on_src) | (F.col("not_on_src") == 0)))


def min_pending_level(nodes: DataFrame) -> DataFrame:
    pending = F.when(F.col("traversal_status") == "pending", F.col("depth"))
    return nodes.groupBy("side").agg(F.coalesce(F.min(pending), F.lit(-1)).alias("level"))


def levels(nodes: DataFrame) -> DataFrame:
    return nodes.select("side", "depth").distinct()


def max_depth(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.coalesce(F.max("depth"), F.lit(-1)).alias("max_depth"))


def level_pivot(nodes: DataFrame) -> DataFrame:
    """Side and level by status, with totals for each row, each side and all (null level, null side)."""
    wide = [F.count_if(F.col("traversal_status") == s).alias(s) for s in STATUSES]
    return nodes.rollup("side", "depth").agg(*wide, F.count("*").alias("total"))


def source_parity(nodes: DataFrame, listing: DataFrame) -> DataFrame:
    """Source nodes, listed entries and their difference."""
    both = nodes.where("side = 'SRC'").select(F.lit(1).alias("n"), F.lit(0).alias("l")).unionByName(listing.select(F.lit(0).alias("n"), F.lit(1).alias("l")))
    return both.agg(F.sum("n").alias("nodes"), F.sum("l").alias("listed"), (F.sum("n") - F.sum("l")).alias("difference"))


def discovery(nodes: DataFrame) -> DataFrame:
    """Files and folders found by round, and running totals (a window over as many rows as there are levels)."""
    by = nodes.groupBy("side", "depth").agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "folder").alias("folders"))
    w = Window.partitionBy("side").orderBy("depth")
    return by.select("side", "depth", "files", "folders", F.sum("files").over(w).alias("files_total"), F.sum("folders").over(w).alias("folders_total"))


def round_stats(nodes: DataFrame) -> DataFrame:
    """Expected and completed work of each round: the folders of a level, on the destination only those with a pair."""
    folders = nodes.where("type = 'folder' AND traversal_status <> 'not_on_src'")
    return folders.groupBy("side", "depth").agg(F.count("*").alias("expected"), F.count_if(F.col("traversal_status").isin("successful", "failed")).alias("completed"), F.count_if(F.col("traversal_status") == "failed").alias("failed"))


def summary(nodes: DataFrame) -> DataFrame:
    """Totals a side; ``successful`` is what is neither pending nor failed."""
    s = nodes.groupBy("side").agg(F.count("*").alias("total"), F.count_if(F.col("traversal_status") == "pending").alias("pending"), F.count_if(F.col("traversal_status") == "failed").alias("failed"))
    return s.withColumn("successful", F.col("total") - F.col("pending") - F.col("failed"))


def parity(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys whose counts differ between two tables."""
    a = left.groupBy(*keys).agg(F.count("*").alias("left_count"))
    b = right.groupBy(*keys).agg(F.count("*").alias("right_count"))
    out = a.join(b, list(keys), "full_outer").na.fill(0, ["left_count", "right_count"])
    return out.where("left_count <> right_count")


def bucket_counts(stats: DataFrame, paths: DataFrame) -> DataFrame:
    """The counts of the buckets asked for (``bucket_path``); 0 for one that isn't there."""
    return paths.select("bucket_path").join(stats.select("bucket_path", "count"), "bucket_path", "left").select("bucket_path", F.coalesce("count", F.lit(0)).alias("count"))


def by_path(stats: DataFrame) -> DataFrame:
    """Bucket counts in the order of their paths."""
    return stats.orderBy("bucket_path")


def round_totals(rounds: DataFrame) -> DataFrame:
    """Expected, completed and failed work of each side over all its rounds (``round_stats``)."""
    return rounds.groupBy("side").agg(F.count("*").alias("rounds"), *[F.sum(c).alias(c) for c in ("expected", "completed", "failed")])
