"""Changes of state as functions from tables to tables; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp
from ..plans.store import few
from .lookups import last_by_key


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of the same key; of several new rows of a key one stays."""
    new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key isn't there yet are added (idempotent seeding)."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def delete(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(few(ids.select("id").distinct()), "id", "left_anti").select(*nodes.columns)


def delete_pairs(pairs: DataFrame, ids: DataFrame, side: str) -> DataFrame:
    """Pairs without those of ``ids``; where ids follow from paths that both tables have (``pairs_of``), by these."""
    key, path = ("src_id", "src_path") if side == "SRC" else ("dst_id", "dst_path")
    if path in pairs.columns and "path" in ids.columns:
        return pairs.join(ids.select(F.col("path").alias(path)), path, "left_anti").select(*pairs.columns)
    return pairs.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(*pairs.columns)


def transition(nodes: DataFrame, ids: DataFrame, new: str, old: str | None = None, column: str = "traversal_status") -> DataFrame:
    """Set a status for the ids given; ids that don't exist are skipped. With ``old``, only where that is the status now."""
    hit = nodes.join(few(ids.select("id", F.lit(True).alias("_hit")).distinct()), "id", "left")
    change = F.coalesce(F.col("_hit"), F.lit(False))
    if old is not None:
        change = change & (F.col(column) == old)
    return hit.withColumn(column, F.when(change, F.lit(new)).otherwise(F.col(column))).select(*nodes.columns)


def transition_one(nodes: DataFrame, key: str, new: str, column: str = "traversal_status") -> DataFrame:
    """Set one node's status; raises if there is no such node."""
    if nodes.where(F.col("id") == key).isEmpty():
        raise KeyError(key)
    return nodes.withColumn(column, F.when(F.col("id") == key, F.lit(new)).otherwise(F.col(column)))


def set_statuses(nodes: DataFrame, changes: DataFrame, column: str = "traversal_status") -> DataFrame:
    """``changes``: ``id, status``, one row an id."""
    out = nodes.join(changes.select("id", F.col("status").alias("_new")), "id", "left")
    return out.withColumn(column, F.coalesce("_new", column)).select(*nodes.columns)


def put_pairs(pairs: DataFrame, new: DataFrame, order: str = "seq", keys: tuple[str, str] = ("src_id", "dst_id")) -> DataFrame:
    """Pairs with new ones; the last writer wins on either side, so pairs stay one to one. ``new`` has ``order``; the old
    pairs come before it. ``keys``: what names the two sides, ids or paths."""
    a, b = keys
    both = pairs.select(a, b, F.lit(-1).cast("long").alias(order)).unionByName(new.select(a, b, F.col(order).cast("long").alias(order)))
    return last_by_key(last_by_key(both, a, order), b, order).select(a, b)


def set_excluded(nodes: DataFrame, ids: DataFrame, value: bool = True, column: str = "explicit_excluded") -> DataFrame:
    hit = nodes.join(few(ids.select("id", F.lit(True).alias("_hit")).distinct()), "id", "left")
    return hit.withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).select(*nodes.columns)


def attempts(folders: DataFrame, failures: str, most: int = 3) -> DataFrame:
    """Outcome of listing with retries: ``failures`` names the column of how often a folder's listing fails before it works
    (null: always). At most ``most`` attempts are made, at least one."""
    most = max(1, most)
    ok = F.coalesce(F.col(failures) < most, F.lit(False))
    return folders.withColumns({"attempts": F.when(ok, F.col(failures) + 1).otherwise(F.lit(most)).cast("int"), "outcome": F.when(ok, F.lit("successful")).otherwise(F.lit("failed"))})


def apply_deltas(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts with deltas added; counts never fall below 0, and rows of 0 go."""
    both = stats.select("bucket_path", F.col("count").alias("d")).unionByName(deltas.select("bucket_path", F.col("delta").alias("d")))
    return both.groupBy("bucket_path").agg(clamp(F.sum("d")).cast("long").alias("count")).where("count <> 0")
