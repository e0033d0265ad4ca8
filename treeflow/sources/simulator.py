"""A simulated tree: a parameterised random tree, the same for the same seed, generated level by level in Spark."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import child_path

MTIME = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class TreeSpec:
    max_depth: int = 4
    min_folders: int = 4
    max_folders: int = 8
    min_files: int = 10
    max_files: int = 20
    seed: int = 0
    #: Share of nodes that the second world holds.
    presence: float = 0.9


def _draw(path: Column, salt: str, seed: int, low: int, high: int) -> Column:
    return F.lit(low) + F.pmod(F.xxhash64(path, F.lit(salt), F.lit(seed)), F.lit(high - low + 1)).cast("int")


def listing(spark: SparkSession, spec: TreeSpec = TreeSpec(), world: str = "primary") -> DataFrame:
    """Listing rows of a world: ``primary`` has all nodes, ``s1`` a share ``presence`` of them (and what is below)."""
    level = spark.range(1).select(F.lit("/").alias("path"), F.lit("").alias("parent_path"), F.lit("").alias("name"), F.lit("folder").alias("type"), F.lit(None).cast("long").alias("size"))
    levels = [level]
    for _ in range(spec.max_depth):
        folders = level.where("type = 'folder'").select(F.col("path").alias("p"))
        kids = []
        for kind, letter, low, high in (("folder", "d", spec.min_folders, spec.max_folders), ("file", "f", spec.min_files, spec.max_files)):
            numbered = folders.select("p", F.explode(F.sequence(F.lit(1), _draw(F.col("p"), kind, spec.seed, low, high))).alias("i"))
            name = F.concat(F.lit(letter), F.col("i"))
            size = _draw(child_path(F.col("p"), name), "size", spec.seed, 0, 1 << 20).cast("long") if kind == "file" else F.lit(None).cast("long")
            kids.append(numbered.select(child_path(F.col("p"), name).alias("path"), F.col("p").alias("parent_path"), name.alias("name"), F.lit(kind).alias("type"), size.alias("size")))
        level = kids[0].unionByName(kids[1])
        levels.append(level)
    out = reduce(DataFrame.unionByName, levels)
    if world != "primary":
        keep = F.pmod(F.xxhash64("path", F.lit("world"), F.lit(spec.seed)), F.lit(1000)) < int(spec.presence * 1000)
        out = out.where((F.col("path") == "/") | keep)
    return out.select(F.col("path").alias("service_id"), F.col("parent_path").alias("parent_service_id"), "parent_path", "path", "name", "type", "size", F.lit(MTIME).alias("mtime"))
