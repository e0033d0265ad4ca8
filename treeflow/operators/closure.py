"""Subtrees: everything below some nodes, by their paths; level by level in tables that have only parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import path_depth
from ..plans.store import few, written


def descendants(nodes: DataFrame, roots: DataFrame, keep_roots: bool = True) -> DataFrame:
    """``id, root_id, distance`` of the nodes below ``roots`` (``id``), any depth. Paths are cut at each depth that roots have
    and joined with them, so there is one join for each of these depths, however deep the subtrees are; nodes are on the
    side of their root, and below several roots if these hang below one another. Tables without paths are followed by parents."""
    if "path" not in nodes.columns:
        return _by_parents(nodes, roots, keep_roots)
    return _inside(nodes, roots, keep_roots).select("id", "root_id", "distance")


def _inside(nodes: DataFrame, roots: DataFrame, keep_roots: bool, *more: str) -> DataFrame:
    """``id, root_id, distance`` and ``more`` columns of the nodes below ``roots``. Few roots are sent to all tasks."""
    tops = nodes.join(few(roots.select("id").distinct()), "id", "left_semi").select("side", F.col("id").alias("root_id"), F.col("path").alias("_top"), *[F.col(c).alias(f"_{c}") for c in more])
    tops = written(tops, "tops")
    rows = nodes.select("side", "id", "path", path_depth(F.col("path")).alias("_at"), *more)
    parts = []
    for depth in _depths(tops, "_top"):
        inside = rows.where(F.col("_at") > depth).select("side", "id", _cut("path", depth).alias("_top"), (F.col("_at") - depth).alias("distance"), *more)
        own = few(tops.where(path_depth(F.col("_top")) == depth).select("side", "root_id", "_top").distinct())
        parts.append(inside.join(own, ["side", "_top"]).select("id", "root_id", "distance", *more))
    if keep_roots or not parts:
        own = tops.select(F.col("root_id").alias("id"), "root_id", F.lit(0).alias("distance"), *[F.col(f"_{c}").alias(c) for c in more])
        parts.append(own if keep_roots else own.limit(0))
    return reduce(DataFrame.unionByName, parts)


def _depths(tops: DataFrame, path: str) -> list[int]:
    return sorted(d for (d,) in tops.select(path_depth(F.col(path))).distinct().collect())  # at most a row a level


def _cut(path: str, depth: int) -> Column:
    return F.lit("/") if depth == 0 else F.substring_index(path, "/", depth + 1)


def marked_below(rows: DataFrame, tops: DataFrame, mark: str, path: str = "path") -> DataFrame:
    """``rows`` with a boolean ``mark``: whether ``path`` is below a path of ``tops`` (``_top``, and ``side`` if it matters; written).
    Few tops are sent to all tasks, so rows stay where they are."""
    sides = [c for c in tops.columns if c == "side"]
    found = F.lit(False)
    for i, depth in enumerate(_depths(tops, "_top")):
        own = few(tops.where(path_depth(F.col("_top")) == depth).distinct()).select(F.col("_top").alias(f"_top{i}"), *[F.col(c).alias(f"_side{i}") for c in sides], F.lit(True).alias(f"_in{i}"))
        here = (path_depth(F.col(path)) > depth) & (_cut(path, depth) == F.col(f"_top{i}"))
        for c in sides:
            here = here & (F.col(c) == F.col(f"_side{i}"))
        rows = rows.join(own, here, "left").drop(f"_top{i}", f"_side{i}")
        found = found | F.coalesce(f"_in{i}", F.lit(False))
    rows = rows.withColumn(mark, found)
    return rows.drop(*[c for c in rows.columns if c.startswith("_in") and c[3:].isdigit()])


def _by_parents(nodes: DataFrame, roots: DataFrame, keep_roots: bool) -> DataFrame:
    """The same by ``parent_id``. Each level and what was met so far are written, so plans don't grow; a node that is met
    again isn't followed (no endless loops in broken trees)."""
    edges = nodes.select("id", "parent_id")
    level = written(roots.select("id", F.col("id").alias("root_id"), F.lit(0).alias("distance")).distinct(), "closure")
    met = level
    while not level.isEmpty():
        kids = edges.join(level.select(F.col("id").alias("parent_id"), "root_id", "distance"), "parent_id").select("id", "root_id", (F.col("distance") + 1).alias("distance"))
        level = written(kids.distinct().join(met.select("id", "root_id"), ["id", "root_id"], "left_anti"), "closure")
        met = written(met.unionByName(level), "met")
    return met if keep_roots else met.where("distance > 0")


def subtree_stats(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes, folders, files, excluded nodes and largest relative depth of each root's subtree."""
    if "path" in nodes.columns:
        rows = _inside(nodes, roots, True, "type", "explicit_excluded", "inherited_excluded")
    else:
        rows = nodes.join(descendants(nodes, roots), "id")
    return rows.groupBy("root_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("type") == "folder").alias("folders"), F.count_if(F.col("type") == "file").alias("files"),
        F.count_if(F.col("explicit_excluded") | F.col("inherited_excluded")).alias("excluded"), F.max("distance").alias("max_depth"),
    )


def delete_subtree(nodes: DataFrame, roots: DataFrame, keep_roots: bool = True) -> DataFrame:
    """``nodes`` without what is below ``roots``, and without the roots unless they are kept."""
    if "path" not in nodes.columns:
        return nodes.join(descendants(nodes, roots, keep_roots=not keep_roots).select("id").distinct(), "id", "left_anti").select(*nodes.columns)
    roots = few(roots.select("id").distinct())
    tops = written(nodes.join(roots, "id", "left_semi").select("side", F.col("path").alias("_top")), "tops")
    out = marked_below(nodes, tops, "_gone").where("NOT _gone")
    return (out if keep_roots else out.join(roots, "id", "left_anti")).select(*nodes.columns)


def inherit_exclusion(nodes: DataFrame) -> DataFrame:
    """``inherited_excluded`` anew: true below an explicitly excluded node. This also serves un-exclusion."""
    if "path" not in nodes.columns:
        below = descendants(nodes, nodes.where("explicit_excluded").select("id"), keep_roots=False).select("id", F.lit(True).alias("_in")).distinct()
        return nodes.drop("inherited_excluded").join(below, "id", "left").withColumn("inherited_excluded", F.coalesce("_in", F.lit(False))).select(*nodes.columns)
    tops = written(nodes.where("explicit_excluded").select("side", F.col("path").alias("_top")), "tops")
    return marked_below(nodes.drop("inherited_excluded"), tops, "inherited_excluded").select(*nodes.columns)
