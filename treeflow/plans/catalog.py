"""Names of the reconciliation queries, each with its callable and, where SQL can say it, its oracle.

The two trees of a data set are expanded and compared once a session; the written state serves all queries on it, as a
state database does.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import closure, compare, etl, expand, logs, lookups, metrics, retry, state, stats
from ..schema import LOGS, QUEUE_STATS
from ..sources import star_tree
from . import engine
from .store import passes, written

QUERIES: dict = {}
ORACLES: dict = {}
_STATES: dict = {}


def reconciled(spark: SparkSession, sf_dir: str, fresh: bool = False) -> engine.State:
    key = (spark.sparkContext.applicationId, sf_dir)
    if fresh or key not in _STATES:
        s = engine.reconcile(star_tree.src_listing(spark, sf_dir), star_tree.dst_listing(spark, sf_dir))
        _STATES[key] = s if s.both is not None else engine.State(written(s.src, "src"), written(s.dst, "dst"), written(s.pairs, "pairs"), s.rounds)
    return _STATES[key]


def _paired(s: engine.State, side: str, lists: bool = False) -> DataFrame:
    """A side's nodes with ``other_id``, ``other_path`` and ``other_mtime`` of their pairs. A reconciled state holds pairs in a row; one that
    came by the level loop is joined."""
    if s.both is not None:
        return engine.with_partners(s.both, side, lists)
    (mine, other), (nodes, theirs) = (("src_id", "dst_id"), (s.src, s.dst)) if side == "SRC" else (("dst_id", "src_id"), (s.dst, s.src))
    theirs = theirs.select(F.col("id").alias(other), F.col("path").alias("other_path"), F.col("mtime").alias("other_mtime")).join(s.pairs, other)
    return nodes.join(theirs.withColumnsRenamed({mine: "id", other: "other_id"}), "id", "left")


def _pairs(s: engine.State) -> DataFrame:
    return s.pairs if s.both is None else engine.pairs_of(s.both)  # paths; ``engine.pair_ids`` last


def _table_of(s: engine.State, side: str) -> DataFrame:
    """A side's relational table."""
    if s.both is not None:
        return etl.to_table(_paired(s, side, lists=True), None, side)
    return etl.to_table(s.src if side == "SRC" else s.dst, s.pairs, side)


def _last_pairs(s: engine.State) -> DataFrame:
    """The pairs put again: by paths where ids follow from them."""
    if s.both is None:
        return state.put_pairs(s.pairs, s.pairs.withColumn("seq", F.lit(1)))
    pairs = engine.pairs_of(s.both)
    kept = state.put_pairs(pairs, pairs.withColumn("seq", F.lit(1)), keys=("src_path", "dst_path"))
    return engine.pair_ids(kept)


def _kept_pairs(s: engine.State) -> DataFrame:
    kept = state.delete_pairs(_pairs(s), s.src.where("depth = 5"), "SRC")
    return kept if s.both is None else engine.pair_ids(kept)


def nodes_of(s: engine.State) -> DataFrame:
    return s.src.unionByName(s.dst)


def varied(nodes: DataFrame) -> DataFrame:
    """Nodes with some statuses changed by a rule on the name, for reports on unfinished states."""
    number = F.regexp_extract("name", r"(\d+)$", 1).try_cast("long")
    folder = (F.col("type") == "folder") & (F.col("depth") >= 3) & (F.col("traversal_status") == "successful")
    status = F.when(folder & (number % 11 == 1), F.lit("pending")).when(folder & (number % 7 == 2), F.lit("failed")).otherwise(F.col("traversal_status"))
    return nodes.withColumn("traversal_status", status)


BASE = f"""
WITH RECURSIVE sl AS ({star_tree.listing_sql('SRC')}),
dl AS ({star_tree.listing_sql('DST')}),
m AS (
  SELECT path, parent_path, name, type, size, mtime, 0 AS depth, 'successful' AS st, '/' AS spath, CAST(NULL AS VARCHAR) AS scopy FROM dl WHERE path = '/'
  UNION ALL
  SELECT d.path, d.parent_path, d.name, d.type, d.size, d.mtime, m.depth + 1, CASE WHEN s.path IS NULL THEN 'not_on_src' ELSE 'successful' END, s.path,
    CASE WHEN s.path IS NULL THEN NULL WHEN d.type = 'folder' OR d.mtime > s.mtime THEN 'successful' ELSE 'pending' END
  FROM m JOIN dl d ON d.parent_path = m.path LEFT JOIN sl s ON s.parent_path = m.spath AND s.type = d.type AND s.name = d.name
  WHERE m.type = 'folder' AND m.spath IS NOT NULL),
src AS (
  SELECT 'SRC' AS side, sha256('SRC:' || s.path) AS id, s.path AS service_id, CASE WHEN s.path = '/' THEN '' ELSE sha256('SRC:' || s.parent_path) END AS parent_id,
    s.parent_path AS parent_service_id, s.parent_path, s.name, s.path, s.type, CASE WHEN s.type = 'folder' THEN NULL ELSE coalesce(s.size, 0) END AS size, s.mtime,
    CAST(s.depth AS INTEGER) AS depth, 'successful' AS traversal_status, CASE WHEN s.path = '/' THEN '' ELSE coalesce(m.scopy, 'pending') END AS copy_status,
    false AS explicit_excluded, false AS inherited_excluded
  FROM sl s LEFT JOIN m ON m.spath = s.path),
dst AS (
  SELECT 'DST' AS side, sha256('DST:' || path) AS id, path AS service_id, CASE WHEN path = '/' THEN '' ELSE sha256('DST:' || parent_path) END AS parent_id,
    parent_path AS parent_service_id, parent_path, name, path, type, CASE WHEN type = 'folder' THEN NULL ELSE coalesce(size, 0) END AS size, mtime,
    CAST(depth AS INTEGER) AS depth, st AS traversal_status, '' AS copy_status, false AS explicit_excluded, false AS inherited_excluded
  FROM m),
pairs AS (SELECT sha256('SRC:' || spath) AS src_id, sha256('DST:' || path) AS dst_id FROM m WHERE spath IS NOT NULL),
nodes AS (SELECT * FROM src UNION ALL SELECT * FROM dst),
varied AS (
  SELECT * EXCLUDE (traversal_status, num), CASE WHEN type = 'folder' AND depth >= 3 AND traversal_status = 'successful' AND num % 11 = 1 THEN 'pending'
    WHEN type = 'folder' AND depth >= 3 AND traversal_status = 'successful' AND num % 7 = 2 THEN 'failed' ELSE traversal_status END AS traversal_status
  FROM (SELECT *, TRY_CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) AS num FROM nodes))
"""
LEVEL_SQL = "CASE event_type WHEN 'view' THEN 'trace' WHEN 'click' THEN 'debug' WHEN 'signup' THEN 'info' WHEN 'purchase' THEN 'warning' WHEN 'error' THEN 'error' ELSE 'critical' END"
LOGS_SQL = f"""logs AS (SELECT CAST(event_id AS VARCHAR) AS id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z' AS timestamp, {LEVEL_SQL} AS level,
  'user' AS entity, CAST(user_id AS VARCHAR) AS entity_id, event_type AS message, CASE WHEN event_id % 2 = 0 THEN 'src' ELSE 'dst' END AS queue FROM events)"""
NODE_COLUMNS = "side, id, service_id, parent_id, parent_service_id, parent_path, name, path, type, size, mtime, depth, traversal_status, copy_status, explicit_excluded, inherited_excluded"


def query(name: str, sql: str | None = None, base: str = BASE):
    """Register a query and, with ``sql``, its oracle: ``sql`` after the common table expressions of ``base``."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{base} {sql}"
        return f

    return keep


def on_state(name: str, sql: str | None = None):
    """Register a function of (state, spark, sf_dir)."""
    return lambda f: query(name, sql)(lambda spark, sf_dir: f(reconciled(spark, sf_dir), spark, sf_dir))


def literal_paths(spark, *paths: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")


# Traversal -----------------------------------------------------------------------------------------------------------


@query("j03_copy_status_counts", "SELECT type, copy_status, count(*) AS nodes FROM src GROUP BY ALL")
def _flagship(spark, sf_dir):
    """Both trees are expanded and compared anew; the source's copy statuses are counted."""
    return stats.copy_counts(engine.reconcile(star_tree.src_listing(spark, sf_dir), star_tree.dst_listing(spark, sf_dir)).src)


@query("s03_src_listing", "SELECT path, parent_path, name, type, size, mtime, k FROM sl")
def _s03(spark, sf_dir):
    return star_tree.src_listing(spark, sf_dir).select("path", "parent_path", "name", "type", "size", "mtime", "k")


@query("s03_dst_listing", "SELECT path, parent_path, name, type, size, mtime, k FROM dl")
def _s03d(spark, sf_dir):
    return star_tree.dst_listing(spark, sf_dir).select("path", "parent_path", "name", "type", "size", "mtime", "k")


on_state("j01_src_level_counts", "SELECT depth, type, traversal_status, count(*) AS nodes FROM src GROUP BY ALL")(lambda s, *_: s.src.groupBy("depth", "type", "traversal_status").agg(F.count("*").alias("nodes")))
on_state("j01_bfs_nodes", f"SELECT {NODE_COLUMNS} FROM src")(lambda s, *_: s.src)
on_state("j03_dst_nodes", f"SELECT {NODE_COLUMNS} FROM dst")(lambda s, *_: s.dst)
on_state("s21_root_seed", "SELECT side, id, path, depth FROM nodes WHERE depth = 0")(
    lambda s, spark, sf: state.insert_missing(expand.root_node("SRC", star_tree.src_listing(spark, sf)).unionByName(expand.root_node("DST", star_tree.dst_listing(spark, sf))), s.src.where("depth = 0")).select("side", "id", "path", "depth")
)
on_state("s01_list_children", "SELECT service_id, name, type FROM src WHERE parent_path IN (SELECT path FROM src WHERE depth = 1)")(
    lambda s, spark, sf: expand.expand(s.src.where("depth = 1"), star_tree.src_listing(spark, sf), "SRC").select("service_id", "name", "type")
)
on_state("p04_child_status", "SELECT id, CASE WHEN type = 'folder' THEN 'pending' ELSE 'successful' END AS status, depth FROM src WHERE depth >= 4")(
    lambda s, spark, sf: expand.expand(s.src.where("depth >= 3 AND type = 'folder'"), star_tree.src_listing(spark, sf), "SRC").select("id", F.col("traversal_status").alias("status"), "depth")
)
on_state(
    "u16_retry_attempts",
    """SELECT id, CASE WHEN f < 3 THEN f + 1 ELSE 3 END AS attempts, CASE WHEN f < 3 THEN 'successful' ELSE 'failed' END AS outcome
       FROM (SELECT id, CAST(TRY_CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) % 5 AS INTEGER) AS f FROM src WHERE type = 'folder' AND depth >= 3)""",
)(lambda s, *_: state.attempts(s.src.where("type = 'folder' AND depth >= 3").withColumn("f", (F.regexp_extract("name", r"(\d+)$", 1).cast("long") % 5).cast("int")), "f").select("id", "attempts", "outcome"))


@on_state("t02_round_log", """
SELECT 'SRC' AS side, depth, CAST(count(*) FILTER (type = 'folder') AS BIGINT) AS expanded,
  (SELECT count(*) FROM src c WHERE c.depth = p.depth + 1) AS discovered FROM src p WHERE depth <= 4 GROUP BY depth
UNION ALL SELECT 'DST', depth, count(*) FILTER (type = 'folder' AND traversal_status <> 'not_on_src'), (SELECT count(*) FROM dst c WHERE c.depth = p.depth + 1) FROM dst p
  WHERE depth <= 4 GROUP BY depth""")
def _t02(s, spark, sf):
    return spark.createDataFrame([r for r in s.rounds], "side string, depth int, expanded long, discovered long")


@query("u16_failed_listing", "SELECT depth, traversal_status, count(*) AS nodes FROM (SELECT s.depth, CASE WHEN s.depth = 3 AND CAST(substr(s.name, 2) AS BIGINT) % 13 = 4 THEN 'failed' ELSE 'successful' END AS traversal_status FROM src s WHERE NOT EXISTS (SELECT 1 FROM src c WHERE c.depth = 3 AND CAST(substr(c.name, 2) AS BIGINT) % 13 = 4 AND s.depth > 3 AND starts_with(s.path, c.path || '/'))) GROUP BY ALL")
def _u16(spark, sf_dir):
    """Source folders whose listing fails for good: they are failed and nothing below them is found."""
    bad = lambda f: f.where((F.col("side") == "SRC") & (F.col("depth") == 3) & (F.substring("name", 2, 20).try_cast("long") % 13 == 4))
    return engine.reconcile(star_tree.src_listing(spark, sf_dir), star_tree.dst_listing(spark, sf_dir), failing=bad).src.groupBy("depth", "traversal_status").agg(F.count("*").alias("nodes"))


# Comparison ----------------------------------------------------------------------------------------------------------

on_state("j03_dst_status_by_depth", "SELECT depth, traversal_status, count(*) AS nodes FROM dst GROUP BY ALL")(lambda s, *_: s.dst.groupBy("depth", "traversal_status").agg(F.count("*").alias("nodes")))
on_state("j03_not_on_src_list", "SELECT path, type, depth FROM dst WHERE traversal_status = 'not_on_src'")(lambda s, *_: s.dst.where("traversal_status = 'not_on_src'").select("path", "type", "depth"))
on_state("j03_missing_on_dst", "SELECT path, type, depth FROM src WHERE depth > 0 AND id NOT IN (SELECT src_id FROM pairs)")(lambda s, *_: compare.missing_on_dst(s.src, s.pairs).select("path", "type", "depth"))
on_state("j02_expected_children", "SELECT p.dst_id, c.id AS child_id, c.type, c.name FROM pairs p JOIN src c ON c.parent_id = p.src_id")(lambda s, *_: compare.expected_children(_pairs(s), s.src).select("dst_id", "child_id", "type", "name"))
on_state("j05_pairs", "SELECT src_id, dst_id FROM pairs")(lambda s, *_: s.pairs)
on_state("j05_pairs_last_writer", "SELECT src_id, dst_id FROM pairs")(
    lambda s, *_: _last_pairs(s)
)
on_state("j11_copy_updates", "SELECT s.id, s.copy_status FROM src s JOIN pairs ON s.id = src_id WHERE s.depth > 0")(lambda s, *_: _paired(s, "SRC").where("depth > 0 AND other_id IS NOT NULL").select("id", "copy_status"))
on_state("x02_mtime_decision", "SELECT s.id, d.mtime > s.mtime AS dst_newer FROM src s JOIN pairs ON s.id = src_id JOIN dst d ON d.id = dst_id WHERE s.type = 'file'")(
    lambda s, *_: _paired(s, "SRC").where("type = 'file' AND other_id IS NOT NULL").select("id", scalar.newer(F.col("other_mtime"), F.col("mtime")).alias("dst_newer"))
)

# Lookups -------------------------------------------------------------------------------------------------------------

on_state("f01_status_scan_limit", "SELECT id, path FROM varied WHERE side = 'SRC' AND depth = 4 AND traversal_status = 'pending' ORDER BY id LIMIT 50")(lambda s, *_: lookups.status_scan(varied(s.src), 4, "pending", 50).select("id", "path"))
on_state("f02_node_scan_limit", "SELECT id, path FROM src ORDER BY id LIMIT 100")(lambda s, *_: lookups.node_scan(s.src, 100).select("id", "path"))
on_state("f03_level_scan", "SELECT traversal_status, count(*) AS nodes FROM varied WHERE side = 'DST' AND depth = 3 GROUP BY ALL")(lambda s, *_: lookups.level_scan(varied(s.dst), 3).groupBy("traversal_status").agg(F.count("*").alias("nodes")))
on_state("f05_pending_folders", "SELECT id, depth FROM varied WHERE traversal_status = 'pending' AND type = 'folder'")(lambda s, *_: lookups.pending_folders(varied(nodes_of(s))).select("id", "depth"))
on_state("f06_existence", "SELECT EXISTS (SELECT 1 FROM varied WHERE traversal_status = 'pending') AS has_pending, EXISTS (SELECT 1 FROM nodes WHERE traversal_status = 'failed') AS has_failed")(
    lambda s, spark, sf: spark.createDataFrame([(lookups.exists(lookups.pending_folders(varied(nodes_of(s)))), lookups.exists(nodes_of(s).where("traversal_status = 'failed'")))], "has_pending boolean, has_failed boolean")
)
on_state("f07_by_id", "SELECT path FROM src WHERE id = sha256('SRC:/ASIA')")(lambda s, *_: lookups.by_id(s.src, hashlib.sha256(b"SRC:/ASIA").hexdigest()).select("path"))
on_state("f08_path_lookup", "SELECT id FROM src WHERE path = '/EUROPE'")(lambda s, *_: lookups.by_path_hash(s.src, "/EUROPE").select("id"))
on_state("f09_path_lookup_batch", "SELECT id, path, sha256(path) AS path_hash FROM src WHERE path IN ('/ASIA', '/EUROPE', '/AFRICA', '/none')")(lambda s, spark, _: lookups.by_paths(s.src, literal_paths(spark, "/ASIA", "/EUROPE", "/AFRICA", "/none")))
on_state("f11_root", "SELECT side, id FROM nodes WHERE depth = 0")(lambda s, *_: lookups.root(nodes_of(s)).select("side", "id"))
on_state("f12_in_list", "SELECT id, name FROM src WHERE id IN (SELECT src_id FROM pairs) AND depth = 3")(lambda s, *_: lookups.by_ids(s.src.where("depth = 3"), s.pairs.select(F.col("src_id").alias("id"))).select("id", "name"))
on_state("f13_null_filter", "SELECT count(*) AS unpaired FROM src LEFT JOIN pairs ON id = src_id WHERE dst_id IS NULL")(lambda s, *_: s.src.join(s.pairs, F.col("id") == F.col("src_id"), "left").where(F.col("dst_id").isNull()).agg(F.count("*").alias("unpaired")))
on_state("f18_fresh_rows", "SELECT id FROM src WHERE depth = 4 AND parent_id NOT IN (SELECT src_id FROM pairs)")(lambda s, *_: lookups.fresh(s.src.where("depth = 4").select("id", "parent_id"), s.pairs.select(F.col("src_id").alias("parent_id")), "parent_id").select("id"))
on_state("f19_stale_round", "SELECT id FROM varied WHERE traversal_status = 'pending' AND depth >= 4")(lambda s, *_: lookups.not_stale(lookups.pending_folders(varied(nodes_of(s))), 4).select("id"))
on_state("j04_pair_lookup", "SELECT id, coalesce(dst_id, '') AS other_id FROM src LEFT JOIN pairs ON id = src_id WHERE depth <= 3")(lambda s, *_: lookups.partner(s.pairs, s.src.where("depth <= 3")))
on_state("j06_children_ids_json", "SELECT parent_id, '[\"' || string_agg(id, '\",\"' ORDER BY id) || '\"]' AS child_ids FROM src WHERE parent_id <> '' GROUP BY parent_id")(lambda s, *_: lookups.child_lists(s.src))
on_state("j07_children_rows", "SELECT id, path FROM src WHERE parent_id IN (SELECT id FROM src WHERE depth = 2)")(lambda s, *_: lookups.children(s.src, s.src.where("depth = 2")).select("id", "path"))
on_state("j16_owning_side", "SELECT DISTINCT id, side FROM nodes WHERE depth <= 3")(lambda s, *_: lookups.owning_side(s.src, s.dst, nodes_of(s).where("depth <= 3")))
on_state("l01_lease_limit", "SELECT id FROM varied WHERE side = 'SRC' AND depth = 4 AND traversal_status = 'pending' ORDER BY id LIMIT 1000")(lambda s, *_: lookups.status_scan(varied(s.src), 4, "pending", 1000).select("id"))
on_state("l06_sample", "SELECT id FROM src ORDER BY sha256(id) LIMIT 100")(lambda s, *_: lookups.sample(s.src).select("id"))
on_state("l07_top_level_folders", "SELECT side, path FROM nodes WHERE depth = 1 AND type = 'folder'")(lambda s, *_: lookups.top_level_folders(nodes_of(s)).select("side", "path"))

# Statistics ----------------------------------------------------------------------------------------------------------

on_state("a01_node_counts", "SELECT side, count(*) AS nodes FROM nodes GROUP BY side")(lambda s, *_: stats.node_counts(nodes_of(s)))
on_state("a02_status_counts", "SELECT side, depth, traversal_status, count(*) AS nodes FROM varied GROUP BY ALL")(lambda s, *_: stats.status_counts(varied(nodes_of(s))))
on_state("a03_bucket_stats", """
SELECT 'Traversal-Data/' || side || '/nodes' AS bucket_path, count(*) AS count FROM varied GROUP BY side
UNION ALL SELECT 'Traversal-Data/' || side || '/levels/' || printf('%08d', depth) || '/traversal/' || traversal_status, count(*) FROM varied GROUP BY side, depth, traversal_status
UNION ALL SELECT 'Traversal-Data/SRC/levels/' || printf('%08d', depth) || '/copy/' || copy_status, count(*) FROM varied WHERE side = 'SRC' AND copy_status <> '' GROUP BY depth, copy_status
UNION ALL SELECT 'Traversal-Data/' || side || '/children', count(DISTINCT parent_id) FROM varied WHERE parent_id <> '' GROUP BY side
UNION ALL SELECT 'Traversal-Data/SRC/src-to-dst', count(*) FROM pairs UNION ALL SELECT 'Traversal-Data/DST/dst-to-src', count(*) FROM pairs""")(lambda s, *_: stats.bucket_stats(varied(nodes_of(s)), s.pairs))
on_state("a03_stats_deltas", "SELECT side || '/' || traversal_status AS bucket_path, count(*) - 1 AS count FROM varied WHERE traversal_status <> 'failed' GROUP BY side, traversal_status HAVING count(*) > 1")(
    lambda s, *_: _deltas(varied(nodes_of(s)))
)
on_state("a05_migration_status", "SELECT " + ", ".join(f"count(*) FILTER (side = '{x}') AS {x.lower()}_total, count(*) FILTER (side = '{x}' AND traversal_status = 'pending') AS {x.lower()}_pending, count(*) FILTER (side = '{x}' AND traversal_status = 'failed') AS {x.lower()}_failed, min(CASE WHEN side = '{x}' AND traversal_status = 'pending' THEN depth END) AS {x.lower()}_min_pending_depth" for x in ("SRC", "DST")) + " FROM varied")(lambda s, *_: stats.migration_status(varied(nodes_of(s))))
on_state("f20_status_flags", "SELECT count(*) = 0 AS empty, count(*) FILTER (traversal_status = 'pending') > 0 AS has_pending, count(*) FILTER (traversal_status = 'failed') > 0 AS has_failed, count(*) > 0 AND count(*) FILTER (traversal_status = 'pending') = 0 AS complete FROM varied")(lambda s, *_: stats.status_flags(varied(nodes_of(s))))
on_state("a06_verification", "SELECT count(*) FILTER (side = 'SRC') AS src_total, count(*) FILTER (side = 'DST') AS dst_total, count(*) FILTER (traversal_status = 'pending') AS pending, count(*) FILTER (traversal_status = 'failed') AS failed, count(*) FILTER (side = 'DST' AND traversal_status = 'not_on_src') AS not_on_src, count(*) FILTER (traversal_status = 'pending') = 0 AS success FROM nodes")(lambda s, *_: stats.verification(nodes_of(s), allow_not_on_src=True))
on_state("a07_min_pending_level", "SELECT side, coalesce(min(CASE WHEN traversal_status = 'pending' THEN depth END), -1) AS level FROM varied GROUP BY side")(lambda s, *_: stats.min_pending_level(varied(nodes_of(s))))
on_state("a08_levels", "SELECT DISTINCT side, depth FROM nodes")(lambda s, *_: stats.levels(nodes_of(s)))
on_state("a08_max_depth", "SELECT coalesce(max(depth), -1) AS max_depth FROM nodes")(lambda s, *_: stats.max_depth(nodes_of(s)))
on_state("a09_level_pivot", "SELECT side, depth, " + ", ".join(f"count(*) FILTER (traversal_status = '{x}') AS {x}" for x in stats.STATUSES) + ", count(*) AS total FROM varied GROUP BY ROLLUP (side, depth)")(lambda s, *_: stats.level_pivot(varied(nodes_of(s))))
on_state("a10_pending_failed_totals", "SELECT count(*) FILTER (traversal_status = 'pending') AS pending, count(*) FILTER (traversal_status = 'failed') AS failed FROM varied")(lambda s, *_: varied(nodes_of(s)).agg(F.count_if(F.col("traversal_status") == "pending").alias("pending"), F.count_if(F.col("traversal_status") == "failed").alias("failed")))
on_state("a14_subtree_stats", """SELECT sha256('SRC:' || r.path) AS root_id, count(*) AS total, count(*) FILTER (s.type = 'folder') AS folders, count(*) FILTER (s.type = 'file') AS files, count(*) FILTER (s.explicit_excluded) AS excluded, max(s.depth - r.depth) AS max_depth
FROM src r JOIN src s ON s.path = r.path OR starts_with(s.path, r.path || '/') WHERE r.depth = 1 GROUP BY r.path""")(lambda s, *_: closure.subtree_stats(s.src, s.src.where("depth = 1").select("id")))
on_state("a16_child_counts", "SELECT parent_id, count(*) AS n_children FROM dst WHERE parent_id <> '' GROUP BY parent_id")(lambda s, *_: s.dst.where("parent_id <> ''").groupBy("parent_id").agg(F.count("*").alias("n_children")))
on_state("a17_copy_groups", "SELECT depth, copy_status, count(*) AS nodes, min(id) AS first_id, max(id) AS last_id FROM src GROUP BY depth, copy_status")(lambda s, *_: s.src.groupBy("depth", "copy_status").agg(F.count("*").alias("nodes"), F.min("id").alias("first_id"), F.max("id").alias("last_id")))
on_state("a18_running_discovery", "SELECT side, depth, files, folders, CAST(sum(files) OVER w AS BIGINT) AS files_total, CAST(sum(folders) OVER w AS BIGINT) AS folders_total FROM (SELECT side, depth, count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'folder') AS folders FROM nodes GROUP BY side, depth) WINDOW w AS (PARTITION BY side ORDER BY depth)")(lambda s, *_: stats.discovery(nodes_of(s)))
on_state("a19_round_expected_completed", "SELECT side, depth, count(*) AS expected, count(*) FILTER (traversal_status IN ('successful', 'failed')) AS completed, count(*) FILTER (traversal_status = 'failed') AS failed FROM varied WHERE type = 'folder' AND traversal_status <> 'not_on_src' GROUP BY side, depth")(lambda s, *_: stats.round_stats(varied(nodes_of(s))))
on_state("a23_queue_snapshot", "SELECT side, min(depth) AS round, count(*) FILTER (depth = (SELECT min(depth) FROM varied v WHERE v.side = p.side AND v.traversal_status = 'pending')) AS pending FROM varied p WHERE traversal_status = 'pending' AND type = 'folder' GROUP BY side")(
    lambda s, *_: lookups.pending_folders(varied(nodes_of(s))).groupBy("side", "depth").agg(F.count("*").alias("n")).groupBy("side").agg(F.min("depth").alias("round"), F.min_by("n", "depth").alias("pending"))
)
on_state("a27_summary", "SELECT side, count(*) AS total, count(*) FILTER (traversal_status = 'pending') AS pending, count(*) FILTER (traversal_status = 'failed') AS failed, count(*) - count(*) FILTER (traversal_status = 'pending') - count(*) FILTER (traversal_status = 'failed') AS successful FROM varied GROUP BY side")(lambda s, *_: stats.summary(varied(nodes_of(s))))
on_state("s24_source_parity", "SELECT (SELECT count(*) FROM src) AS nodes, (SELECT count(*) FROM sl) AS listed, (SELECT count(*) FROM src) - (SELECT count(*) FROM sl) AS difference")(lambda s, spark, sf: stats.source_parity(nodes_of(s), star_tree.src_listing(spark, sf)))


STATS_SQL = "st AS (SELECT side || '/' || traversal_status AS bucket_path, count(*) AS count FROM varied GROUP BY ALL)"


def _bucket_table(s) -> DataFrame:
    return varied(nodes_of(s)).groupBy(F.concat_ws("/", "side", "traversal_status").alias("bucket_path")).agg(F.count("*").alias("count"))


query("a04_bucket_counts", "SELECT q.p AS bucket_path, coalesce(st.count, 0) AS count FROM (VALUES ('SRC/pending'), ('DST/not_on_src'), ('SRC/not_on_src'), ('nothing')) q(p) LEFT JOIN st ON st.bucket_path = q.p", f"{BASE}, {STATS_SQL}")(
    lambda spark, sf: stats.bucket_counts(_bucket_table(reconciled(spark, sf)), spark.createDataFrame([(p,) for p in ("SRC/pending", "DST/not_on_src", "SRC/not_on_src", "nothing")], "bucket_path string"))
)
query("l05_stats_by_path", "SELECT row_number() OVER (ORDER BY bucket_path) - 1 AS place, bucket_path, count FROM st", f"{BASE}, {STATS_SQL}")(
    lambda spark, sf: _numbered(stats.by_path(_bucket_table(reconciled(spark, sf))))
)
on_state("a22_round_totals", """SELECT side, count(*) AS rounds, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(failed) AS BIGINT) AS failed FROM (
  SELECT side, depth, count(*) AS expected, count(*) FILTER (traversal_status IN ('successful', 'failed')) AS completed, count(*) FILTER (traversal_status = 'failed') AS failed
  FROM varied WHERE type = 'folder' AND traversal_status <> 'not_on_src' GROUP BY side, depth) GROUP BY side""")(lambda s, *_: stats.round_totals(stats.round_stats(varied(nodes_of(s)))))
on_state("f04_pending_roots", "SELECT side, path FROM nodes WHERE depth = 0")(lambda s, *_: lookups.pending_folders(state.transition(nodes_of(s), nodes_of(s).where("depth <= 1").select("id"), "pending"), 0).select("side", "path"))
on_state("f10_path_scan", "SELECT id, type FROM src WHERE path = '/ASIA/CHINA'")(lambda s, *_: lookups.by_path(s.src, "/ASIA/CHINA").select("id", "type"))
on_state("f15_open_top_folders", "SELECT path FROM src WHERE depth = 1 AND type = 'folder' AND name >= 'B'")(
    lambda s, *_: lookups.top_level_folders(state.set_excluded(s.src, s.src.where("depth = 1 AND name < 'B'"))).where("NOT explicit_excluded").select("path")
)
on_state("u13_marked", "SELECT id, CASE depth WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE traversal_status END AS traversal_status, depth = 3 AS explicit_excluded FROM src")(
    lambda s, *_: state.set_excluded(state.transition(state.transition(s.src, s.src.where("depth = 1"), "pending"), s.src.where("depth = 2"), "failed"), s.src.where("depth = 3")).select("id", "traversal_status", "explicit_excluded")
)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (a bounded report: a row a bucket) with their place in the order they have."""
    spark, held = rows.sparkSession, rows.collect()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(held)], "place long, bucket_path string, count long")


def _deltas(nodes: DataFrame) -> DataFrame:
    counted = nodes.groupBy(F.concat_ws("/", "side", "traversal_status").alias("bucket_path")).agg(F.count("*").alias("count"))
    gone = F.when(F.col("bucket_path").endswith("/failed"), -F.col("count") - 5).otherwise(F.lit(-1))
    return state.apply_deltas(counted, counted.select("bucket_path", gone.alias("delta")))


# Changes -------------------------------------------------------------------------------------------------------------

on_state("u03_upsert", "SELECT id, CASE WHEN depth = 3 THEN 'failed' ELSE traversal_status END AS traversal_status FROM src")(lambda s, *_: state.upsert(s.src, s.src.where("depth = 3").withColumn("traversal_status", F.lit("failed"))).select("id", "traversal_status"))
on_state("u05_batch_delete", "SELECT id FROM src WHERE NOT (depth = 5 AND size % 2 = 0)")(lambda s, *_: state.delete(s.src, s.src.where("depth = 5 AND size % 2 = 0")).select("id"))
on_state("u05_delete_pairs", "SELECT src_id, dst_id FROM pairs WHERE src_id NOT IN (SELECT id FROM src WHERE depth = 5)")(lambda s, *_: _kept_pairs(s))
on_state("u07_delete_subtree", "SELECT id FROM src WHERE NOT starts_with(path, '/ASIA/')")(lambda s, *_: closure.delete_subtree(s.src, s.src.where("path = '/ASIA'").select("id")).select("id"))
on_state("u08_transition", "SELECT id, CASE WHEN depth = 3 AND traversal_status = 'successful' THEN 'pending' ELSE traversal_status END AS traversal_status FROM dst")(lambda s, *_: state.transition(s.dst, s.dst.where("depth = 3"), "pending", "successful").select("id", "traversal_status"))
on_state("u09_transition_batch", "SELECT id, CASE depth WHEN 3 THEN 'failed' WHEN 4 THEN 'pending' ELSE traversal_status END AS traversal_status FROM src")(
    lambda s, *_: state.set_statuses(s.src, s.src.where("depth IN (3, 4)").select("id", F.when(F.col("depth") == 3, "failed").otherwise("pending").alias("status"))).select("id", "traversal_status")
)
on_state("u10_copy_status", "SELECT id, CASE WHEN type = 'file' AND size > 25 THEN 'skipped' ELSE copy_status END AS copy_status FROM src")(lambda s, *_: state.transition(s.src, s.src.where("type = 'file' AND size > 25"), "skipped", column="copy_status").select("id", "copy_status"))
on_state("u12_inherited_exclusion", "SELECT id, depth = 2 AND name < 'F' AS explicit_excluded, EXISTS (SELECT 1 FROM src e WHERE e.depth = 2 AND e.name < 'F' AND starts_with(s.path, e.path || '/')) AS inherited_excluded FROM src s")(
    lambda s, *_: closure.inherit_exclusion(state.set_excluded(s.src, s.src.where("depth = 2 AND name < 'F'"))).select("id", "explicit_excluded", "inherited_excluded")
)
on_state("a15_excluded_in_subtree", "SELECT count(*) AS excluded FROM src s WHERE EXISTS (SELECT 1 FROM src e WHERE e.path = '/ASIA' AND (s.path = e.path OR starts_with(s.path, e.path || '/')))")(
    lambda s, *_: lookups.excluded(closure.inherit_exclusion(state.set_excluded(s.src, s.src.where("path = '/ASIA'")))).agg(F.count("*").alias("excluded"))
)


@on_state("j12_retry_invalidation", """
SELECT side, depth, traversal_status, count(*) AS nodes FROM (
  SELECT side, depth, CASE WHEN path = '/ASIA' THEN 'pending' ELSE traversal_status END AS traversal_status FROM nodes WHERE NOT starts_with(path, '/ASIA/')) GROUP BY ALL""")
def _j12(s, *_):
    return stats.status_counts(nodes_of(retry.invalidate(s, s.src.where("path = '/ASIA'").select("id"))))


@on_state("t13_retry_restores_counts", "SELECT side, depth, traversal_status, count(*) AS nodes FROM nodes GROUP BY ALL")
def _t13(s, spark, sf):
    gone = retry.invalidate(s, s.src.where("path = '/ASIA'").select("id"))
    return stats.status_counts(nodes_of(retry.sweep(gone, star_tree.src_listing(spark, sf), star_tree.dst_listing(spark, sf))))


# Relational tables ---------------------------------------------------------------------------------------------------

TABLE_SQL = """SELECT n.id, service_id, n.parent_id, parent_service_id, parent_path, name, path, sha256(path) AS path_hash, coalesce(c.child_ids, '') AS child_ids, type, size, mtime, depth,
  traversal_status, copy_status, p.{other} FROM {side} n LEFT JOIN pairs p ON p.{mine} = n.id
  LEFT JOIN (SELECT parent_id, '["' || string_agg(id, '","' ORDER BY id) || '"]' AS child_ids FROM {side} WHERE parent_id <> '' GROUP BY parent_id) c ON c.parent_id = n.id"""
on_state("p07_src_nodes_table", TABLE_SQL.format(side="src", mine="src_id", other="dst_id"))(lambda s, *_: _table_of(s, "SRC"))
on_state("p07_dst_nodes_table", TABLE_SQL.format(side="dst", mine="dst_id", other="src_id"))(lambda s, *_: _table_of(s, "DST"))
on_state("p06_status_flatten", "SELECT id, CASE WHEN depth = 2 AND name < 'F' THEN 'excluded_explicit' WHEN EXISTS (SELECT 1 FROM src e WHERE e.depth = 2 AND e.name < 'F' AND starts_with(s.path, e.path || '/')) THEN 'excluded_inherited' ELSE traversal_status END AS status FROM src s")(
    lambda s, *_: closure.inherit_exclusion(state.set_excluded(s.src, s.src.where("depth = 2 AND name < 'F'"))).select("id", etl.flat_status(F.col("explicit_excluded"), F.col("inherited_excluded"), F.col("traversal_status")).alias("status"))
)
on_state("u19_tables_roundtrip", f"SELECT {NODE_COLUMNS}, coalesce(dst_id, '') AS dst_id FROM src LEFT JOIN pairs ON id = src_id")(lambda s, spark, _: _through_tables(s, spark))
on_state("p08_roundtrip", f"SELECT {NODE_COLUMNS} FROM dst")(lambda s, *_: etl.from_table(_table_of(s, "DST"), "DST")[0])
on_state("p08_roundtrip_pairs", "SELECT src_id, dst_id FROM pairs")(lambda s, *_: etl.from_table(_table_of(s, "SRC"), "SRC")[1])
on_state("j15_differences", "SELECT id, 'traversal_status' AS fields FROM varied WHERE id IN (SELECT id FROM nodes n WHERE n.traversal_status <> varied.traversal_status)")(lambda s, *_: _differences(s))
on_state("a11_status_parity", "SELECT depth, traversal_status, a AS left_count, b AS right_count FROM (SELECT depth, traversal_status, sum(x) AS a, sum(y) AS b FROM (SELECT depth, traversal_status, CAST(1 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM src UNION ALL SELECT depth, traversal_status, 0, 1 FROM varied WHERE side = 'SRC') GROUP BY ALL) WHERE a <> b".replace("a AS left_count, b AS right_count", "CAST(a AS BIGINT) AS left_count, CAST(b AS BIGINT) AS right_count"))(lambda s, *_: stats.parity(s.src, varied(s.src), "depth", "traversal_status"))
on_state("a12_join_coverage", "SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM src JOIN pairs ON id = src_id) AS src_with_dst, (SELECT count(*) FROM dst JOIN pairs ON id = dst_id) AS dst_with_src")(
    lambda s, *_: s.pairs.agg(F.count("*").alias("pairs")).crossJoin(_table_of(s, "SRC").agg(F.count("dst_id").alias("src_with_dst"))).crossJoin(_table_of(s, "DST").agg(F.count("src_id").alias("dst_with_src")))
)
on_state("j14_sample_missing", "SELECT id FROM (SELECT id, depth FROM src ORDER BY sha256(id) LIMIT 100) WHERE depth = 5 AND right(id, 1) < '8'")(
    lambda s, *_: etl.missing_samples(lookups.sample(s.src), etl.to_table(s.src.where("NOT (depth = 5 AND right(id, 1) < '8')"), s.pairs, "SRC"))
)


def _differences(s) -> DataFrame:
    a, b, columns = nodes_of(s), varied(nodes_of(s)), ["type", "name", "size", "mtime", "traversal_status", "copy_status"]
    return etl.differences(a, b, columns) if s.both is None else etl.differences_by_path(a, b, columns, 2 * s.both.count())


def _through_tables(s, spark) -> DataFrame:
    """The five tables written and read back: source nodes with their pairs."""
    import uuid

    from .store import shared_dir

    root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    sides = (s.src, s.dst)
    if s.both is not None:
        n = passes(s.both.count())
        sides = [[engine.with_partners(s.both, side, True, (i, n)) for i in range(n)] for side in ("SRC", "DST")]
    counts = lambda: stats.bucket_stats(nodes_of(s), s.pairs, etl.parents(spark, root) if s.both is not None else None)
    etl.write_tables(spark, root, *sides, s.pairs, counts, spark.createDataFrame([], QUEUE_STATS), spark.createDataFrame([], LOGS))
    return etl.paired_nodes(spark, root)


# Functions -----------------------------------------------------------------------------------------------------------


@query("x12_paths", """SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path, sha256(CASE WHEN p = '' THEN '/' ELSE p END) AS path_hash, CASE WHEN p = '' THEN 0 ELSE len(p) - len(replace(p, '/', '')) END AS depth
FROM (SELECT page_id, regexp_replace(regexp_replace('/' || regexp_replace(url, '^[a-z]+:', ''), '/+', '/', 'g'), '/$', '') AS p FROM pages)""", base="")
def _x12(spark, sf_dir):
    path = scalar.normalise_path(F.regexp_replace("url", "^[a-z]+:", ""))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path.alias("path"))
    return pages.select("page_id", "path", scalar.path_hash(F.col("path")).alias("path_hash"), scalar.path_depth(F.col("path")).cast("long").alias("depth"))


@query("p09_level_names", "SELECT DISTINCT depth, printf('%08d', depth) AS level, CAST(printf('%08d', depth) AS INTEGER) AS parsed FROM src")
def _p09(spark, sf_dir):
    levels = reconciled(spark, sf_dir).src.select("depth").distinct().withColumn("level", scalar.level_name(F.col("depth")))
    return levels.withColumn("parsed", scalar.level_of(F.col("level")))


@query("p13_config_strings", "SELECT * FROM (VALUES ('a.db', 'a-duck.db', '127.0.0.1', 8081), ('b', 'b-duck.db', 'host', 9), ('x.y.db', 'x.y-duck.db', '::1', 80)) t(path, analytic, host, port)", base="")
def _p13(spark, sf_dir):
    rows = spark.createDataFrame([("a.db", ""), ("b", "host:9"), ("x.y.db", "::1:80")], "path string, addr string")
    host, port = scalar.address(F.col("addr"))
    return rows.select("path", scalar.analytic_path(F.col("path")).alias("analytic"), host.alias("host"), port.alias("port"))


@query("j06_conversation_children", "SELECT conv_id, '[' || string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) || ']' AS turns, count(*) AS n FROM conversations GROUP BY conv_id", base="")
def _conv(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id")
    return rows.agg(F.to_json(F.sort_array(F.collect_list("turn"))).alias("turns"), F.count("*").alias("n"))


# Metrics and logs ----------------------------------------------------------------------------------------------------


def _events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def polls(events: DataFrame) -> DataFrame:
    """Events found so far by type, polled once a day: ``event_type, day, total`` (days in seconds)."""
    day = F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp")))
    daily = events.groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"))
    return daily.select("event_type", "day", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")).alias("total"))


@query("a24_ema_rate", """
WITH RECURSIVE d AS (SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT event_type, day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS total, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d),
e AS (SELECT event_type, day, total, i, CAST(0 AS DOUBLE) AS rate FROM p WHERE i = 1
  UNION ALL SELECT p.event_type, p.day, p.total, p.i, 0.2::DOUBLE * ((p.total - e.total)::DOUBLE / (p.day - e.day)::DOUBLE) + 0.8::DOUBLE * e.rate FROM e JOIN p ON p.event_type = e.event_type AND p.i = e.i + 1)
SELECT event_type, day, CAST(round(rate * 1e9) AS BIGINT) AS nano_rate FROM e""", base="")
def _a24(spark, sf_dir):
    return metrics.ema_rate(polls(_events(spark, sf_dir)), "event_type", "day", "total").select("event_type", "day", F.round(F.col("rate") * 1e9).cast("long").alias("nano_rate"))


@query("a21_last100_avg", "SELECT event_type, CAST(round(avg(value) * 1e6) AS BIGINT) AS micro_average, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 100 GROUP BY event_type", base="")
def _a21(spark, sf_dir):
    out = metrics.last_n_average(_events(spark, sf_dir), "event_type", ["ts", "event_id"], "value")
    return out.select("event_type", F.round(F.col("average") * 1e6).cast("long").alias("micro_average"), "n")


@query("a25_state_time", "SELECT event_type, CAST(sum(epoch_us(nxt) - epoch_us(ts)) AS BIGINT) AS micros, count(*) AS intervals FROM (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY event_type", base="")
def _a25(spark, sf_dir):
    return metrics.state_times(_events(spark, sf_dir), "user_id", "ts", "event_id", "event_type")


@query("f17_log_threshold", f"SELECT level, count(*) AS n FROM logs WHERE level IN ('warning', 'error', 'critical') GROUP BY level", base=f"WITH {LOGS_SQL}")
def _f17(spark, sf_dir):
    return logs.by_level(lookups.logs_from(logs.from_events(_events(spark, sf_dir)), "warning"))


@query("a13_log_count", "SELECT count(*) AS n FROM logs", base=f"WITH {LOGS_SQL}")
def _a13(spark, sf_dir):
    return logs.from_events(_events(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("s18_logs", "SELECT * FROM logs", base=f"WITH {LOGS_SQL}")
def _s18(spark, sf_dir):
    return logs.from_events(_events(spark, sf_dir))


@query("l03_log_string_order", "SELECT id, timestamp, row_number() OVER (PARTITION BY entity_id ORDER BY timestamp, id) AS place FROM logs", base=f"WITH {LOGS_SQL}")
def _l03(spark, sf_dir):
    w = Window.partitionBy("entity_id").orderBy("timestamp", "id")
    return logs.from_events(_events(spark, sf_dir)).select("id", "timestamp", F.row_number().over(w).cast("long").alias("place"))


@query("a26_throughput", "SELECT queue, n AS processed, bad AS flushed, CAST(s AS DOUBLE) AS seconds, n / s AS processed_per_second, bad / s AS flushed_per_second FROM (SELECT queue, count(*) AS n, count(*) FILTER (level <> 'trace') AS bad, CAST(1000 AS DOUBLE) AS s FROM logs GROUP BY queue)", base=f"WITH {LOGS_SQL}")
def _a26(spark, sf_dir):
    made = logs.from_events(_events(spark, sf_dir)).groupBy("queue").agg(F.count("*").alias("processed"), F.count_if(F.col("level") != "trace").alias("flushed"), F.lit(1000.0).alias("seconds"))
    return metrics.throughput(made)


@query("x16_sides_of_queues", "SELECT id, upper(queue) AS side FROM logs", base=f"WITH {LOGS_SQL}")
def _x16(spark, sf_dir):
    return logs.from_events(_events(spark, sf_dir)).select("id", scalar.side_of_queue(F.col("queue")).alias("side"))


@query("x05_log_ids", "SELECT count(*) AS rows, count(*) AS ids, count(*) AS version4 FROM events", base="")
def _x05(spark, sf_dir):
    """Random ids are distinct and of version 4."""
    made = written(logs.with_ids(logs.from_events(_events(spark, sf_dir)).withColumn("id", F.lit(None).cast("string"))).select("id"), "log-ids")
    v4 = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return made.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(v4).alias("version4"))


@query("f16_logs_of_all_levels", "SELECT level, count(*) AS n, min(id) AS first_id FROM logs GROUP BY level", base=f"WITH {LOGS_SQL}")
def _f16_all(spark, sf_dir):
    return logs.in_order(logs.from_events(_events(spark, sf_dir))).groupBy("level").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("f16_log_by_id", "SELECT * FROM logs WHERE id = '17'", base=f"WITH {LOGS_SQL}")
def _f16_id(spark, sf_dir):
    return logs.in_order(logs.from_events(_events(spark, sf_dir)), key="17")


@query("z03_queue_stats", "SELECT queue, CAST(count(*) AS BIGINT) AS total_discovered, CAST(count(*) FILTER (level = 'error') AS BIGINT) AS total_failed FROM logs GROUP BY queue", base=f"WITH {LOGS_SQL}")
def _z03(spark, sf_dir):
    """Metrics written as JSON and read back."""
    made = logs.from_events(_events(spark, sf_dir)).groupBy(F.col("queue").alias("queue_key")).agg(F.count("*").alias("total_discovered"), F.count_if(F.col("level") == "error").alias("total_failed"))
    read = metrics.external_json(made).select("queue_key", F.from_json("metrics_json", "total_discovered long, total_failed long").alias("m"))
    return read.select(F.col("queue_key").alias("queue"), "m.total_discovered", "m.total_failed")


@query("f16_logs_of_level", "SELECT id, timestamp, message FROM logs WHERE level = 'error'", base=f"WITH {LOGS_SQL}")
def _f16(spark, sf_dir):
    return logs.in_level_order(logs.from_events(_events(spark, sf_dir)).where("level = 'error'")).select("id", "timestamp", "message")


on_state("a20_round_rates", """SELECT side, depth, expanded, discovered, CAST(round(1e6 * discovered / expanded) AS BIGINT) AS micro_per_folder FROM (
SELECT side, depth, count(*) FILTER (type = 'folder' AND traversal_status <> 'not_on_src') AS expanded, (SELECT count(*) FROM nodes c WHERE c.side = p.side AND c.depth = p.depth + 1) AS discovered
FROM nodes p WHERE depth <= 4 GROUP BY side, depth)""")(
    lambda s, spark, _: metrics.round_rates(spark.createDataFrame(s.rounds, "side string, depth int, expanded long, discovered long")).withColumn("micro_per_folder", F.round(F.col("per_folder") * 1e6).cast("long")).drop("per_folder")
)
on_state("p01_tasks", "SELECT id, CASE WHEN type = 'folder' THEN service_id ELSE '' END AS folder_id, CASE WHEN type = 'file' THEN service_id ELSE '' END AS file_id, side, name, path, parent_path, parent_service_id, mtime, coalesce(size, 0) AS size, depth AS round FROM nodes")(
    lambda s, *_: expand.as_tasks(nodes_of(s))
)
on_state("p02_task_nodes", "SELECT side, id, service_id, '' AS parent_id, parent_service_id, CASE WHEN parent_path = '' THEN '/' ELSE parent_path END AS parent_path, name, path, type, coalesce(size, 0) AS size, mtime, depth FROM nodes")(
    lambda s, *_: expand.from_tasks(expand.as_tasks(nodes_of(s)).withColumn("id", F.lit("")))
)


@query("p10_roots", "SELECT * FROM (VALUES ('r1', 'r1', '/', '', 'folder', 'now'), ('r2', 'Two', '/', '', 'folder', '2025-01-01T00:00:00Z')) t(service_id, name, path, parent_path, type, mtime)", base="")
def _p10(spark, sf_dir):
    rows = spark.createDataFrame([("r1", None, ""), ("r2", "Two", "2025-01-01T00:00:00Z")], "service_id string, name string, mtime string")
    return expand.normalise_root(rows, F.lit("now"))


@query("s03_simulator_counts")
def _sim(spark, sf_dir):
    """Rows by depth and type of a simulated tree and of its second world."""
    from ..sources import simulator

    spec = simulator.TreeSpec(max_depth=3)
    both = simulator.listing(spark, spec).withColumn("world", F.lit("primary")).unionByName(simulator.listing(spark, spec, "s1").withColumn("world", F.lit("s1")))
    return both.groupBy("world", scalar.path_depth(F.col("path")).alias("depth"), "type").agg(F.count("*").alias("nodes"))


@query("s04_local_fs_listing")
def _s04(spark, sf_dir):
    """This package's own directory, listed by the directory source."""
    from pathlib import Path

    from ..sources import local_fs

    root = Path(__file__).resolve().parent.parent / "sources"
    return local_fs.listing(spark, str(root)).select("path", "parent_path", "name", "type", "size").where("NOT contains(path, '__pycache__')")


# Streams: run to the end of what is there, into a written table --------------------------------------------------------


def _streamed(spark: SparkSession, stream: DataFrame, label: str, mode: str) -> DataFrame:
    import uuid

    from .store import shared_dir

    place = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{place}/rows")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/rows")


def _event_stream(spark: SparkSession, sf_dir: str, files: int = 5) -> DataFrame:
    """The events as a stream of several micro-batches, in order of time; days and hours are spread over batches."""
    import uuid

    from .store import shared_dir

    events, place = _events(spark, sf_dir), f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    cut = written(events.repartitionByRange(files, "ts", "event_id").withColumn("_part", F.spark_partition_id()), "events", "_part")
    for part in range(files):  # one after the other, as a stream takes the oldest files first
        cut.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(place)


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the last micro-batch for each key."""
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("v")).select(*keys, "v.*")


@query("t07_streaming_ema")
def _t07(spark, sf_dir):
    from ..streaming.metrics_stream import ema_stream

    rows = _last(_streamed(spark, ema_stream(_event_stream(spark, sf_dir)), "t07", "update"), "queue", "t")
    return rows.select(F.col("queue").alias("event_type"), F.col("t").alias("day"), F.round(F.col("rate") * 1e9).cast("long").alias("nano_rate"))


ORACLES["t07_streaming_ema"] = ORACLES["a24_ema_rate"]


@query("t08_windowed_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS start, event_type, count(*) AS n FROM events GROUP BY ALL", base="")
def _t08(spark, sf_dir):
    """Counts by hour from a stream of several micro-batches; the last count of each window."""
    from ..streaming.metrics_stream import windowed_counts

    rows = _last(_streamed(spark, windowed_counts(_event_stream(spark, sf_dir), late="400 days"), "t08", "update"), "start", "event_type")
    return rows.select(scalar.rfc3339(F.col("start")).alias("start"), "event_type", "n")


@query("t06_streaming_logs", "SELECT level, queue, count(*) AS n FROM logs GROUP BY level, queue", base=f"WITH {LOGS_SQL}")
def _t06(spark, sf_dir):
    """Logs sent as JSON lines, read back as a stream."""
    import uuid

    from ..streaming.logs_stream import packets
    from .store import shared_dir

    sent = f"{shared_dir(spark)}/packets-{uuid.uuid4().hex}"
    logs.from_events(_events(spark, sf_dir)).select(F.to_json(F.struct("timestamp", "level", "message", "entity", "entity_id", "queue")).alias("value")).write.text(sent)
    return _streamed(spark, packets(spark, sent), "t06", "append").groupBy("level", "queue").agg(F.count("*").alias("n"))
