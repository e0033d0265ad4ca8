"""Retry sweep: pending folders are listed again, and what hangs on them is found anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import node_id
from ..plans import engine
from ..plans.store import few, written
from . import closure, state


def mark_pending(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return state.transition(nodes, ids, "pending")


def invalidate(s: engine.State, src_ids: DataFrame) -> engine.State:
    """Source folders and their pairs become pending; everything below them goes on both sides, pairs included."""
    if s.both is not None:
        return _invalidate_both(s, src_ids)
    dst_ids = s.pairs.join(src_ids.select(F.col("id").alias("src_id")), "src_id", "left_semi").select(F.col("dst_id").alias("id"))
    src_gone = closure.descendants(s.src, src_ids, keep_roots=False).select("id").distinct()
    dst_gone = closure.descendants(s.dst, dst_ids, keep_roots=False).select("id").distinct()
    pairs = state.delete_pairs(state.delete_pairs(s.pairs, src_gone, "SRC"), dst_gone, "DST")
    src = mark_pending(state.delete(s.src, src_gone), src_ids)
    dst = mark_pending(state.delete(s.dst, dst_gone), dst_ids)
    return engine.State(written(src, "src"), written(dst, "dst"), written(pairs, "pairs"), s.rounds)


def _invalidate_both(s: engine.State, src_ids: DataFrame) -> engine.State:
    """The same where rows hold both sides: by paths, in one pass over them."""
    nodes = engine.with_partners(s.both, "SRC").join(few(src_ids.select("id").distinct()), "id", "left_semi")
    tops = {"s": nodes.select(F.col("path").alias("_top")), "d": nodes.where("other_path IS NOT NULL").select(F.col("other_path").alias("_top"))}
    rows = s.both
    for x, paths in tops.items():
        paths = written(paths.distinct(), "tops")
        rows = closure.marked_below(rows.withColumn("_at", F.coalesce(f"{x}_path", "path")), paths, "_gone", "_at")
        rows = rows.join(few(paths.select(F.col("_top").alias("_at"), F.lit(True).alias("_open"))), "_at", "left")
        status = F.col(f"{x}_status")
        rows = rows.withColumn(f"{x}_status", F.when(F.col("_gone") | status.isNull(), None).when(F.col("_open"), F.lit("pending")).otherwise(status)).drop("_gone", "_open", "_at")
    left = rows.where("s_status IS NOT NULL OR d_status IS NOT NULL").select(*engine.BOTH)
    return engine.of_both(written(left, "both"), s.rounds)


def _sweep_both(s: engine.State, src_listing: DataFrame, dst_listing: DataFrame) -> engine.State | None:
    """A sweep without a loop, where rows hold both sides: what hangs below the pending folders is listed and joined at once. Only for
    pending folders that have nothing below them and whose pairs have their path (as after ``invalidate``); else None."""
    both = s.both
    waiting = (F.col("type") == "folder") & (F.coalesce(F.col("s_status") == "pending", F.lit(False)) | F.coalesce(F.col("d_status") == "pending", F.lit(False)))
    tops = written(both.where(waiting), "pending")
    paths = tops.select("path")
    if not both.where("s_path IS NOT NULL OR d_path IS NOT NULL").isEmpty() or not tops.where("s_status IS NULL OR s_status <> 'pending'").isEmpty() or tops.isEmpty():
        return None
    if not closure.marked_below(both.select("path"), written(paths.select(F.col("path").alias("_top")), "tops"), "_in").where("_in").isEmpty():
        return None
    raw = []
    for x, listing in (("s", src_listing), ("d", dst_listing)):
        there = tops.where(F.col(f"{x}_status").isNotNull())
        part = written(engine.pack(engine.below(listing, there.select("path"))), "listing")
        if not engine._no_repeats(engine.unpack(part)):
            return None
        raw.append(part.unionByName(there.select("path", "type", *[F.col(f"{x}_{c}").alias(c) for c in engine.ENTRY])))
    part = engine.at_once(*raw, tops=paths)
    kept = both.withColumns({f"{x}_status": F.when(waiting & F.col(f"{x}_status").isNotNull(), F.lit("successful")).otherwise(F.col(f"{x}_status")) for x in "sd"})
    found = part.both.join(few(paths), "path", "left_anti").select(*engine.BOTH)
    return engine.of_both(written(kept.select(*engine.BOTH).unionByName(found), "both"), s.rounds + part.rounds)


def sweep(s: engine.State, src_listing: DataFrame, dst_listing: DataFrame, failing=None) -> engine.State:
    """Expand what is pending, at any level, and compare again. Ids are deterministic, so what is found again keeps its id;
    nodes that aren't below a pending folder stay as they are. Excluded nodes aren't pending, so they are skipped. The pair
    of a pending source folder is compared again too."""
    if s.both is not None and failing is None and (done := _sweep_both(s, src_listing, dst_listing)) is not None:
        return done
    open_src = s.src.where("traversal_status = 'pending' AND type = 'folder'").select(F.col("id").alias("src_id"))
    partners = s.pairs.join(open_src, "src_id", "left_semi").select(F.col("dst_id").alias("id"))
    started = engine.State(s.src, mark_pending(s.dst, partners), s.pairs, s.rounds)
    src_listing, dst_listing = (_below(listing, nodes) for listing, nodes in ((src_listing, started.src), (dst_listing, started.dst)))
    out = engine.advance(started, engine.laid_out(src_listing), engine.laid_out(dst_listing), failing)
    return engine.State(written(out.src, "src"), written(out.dst, "dst"), written(out.pairs, "pairs"), out.rounds)


def _below(listing: DataFrame, nodes: DataFrame) -> DataFrame:
    """The part of a listing that hangs below pending folders: what a sweep reads and lays out."""
    pending = nodes.where("traversal_status = 'pending' AND type = 'folder'").select("path")
    return engine.below(listing, written(pending, "pending"))


def ids_of(side: str, paths: DataFrame) -> DataFrame:
    return paths.select(node_id(side, F.col("path")).alias("id"))
