"""Expansion and comparison of two trees.

A fresh run over whole listings needs no loop (``at_once``): a node is reached if all folders above it are listed, and a
destination node is compared if all folders above it have a counterpart, so one join by parent, type and name finds all
pairs, and what hangs below unmatched or missing folders is taken out by one semi join of ancestor paths. What that plan
doesn't cover goes through the level loop: listings that fail, suspension between levels, resumed runs, retry sweeps, and
listings with repeated names. Both give the same state.

The level loop: source level N+1 is written before destination level N is compared. Each level is one join of the frontier with the listing of the level below (listings are laid out by path depth, so a level
reads its own part only), written to the shared folder. The loop starts at the lowest pending depth of a state, so a fresh
run, a resumed one and a retry sweep are the same: what isn't below a pending folder is never listed again. Statuses that
whole levels share are set once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import last_name, newer, node_id, normalise_path, parent_of, path_depth
from ..operators import compare, expand
from ..schema import NODES
from .store import PART, dropped, few, grouped_parts, in_passes, packed, part_of, unpacked, written

COLUMNS = [f.name for f in NODES]


@dataclass
class State:
    src: DataFrame
    dst: DataFrame
    pairs: DataFrame
    rounds: list[tuple[str, int, int, int]] = field(default_factory=list)  # side, depth, folders expanded, children found
    both: DataFrame | None = None  # of a state made at once (``of_both``): a row for each pair and each node without one


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def laid_out(listing: DataFrame) -> DataFrame:
    """A listing with its path depth as partition column."""
    return written(listing.withColumn("_depth", path_depth(F.col("path"))), "listing", "_depth")


def seed(src_listing: DataFrame, dst_listing: DataFrame) -> State:
    """Two pending roots, paired."""
    src, dst = (written(expand.root_node(side, listing), side) for side, listing in (("SRC", src_listing), ("DST", dst_listing)))
    return State(src, dst, src.select(F.col("id").alias("src_id")).crossJoin(dst.select(F.col("id").alias("dst_id"))))  # one row each


def reconcile(src_listing: DataFrame, dst_listing: DataFrame, failing: Callable[[DataFrame], DataFrame] | None = None, stop: Callable[[int], bool] | None = None) -> State:
    """Expand both trees from their roots and compare them. ``failing`` picks, of a frontier, the folders whose listing
    fails for good; ``stop`` is asked before each level (suspend)."""
    if stop is None:
        raw = [written(pack(listing, parts=True), "listing", PART) for listing in (src_listing, dst_listing)]
        src_listing, dst_listing = (unpacked(r, _listed()) for r in raw)
        if _each_once(src_listing) and _each_once(dst_listing):
            done = at_once(*raw, failing)
            dropped(*raw)
            return done
    src_list, dst_list = laid_out(src_listing), laid_out(dst_listing)
    return advance(seed(src_list.where("_depth = 0"), dst_list.where("_depth = 0")), src_list, dst_list, failing, stop)


LISTED = ("parent_path", "name", "service_id", "parent_service_id")
ENTRY = ["_own", *LISTED, "size", "mtime"]


def _listed() -> dict[str, Column]:
    """What a path gives of an entry's other columns, in nearly all listings."""
    path = F.col("path")
    return dict(zip(LISTED, (parent_of(path), last_name(path), path, parent_of(path))))


def pack(listing: DataFrame, parts: bool = False) -> DataFrame:
    """A listing without what its paths give. ``parts``: with ``PART``, by parents, so that pairs are in the same part and a folder's
    entries stay together, which takes less space."""
    shaped = _shaped(listing)
    return packed(shaped.withColumn(PART, part_of("parent_path")) if parts else shaped, _listed())


def unpack(raw: DataFrame) -> DataFrame:
    return unpacked(raw, _listed())


def _shaped(listing: DataFrame) -> DataFrame:
    up = F.when(F.col("path") == "/", F.lit("")).otherwise(normalise_path(F.col("parent_path")))
    return listing.withColumn("parent_path", up).select("path", "type", *LISTED, "size", "mtime")


def _each_once(listing: DataFrame) -> bool:
    """Whether no parent has two entries of a type and name, and there is one root."""
    return _no_repeats(listing) and listing.where("path = '/'").count() == 1


def _no_repeats(listing: DataFrame) -> bool:
    """Whether no parent has two entries of a type and name. Counted by 64-bit hashes."""
    code = F.xxhash64("parent_path", "type", "name")
    return written(listing.groupBy(code.alias("code")).count().where("count > 1"), "twice").isEmpty()


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (with ``path``) that aren't below a path of ``gone`` (written). A path is cut at each depth that ``gone`` has, so
    there is one anti join for each of these depths, and rows aren't multiplied."""
    for depth in _depths(gone):
        rows = rows.join(_tops(gone, depth), (path_depth(F.col("path")) > depth) & (_cut(depth) == F.col("_top")), "left_anti")
    return rows


def _depths(tops: DataFrame) -> list[int]:
    return sorted(d for (d,) in tops.select(path_depth(F.col("path"))).distinct().collect())  # at most a row a level


def _cut(depth: int):
    return F.lit("/") if depth == 0 else F.substring_index("path", "/", depth + 1)


def _tops(tops: DataFrame, depth: int) -> DataFrame:
    return few(tops.where(path_depth(F.col("path")) == depth).select(F.col("path").alias("_top")).distinct())


def below(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """``rows`` (with ``path``) that are below a path of ``tops`` (written), each once."""
    parts, depths = [], _depths(tops)
    for depth in depths:
        inside = rows.where(path_depth(F.col("path")) > depth)
        if parts:  # not what a shorter path holds already
            inside = _without(inside, tops.where(path_depth(F.col("path")) < depth))
        parts.append(inside.join(_tops(tops, depth), _cut(depth) == F.col("_top"), "left_semi"))
    return _union(parts) if parts else rows.limit(0)


def _orphaned(listing: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """Paths that entries have as their parent and that aren't listed as folders: entries below them can't be reached. Those at
    ``tops`` (``path``) are reached from outside the listing."""
    folders = listing.where("type = 'folder'").select(F.col("path").alias("parent_path"))
    inner = listing if tops is None else listing.join(few(tops), "path", "left_anti")
    missing = inner.where("path <> '/'").select("parent_path").distinct().join(folders, "parent_path", "left_anti")
    return missing.select(F.col("parent_path").alias("path"))


def _entries(listing: DataFrame, side: str, status, copy_status, more: tuple[str, ...] = ()) -> DataFrame:
    """Listing rows as node rows, with ``more`` of their columns."""
    root = F.col("path") == "/"
    parent = F.when(root, F.lit("")).otherwise(node_id(side, F.col("parent_path")))
    service = F.when(root, F.lit("")).otherwise(F.col("parent_service_id"))
    return expand.as_nodes(listing, side, parent, service, path_depth(F.col("path")), status, copy_status, more)


def at_once(src_raw: DataFrame, dst_raw: DataFrame, failing: Callable[[DataFrame], DataFrame] | None = None, tops: DataFrame | None = None) -> State:
    """The state that expanding and comparing from the roots gives, for listings that are whole (written, packed by ``_listed``).
    One full join of both sides, of what a path doesn't give; ids are made when they are read. ``failing`` must pick folders
    by their rows alone. ``tops``: folders (``path``) that take the place of the roots, for parts of trees. Listings that are laid
    out by ``PART`` are used up: a part is deleted as soon as it is joined."""
    own_place = F.col("_own").bitwiseAND(F.lit(3)) != 0  # a parent or a name that isn't the path's
    keys = ["path", "type"] if src_raw.where(own_place).isEmpty() and dst_raw.where(own_place).isEmpty() else ["parent_path", "name", "type"]

    def keyed(raw: DataFrame) -> DataFrame:
        given = {"path": F.col("path"), "type": F.col("type")} | {k: F.when(F.col("_own").bitwiseAND(F.lit(1 << i)) == 0, e).otherwise(F.col(k)) for i, (k, e) in enumerate(_listed().items()) if k in keys}
        return raw.withColumns({f"_k{i}": given[k] for i, k in enumerate(keys)})

    def failed(rows: DataFrame, side: str) -> DataFrame | None:
        if failing is None:
            return None
        open_folders = _entries(unpacked(rows.select("path", "type", *ENTRY), _listed()).where("type = 'folder'"), side, F.lit("pending"), F.lit("pending" if side == "SRC" else ""))
        return written(failing(open_folders).select("path").distinct(), "failed")

    at = [f"_k{i}" for i in range(len(keys))]
    src, dst = keyed(src_raw), keyed(dst_raw)
    src = _without(src, written(_orphaned(unpacked(src_raw, _listed()), tops), "orphaned"))
    bad_src = failed(src, "SRC")
    src = _without(src, bad_src) if failing else src
    theirs = src.where("type = 'folder'").select(*at)
    closed = [written(dst.where("type = 'folder'").join(theirs, at, "left_anti").select("path"), "closed"), written(_orphaned(unpacked(dst_raw, _listed()), tops), "orphaned")]  # one after another
    dst = _without(dst, _union(closed))
    bad_dst = failed(dst.join(theirs, at, "left_semi"), "DST") if failing else None
    dst = _without(dst, bad_dst) if failing else dst

    plain = "path" in keys  # then the keys are path and type

    def sided(rows: DataFrame, x: str) -> DataFrame:
        own = ["path", "type"] * (not plain) + [c for c in ENTRY]
        return rows.select(*at, F.lit(True).alias(f"{x}_there"), *[F.col(c).alias(f"{x}_{c}") for c in own])

    bad = {x: few(b.select(F.col("path").alias(f"{x}_path"), F.lit(True).alias("_bad"))) for b, x in ((bad_src, "s"), (bad_dst, "d")) if b is not None}

    def passed(rows: int, parts: list[int] | None = None) -> DataFrame:
        mine = [t if parts is None else t.where(F.col(PART).isin(parts)) for t in (src, dst)]
        return in_passes(rows, lambda i, n: _joined(*(sided(t.where(F.pmod(F.xxhash64(*at), F.lit(n)) == i), x) for t, x in zip(mine, "sd")), at, dict(zip(keys, at)) if plain else {}, bad), "both")

    if PART not in src_raw.columns or PART not in dst_raw.columns:
        return of_both(passed(src_raw.count() + dst_raw.count()))
    done = []
    for parts, rows in grouped_parts(src_raw, dst_raw):
        done.append(passed(rows, parts))
        dropped(src_raw, dst_raw, parts=parts)
    return of_both(_union(done))


def _joined(src: DataFrame, dst: DataFrame, at: list[str], given: dict[str, str], bad: dict[str, DataFrame]) -> DataFrame:
    """Both sides joined by ``at``, with statuses. ``given``: which of the columns the keys hold; ``bad``: folders that failed."""
    joined = src.join(dst, at, "full")
    if given:
        joined = joined.withColumns({f"{x}_{c}": F.when(F.col(f"{x}_there"), F.col(k)) for x in "sd" for c, k in given.items()})
    in_src, in_dst, folder = F.col("s_there").isNotNull(), F.col("d_there").isNotNull(), F.col("type") == "folder"
    joined = joined.withColumns({"type": F.coalesce("s_type", "d_type"), "path": F.coalesce("s_path", "d_path")})
    copied = F.when(in_dst & folder, F.lit("successful")).when(in_dst, F.when(newer(F.col("d_mtime"), F.col("s_mtime")), F.lit("successful")).otherwise(F.lit("pending"))).otherwise(F.lit("pending"))
    joined = joined.withColumns({
        "s_status": F.when(in_src, F.lit("successful")), "d_status": F.when(in_dst, F.when(in_src, F.lit("successful")).otherwise(F.lit("not_on_src"))),
        "s_copy": F.when(in_src, F.when(F.col("s_path") == "/", F.lit("")).otherwise(copied)),
    })
    for x, failed in bad.items():
        joined = joined.join(failed, f"{x}_path", "left")
        joined = joined.withColumn(f"{x}_status", F.when(F.col("_bad") & folder & in_src, F.lit("failed")).otherwise(F.col(f"{x}_status"))).drop("_bad")
    there = {f"{x}_path": F.when(F.col(f"{x}_path") != F.col("path"), F.col(f"{x}_path")) for x in "sd"}
    return joined.withColumns(there).select(*BOTH)


#: A row for each pair and each node without one: ``path`` and ``type``, and what either side has of its own, without the paths that
#: are the same.
BOTH = ["path", "type", *[f"{x}_{c}" for x in "sd" for c in ("path", *ENTRY, "status")], "s_copy"]


def _side(both: DataFrame, x: str) -> DataFrame:
    """One side's listing rows (packed) out of ``both``, with its statuses, and path and time of what they are paired with."""
    o = "d" if x == "s" else "s"
    there = F.col(f"{o}_status").isNotNull()
    rows = both.where(F.col(f"{x}_status").isNotNull())
    return rows.select(
        F.coalesce(f"{x}_path", "path").alias("path"), "type", *[F.col(f"{x}_{c}").alias(c) for c in (*ENTRY, "status")], F.col("s_copy").alias("_copy"),
        F.when(there, F.coalesce(f"{o}_path", "path")).alias("other_path"), F.when(there, F.col(f"{o}_mtime")).alias("other_mtime"),
    )


def of_both(both: DataFrame, rounds: list[tuple[str, int, int, int]] | None = None) -> State:
    """The state that reads ``both`` (written). ``rounds`` are counted unless they are given."""
    src, dst = (with_partners(both, side).select(*COLUMNS) for side in ("SRC", "DST"))
    pairs = pair_ids(pairs_of(both))
    return State(src, dst, pairs, _rounds(both) if rounds is None else rounds, both)


def _rounds(both: DataFrame) -> list[tuple[str, int, int, int]]:
    depth, folder = path_depth(F.col("path")).alias("depth"), F.col("type") == "folder"
    hit = F.col("other_path").isNotNull()
    found = _side(both, "s").select(F.lit("SRC").alias("side"), depth, folder.alias("open")).unionByName(_side(both, "d").select(F.lit("DST").alias("side"), depth, (folder & hit).alias("open")))
    levels = {(r.side, r.depth): r for r in found.groupBy("side", "depth").agg(F.count("*").alias("n"), F.count_if("open").alias("open")).collect()}  # two rows a level
    return [(side, d, levels[side, d].open, levels[side, d + 1].n if (side, d + 1) in levels else 0) for d in sorted({d for _, d in levels}) for side in ("SRC", "DST") if (side, d) in levels and levels[side, d].open]


def with_partners(both: DataFrame, side: str, lists: bool = False, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """A side's nodes with ``other_path``, ``other_id`` and ``other_mtime`` of their pairs, and with ``lists`` the paths of their
    children (``child_paths``; only folders have any). Rows are joined before ids are made. ``part``: i and n, for the nodes in the
    i-th of n parts of the paths."""
    rows = every = _side(both, side[0].lower())

    def mine(path: str) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(part[1])) == part[0]

    rows = rows.where(mine("path")) if part[1] > 1 else rows
    extra = ["other_path", "other_id", "other_mtime"] + ["child_paths"] * lists
    if lists:
        kids = unpacked(every, _listed()).where("parent_path <> ''")
        kids = (kids.where(mine("parent_path")) if part[1] > 1 else kids).groupBy(F.col("parent_path").alias("_p")).agg(F.collect_list("path").alias("child_paths"))
        folder = F.coalesce(F.col("type") == "folder", F.lit(False))
        rows = rows.where(folder).join(kids, F.col("path") == F.col("_p"), "left").drop("_p").unionByName(rows.where(~folder).withColumn("child_paths", F.lit(None).cast("array<string>")))
    other = "DST" if side == "SRC" else "SRC"
    rows = unpacked(rows, _listed()).withColumn("other_id", node_id(other, F.col("other_path")))
    return _entries(rows, side, F.col("status"), F.col("_copy") if side == "SRC" else F.lit(""), tuple(extra))


def pairs_of(both: DataFrame) -> DataFrame:
    """``src_path, dst_path, type`` of the pairs."""
    return both.where("s_status IS NOT NULL AND d_status IS NOT NULL").select(F.coalesce("s_path", "path").alias("src_path"), F.coalesce("d_path", "path").alias("dst_path"), "type")


def pair_ids(pairs: DataFrame) -> DataFrame:
    """``src_id, dst_id`` of pairs of paths: made last, as ids take more space than paths."""
    return pairs.select(node_id("SRC", F.col("src_path")).alias("src_id"), node_id("DST", F.col("dst_path")).alias("dst_id"))


def advance(state: State, src_list: DataFrame, dst_list: DataFrame, failing: Callable[[DataFrame], DataFrame] | None = None, stop: Callable[[int], bool] | None = None) -> State:
    """Expand and compare what is pending in ``state``. The listings are laid out by depth."""
    both = state.src.select("depth", "traversal_status", "type").unionByName(state.dst.select("depth", "traversal_status", "type"))
    waiting = (F.col("traversal_status") == "pending") & (F.col("type") == "folder")
    first, last, known = both.agg(F.min(F.when(waiting, F.col("depth"))), F.max(F.when(waiting, F.col("depth"))), F.max("depth")).first()
    if first is None:
        return state
    src_new, dst_new, pairs_new, failed, rounds, depth = [], [], [], [], list(state.rounds), first
    open_src = open_dst = None  # pending folders among the level just found

    def frontier(old: DataFrame, new: list[DataFrame]) -> DataFrame:
        parts = []
        if depth <= last:
            kept = old.where(F.col("depth") == depth)
            parts.append(kept.join(new[-1].select("id"), "id", "left_anti").select(*old.columns) if new else kept)
        if new:
            parts.append(new[-1].select(*COLUMNS))
        return expand.frontier(_union([p.select(*COLUMNS) for p in parts]))

    while not (stop and stop(depth)):
        src_front, dst_front = frontier(state.src, src_new), frontier(state.dst, dst_new)
        n_src, n_dst = (f.count() if depth <= last or n is None else n for f, n in ((src_front, open_src), (dst_front, open_dst)))
        if not n_src and not n_dst and depth > last:
            break
        if failing is not None:
            bad = [failing(f).select("id") for f in (src_front, dst_front)]
            failed += bad
            src_front, dst_front = (f.join(b, "id", "left_anti").select(*COLUMNS) for f, b in zip((src_front, dst_front), bad))
        kids = written(expand.expand(src_front, src_list.where(F.col("_depth") == depth + 1), "SRC"), "src")
        actual = expand.expand(dst_front, dst_list.where(F.col("_depth") == depth + 1), "DST")
        pairs = pairs_new[-1:] + ([state.pairs.select("src_id", "dst_id")] if depth <= last else [])
        matched = dst_front.select(F.col("id").alias("dst_id")).join(_union(pairs).distinct(), "dst_id")
        expected = kids
        if depth < known:  # source children that weren't listed again
            expected = kids.unionByName(state.src.where(F.col("depth") == depth + 1).join(kids.select("id"), "id", "left_anti").select(*COLUMNS))
        found = written(compare.compare_level(actual, matched, expected), "dst")
        src_new.append(kids)
        dst_new.append(found)
        pairs_new.append(found.where("match_id IS NOT NULL").select(F.col("match_id").alias("src_id"), F.col("id").alias("dst_id")))
        (all_src, open_src), (all_dst, open_dst) = (df.agg(F.count("*"), F.count_if(waiting)).first() for df in (kids, found))
        rounds += [(side, depth, n, total) for side, n, total in (("SRC", n_src, all_src), ("DST", n_dst, all_dst)) if n]
        depth += 1
    if not src_new:
        return state
    bad = _union(failed) if failed else None
    kids, found, pairs = _union(src_new), _union(dst_new), _union(pairs_new)
    copies = found.where("match_id IS NOT NULL").select(F.col("match_id").alias("id"), F.col("src_copy").alias("_copy"))
    src = _finish(_replaced(state.src, kids), bad, depth).join(copies, "id", "left").withColumn("copy_status", F.coalesce("_copy", "copy_status"))
    dst = _finish(_replaced(state.dst, found), bad, depth)
    kept = state.pairs.join(pairs.select("src_id"), "src_id", "left_anti").join(pairs.select("dst_id"), "dst_id", "left_anti")
    return State(src.select(*COLUMNS), dst.select(*COLUMNS), kept.select("src_id", "dst_id").unionByName(pairs), rounds)


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old nodes that weren't found again, and the new ones."""
    return old.join(new.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(new.select(*COLUMNS))


def _finish(nodes: DataFrame, failed: DataFrame | None, depth: int) -> DataFrame:
    """Folders above ``depth`` have been expanded: they are successful, or failed if their listing was."""
    done = (F.col("traversal_status") == "pending") & (F.col("type") == "folder") & (F.col("depth") < depth)
    status = F.lit("successful")
    if failed is not None:
        nodes = nodes.join(failed.select("id", F.lit(True).alias("_failed")), "id", "left")
        status = F.when(F.col("_failed"), F.lit("failed")).otherwise(status)
    return nodes.withColumn("traversal_status", F.when(done, status).otherwise(F.col("traversal_status"))).select(*COLUMNS)
