"""Queries at size: states hold paths, not ids, and nothing of a tree's size is joined by ids."""

import re

import pytest
from helpers import DATA

from treeflow.operators import retry
from treeflow.plans import catalog, engine

IDS = {"id", "src_id", "dst_id", "root_id", "parent_id"}


def keyed_by_ids(spark, name):
    """Keys of sort-merge joins and windows of a query's plan that are ids; small tables aren't sent to all tasks unless the code says so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"(?:SortMergeJoin|Window) [^\n]*", plan)
    return {k for line in keys for k in re.findall(r"(\w+)#", line) if k in IDS}


@pytest.fixture
def whole(spark):
    return catalog.reconciled(spark, f"{DATA}/sf0.001")


#: Queries of findings.
BY_PATHS = [
    "a14_subtree_stats",
    "a15_excluded_in_subtree",
    "j11_copy_updates",
    "p06_status_flatten",
    "p07_dst_nodes_table",
    "p07_src_nodes_table",
    "p08_roundtrip_pairs",
    "u05_delete_pairs",
    "x02_mtime_decision",
    "j05_pairs_last_writer",
    "a12_join_coverage",
    "j02_expected_children",
    "p08_roundtrip",
    "u07_delete_subtree",
    "u12_inherited_exclusion",
]


@pytest.mark.parametrize("name", BY_PATHS)
def test_no_join_by_ids(spark, name):
    assert not keyed_by_ids(spark, name)


def test_invalidated_state_without_ids(whole):
    gone = retry.invalidate(whole, whole.src.where("path = '/ASIA'").select("id"))
    assert gone.both is not None and gone.src.where("path LIKE '/ASIA/%'").isEmpty() and gone.pairs.count() < whole.pairs.count()


def test_differences_in_passes(whole, monkeypatch):
    from treeflow.operators import etl
    from treeflow.plans import store

    changed, columns = catalog.varied(whole.src), ["traversal_status"]
    want = sorted(map(tuple, etl.differences(whole.src, changed, columns).collect()))
    monkeypatch.setattr(store, "ROWS_A_PASS", 2000)
    assert sorted(map(tuple, etl.differences_by_path(whole.src, changed, columns, whole.src.count()).collect())) == want and want


def test_state_without_ids(whole):
    """p01_tasks and p02_task_nodes read the state alone: its files have no ids."""
    assert not IDS & set(whole.both.columns) and set(engine.COLUMNS) == set(whole.src.columns)


def test_ids_are_made_on_reading(whole):
    """For p02_task_nodes: ids that are left out come from side and path again."""
    from treeflow.functions.scalar import node_id

    nodes = catalog.nodes_of(whole)
    assert nodes.where(nodes["id"] != node_id(nodes["side"], nodes["path"])).isEmpty() and whole.both is not None


def test_failures_without_the_loop(spark):
    from helpers import listing

    rows = [("/a",), ("/a/x", "file"), ("/b",), ("/b/c",), ("/b/c/d", "file")]
    src, dst, bad = listing(spark, *rows), listing(spark, *rows, ("/a/y", "file")), lambda f: f.where("path = '/b' AND side = 'SRC' OR path = '/a'")
    one, a, b = engine.reconcile(src, dst, bad), engine.laid_out(src), engine.laid_out(dst)
    loop = engine.advance(engine.seed(a.where("_depth = 0"), b.where("_depth = 0")), a, b, bad)
    assert one.both is not None and one.rounds == loop.rounds
    for name in ("src", "dst", "pairs"):
        assert sorted(map(repr, getattr(one, name).collect())) == sorted(map(repr, getattr(loop, name).collect()))


def test_listings_go_as_they_are_joined(spark, monkeypatch):
    """u16_failed_listing: a part of both listings is deleted when its pass is over, so that disk holds an entry in a listing or in the
    state. A part that is too large for a pass is joined in several."""
    import glob

    from treeflow.plans import store

    want, joined, left = rows_of(catalog.QUERIES["u16_failed_listing"](spark, f"{DATA}/sf0.001")), engine._joined, []

    def counted(*args):
        left.append(len({f.rsplit("/", 1)[0] for f in glob.glob(f"{store.shared_dir(spark)}/listing-*/_part=*/*.parquet")} - before))
        return joined(*args)

    before = {f.rsplit("/", 1)[0] for f in glob.glob(f"{store.shared_dir(spark)}/listing-*/_part=*/*.parquet")}
    monkeypatch.setattr(engine, "_joined", counted)
    for rows, passes in ((1_000, range(9, 40)), (3_500, range(3, 9)), (10**6, [1])):
        monkeypatch.setattr(store, "ROWS_A_PASS", rows)
        left.clear()
        assert rows_of(catalog.QUERIES["u16_failed_listing"](spark, f"{DATA}/sf0.001")) == want
        assert len(left) in passes and left[0] == 16 and left == sorted(left, reverse=True) and (left[-1] < 16) == (len(left) > 1)
        assert not {f.rsplit("/", 1)[0] for f in glob.glob(f"{store.shared_dir(spark)}/listing-*/_part=*/*.parquet")} - before


def test_sweep_without_the_loop(spark, whole):
    from treeflow.sources import star_tree

    gone = retry.invalidate(whole, whole.src.where("path = '/ASIA'").select("id"))
    again = retry.sweep(gone, star_tree.src_listing(spark, f"{DATA}/sf0.001"), star_tree.dst_listing(spark, f"{DATA}/sf0.001"))
    assert again.both is not None
    for name in ("src", "dst", "pairs"):
        assert getattr(again, name).exceptAll(getattr(whole, name)).isEmpty() and getattr(again, name).count() == getattr(whole, name).count()


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df.select(*columns).collect()))


def test_roundtrip_through_tables_without_ids(spark, whole):
    """u19_tables_roundtrip: neither side's table is joined by ids."""
    assert not keyed_by_ids(spark, "u19_tables_roundtrip")


def test_written_tables_hold_no_ids(spark, whole, tmp_path, monkeypatch):
    """What follows from paths isn't in the files, in however many parts they are written; all columns come back."""
    from treeflow.operators import etl, stats
    from treeflow.plans import store
    from treeflow.schema import LOGS, QUEUE_STATS

    root, more = str(tmp_path / "t"), [spark.createDataFrame([], s) for s in ("bucket_path string, count long", QUEUE_STATS, LOGS)]
    parts = [[engine.with_partners(whole.both, side, True, (i, 3)) for i in range(3)] for side in ("SRC", "DST")]
    etl.write_tables(spark, root, *parts, None, *more)
    monkeypatch.setattr(store, "ROWS_A_PASS", 2000)
    for name, side in etl.SIDES.items():
        held = spark.read.parquet(f"{root}/{name}")
        assert held.where("id IS NOT NULL OR parent_id IS NOT NULL OR path_hash IS NOT NULL OR child_ids IS NOT NULL OR dst_id IS NOT NULL".replace("dst_id", etl._other(side)[0])).isEmpty()
        assert rows_of(etl.read_table(spark, root, name)) == rows_of(etl.to_table(getattr(whole, side.lower()), whole.pairs, side))
    assert rows_of(etl.read_tables(spark, root)["pairs"]) == rows_of(whole.pairs)
    assert rows_of(stats.bucket_stats(catalog.nodes_of(whole), whole.pairs, etl.parents(spark, root))) == rows_of(stats.bucket_stats(catalog.nodes_of(whole), whole.pairs))
    want = whole.src.join(whole.pairs.withColumnRenamed("src_id", "id"), "id", "left").fillna("", ["dst_id"])
    assert rows_of(etl.paired_nodes(spark, root)) == rows_of(want)


def test_tables_of_other_ids(spark, tmp_path):
    """Ids and pairs that don't follow from paths are kept as they are; pairs of either table count."""
    from helpers import listing
    from pyspark.sql import functions as F

    from treeflow.operators import etl
    from treeflow.schema import LOGS, QUEUE_STATS

    done = engine.reconcile(listing(spark, ("/a",), ("/a/x", "file"), ("/b",)), listing(spark, ("/a",), ("/b",)))
    src = done.src.withColumns({c: F.when(F.col(c) != "", F.substring(c, 1, 9)).otherwise("") for c in ("id", "parent_id")}).withColumn("service_id", F.lit("s"))
    pairs = done.pairs.withColumn("src_id", F.substring("src_id", 1, 9))
    root, more = str(tmp_path / "t"), [spark.createDataFrame([], s) for s in ("bucket_path string, count long", QUEUE_STATS, LOGS)]
    etl.write_tables(spark, root, src, done.dst, pairs, *more)
    back = etl.read_tables(spark, root)
    assert rows_of(back["src"]) == rows_of(src) and rows_of(back["pairs"]) == rows_of(pairs)
    assert rows_of(etl.read_table(spark, root, "src_nodes")) == rows_of(etl.to_table(src, pairs, "SRC"))
    want = src.join(pairs.withColumnRenamed("src_id", "id"), "id", "left").fillna("", ["dst_id"])
    assert rows_of(etl.paired_nodes(spark, root)) == rows_of(want)
    etl.write_tables(spark, root, src, done.dst, pairs.limit(0), *more)  # no pairs in either
    etl.save(etl.compact(done.dst, done.pairs, "DST"), f"{root}/dst_nodes", "depth", mode="overwrite")  # now the destination's alone
    assert rows_of(etl.read_tables(spark, root)["pairs"]) == rows_of(done.pairs)
