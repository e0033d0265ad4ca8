"""Hand-written trees: each case of comparison, failure, exclusion and retry."""

import pytest
from helpers import listing
from pyspark.sql import functions as F

from treeflow.functions.scalar import node_id
from treeflow.operators import closure, retry, state, stats
from treeflow.plans import engine


@pytest.fixture(scope="module")
def trees(spark):
    src = listing(
        spark, ("/a",), ("/a/new", "file", 1, "2025-01-01T00:00:00Z"), ("/a/equal", "file"), ("/a/old", "file", 1, "2025-01-03T00:00:00Z"), ("/a/zone", "file", 1, "2025-01-01T00:00:00Z"),
        ("/a/bare", "file", 1, "2025-01-01"), ("/a/size", "file", 1), ("/x",), ("/only",), ("/only/f", "file"), ("/empty",), ("/zero", "file", 0), ("/file:y", "file"),
    )
    dst = listing(
        spark, ("/a",), ("/a/new", "file", 1, "2025-01-02T00:00:00Z"), ("/a/equal", "file"), ("/a/old", "file", 1, "2025-01-02T00:00:00Z"), ("/a/zone", "file", 1, "2025-01-01T00:30:00+01:00"),
        ("/a/bare", "file", 1, "2025-01-02T00:00:00Z"), ("/a/size", "file", 2, "2025-01-02T00:00:00Z"), ("/x", "file"), ("/theirs",), ("/theirs/f", "file"), ("/empty",), ("/y", "file"),
    )
    return src, dst


@pytest.fixture(scope="module")
def done(trees):
    return engine.reconcile(*trees)


def by_path(df, *columns):
    return {r.path: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_files_by_time(done):
    copy = by_path(done.src, "copy_status")
    assert copy["/a/new"] == "successful" and copy["/a/size"] == "successful"
    assert [copy[f"/a/{n}"] for n in ("equal", "old", "zone", "bare")] == ["pending"] * 4


def test_folders_and_types(done):
    dst, copy = by_path(done.dst, "traversal_status"), by_path(done.src, "copy_status")
    assert dst["/a"] == dst["/empty"] == "successful" and copy["/a"] == "successful"
    assert dst["/x"] == "not_on_src" and copy["/x"] == "pending"
    assert dst["/theirs"] == "not_on_src" and "/theirs/f" not in dst
    assert copy["/only"] == copy["/only/f"] == "pending" and "/only" not in dst
    assert dst["/y"] == "not_on_src" and copy["/file:y"] == "pending"
    assert copy["/"] == ""


def test_sizes(done):
    size = by_path(done.src, "size")
    assert size["/zero"] == 0 and size["/a"] is None


def test_invariants(done):
    nodes = done.src.unionByName(done.dst)
    assert nodes.count() == stats.status_counts(nodes).agg(F.sum("nodes")).first()[0]
    p = done.pairs
    assert p.count() == p.select("src_id").distinct().count() == p.select("dst_id").distinct().count()
    kids = nodes.where("depth > 0").alias("c").join(nodes.alias("p"), F.col("c.parent_id") == F.col("p.id"))
    assert kids.count() == nodes.where("depth > 0").count()
    assert kids.where("c.depth <> p.depth + 1").isEmpty()


def test_again_gives_the_same(trees, done):
    assert done.src.exceptAll(engine.reconcile(*trees).src).isEmpty()


def test_failed_listing(trees):
    out = engine.reconcile(*trees, failing=lambda f: f.where("path = '/a'"))
    status = by_path(out.src, "traversal_status")
    assert status["/a"] == "failed" and "/a/new" not in status
    assert by_path(out.dst, "traversal_status")["/a"] == "failed"
    assert stats.verification(out.src.unionByName(out.dst), allow_not_on_src=True).first().success


def test_attempts(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", None)], "id string, f int")
    got = {r.id: (r.attempts, r.outcome) for r in state.attempts(rows, "f", 3).collect()}
    assert got == {"a": (1, "successful"), "b": (2, "successful"), "c": (3, "successful"), "d": (3, "failed"), "e": (3, "failed")}
    assert state.attempts(rows, "f", 0).where("attempts <> 1").isEmpty()


def test_equal_names_pair_once(spark):
    twice = listing(spark, ("/d",)).unionByName(listing(spark, ("/d",)).where("path <> '/'").withColumn("service_id", F.lit("other")))
    out = engine.reconcile(twice, listing(spark, ("/d",)))
    assert out.pairs.where(F.col("dst_id") == node_id("DST", F.lit("/d"))).count() == 1


def test_exclusion(done):
    marked = state.set_excluded(done.src, done.src.where("path = '/only'"))
    marked = closure.inherit_exclusion(marked)
    flags = by_path(marked, "explicit_excluded", "inherited_excluded")
    assert flags["/only"] == (True, False) and flags["/only/f"] == (False, True) and flags["/a"] == (False, False)
    undone = closure.inherit_exclusion(state.set_excluded(marked, done.src.where("path = '/only'"), False))
    assert undone.where("explicit_excluded OR inherited_excluded").isEmpty()


def test_retry_restores(trees, done):
    broken = retry.invalidate(done, done.src.where("path = '/a'").select("id"))
    assert broken.src.count() == done.src.count() - 6 and broken.dst.count() == done.dst.count() - 6
    assert by_path(broken.dst, "traversal_status")["/a"] == "pending"
    again = retry.sweep(broken, *trees)
    assert again.src.exceptAll(done.src).isEmpty() and done.src.exceptAll(again.src).isEmpty()
    assert again.dst.exceptAll(done.dst).isEmpty() and again.pairs.count() == done.pairs.count()


def test_transitions(done):
    top = done.src.where("depth = 1 AND type = 'folder'")
    assert state.transition(done.src, top, "pending", "failed").exceptAll(done.src).isEmpty()
    assert state.transition(done.src, top, "pending").where("traversal_status = 'pending'").count() == top.count()
    with pytest.raises(KeyError):
        state.transition_one(done.src, "none", "failed")


def test_pairs_last_writer(spark):
    pairs = spark.createDataFrame([("a", "1"), ("b", "2")], "src_id string, dst_id string")
    new = spark.createDataFrame([("a", "2", 1), ("c", "1", 2)], "src_id string, dst_id string, seq long")
    assert {tuple(r) for r in state.put_pairs(pairs, new).collect()} == {("a", "2"), ("c", "1")}


def test_closure_survives_loops(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "id string, parent_id string")
    got = closure.descendants(loop, spark.createDataFrame([("a",)], "id string"))
    assert {(r.id, r.distance) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_empty_tables(spark, done):
    none = done.src.limit(0)
    assert stats.migration_status(none).first().src_total == 0
    assert stats.max_depth(none).first().max_depth == -1
    assert stats.status_flags(none).first().empty


def test_one_plan_gives_what_the_loop_gives(spark):
    """Random trees with missing, orphaned and unmatched folders, files of folders' names, and older and newer files."""
    import random

    for seed in (1, 2):
        r = random.Random(seed)
        sides = []
        for _ in range(2):
            rows = [("/r1",)]
            for i in range(150):
                path = "".join(f"/{r.choice('abc')}" for _ in range(r.randint(1, 5)))
                rows.append((path, r.choice(["folder", "folder", "file"]), None, f"2025-01-0{r.randint(1, 3)}T00:00:00Z"))
            sides.append(listing(spark, *{x[0]: x for x in rows}.values()))
        one, src, dst = engine.reconcile(*sides), *(engine.laid_out(x) for x in sides)
        loop = engine.advance(engine.seed(src.where("_depth = 0"), dst.where("_depth = 0")), src, dst)
        for name in ("src", "dst", "pairs"):
            a, b = (sorted(map(repr, getattr(s, name).collect())) for s in (one, loop))
            assert a == b and len(a) > 5
        assert one.rounds == loop.rounds


def test_repeated_names_go_through_the_loop(spark):
    rows = [("/a",), ("/a",), ("/a/x", "file")]
    done = engine.reconcile(listing(spark, *rows), listing(spark, *rows))
    assert done.dst.count() == 3 and done.pairs.count() == 3
