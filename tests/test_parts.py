"""Functions, sources, store, lifecycle, streams and the command line."""

import json
import os
import subprocess
import sys
import threading
from pathlib import Path

import pytest
from helpers import DATA, listing
from pyspark.sql import functions as F

from treeflow import lifecycle, schema
from treeflow.functions import scalar
from treeflow.operators import logs, metrics
from treeflow.plans.store import SnapshotStore
from treeflow.sources import local_fs, simulator
from treeflow.streaming import logs_stream, metrics_stream


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_paths(spark):
    norm = lambda p: scalar.normalise_path(F.lit(p))
    assert one(spark, norm("a//b/"), norm("/"), norm(""), norm(None), norm("/x")) == ("/a/b", "/", "/", "/", "/x")
    assert one(spark, scalar.path_depth(F.lit("/")), scalar.path_depth(F.lit("/a/b"))) == (0, 2)


def test_times(spark):
    newer = lambda a, b: scalar.newer(F.lit(a), F.lit(b))
    assert one(spark, newer("2025-01-02T00:00:00Z", "2025-01-01T00:00:00Z"), newer("2025-01-01T00:30:00+01:00", "2025-01-01T00:00:00Z")) == (True, False)
    assert one(spark, newer("2025-01-02", "2025-01-01T00:00:00Z"), newer(None, "2025-01-01T00:00:00Z"), newer("2025-13-01T00:00:00Z", "2025-01-01T00:00:00Z")) == (False, False, False)


def test_levels(spark):
    assert one(spark, scalar.level_name(F.lit(7)), scalar.level_of(F.lit("00000012")), scalar.level_of(F.lit("x"))) == ("00000007", 12, None)
    assert one(spark, scalar.level_index(F.lit("Warning")), scalar.level_index(F.lit("none"))) == (3, None)


def test_schema_check(spark):
    rows = listing(spark)
    assert schema.require(rows.withColumn("more", F.lit(1)), schema.LISTING).columns == [f.name for f in schema.LISTING]
    with pytest.raises(ValueError, match="size"):
        schema.require(rows.drop("size"), schema.LISTING)


def test_simulator(spark):
    spec = simulator.TreeSpec(max_depth=3, min_folders=2, max_folders=3, min_files=1, max_files=2, seed=5)
    first, again = simulator.listing(spark, spec), simulator.listing(spark, spec)
    assert first.exceptAll(again).isEmpty()
    per = first.where("type = 'folder' AND path <> '/'").groupBy("parent_path").count()
    assert per.where("count < 2 OR count > 3").isEmpty()
    second = simulator.listing(spark, spec, "s1")
    assert second.exceptAll(first).isEmpty() and second.count() < first.count()


def test_local_tree(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/f.txt").write_text("abc")
    (tmp_path / "top.txt").write_text("")
    got = {r.path: (r.type, r.size, r.parent_path) for r in local_fs.listing(spark, str(tmp_path)).collect()}
    assert got == {"/": ("folder", None, ""), "/d": ("folder", None, "/"), "/top.txt": ("file", 0, "/"), "/d/e": ("folder", None, "/d"), "/d/e/f.txt": ("file", 3, "/d/e")}
    with pytest.raises(ValueError, match="unsupported"):
        local_fs.open_source(spark, "ftp")


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    assert store.manifest()["version"] == 0
    store.save({"a": spark.range(3).toDF("x")}, {"k": 1})
    store.save({"a": spark.range(5).toDF("x")}, {"k": 2})
    assert store.load("a").count() == 5 and store.manifest()["state"] == {"k": 2}
    with pytest.raises(KeyError):
        store.load("b")


def test_intermediate_tables_can_be_released(spark):
    from treeflow.plans import store

    table = store.written(spark.range(3).toDF("x"), "test")
    assert table.count() == 3 and f"/treeflow/{spark.sparkContext.applicationId}/" in table.inputFiles()[0]


def _config(tmp_path, **more):
    spec = {"kind": "simulator", "max_depth": 2, "min_folders": 1, "max_folders": 2, "min_files": 1, "max_files": 2}
    return lifecycle.Config(str(tmp_path / "run"), spec, spec | more)


def test_run_and_rerun(spark, tmp_path):
    config = _config(tmp_path)
    report = lifecycle.migrate(spark, config)
    assert report["src_total"] == report["dst_total"] > 1 and report["pending"] == 0
    run = lifecycle.Run(spark, config)
    assert run.state()["checkpoint"] == lifecycle.Checkpoint.PATH_REVIEW.value
    assert run.run() == report


def test_suspend_and_resume(spark, tmp_path):
    config = _config(tmp_path)
    whole = lifecycle.migrate(spark, lifecycle.Config(str(tmp_path / "other"), config.source, config.destination))
    run = lifecycle.Run(spark, config)
    run._stop.is_set = iter([False, False, True, True]).__next__
    assert run.start().wait(120) == {"suspended": True}
    assert run.state()["checkpoint"] == lifecycle.Checkpoint.TRAVERSAL_SUSPENDED.value
    assert not run.store.load("src_nodes").where("traversal_status = 'pending' AND type = 'folder'").isEmpty()
    assert lifecycle.Run(spark, config).start().wait(120) == whole


def test_checkpoints():
    c = lifecycle.Checkpoint
    assert lifecycle.move(None, c.ROOTS_SET) == c.ROOTS_SET
    with pytest.raises(ValueError):
        lifecycle.move(c.ROOTS_SET, c.COMPLETE)


def test_config():
    text = json.dumps({"state_dir": "s", "source": {}, "destination": {}, "max_retries": 0})
    library, cli = lifecycle.Config.from_json(text), lifecycle.Config.from_json(text, command_line=True)
    assert library.max_retries == 1 and not library.verify.allow_not_on_src and cli.verify.allow_not_on_src
    assert lifecycle.Config.from_json(library.to_json()) == library


def test_verification_errors(spark):
    from treeflow.operators.expand import root_node

    nodes = root_node("SRC", listing(spark))
    with pytest.raises(lifecycle.VerificationError, match="no nodes"):
        lifecycle.verify(nodes.limit(0), lifecycle.Verify())
    with pytest.raises(lifecycle.VerificationError, match="not verified"):
        lifecycle.verify(nodes, lifecycle.Verify())
    assert lifecycle.verify(nodes, lifecycle.Verify(allow_pending=True))["pending"] == 1


def test_ema(spark):
    polls = spark.createDataFrame([("q", 0, 10), ("q", 10, 30), ("q", 20, 30), ("r", 5, 1)], "k string, t long, n long")
    got = {(r.k, r.t): round(r.rate, 9) for r in metrics.ema_rate(polls, "k", "t", "n").collect()}
    assert got == {("q", 0): 0.0, ("q", 10): 0.4, ("q", 20): 0.32, ("r", 5): 0.0}


def test_ema_stream(spark, tmp_path):
    path = f"{DATA}/sf0.001/events.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    source = tmp_path / "in"
    source.mkdir()
    (source / "events.parquet").symlink_to(path)
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(str(source))
    query = metrics_stream.ema_stream(events).writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    from treeflow.plans import catalog

    want = catalog.QUERIES["a24_ema_rate"](spark, f"{DATA}/sf0.001")
    got = spark.table("rates").select(F.col("queue").alias("event_type"), F.col("t").alias("day"), F.round(F.col("rate") * 1e6).cast("long").alias("r"))
    want = want.select("event_type", "day", F.round(F.col("nano_rate") / 1e3).cast("long").alias("r"))
    joined = got.join(want.withColumnRenamed("r", "w"), ["event_type", "day"])
    assert joined.count() == want.count() and joined.where(F.abs(F.col("r") - F.col("w")) > 1).isEmpty()


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"timestamp":"2025-01-01T00:00:00Z","level":"error","message":"m"}\nnot json\n{"level":"trace","message":"n"}\n')
    shown = []
    query = logs_stream.keep(logs_stream.packets(spark, str(tmp_path / "in")), str(tmp_path / "logs"), str(tmp_path / "cp"), "warning", lambda b: shown.extend(r.message for r in b.collect()))
    query.awaitTermination(120)
    assert {r.message for r in spark.read.parquet(str(tmp_path / "logs")).collect()} == {"m", "n"} and shown == ["m"]


def test_log_orders(spark):
    rows = spark.createDataFrame([("1", "2025-01-01T00:00:00.5Z", "info"), ("2", "2025-01-01T00:00:00Z", "info")], "id string, timestamp string, level string")
    assert [r.id for r in logs.ordered(rows).collect()] == ["2", "1"]
    assert [r.id for r in logs.ordered(rows, by_text=True).collect()] == ["1", "2"]


def test_entry_without_corpus_operators(tmp_path):
    """The entry module works where the corpus subpackage is missing."""
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['treeflow.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__file__).resolve().parent.parent / "treeflow"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_threads_are_daemons(spark, tmp_path):
    run = lifecycle.Run(spark, _config(tmp_path)).start()
    assert isinstance(run._thread, threading.Thread) and run._thread.daemon
    run.wait(120)
    assert run.done
