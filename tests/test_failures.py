"""Folders that can't be read, sweeps, inspection, tables, crashes while saving, and streams in several batches."""

import os

import pytest
from helpers import listing
from pyspark.sql import functions as F

from treeflow.lifecycle import Config, Run, Verify
from treeflow.operators import etl, metrics
from treeflow.plans import engine
from treeflow.plans.store import SnapshotStore
from treeflow.schema import LOGS, QUEUE_STATS
from treeflow.sources import local_fs
from treeflow.streaming import metrics_stream


def write(df, path, errors=()):
    bad = F.lit(None).cast("string")
    for p in errors:
        bad = F.when(F.col("path") == p, F.lit("Permission denied")).otherwise(bad)
    df.withColumn("error", bad).write.mode("overwrite").parquet(str(path))


def test_unreadable_folder_fails_and_is_swept(spark, tmp_path):
    rows = [("/a",), ("/a/x", "file"), ("/b",), ("/b/y", "file"), ("/b/c",), ("/b/c/z", "file")]
    write(listing(spark, *rows[:3]), tmp_path / "src", ["/b"])
    write(listing(spark, *rows), tmp_path / "dst")
    config = Config(str(tmp_path / "state"), {"kind": "parquet", "path": str(tmp_path / "src")}, {"kind": "parquet", "path": str(tmp_path / "dst")}, verify=Verify(allow_not_on_src=True))
    run = Run(spark, config)
    report = run.run()
    assert report["failed"] == 1
    nodes = {(r.side, r.path): r.traversal_status for r in run.store.load("src_nodes").unionByName(run.store.load("dst_nodes")).collect()}
    assert nodes["SRC", "/b"] == "failed" and nodes["DST", "/b/y"] == "not_on_src" and ("SRC", "/b/y") not in nodes
    told = run.inspect()
    assert told["src_failed"] == 1 and told["src_total"] == 4 and told["checkpoint"] == "Preparing-Path-Review"
    write(listing(spark, *rows), tmp_path / "src")  # it can be read now
    again = Run(spark, config)
    assert again.sweep()["failed"] == 0
    nodes = {(r.side, r.path): r.traversal_status for r in again.store.load("src_nodes").unionByName(again.store.load("dst_nodes")).collect()}
    assert set(nodes.values()) == {"successful"} and len(nodes) == 14
    write(listing(spark, *rows[:5]), tmp_path / "src")
    again.sweep(["/b"])
    assert {r.path for r in again.store.load("src_nodes").collect()} == {"/", "/a", "/a/x", "/b", "/b/y", "/b/c"}


def test_sweep_reads_pending_parts_only(spark):
    rows = listing(spark, ("/a",), ("/a/x", "file"), ("/b",), ("/b/c",), ("/b/c/d", "file"), ("/bb",), ("/bb/e", "file"))
    tops = spark.createDataFrame([("/b",), ("/b/c",)], "path string")
    assert sorted(r.path for r in engine.below(rows, tops).collect()) == ["/b/c", "/b/c/d"]
    assert engine.below(rows, tops.limit(0)).isEmpty()
    assert engine.below(rows, spark.createDataFrame([("/",)], "path string")).count() == 7


def test_directory_reader_tries_again(tmp_path, monkeypatch):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/f").write_text("x")
    tries, real = [], os.scandir

    def scandir(path):
        if str(path).endswith("/e"):
            tries.append(path)
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    monkeypatch.setattr(local_fs, "PAUSE", 0)
    reader = local_fs._Reader(str(tmp_path), 3)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(tries) == 3 and {r[3]: r[-1] for r in rows} == {"/": None, "/d": None, "/d/f": None, "/d/e": "Permission denied"}


def test_killed_save_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    store.save({"a": spark.range(3).toDF("x")}, {"k": 1})
    real = SnapshotStore._commit

    def killed(self, version, body):
        raise KeyboardInterrupt

    monkeypatch.setattr(SnapshotStore, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        store.save({"a": spark.range(9).toDF("x")}, {"k": 2})
    assert store.load("a").count() == 3 and store.manifest()["state"] == {"k": 1}
    monkeypatch.setattr(SnapshotStore, "_commit", real)
    for n in (4, 5, 6):
        store.save({"a": store.load("a").unionByName(spark.range(1).toDF("x"))}, {"k": n})
    assert store.load("a").count() == 6 and store.manifest()["version"] == 4
    assert sorted(p for p in os.listdir(tmp_path / "state") if p.startswith("manifest")) == ["manifest-3.json", "manifest-4.json"]


def test_tables_there_and_back(spark, tmp_path):
    done = engine.reconcile(listing(spark, ("/a",), ("/a/x", "file")), listing(spark, ("/a",), ("/z", "file")))
    empty = spark.createDataFrame([], "bucket_path string, count long"), spark.createDataFrame([], QUEUE_STATS), spark.createDataFrame([], LOGS)
    reports = etl.write_tables(spark, str(tmp_path / "t"), done.src, done.dst, done.pairs, *empty)
    assert {r.queue: r.processed for r in metrics.throughput(reports).collect()} == {"src_nodes": 3, "dst_nodes": 3, "stats": 0, "queue_stats": 0, "logs": 0}
    back = etl.read_tables(spark, str(tmp_path / "t"))
    for name in ("src", "dst", "pairs"):
        columns = sorted(back[name].columns)
        assert sorted(map(repr, back[name].select(*columns).collect())) == sorted(map(repr, getattr(done, name).select(*columns).collect()))
    etl.drop_tables(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_services():
    assert local_fs.service_type(None) == "unknown" and local_fs.service_type({"kind": "Local"}) == "local"
    assert local_fs.same_service({"kind": "simulator"}, {"kind": "SIMULATOR"}) and not local_fs.same_service({"kind": "local"}, {"kind": "local"}) and not local_fs.same_service(None, {"kind": "simulator"})


class Held:
    """A state as the streaming operator sees it."""

    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_rates_do_not_depend_on_batches():
    import pandas as pd

    events = [(0, 5), (10, 3), (10, 4), (20, 1), (20, 2), (40, 6)]

    def last(batches):
        state, rows = Held(), {}
        for batch in batches:
            frames = iter([pd.DataFrame(batch, columns=["t", "n"])])
            for frame in metrics_stream._update(("q",), frames, state):
                rows |= {r.t: (r.total, r.rate) for r in frame.itertuples()}
        return rows

    want = last([events])
    assert want == last([[e] for e in events]) == last([events[:2], events[2:4], events[4:]])
    assert want[10] == (12, pytest.approx(0.14)) and [t for t, _ in want.values()] == [5, 12, 15, 21]


def test_late_rows_of_a_stream(spark, tmp_path):
    """Rows older than the watermark are dropped, others reach their window in a later batch."""
    schema = "event_type string, ts timestamp"
    for i, rows in enumerate(([("a", "2024-01-01 10:10:00")], [("a", "2024-01-03 10:00:00")], [("a", "2024-01-03 09:30:00"), ("a", "2024-01-01 10:20:00")])):
        spark.createDataFrame(rows, "event_type string, t string").select("event_type", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        kept = []
        query = metrics_stream.windowed_counts(stream).writeStream.foreachBatch(lambda df, e: kept.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
        got = {(r.start.day, r.start.hour): r.n for r in kept}
        assert got == [{(1, 10): 1}, {(3, 10): 1}, {(3, 9): 1}][i]
