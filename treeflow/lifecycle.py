"""Runs from configuration to verified result: state document, checkpoints, suspend and resume, controller."""

from __future__ import annotations

import json
import signal
import threading
import time
from dataclasses import asdict, dataclass, field
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import retry, state, stats
from .plans import engine
from .plans.store import SnapshotStore, written


# The names of the checkpoints in state documents.
class Checkpoint(str, Enum):
    ROOTS_SET = "Roots-Set"
    FILTERS_SET = "Filters-Set"
    TRAVERSAL_PENDING = "Traversal-Pending"
    TRAVERSAL_RUNNING = "Traversal-In-Progress"
    TRAVERSAL_SUSPENDED = "Traversal-Suspended"
    PATH_REVIEW = "Preparing-Path-Review"
    REVIEW_PENDING = "Awaiting-Path-Review"
    COPY_RUNNING = "Copy-In-Progress"
    COPY_SUSPENDED = "Copy-Suspended"
    COMPLETE = "Complete"
    FAILED = "Failed"


#: Which checkpoints may follow which; resuming goes back to running.
NEXT = {
    Checkpoint.ROOTS_SET: {Checkpoint.FILTERS_SET, Checkpoint.TRAVERSAL_PENDING, Checkpoint.TRAVERSAL_RUNNING, Checkpoint.FAILED},
    Checkpoint.FILTERS_SET: {Checkpoint.TRAVERSAL_PENDING, Checkpoint.TRAVERSAL_RUNNING, Checkpoint.FAILED},
    Checkpoint.TRAVERSAL_PENDING: {Checkpoint.TRAVERSAL_RUNNING, Checkpoint.FAILED},
    Checkpoint.TRAVERSAL_RUNNING: {Checkpoint.TRAVERSAL_SUSPENDED, Checkpoint.PATH_REVIEW, Checkpoint.FAILED},
    Checkpoint.TRAVERSAL_SUSPENDED: {Checkpoint.TRAVERSAL_RUNNING, Checkpoint.FAILED},
    Checkpoint.PATH_REVIEW: {Checkpoint.REVIEW_PENDING, Checkpoint.FILTERS_SET, Checkpoint.FAILED},
    Checkpoint.REVIEW_PENDING: {Checkpoint.FILTERS_SET, Checkpoint.COPY_RUNNING, Checkpoint.FAILED},
    Checkpoint.COPY_RUNNING: {Checkpoint.COPY_SUSPENDED, Checkpoint.COMPLETE, Checkpoint.FAILED},
    Checkpoint.COPY_SUSPENDED: {Checkpoint.COPY_RUNNING, Checkpoint.FAILED},
    Checkpoint.COMPLETE: {Checkpoint.FILTERS_SET},
    Checkpoint.FAILED: {Checkpoint.TRAVERSAL_RUNNING, Checkpoint.FILTERS_SET},
}


@dataclass
class Verify:
    allow_pending: bool = False
    allow_not_on_src: bool = False


@dataclass
class Config:
    """What a run needs: where state is kept, the two sources (adapter name and options), retries, verification."""

    state_dir: str
    source: dict
    destination: dict
    max_retries: int = 3
    verify: Verify = field(default_factory=Verify)
    migration_id: str = ""

    def __post_init__(self):
        self.max_retries = max(1, self.max_retries)
        self.migration_id = self.migration_id or f"migration-{int(time.time())}"

    @classmethod
    def from_json(cls, text: str, command_line: bool = False) -> Config:
        """A configuration document. On the command line a document without verification options allows what is only on the
        destination; in the library it doesn't."""
        d = json.loads(text)
        options = d.pop("verify", None) or d.pop("verification", None) or {}
        if command_line and not any(options.values()):
            options = {"allow_not_on_src": True}
        return cls(**d, verify=Verify(**options))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


class VerificationError(Exception):
    pass


def move(now: Checkpoint | None, new: Checkpoint) -> Checkpoint:
    """The new checkpoint, if it may follow the present one."""
    if now is not None and new != now and new not in NEXT[now]:
        raise ValueError(f"{now.value} can't become {new.value}")
    return new


def verify(nodes: DataFrame, options: Verify) -> dict:
    """The verification report; raises if there is nothing to verify or it doesn't hold."""
    report = stats.verification(nodes, options.allow_pending, options.allow_not_on_src).first().asDict()
    if not report["src_total"] and not report["dst_total"]:
        raise VerificationError("no nodes")
    if not report["success"]:
        raise VerificationError(f"not verified: {report}")
    return report


def _unreadable(src: DataFrame, dst: DataFrame):
    """Picks, of a frontier, the folders that a listing says it couldn't read; None if there are none."""
    bad = [df.where("error IS NOT NULL").select(F.lit(side).alias("side"), "path") for side, df in (("SRC", src), ("DST", dst)) if "error" in df.columns]
    if not bad:
        return None
    bad = written(reduce(DataFrame.unionByName, bad), "unreadable")
    return None if bad.isEmpty() else lambda frontier: frontier.join(bad, ["side", "path"], "left_semi")


class Run:
    """A run: ``start`` in a thread, ``shutdown`` suspends it between levels, ``wait`` gives the report."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.store = SnapshotStore(spark, config.state_dir)
        self._stop, self._thread = threading.Event(), None
        self._result: dict | None = None
        self._error: BaseException | None = None

    # state document
    def state(self) -> dict:
        return self.store.manifest()["state"]

    def _save(self, checkpoint: Checkpoint, tables: dict[str, DataFrame], **more) -> None:
        before = self.state()
        now = Checkpoint(before["checkpoint"]) if before.get("checkpoint") else None
        doc = before | {"checkpoint": move(now, checkpoint).value, "config": asdict(self.config), "saved_at": int(time.time())} | more
        self.store.save(tables, doc)

    def _tables(self) -> dict[str, DataFrame]:
        return {n: self.store.load(n) for n in self.store.manifest()["tables"]}

    # running
    def run(self) -> dict:
        """Fresh, resumed or already complete: traverse what is left, then verify."""
        checkpoint = self.state().get("checkpoint")
        if checkpoint in (Checkpoint.PATH_REVIEW.value, Checkpoint.COMPLETE.value):
            tables = self._tables()
            return self._verified(tables["src_nodes"].unionByName(tables["dst_nodes"]))
        if checkpoint is None:
            self._save(Checkpoint.ROOTS_SET, {})
        src, dst = self._listings()
        for side, listing in (("source", src), ("destination", dst)):
            if listing.where(F.col("path") == "/").isEmpty():
                raise ValueError(f"the {side} has no root")
        self._suspended = self._tables()  # paths of the version now current; the next ones don't overwrite it
        self._save(Checkpoint.TRAVERSAL_RUNNING, self._suspended)
        stop, failing = (lambda depth: self._stop.is_set()), _unreadable(src, dst)
        if checkpoint == Checkpoint.TRAVERSAL_SUSPENDED.value:  # go on at the lowest pending depth
            t = self._suspended
            before = engine.State(t["src_nodes"], t["dst_nodes"], t["pairs"], [tuple(r) for r in self.state().get("rounds", [])])
            done = engine.advance(before, engine.laid_out(src), engine.laid_out(dst), failing, stop)
        else:
            done = engine.reconcile(src, dst, failing, stop)
        tables = {"src_nodes": done.src, "dst_nodes": done.dst, "pairs": done.pairs}
        rounds = [list(r) for r in done.rounds]
        if self._stop.is_set():
            self._save(Checkpoint.TRAVERSAL_SUSPENDED, tables, rounds=rounds)
            return {"suspended": True}
        self._save(Checkpoint.PATH_REVIEW, tables, rounds=rounds)
        return self._verified(self.store.load("src_nodes").unionByName(self.store.load("dst_nodes")))

    def _listings(self) -> tuple[DataFrame, DataFrame]:
        """Both sources; an adapter that reads folders itself tries each as often as the configuration says."""
        from .sources.local_fs import open_source, service_type

        options = [dict(x) | ({"attempts": self.config.max_retries} if service_type(x) == "local" else {}) for x in (self.config.source, self.config.destination)]
        src, dst = (open_source(self.spark, **x) for x in options)
        return src, dst

    def sweep(self, paths: list[str] | None = None) -> dict:
        """List again what failed, or the source folders at ``paths`` with all that hangs on them, and verify."""
        t = self._tables()
        if not t:
            raise ValueError("there is no state to sweep")
        s = engine.State(t["src_nodes"], t["dst_nodes"], t["pairs"], [tuple(r) for r in self.state().get("rounds", [])])
        if paths is None:
            again = lambda nodes: state.transition(nodes, nodes.where("traversal_status = 'failed'").select("id"), "pending")
            s = engine.State(again(s.src), again(s.dst), s.pairs, s.rounds)
        else:
            s = retry.invalidate(s, retry.ids_of("SRC", self.spark.createDataFrame([(p,) for p in paths], "path string")))
        src, dst = self._listings()
        done = retry.sweep(s, src, dst, _unreadable(src, dst))
        self._save(Checkpoint(self.state()["checkpoint"]), {"src_nodes": done.src, "dst_nodes": done.dst, "pairs": done.pairs}, rounds=[list(r) for r in done.rounds])
        return self._verified(self.store.load("src_nodes").unionByName(self.store.load("dst_nodes")))

    def inspect(self) -> dict:
        """Checkpoint, and totals, pending, failed and smallest pending depth of both sides."""
        t = self._tables()
        doc = {"checkpoint": self.state().get("checkpoint")}
        return doc | stats.migration_status(t["src_nodes"].unionByName(t["dst_nodes"])).first().asDict() if t else doc

    def _verified(self, nodes: DataFrame) -> dict:
        return verify(nodes, self.config.verify)

    def start(self) -> Run:
        def work():
            try:
                self._result = self.run()
            except BaseException as e:
                self._error = e

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()
        return self

    def shutdown(self) -> None:
        self._stop.set()

    @property
    def done(self) -> bool:
        return self._thread is not None and not self._thread.is_alive()

    def wait(self, timeout: float | None = None) -> dict | None:
        self._thread.join(timeout)
        if self._error is not None:
            raise self._error
        return self._result


def migrate(spark: SparkSession, config: Config) -> dict:
    """Run to the end; an interrupt or a request to terminate suspends between levels."""
    run = Run(spark, config)
    if threading.current_thread() is threading.main_thread():
        before = {x: signal.signal(x, lambda *_: run.shutdown()) for x in (signal.SIGINT, signal.SIGTERM)}
        try:
            return run.run()
        finally:
            for x, handler in before.items():
                signal.signal(x, handler)
    return run.run()
