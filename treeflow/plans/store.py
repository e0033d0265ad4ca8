"""Written state: immutable versions in the shared folder, and a manifest that names the current one."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FEW = 300_000  # rows of a key or two: some 30 MB
MANIFEST = re.compile(r"manifest-(\d+)\.json$")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder in ``spark.checkpoint.dir``; where that is unset and driver and executors are one
    process, a folder of its own."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="treeflow-")
        folder = _OWN[app]
    return f"{folder.rstrip('/')}/treeflow/{app}"


ROWS_A_PASS = 16_000_000


def passes(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_PASS))


def in_passes(rows: int, part, label: str) -> DataFrame:
    """``part(i, n)`` for each i below n written to one table, one after another, so that the disk holds the shuffle files of one part
    at a time. n grows with ``rows``; the parts together must be the whole."""
    n = passes(rows)
    return reduce(DataFrame.unionByName, [written(part(i, n), label) for i in range(n)])


PART = "_part"  # column of a table that is laid out in parts
PARTS = 8


def part_of(*keys: str) -> Column:
    """For ``PART``: rows with the same keys are in the same part, in whatever table."""
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")


def grouped_parts(*tables: DataFrame) -> list[tuple[list[int], int]]:
    """Parts that tables (written by ``PART``) have, in groups for a pass each, with their rows. A part that is too large for a pass
    is a group of its own."""
    counts = reduce(DataFrame.unionByName, [t.select(PART) for t in tables]).groupBy(PART).count().orderBy(PART).collect()  # PARTS rows
    groups: list[tuple[list[int], int]] = []
    for part, n in counts:
        if groups and groups[-1][1] + n <= ROWS_A_PASS:
            groups[-1] = ([*groups[-1][0], part], groups[-1][1] + n)
        else:
            groups.append(([part], n))
    return groups


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the plan starts anew there, and lost executors cost no rerun. The
    shuffle files of the write go as soon as it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    save(df, path, *partition_by)
    return spark.read.schema(df.schema).parquet(path)


def save(df: DataFrame, path: str, *partition_by: str, mode: str = "error") -> None:
    """``df`` written to ``path``; the shuffle files of the write go as soon as it ends."""
    spark = df.sparkSession
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def dropped(*tables: DataFrame, parts: list[int] | None = None) -> None:
    """Delete the files of tables from ``written`` that nothing reads any more: all, or those of ``parts``."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if parts is not None and folder.rsplit("/", 1)[1] not in {f"{PART}={p}" for p in parts}:
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(rows: DataFrame) -> DataFrame:
    """``rows``, sent to all tasks by joins if they are counted to be at most ``FEW``, so that the other side isn't dealt again."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def packed(rows: DataFrame, derived: dict[str, Column], known: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with the columns of ``derived`` null where they are what the expression gives; ``_own`` has a bit for each that isn't.
    Ids and parents that follow from a path so take no space in files and shuffles. ``known``: for some columns, a cheaper condition
    for being what the expression gives."""
    same = {c: known[c] if known and c in known else F.col(c).eqNullSafe(e) for c, e in derived.items()}
    own = reduce(lambda a, b: a + b, [F.when(x, 0).otherwise(1 << i) for i, x in enumerate(same.values())])
    return rows.withColumns({c: F.when(~x, F.col(c)) for c, x in same.items()} | {"_own": own})


def unpacked(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """What ``packed`` got."""
    return rows.withColumns({c: F.when(F.col("_own").bitwiseAND(F.lit(1 << i)) == 0, e).otherwise(F.col(c)) for i, (c, e) in enumerate(derived.items())}).drop("_own")


def release(spark: SparkSession) -> None:
    """Delete the application's intermediate tables. Results that read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class SnapshotStore:
    """Versioned tables under ``root``. ``save`` writes a new version's tables, then its manifest under a name of its own, moved
    there whole; the newest manifest is the current one. Nothing current is deleted before, so a failure at any point leaves
    the old version current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._fs_path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self) -> list[int]:
        """Versions that have a manifest, in order."""
        root = self._fs_path(self.root)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(m[1]) for n in names if (m := MANIFEST.match(n)))

    def manifest(self) -> dict:
        versions = self._versions()
        return json.loads(self._read(f"manifest-{versions[-1]}.json")) if versions else {"version": 0, "tables": [], "state": {}}

    def save(self, tables: dict[str, DataFrame], state: dict | None = None) -> int:
        """Write the next version. The one before it stays readable (the new tables may come from it); older ones go."""
        versions = self._versions()
        version = versions[-1] + 1 if versions else 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
        body = json.dumps({"version": version, "tables": sorted(tables), "state": state or {}})
        self._commit(version, body)
        for old in versions[:-1]:
            self._fs.delete(self._fs_path(f"{self.root}/manifest-{old}.json"), False)
            self._fs.delete(self._fs_path(f"{self.root}/v={old}"), True)
        return version

    def _commit(self, version: int, body: str) -> None:
        new, final = self._fs_path(f"{self.root}/_manifest-{version}"), self._fs_path(f"{self.root}/manifest-{version}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(body.encode()))
        out.close()
        if not self._fs.rename(new, final):
            raise OSError(f"the manifest of version {version} couldn't be moved")

    def load(self, name: str) -> DataFrame:
        m = self.manifest()
        if name not in m["tables"]:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/v={m['version']}/{name}")
