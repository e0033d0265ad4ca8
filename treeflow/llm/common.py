"""What the operators share: the shared folder, written intermediate tables, checked broadcasts, salted joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (ids, hashes, counts; under 100 bytes a row) is broadcast; beyond it, it is shuffled.
BROADCAST_ROWS = 100_000
#: Rows of an Arrow batch, and bytes of them on average, from which Python objects are made at once.
SLICE_ROWS, SLICE_BYTES = 512, 16 << 20


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share, ``spark.checkpoint.dir``; only where that is unset
    and driver and executors are one process (tests) a folder of its own."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="treeflow-")
        folder = _OWN[app]
    return f"{folder.rstrip('/')}/treeflow-corpus/{app}"


def new_table(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the application's intermediate tables. Results that read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_table(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], base: str) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (already written, so that counting is cheap) has at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its row count, looked up now, allows it; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, limit) else df


def salted_left_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, salts: int = 32) -> DataFrame:
    """Left join of many rows a key with one row a key. The keys listed in ``hot`` (column ``key``; those with very many
    rows on the left, at most ``1 / share`` of them, so a bounded set) are spread over ``salts`` partitions, by a hash of
    the row, so that a task that runs again deals alike; rows that are equal in all columns stay together."""
    names = [*left.columns, *right.columns]
    is_hot, salt = free_name(names, "_tf_hot"), free_name(names, "_tf_salt")
    spread = F.broadcast(hot.select(F.col(key), F.lit(True).alias(is_hot)))
    many = left.join(spread, key, "left").withColumn(salt, F.when(F.col(is_hot), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    one = right.join(spread, key, "left").withColumn(salt, F.explode(F.when(F.col(is_hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return many.drop(is_hot).join(one.drop(is_hot), [key, salt], "left").drop(salt)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, weigh: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Tuples gathered into Arrow batches of at most ``size`` rows and, by ``weigh``, about ``SLICE_BYTES``."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= size or weight >= SLICE_BYTES:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as tuples, made a slice at a time so that a batch of long texts isn't held twice."""
    step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*(c.to_pylist() for c in part.columns))


def map_rows(df: DataFrame, make: Callable[[], Callable[[tuple], Iterable[tuple]]], schema: str, size: int = 4096, weigh: Callable[[tuple], int] | None = None) -> DataFrame:
    """``mapInArrow`` over rows: ``make()`` runs once a task and gives the function from an input row to output rows."""
    arrow = to_arrow(df.sparkSession, schema)

    def run(it):
        each = make()
        return batches((out for batch in it for row in rows_of(batch) for out in each(row)), arrow, size, weigh)

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema) -> pa.Schema:
    """The Arrow schema of a Spark schema or of its DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
