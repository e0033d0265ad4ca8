"""Logs as a stream: JSON packets parsed, kept as a whole, and shown from a level on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.logs import parsed
from ..operators.lookups import logs_from


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of log rows from files of JSON lines; other lines are skipped."""
    return parsed(spark.readStream.format("text").load(folder))


def keep(logs: DataFrame, table: str, checkpoint: str, show_from: str = "info", show=None) -> StreamingQuery:
    """Append every row to ``table`` (a path, by level); rows of at least ``show_from`` also go to ``show(batch)``."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.write.mode("append").partitionBy("level").parquet(table)
        if show is not None:
            show(logs_from(batch, show_from))
        batch.unpersist()

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
