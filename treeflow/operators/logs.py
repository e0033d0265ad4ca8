"""Log tables: from events, by level, ordered by time or, as older readers did, by the time's text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import level_index, timestamp_of
from ..schema import LOGS

# The level that stands for each type of event.
EVENT_LEVELS = {"view": "trace", "click": "debug", "signup": "info", "purchase": "warning", "error": "error"}


def from_events(events: DataFrame) -> DataFrame:
    """Events as log rows. Times are written without trailing zeros in the fraction."""
    level = F.lit("critical")
    for kind, name in EVENT_LEVELS.items():
        level = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(level)
    text = F.regexp_replace(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0*$", "")
    return events.select(
        F.col("event_id").cast("string").alias("id"), F.concat(text, F.lit("Z")).alias("timestamp"), level.alias("level"), F.lit("user").alias("entity"),
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("message"), F.when(F.col("event_id") % 2 == 0, F.lit("src")).otherwise(F.lit("dst")).alias("queue"),
    ).select(*[f.name for f in LOGS])


def by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("n"))


def ordered(logs: DataFrame, by_text: bool = False) -> DataFrame:
    """Logs in time order (unreadable times first), or in the order of the time's text."""
    return logs.orderBy("timestamp", "id") if by_text else logs.orderBy(timestamp_of(F.col("timestamp")), "id")


def in_level_order(logs: DataFrame) -> DataFrame:
    return logs.orderBy(level_index(F.col("level")), "id")


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log packets from JSON lines; lines that aren't JSON objects with a level are skipped."""
    packet = F.from_json(F.col(column), "timestamp string, level string, message string, entity string, entity_id string, queue string")
    out = lines.select(packet.alias("p")).where("p IS NOT NULL AND p.level IS NOT NULL")
    return out.select(F.sha2(F.to_json("p"), 256).alias("id"), "p.timestamp", "p.level", "p.entity", "p.entity_id", "p.message", "p.queue")


def with_ids(logs: DataFrame) -> DataFrame:
    """Logs that have no id get a random one (UUID, version 4). Write the result before it is used twice."""
    return logs.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.uuid()))


def in_order(logs: DataFrame, level: str | None = None, key: str | None = None) -> DataFrame:
    """Logs of one level or of all levels, or the one of an id; by level, then id."""
    out = logs if level is None else logs.where(F.lower("level") == level.lower())
    return in_level_order(out if key is None else out.where(F.col("id") == key))
