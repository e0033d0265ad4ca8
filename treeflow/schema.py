"""Row types of the state: listings, nodes, pairs, intents, statistics, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

_KINDS = {"string": StringType(), "long": LongType(), "int": IntegerType(), "boolean": BooleanType()}


def _struct(text: str) -> StructType:
    """A schema from ``name kind, ...``, without a session."""
    out = StructType()
    for part in text.split(","):
        name, kind = part.split()
        out.add(name, _KINDS[kind])
    return out


LISTING = _struct("service_id string, parent_service_id string, parent_path string, path string, name string, type string, size long, mtime string")
NODES = _struct(
    "side string, id string, service_id string, parent_id string, parent_service_id string, parent_path string, name string, path string, "
    "type string, size long, mtime string, depth int, traversal_status string, copy_status string, explicit_excluded boolean, inherited_excluded boolean"
)
PAIRS = _struct("src_id string, dst_id string")
STATS = _struct("bucket_path string, count long")
QUEUE_STATS = _struct("queue_key string, metrics_json string")
LOGS = _struct("id string, timestamp string, level string, entity string, entity_id string, message string, queue string")
ROUND_LOG = _struct("side string, depth int, expanded long, discovered long")

#: Statuses that a side can have; copy statuses are the source's alone.
TRAVERSAL = {"SRC": ("pending", "successful", "failed", "excluded"), "DST": ("pending", "successful", "failed", "not_on_src", "excluded")}
COPY = ("", "pending", "successful", "skipped", "failed")
LEVELS = ("trace", "debug", "info", "warning", "error", "critical")
ROOT = "/"
ROUND = "rounds"


def require(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the columns of ``schema``; raises where one is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    return df.select(*[f.name for f in schema])
