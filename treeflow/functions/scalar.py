"""Scalar expressions: ids, paths, levels, times, JSON. All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVELS

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def node_id(side: str | Column, path: Column) -> Column:
    """Deterministic id of a node: listing again gives the same id."""
    return F.sha2(F.concat(F.lit(side) if isinstance(side, str) else side, F.lit(":"), path), 256)


def path_hash(path: Column) -> Column:
    return F.sha2(path, 256)


def level_name(depth: Column) -> Column:
    return F.format_string("%08d", depth)


def level_of(name: Column) -> Column:
    return name.try_cast("int")


def normalise_path(path: Column) -> Column:
    """One leading slash, no repeated and no trailing ones."""
    clean = path.startswith("/") & ~F.contains(path, F.lit("//")) & ((path == "/") | ~path.endswith("/"))
    bare = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), F.coalesce(path, F.lit(""))), r"/+", "/"), r"/$", "")
    return F.when(clean, path).when(bare == "", F.lit("/")).otherwise(bare)  # most paths need no pattern


def child_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(parent, name)).otherwise(F.concat(parent, F.lit("/"), name))


def last_name(path: Column) -> Column:
    """The part after the last slash; '' of the root."""
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """The path without its last part; '' of the root."""
    up = F.left(path, F.char_length(path) - F.char_length(last_name(path)) - 1)
    return F.when(path == "/", F.lit("")).when(up == "", F.lit("/")).otherwise(up)


def path_depth(path: Column) -> Column:
    return F.when(path == "/", F.lit(0)).otherwise(F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit(""))))


def timestamp_of(text: Column) -> Column:
    """A full RFC 3339 time; anything else, bare dates included, is null. Resolution: microseconds."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def newer(a: Column, b: Column) -> Column:
    """Whether time ``a`` is strictly after ``b``; a time that can't be read is never newer and never older."""
    return F.coalesce(timestamp_of(a) > timestamp_of(b), F.lit(False))


def rfc3339(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def level_index(level: Column) -> Column:
    """0 for trace to 5 for critical; null for an unknown level."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(LEVELS):
        out = F.when(F.lower(level) == name, F.lit(i)).otherwise(out)
    return out


def bucket_path(*parts: str | Column) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def side_of_queue(name: Column) -> Column:
    return F.when(F.lower(name) == "dst", F.lit("DST")).otherwise(F.lit("SRC"))


def set_or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def analytic_path(path: Column) -> Column:
    """``x.db`` -> ``x-duck.db``; another name gets the ending added."""
    return F.when(path.endswith(".db"), F.regexp_replace(path, r"\.db$", "-duck.db")).otherwise(F.concat(path, F.lit("-duck.db")))


def address(text: Column) -> tuple[Column, Column]:
    """Host and port of ``host:port``, split at the last colon; 127.0.0.1 and 8081 where missing."""
    host = F.coalesce(set_or_null(F.regexp_extract(text, r"^(.*):[^:]*$", 1)), F.when(~F.contains(text, F.lit(":")), set_or_null(text)), F.lit("127.0.0.1"))
    port = F.coalesce(F.regexp_extract(text, r":(\d+)$", 1).try_cast("int"), F.lit(8081))
    return host, port


def ema_step(previous: Column, rate: Column, alpha: float = 0.2) -> Column:
    return F.lit(alpha) * rate + F.lit(1 - alpha) * previous


def clamp(x: Column) -> Column:
    return F.greatest(x, F.lit(0))
