"""Discovery rates as a stream: one state a queue, updated at each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import ALPHA

OUT = "queue string, t long, total long, rate double"
#: The last closed poll (time, total, rate), time and count of the open one, and how many are closed.
STATE = "t long, total long, rate double, open_t long, open_n long, closed long"
POLLS = "queue string, t long, n long"


def _combined(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by queue and poll of each batch, so that few rows are shuffled however many events a queue has."""
    for batch in frames:
        counted = pa.Table.from_batches([batch]).group_by(["queue", "t"]).aggregate([([], "count_all")])
        yield from counted.rename_columns(["queue", "t", "n"]).to_batches()


def _update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A poll is open until a later one comes, so its events may be spread over micro-batches; its row is given anew each
    time, and the last one counts. Events of closed polls only add to the total."""
    before, total, rate, open_t, open_n, closed = state.get if state.exists else (0, 0, 0.0, 0, 0, -1)
    found: dict[int, int] = {}
    for frame in frames:
        for t, n in zip(frame["t"].tolist(), frame["n"].tolist()):
            found[t] = found.get(t, 0) + n
    out = []

    def now() -> float:
        return ALPHA * (open_n / (open_t - before)) + (1 - ALPHA) * rate if closed > 0 else 0.0

    for t in sorted(found):
        if closed >= 0 and t < open_t:
            total += found[t]
            continue
        if closed < 0 or t > open_t:  # the open poll, if there is one, is closed
            before, total, rate, open_n, closed = open_t, total + open_n, now(), 0, closed + 1
        open_t, open_n = t, open_n + found[t]
        out.append((key[0], open_t, total + open_n, now()))
    state.update((before, total, rate, open_t, open_n, closed))
    yield pd.DataFrame(out, columns=["queue", "t", "total", "rate"])


def ema_stream(events: DataFrame, key: str = "event_type", ts: str = "ts", every: str = "day") -> DataFrame:
    """Of a stream of events: a row for each queue and poll, with the total found and the moving average of the rate. The row of
    a poll is given anew when more of its events come."""
    polls = events.select(F.col(key).cast("string").alias("queue"), F.unix_seconds(F.date_trunc(every, F.col(ts).cast("timestamp"))).alias("t"))
    return polls.mapInArrow(_combined, POLLS).groupBy("queue").applyInPandasWithState(_update, OUT, STATE, "update", "NoTimeout")


def windowed_counts(events: DataFrame, key: str = "event_type", ts: str = "ts", late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Counts by window and key, final once the watermark has passed."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = timed.groupBy(F.window("_ts", width).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")
