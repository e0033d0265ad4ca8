"""Rates, running figures and times in states from polled series. Series are per key and bounded by the number of polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ema_step

ALPHA = 0.2


def ema_rate(polls: DataFrame, key: str, ts: str, total: str, alpha: float = ALPHA) -> DataFrame:
    """``key, ts, rate``: the exponential moving average of the discovery rate (per second) at each poll. The first poll
    has 0; where no time has passed the rate stays. ``ts`` is in whole seconds."""
    series = polls.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(total).alias("n")))).alias("s"))

    def step(acc, x):
        dt = (x["t"] - acc["t"]).cast("double")
        rate = F.when(dt <= 0, acc["r"]).otherwise(ema_step(acc["r"], (x["n"] - acc["n"]).cast("double") / dt, alpha))
        return F.struct(x["t"].alias("t"), x["n"].alias("n"), rate.alias("r"), F.concat(acc["out"], F.array(F.struct(x["t"].alias("t"), rate.alias("r")))).alias("out"))

    first = F.struct(F.col("s")[0]["t"].alias("t"), F.col("s")[0]["n"].alias("n"), F.lit(0.0).alias("r"), F.array(F.struct(F.col("s")[0]["t"].alias("t"), F.lit(0.0).alias("r"))).alias("out"))
    folded = series.select(key, F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), first, step)["out"].alias("out"))
    return folded.select(key, F.explode("out").alias("o")).select(key, F.col("o.t").alias(ts), F.col("o.r").alias("rate"))


def last_n_average(rows: DataFrame, key: str, order: list[str], value: str, n: int = 100) -> DataFrame:
    """Mean of the last ``n`` values of each key; Spark limits each partition to ``n`` rows a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    last = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return last.groupBy(key).agg(F.avg(value).alias("average"), F.count("*").alias("n"))


def state_times(rows: DataFrame, entity: str, ts: str, tie: str, state: str) -> DataFrame:
    """Seconds spent in each state: from an entity's row to its next."""
    w = Window.partitionBy(entity).orderBy(ts, tie)
    held = rows.withColumn("_next", F.lead(ts).over(w)).where(F.col("_next").isNotNull())
    seconds = F.unix_micros(F.col("_next").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return held.groupBy(state).agg(F.sum(seconds).alias("micros"), F.count("*").alias("intervals"))


def round_rates(rounds: DataFrame) -> DataFrame:
    """``expanded``, ``discovered`` and children a folder for each round of a round log."""
    return rounds.withColumn("per_folder", F.when(F.col("expanded") > 0, F.col("discovered") / F.col("expanded")).otherwise(F.lit(0.0)))


def external_json(metrics: DataFrame) -> DataFrame:
    """``queue_key, metrics_json`` from metric columns."""
    fields = [c for c in metrics.columns if c != "queue_key"]
    return metrics.select("queue_key", F.to_json(F.struct(*fields)).alias("metrics_json"))


def throughput(reports: DataFrame) -> DataFrame:
    """Rows a second of each report (``queue, processed, flushed, seconds``); 0 where no time has passed."""
    rate = lambda c: F.when(F.col("seconds") > 0, F.col(c) / F.col("seconds")).otherwise(F.lit(0.0)).alias(f"{c}_per_second")
    return reports.select("queue", "processed", "flushed", "seconds", rate("processed"), rate("flushed"))
