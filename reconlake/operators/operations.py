"""Operational jobs: uploads, integrity, retries, notifications, counters over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DELAYS = (60, 300, 900)  # seconds before the next attempt
RETRYABLE = (408, 429)


def new_uploads(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first of each new content: not stored yet, and once in the batch."""
    fresh = incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*fresh.columns), order).alias("r")).select("r.*")


def integrity(stored: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """checked, ok, mismatched, missing: stored hashes against those computed from the objects."""
    both = stored.join(recomputed.select(key, F.col("hash").alias("__now")), key, "left")
    return both.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("hash") == F.col("__now")).alias("ok"),
        F.count_if(F.col("hash") != F.col("__now")).alias("mismatched"), F.count_if(F.col("__now").isNull()).alias("missing"),
    )


def retry(attempt: Column, code: Column, now: Column) -> Column:
    """struct<status, next_at> after attempt number `attempt` (from 1) failed with an HTTP code (null: network)."""
    again = code.isNull() | (code >= 500) | code.isin(*RETRYABLE)
    delay = F.try_element_at(F.array(*map(F.lit, DELAYS)), attempt)
    waits = again & (attempt <= len(DELAYS))
    return F.struct(F.when(waits, "PENDING").otherwise("FAILED").alias("status"), F.when(waits, F.timestamp_add("SECOND", delay, now)).alias("next_at"))


def due(transfers: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    return transfers.where((F.col("status") == "PENDING") & (F.col("next_at") <= now)).orderBy("next_at", "transfer_id").limit(limit)


def fan_out(events: DataFrame, users: DataFrame) -> DataFrame:
    """event_id, user_id: an event goes to its owner, or without one to every user of its role."""
    owned = events.where("owner_id is not null").select("event_id", F.col("owner_id").alias("user_id"))
    return owned.union(events.where("owner_id is null").join(users, "role").select("event_id", "user_id"))


def increases(samples: DataFrame, window: str, *keys: str) -> DataFrame:
    """keys, start, increase: growth of counters (ts, value) by window, where a fall is a restart from zero.

    Samples are ordered within an hour of their counter, and each hour is
    handed the last value before it, so that a counter's history is never
    sorted in one piece.
    """
    hours = samples.withColumn("__hour", F.date_trunc("hour", "ts"))
    last = hours.groupBy(*keys, "__hour").agg(F.max_by("value", F.struct("ts", "value")).alias("__last"))
    carried = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__hour"))).drop("__last")
    samples = hours.join(carried, [*keys, "__hour"])
    order = Window.partitionBy(*keys, "__hour").orderBy("ts", "value")
    before = F.coalesce(F.lag("value").over(order), "__carry")
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    stepped = samples.withColumn("__step", step)
    grouped = stepped.groupBy(*keys, F.window("ts", window).alias("w")).agg(F.sum("__step").alias("increase"))
    return grouped.select(*keys, F.col("w.start").alias("start"), "increase")


def latency_quantile(durations: DataFrame, window: str, q: float, *keys: str) -> DataFrame:
    """keys, start, n, value: exact quantile by window."""
    w = durations.groupBy(*keys, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.percentile("value", q).alias("value"))
    return w.select(*keys, F.col("w.start").alias("start"), "n", "value")


def stale(samples: DataFrame, now: Column, hours: int, *keys: str) -> DataFrame:
    """keys, last, is_stale: has anything been seen in the last `hours`?"""
    seen = samples.groupBy(*keys).agg(F.max("ts").alias("last"))
    return seen.withColumn("is_stale", F.unix_seconds(now) - F.unix_seconds(F.col("last").cast("timestamp")) > hours * 3600)


def sustained(flags: DataFrame, least: int, *keys: str) -> DataFrame:
    """keys, first, last, n: runs of at least `least` consecutive windows (start, on) that are on."""
    order = Window.partitionBy(*keys).orderBy("start")
    run = F.sum(F.when(F.col("on"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = flags.withColumn("__run", run).where("on").groupBy(*keys, "__run")
    return runs.agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("__run")


def week_over_week(rows: DataFrame, ts: str, value: Column) -> DataFrame:
    """week, n, delta: a measure by week and its change from the week before."""
    weeks = rows.groupBy(F.date_trunc("week", F.col(ts)).alias("week")).agg(value.alias("n"))
    # One row a week: the window is as long as the history in weeks.
    return weeks.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("week")))


def character_accuracy(reference: Column, found: Column) -> Column:
    """1 - edit distance / length, at least 0; an empty reference is matched by an empty text only."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(found) == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(reference, found) / n))
