"""Quality reports over two periods, releases of labels, and rules that fire by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions import scalars
from reconlake.operators import metrics


def pooled_accuracy(results: DataFrame, *keys: str) -> DataFrame:
    """keys, characters, accuracy of results (distance, length): one minus the share of all edits in all characters, never a mean of ratios."""
    sums = results.groupBy(*keys).agg(F.sum("length").alias("characters"), F.sum("distance").alias("d"))
    return sums.select(*keys, "characters", F.when(F.col("characters") > 0, F.greatest(F.lit(0.0), 1 - F.col("d") / F.col("characters"))).alias("accuracy"))


def worst_group(rated: DataFrame, key: str) -> DataFrame:
    """The group that misses its thresholds with the least F1 (none counts as 1), the first by name on ties."""
    return rated.where("passes = false").orderBy(F.coalesce("f1", F.lit(1.0)), key).limit(1)


def two_periods(labels: DataFrame, at: str, end: Column, days: int = 7) -> DataFrame:
    """metric, now, before, delta: overall metrics of the period up to `end` and of the one before, in one pass over labels (label, engine_status, at)."""
    span = F.make_interval(days=F.lit(days))
    period = F.when((F.col(at) > end - span) & (F.col(at) <= end), 0).when((F.col(at) > end - span - span) & (F.col(at) <= end - span), 1)
    rows = metrics.rated(metrics.confusion(labels.withColumn("period", period).where("period is not null"), "period"))
    names = ("precision", "recall", "f1", "fpr")
    long = rows.select("period", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("period", "m.*")
    pair = long.groupBy("metric").agg(F.max(F.when(F.col("period") == 0, F.col("value"))).alias("now"), F.max(F.when(F.col("period") == 1, F.col("value"))).alias("before"))
    return pair.withColumn("delta", F.col("now") - F.col("before"))


def release(labels: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Labels (id, …) of a release: all, or those of `wanted` (id) that exist, each once."""
    return labels if wanted is None else labels.join(wanted.select("id").distinct(), "id", "left_semi")


def version_tag(releases: DataFrame, day: Column) -> DataFrame:
    """tag: `gold-YYYY.MM.DD`, with a number from the second release of a day on."""
    base = F.concat(F.lit("gold-"), F.date_format(day, "yyyy.MM.dd"))
    n = releases.agg(F.count_if(F.startswith("tag", base)).alias("n"))
    return n.select(F.when(F.col("n") == 0, base).otherwise(F.concat(base, F.lit("-"), (F.col("n") + 1).cast("string"))).alias("tag"))


def latest_tag(releases: DataFrame, configured: str) -> DataFrame:
    """tag: that of the last release (tag, released_at), or the configured one."""
    return releases.agg(F.coalesce(F.max_by("tag", F.struct("released_at", "tag")), F.lit(configured)).alias("tag"))


def daily_due(last: Column, now: Column, hour: int) -> Column:
    """Is a daily job due: its hour has come and it has not run on this day."""
    return (F.hour(now) >= hour) & F.coalesce(F.to_date(last) < F.to_date(now), F.lit(True))


def weekly_due(last: Column, now: Column, weekday: int, hour: int) -> Column:
    """Is a weekly job due: its weekday (1: Sunday) and hour have come and six days have passed since it ran."""
    return (F.dayofweek(now) == weekday) & (F.hour(now) >= hour) & F.coalesce(F.unix_seconds(now) - F.unix_seconds(last) >= 6 * 86400, F.lit(True))


def rate_alert(increases: DataFrame, seconds: int, over: float, least: int, *keys: str) -> DataFrame:
    """keys, first, last, n: runs of at least `least` windows (start, increase) in which a counter grows by more than `over` a second."""
    flags = increases.withColumn("on", F.col("increase") / seconds > over)
    order = Window.partitionBy(*keys).orderBy("start")
    off = F.sum(F.when(F.col("on"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = flags.withColumn("__run", off).where("on").groupBy(*keys, "__run")
    return runs.agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("__run")


def bucket_quantile(durations: DataFrame, bounds: list[float], q: float, window: str, *keys: str) -> DataFrame:
    """keys, start, value: a quantile by linear interpolation inside the bucket that holds it; beyond the last bound, that bound.

    Buckets are counts up to each of the ascending bounds and of all rows.
    """
    counts = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    grouped = durations.groupBy(*keys, F.window("ts", window).alias("w")).agg(*counts, F.count(F.lit(1)).alias("n"))
    rank = F.col("n") * q
    value = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        low, below = (bounds[i - 1], F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
        inside = low + (bounds[i] - low) * F.try_divide(rank - below, F.col(f"b{i}") - below)
        value = F.when(F.col(f"b{i}") >= rank, F.coalesce(inside, F.lit(float(low)))).otherwise(value)
    return grouped.select(*keys, F.col("w.start").alias("start"), value.alias("value"))


def panels(requests: DataFrame, window: str, seconds: int, *keys: str) -> DataFrame:
    """keys, start, per_second, failed_share, mean: what an operations board shows of requests (ts, value, failed)."""
    rows = requests.groupBy(*keys, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed"), F.avg("value").alias("mean"))
    return rows.select(*keys, F.col("w.start").alias("start"), scalars.fixed(F.col("n") / seconds, 6).alias("per_second"), scalars.fixed(F.col("failed") / F.col("n"), 6).alias("failed_share"), scalars.fixed(F.col("mean"), 6).alias("mean"))
