"""The task stream: JSON files in, handled by kind, what can't be read set aside.

A malformed message or an unknown kind is a row of the dead letters and never
stops the stream. The checkpoint lies in the shared folder, so a restarted
query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reconlake.functions.scalars import fixed
from reconlake.streaming import states

MESSAGE = "type string, process_id bigint, file_ids array<bigint>, value double, ts timestamp"
KINDS = ("process.start", "process.update", "process.hypotheses")


def routed(lines: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """line (as it came), the fields of MESSAGE, and route: a kind or 'dead'."""
    m = F.from_json("value", MESSAGE)
    parsed = lines.select(F.col("value").alias("line"), m.alias("m")).select("line", "m.*")
    return parsed.withColumn("route", F.when(F.col("type").isin(*kinds), F.col("type")).otherwise("dead"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return routed(spark.readStream.text(folder))


def consume(stream: DataFrame, handlers: Mapping[str, Callable[[DataFrame, int], None]], dead_letters: str, checkpoint: str) -> StreamingQuery:
    """Runs each batch, with its number, through the handler of each kind; rows without one are appended to the dead letters."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        known = list(handlers)
        for kind, handle in handlers.items():
            handle(rows.where(F.col("route") == kind), batch_id)
        lost = rows.where(~F.col("route").isin(*known)).select("line", F.lit(batch_id).alias("batch_id"))
        # A repeated batch overwrites its own folder only.
        lost.write.mode("overwrite").parquet(f"{dead_letters}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publishing(handle: Callable[[DataFrame, int], None], folder: str) -> Callable[[DataFrame, int], None]:
    """The handler, which then lays the follow-ups of what it has done (states.follow_ups) into `folder`, one for each process of a batch.

    Only a handler that returns publishes; a repeated batch overwrites its own
    messages, so nothing is published twice.
    """

    def handled(rows: DataFrame, batch_id: int) -> None:
        handle(rows, batch_id)
        next_ones = states.follow_ups(rows.select("type", "process_id", F.lit("DONE").alias("status"))).distinct()
        next_ones.select(F.to_json(F.struct("type", "process_id")).alias("value")).write.mode("overwrite").text(f"{folder}/batch_id={batch_id}")

    return handled


def rates(stream: DataFrame, late: str = "10 minutes", window: str = "15 minutes") -> DataFrame:
    """start, type, n, total: counts by window of a stream with ts, type and value; rows later than `late` are dropped by the watermark."""
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), fixed(F.sum("value")).alias("total")).select(F.col("w.start").alias("start"), "type", "n", "total")
