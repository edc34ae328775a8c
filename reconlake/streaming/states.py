"""States of tasks, files and transfers as transitions: attempts, follow-ups, guards, queues."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRIES = 2


def task_outcome(attempt: Column, failed: Column, retries: int = RETRIES) -> Column:
    """struct<status,attempt,notify> after an attempt (from 0): a failure is tried again up to `retries` times, then it is final and the owner is told."""
    again = failed & (attempt < retries)
    return F.struct(
        F.when(~failed, "DONE").when(again, "RETRY").otherwise("FAILED").alias("status"), F.when(again, attempt + 1).otherwise(attempt).alias("attempt"), (failed & ~again).alias("notify")
    )


def file_outcomes(files: DataFrame, parse: Column, text: str = "content") -> DataFrame:
    """`files` with ok and error: each file is parsed by itself (`parse`: null where it fails), so one bad file fails no other."""
    parsed = files.withColumn("__parsed", parse)
    bad = F.col("__parsed").isNull()
    error = F.when(F.col(text).isNull(), "EMPTY").when(bad, "UNREADABLE")
    return parsed.withColumns({"ok": ~bad, "error": error}).drop("__parsed")


def tried(parse: Callable[[str], str], content: str = "content", retries: int = RETRIES) -> Column:
    """struct<parsed,attempts,error> of each file by itself: `parse` is tried up to 1 + `retries` times; what it raises last is the file's error and stops no other. A file without content isn't tried."""

    def one(text: str | None) -> tuple[str | None, int, str | None]:
        if text is None:
            return None, 0, "EMPTY"
        error = None
        for attempt in range(1, retries + 2):
            try:
                return parse(text), attempt, None
            except Exception as e:  # a parser's faults are the file's
                error = str(e) or type(e).__name__
        return None, retries + 1, error

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["parsed", "attempts", "error"])

    return F.pandas_udf(of, "parsed string, attempts int, error string").asNondeterministic()(F.col(content))


def follow_ups(done: DataFrame) -> DataFrame:
    """Tasks (type, process_id) that finished ones publish: a start or an update that is done asks for hypotheses."""
    ready = (F.col("status") == "DONE") & F.col("type").isin("process.start", "process.update")
    return done.where(ready).select(F.lit("process.hypotheses").alias("type"), "process_id")


def queued(transfers: DataFrame, requests: DataFrame) -> DataFrame:
    """Transfers (protocol_id, status, attempt) after requests (protocol_id, kind, at): the last of 'enqueue' and 'cancel' counts; an enqueued one starts anew, only a pending one is cancelled, a sent one stays."""
    last = requests.groupBy("protocol_id").agg(F.max_by("kind", "at").alias("kind"))
    both = transfers.join(last, "protocol_id", "full_outer")
    sent = F.coalesce(F.col("status") == "SENT", F.lit(False))
    enqueue, cancel = (F.coalesce(F.col("kind") == k, F.lit(False)) for k in ("enqueue", "cancel"))
    status = F.when(enqueue & ~sent, "PENDING").when(cancel & F.coalesce(F.col("status") == "PENDING", F.lit(False)), "CANCELLED").otherwise(F.col("status"))
    return both.select("protocol_id", status.alias("status"), F.when(enqueue & ~sent, 0).otherwise(F.col("attempt")).alias("attempt")).where("status is not null")


def update_refused(process_status: Column, protocol_status: Column) -> Column:
    """Why files can't be added to a process, or null."""
    busy = process_status.isin("PENDING", "PARSING", "MATCHING")
    return F.when(busy, "PROCESS_BUSY").when(protocol_status == "PROTOCOL_FINALIZED", "PROTOCOL_FINALIZED").when(protocol_status.isNull(), "NO_PROTOCOL")


def start_refused(status: Column, n_files: Column) -> Column:
    """Why a process can't be started, or null."""
    return F.when(status != "PENDING", "ALREADY_STARTED").when(F.coalesce(n_files, F.lit(0)) == 0, "NO_FILES")
