"""Attempts in a stream that is stopped and started again, against one clock; files that are tried again; follow-ups of handlers."""

import datetime
import json
import random

from pyspark.sql import functions as F

from reconlake.streaming import retries, states, tasks

SCHEMA = "task_id long, event_id long, at timestamp, kind string, code int"
START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def one_clock(events, until):
    """What is done in the order of time, with a queue of timers."""
    out, state = [], {}
    marks = sorted([(at, 0, e, t, k, c) for t, e, at, k, c in events], key=lambda m: (m[0], m[2]))
    for now, _, _, t, kind, code in [*marks, *((until, 1, 0, t, None, None) for t in {m[3] for m in marks})]:
        status, attempt, due = state.get(t, ("idle", 0, None))
        if status == "waiting" and (due < now if kind is None else due <= now):
            status, attempt = "running", attempt + 1
            out.append((t, due, "RUN", attempt))
        if kind == "submitted" and status == "idle":
            status, attempt = "running", 1
            out.append((t, now, "RUN", 1))
        elif kind == "done" and status == "running":
            status = "idle"
            out.append((t, now, "DONE", attempt))
        elif kind == "failed" and status == "running":
            if attempt <= 3 and (code is None or code >= 500 or code in (408, 429)):
                status, due = "waiting", now + datetime.timedelta(seconds=(60, 300, 900)[attempt - 1])
                out.append((t, now, "WAIT", attempt))
            else:
                status = "idle"
                out.append((t, now, "DEAD", attempt))
        state[t] = (status, attempt, due)
    return sorted(out)


def test_attempts_outlive_restarts(spark, tmp_path):
    rng = random.Random(9)
    events, at = [], START
    for e in range(240):
        at += datetime.timedelta(seconds=rng.choice([0, 1, 20, 90, 400]))
        events.append((rng.randint(1, 6), e, at, rng.choice(["submitted", "failed", "failed", "failed", "done", "odd"]), rng.choice([None, 503, 429, 404])))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for i in range(0, 240, 60):  # a file, then a whole run of the query, four times
        batch = events[i : i + 60]
        rng.shuffle(batch)
        rows = batch + ([(None, 999, START, "submitted", None), (1, 998, None, "failed", None)] if i == 0 else [])
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sink = retries.attempts(stream, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        sink.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(retries.STEPS).parquet(str(tmp_path / "out")).select("task_id", F.unix_micros("at"), "action", "attempt").collect()
    micros = lambda t: round((t - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)).total_seconds() * 1e6)
    want = [(t, micros(w), a, n) for t, w, a, n in one_clock(events, at - datetime.timedelta(minutes=1))]
    assert sorted(map(tuple, got)) == sorted(want) and {w[2] for w in want} == {"RUN", "WAIT", "DEAD", "DONE"}


def test_files_are_tried_by_themselves(spark):
    def parse(text):
        if text == "bad":
            raise ValueError("torn")
        if text == "silent":
            raise ValueError
        if text not in seen:
            seen.add(text)
            raise OSError("busy")
        return text.upper()

    seen: set = set()
    files = spark.createDataFrame([(1, "bad"), (2, "slow"), (3, None), (4, "silent")], "file_id long, content string").coalesce(1)
    got = {r.file_id: (r.t.parsed, r.t.attempts, r.t.error) for r in files.withColumn("t", states.tried(parse)).collect()}
    assert got == {1: (None, 3, "torn"), 2: ("SLOW", 2, None), 3: (None, 0, "EMPTY"), 4: (None, 3, "ValueError")}


def test_handlers_publish_follow_ups(spark, tmp_path):
    (tmp_path / "in").mkdir()
    messages = [{"type": "process.start", "process_id": 1}, {"type": "process.start", "process_id": 1}, {"type": "process.update", "process_id": 2}, {"type": "process.hypotheses", "process_id": 3}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, messages)))
    handlers = {k: tasks.publishing(lambda rows, batch_id: None, str(tmp_path / "next" / k)) for k in tasks.KINDS}
    tasks.consume(tasks.messages(spark, str(tmp_path / "in")), handlers, str(tmp_path / "dead"), str(tmp_path / "cp")).awaitTermination()
    said = sorted(json.loads(r.value)["process_id"] for k in tasks.KINDS for r in spark.read.text(str(tmp_path / "next" / k)).collect())
    assert said == [1, 2]
