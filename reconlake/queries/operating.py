"""Geometry of pages, uploads, retries, notifications, time series and the task stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions import scalars
from reconlake.operators import geometry, operations
from reconlake.plans.lineage import new_folder, shared_dir
from reconlake.queries.registry import query
from reconlake.sources.tables import table
from reconlake.streaming import retries, tasks

NOW = "2024-01-31 12:00:00"


def _s(name: str) -> Column:
    """Seconds since 1970; the tables' timestamps have no zone and are read in the session's."""
    return F.unix_seconds(F.col(name).cast("timestamp"))


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


@query(
    """with r as (select l_orderkey as page, l_linenumber as place, l_tax * 10 as y0, l_tax * 10 + l_quantity / 100 as y1, l_partkey, l_suppkey from lineitem),
    d as (select page, place, min(y0) as y0, max(y1) as y1 from r group by all)
    select page, place, min(y0) over w as top, max(y1) over w as bottom from d window w as (partition by page order by place rows between 1 preceding and 1 following)"""
)
def row_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    y0 = F.col("l_tax") * 10
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("place")).agg(
        F.min(y0).alias("y0"), F.max(y0 + F.col("l_quantity") / 100).alias("y1")
    )
    return geometry.row_neighbourhood(rows, "page").select("page", "place", "top", "bottom")


@query(
    """with t as (select p_partkey // 6 as page, p_partkey as table_id, p_size / 64 as x0, p_size / 64 + 25e-2::double as x1 from part)
    select page, table_id, coalesce((lag(x1) over w + x0) / 2, x0 - 12e-3::double) as "left", coalesce((lead(x0) over w + x1) / 2, x1 + 12e-3::double) as "right"
    from t window w as (partition by page order by x0, table_id)"""
)
def table_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = F.col("p_size") / 64
    t = table(spark, sf_dir, "part").select((F.col("p_partkey") / 6).cast("bigint").alias("page"), F.col("p_partkey").alias("table_id"), x0.alias("x0"), (x0 + 0.25).alias("x1"))
    return geometry.table_margins(t, "page").select("page", "table_id", "left", "right")


@query(
    """with c as (select p_partkey as k, p_partkey // 20 as page, (p_partkey // 2) % 10 as r from part)
    select n.page, n.k as number_line, a.k as area_line from c n join c a on n.page = a.page and n.r = a.r and n.k % 2 = 0 and a.k % 2 = 1"""
)
def table_row_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    r = (k / 2).cast("bigint") % 10
    x0, y0 = F.when(k % 2 == 0, 0.1).otherwise(0.7), r / 16
    cells = table(spark, sf_dir, "part").select(
        (k / 20).cast("bigint").alias("page"), k.alias("line"), F.when(k % 2 == 0, "number").otherwise("area").alias("kind"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 0.05).alias("x1"), (y0 + 0.015).alias("y1"),
    )
    return geometry.match_rows(cells)


@query(
    """with s as (select o_orderkey, 100 + o_orderkey % 900 as h from orders), e as (select *, unnest(range(0, ceil(h / 256)::bigint)) as strip_no from s)
    select o_orderkey, strip_no::int as strip_no, strip_no * 256e0 as top, least((strip_no + 1) * 256e0, h) as bottom from e"""
)
def ocr_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = (F.col("o_orderkey") % 900 + 100).cast("double")
    return geometry.strips(table(spark, sf_dir, "orders").select("o_orderkey"), height, 256.0)


@query(
    """with d as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as l from documents)
    select doc_id, (i - 1)::int as line_no, length(l[i]) as chars, printf('%.6f', (i - 1) / len(l)::double) as y0 from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from d)"""
)
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = table(spark, sf_dir, "documents").select("doc_id", F.lit(0.0).alias("top"), F.lit(1.0).alias("bottom"), "text")
    lines = geometry.strip_lines(tiles)
    return lines.select("doc_id", "line_no", F.length("line").cast("bigint").alias("chars"), scalars.fixed(F.col("line_no") / F.count(F.lit(1)).over(Window.partitionBy("doc_id")), 6).alias("y0"))


BOXES = """b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0e0, least(1e0, l_quantity / 64)) as ax, greatest(0e0, least(1e0, l_partkey % 97 / 64)) as bx,
    greatest(0e0, least(1e0, l_suppkey % 50 / 64)) as ay, greatest(0e0, least(1e0, l_orderkey % 83 / 64)) as "by" from lineitem),
    n as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, least(ax, bx) as x0, least(ay, "by") as y0, greatest(ax, bx) as x1, greatest(ay, "by") as y1 from b)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.lit(64.0)
    box = scalars.box_normalized(F.col("l_quantity"), F.col("l_suppkey") % 50, F.col("l_partkey") % 97, F.col("l_orderkey") % 83, size, size)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("box"))


@query(f"with {BOXES} select * from n")
def box_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "box.*")


@query(
    f"""with {BOXES}, f as (select *, least(x1, 75e-2) - greatest(x0, 25e-2) as w, least(y1, 75e-2) - greatest(y0, 25e-2) as h, (x1 - x0) * (y1 - y0) as a from n)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.6f', case when w > 0 and h > 0 then w * h / (a + 25e-2 - w * h) else 0 end) as iou from f"""
)
def iou_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.struct(F.lit(0.25).alias("x0"), F.lit(0.25).alias("y0"), F.lit(0.75).alias("x1"), F.lit(0.75).alias("y1"))
    return _boxes(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.fixed(scalars.iou(F.col("box"), other), 6).alias("iou")
    )


@query(
    """with p as (select p_partkey, lower(p_name) as a, lower(p_type) as b from part), d as (select *, levenshtein(a, b) as d from p)
    select p_partkey, printf('%.6f', case when length(a) = 0 then case when length(b) = 0 then 1 else 0 end else greatest(0e0, 1 - d / length(a)::double) end) as accuracy from d"""
)
def cer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    accuracy = operations.character_accuracy(F.lower("p_name"), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.fixed(accuracy, 6).alias("accuracy"))


@query(
    """with u as (select source as object_id, sha256(text) as file_hash, doc_id from documents where doc_id % 3 > 0), s as (select distinct source as object_id, sha256(text) as file_hash from documents where doc_id % 3 = 0)
    select object_id, file_hash, min(doc_id) as doc_id from u where not exists (select 1 from s where s.object_id = u.object_id and s.file_hash = u.file_hash) group by all"""
)
def upload_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("object_id"), F.sha2("text", 256).alias("file_hash"), "doc_id")
    return operations.new_uploads(docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0"), ["object_id", "file_hash"], "doc_id")


@query(
    """with s as (select doc_id, case when doc_id % 50 = 0 then 'stale' else sha256(text) end as hash from documents), n as (select doc_id, sha256(text) as hash from documents where doc_id % 70 > 0)
    select count(*) as checked, count(*) filter (s.hash = n.hash) as ok, count(*) filter (s.hash <> n.hash) as mismatched, count(*) filter (n.hash is null) as missing from s left join n using (doc_id)"""
)
def integrity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    stored = docs.withColumn("hash", F.when(F.col("doc_id") % 50 == 0, "stale").otherwise(F.col("hash")))
    return operations.integrity(stored, docs.where("doc_id % 70 > 0"), "doc_id")


TRANSFERS = """t as (select event_id as transfer_id, event_id % 5 + 1 as attempt, case event_id % 6 when 0 then null when 1 then 500 when 2 then 404 when 3 then 429 when 4 then 503 else 408 end as code, ts from events),
    r as (select transfer_id, case when (code is null or code >= 500 or code in (408, 429)) and attempt <= 3 then 'PENDING' else 'FAILED' end as status,
      case when (code is null or code >= 500 or code in (408, 429)) and attempt <= 3 then ts + to_seconds([60, 300, 900][attempt]) end as next_at from t)"""


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    code = F.when(k % 6 == 1, 500).when(k % 6 == 2, 404).when(k % 6 == 3, 429).when(k % 6 == 4, 503).when(k % 6 == 5, 408)
    state = operations.retry((k % 5 + 1).cast("int"), code, F.col("ts"))
    return table(spark, sf_dir, "events").select(k.alias("transfer_id"), state.alias("s")).select("transfer_id", "s.*")


@query(f"with {TRANSFERS} select transfer_id, status, floor(epoch(next_at))::bigint as next_s from r")
def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transfers(spark, sf_dir).select("transfer_id", "status", _s("next_at").alias("next_s"))


@query(f"with {TRANSFERS} select transfer_id, floor(epoch(next_at))::bigint as next_s from r where status = 'PENDING' and next_at <= timestamp '{NOW}' order by next_at, transfer_id limit 20")
def due_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations.due(_transfers(spark, sf_dir), _now()).select("transfer_id", _s("next_at").alias("next_s"))


@query(
    """with e as (select event_id, case when event_id % 3 = 0 then user_id end as owner_id, user_id // 20 as role from events)
    select event_id, owner_id as user_id from e where owner_id is not null union all
    select event_id, c_custkey from e join customer on c_custkey // 20 = role where owner_id is null"""
)
def notify_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    team = lambda c: F.floor(F.col(c) / 20).alias("role")  # noqa: E731 - of twenty, so that the fan-out grows with the events
    events = table(spark, sf_dir, "events").select(k, F.when(k % 3 == 0, F.col("user_id")).alias("owner_id"), team("user_id"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), team("c_custkey"))
    return operations.fan_out(events, users)


@query(
    """with o as (select event_type, ts, floor(value) as value, lag(floor(value)) over (partition by event_type order by ts, floor(value)) as was from events),
    s as (select *, case when was is null then 0 when value < was then value else value - was end as step from o)
    select event_type, epoch(time_bucket(interval '1 hour', ts))::bigint as start_s, sum(step) as increase from s group by all"""
)
def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select("event_type", "ts", F.floor("value").cast("double").alias("value"))
    return operations.increases(samples, "1 hour", "event_type").select("event_type", _s("start").alias("start_s"), "increase")


@query(
    """select event_type, epoch(time_bucket(interval '6 hours', ts))::bigint as start_s, count(*) as n, printf('%.6f', quantile_cont(value, 95e-2)) as p95 from events group by all"""
)
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = operations.latency_quantile(table(spark, sf_dir, "events").select("event_type", "ts", "value"), "6 hours", 0.95, "event_type")
    return found.select("event_type", _s("start").alias("start_s"), "n", scalars.fixed(F.col("value"), 6).alias("p95"))


@query(f"select user_id, floor(epoch(max(ts)))::bigint as last_s, epoch(timestamp '{NOW}')::bigint - floor(epoch(max(ts)))::bigint > 26 * 3600 as is_stale from events group by 1")
def stale_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = operations.stale(table(spark, sf_dir, "events").select("user_id", "ts"), _now(), 26, "user_id")
    return seen.select("user_id", _s("last").alias("last_s"), "is_stale")


@query(
    """with h as (select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n from events group by all), f as (select *, n >= 3 as is_on from h),
    r as (select *, sum(case when is_on then 0 else 1 end) over (partition by event_type order by start) as run from f)
    select event_type, epoch(min(start))::bigint as first_s, epoch(max(start))::bigint as last_s, count(*) as n from r where is_on group by event_type, run having count(*) >= 4"""
)
def sustained_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    flags = hours.select("event_type", F.col("w.start").alias("start"), (F.col("n") >= 3).alias("on"))
    runs = operations.sustained(flags, 4, "event_type")
    return runs.select("event_type", _s("first").alias("first_s"), _s("last").alias("last_s"), "n")


@query("with w as (select date_trunc('week', o_orderdate) as week, count(*) as n from orders group by 1) select epoch(week)::bigint as week_s, n, n - lag(n) over (order by week) as delta from w")
def weekly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = operations.week_over_week(table(spark, sf_dir, "orders"), "o_orderdate", F.count(F.lit(1)))
    return weeks.select(_s("week").alias("week_s"), "n", "delta")


@query(
    """select o_custkey, count(*) as files, count(*) filter (o_orderstatus = 'F') as parsed, count(*) filter (o_orderstatus = 'O') as running, count(*) filter (o_orderstatus = 'P') as failed,
      count(distinct o_orderpriority) as disciplines, sum(floor(o_totalprice)) as pages from orders group by 1"""
)
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(s == "F").alias("parsed"), F.count_if(s == "O").alias("running"), F.count_if(s == "P").alias("failed"),
        F.count_distinct("o_orderpriority").alias("disciplines"), F.sum(F.floor("o_totalprice").cast("double")).alias("pages"),
    )


@query(
    """with k as (select event_id, case event_type when 'click' then 'process.start' when 'view' then 'process.update' when 'purchase' then 'process.hypotheses' else event_type end as type from events)
    select case when event_id % 101 = 0 then 'dead' when type in ('process.start','process.update','process.hypotheses') then type else 'dead' end as route, count(*) as n from k group by 1"""
)
def stream_task_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/tasks-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    kinds = {"click": "process.start", "view": "process.update", "purchase": "process.hypotheses"}
    table_of = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    kind = F.coalesce(F.try_element_at(table_of, F.col("event_type")), F.col("event_type"))
    body = F.to_json(F.struct(kind.alias("type"), F.col("event_id").alias("process_id"), "value"))
    # Every 101st message is cut off in the middle.
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 101 == 0, F.left(body, F.lit(20))).otherwise(body).alias("value"))
    lines.write.text(f"{base}/in")
    handlers = {k: _keep(f"{base}/out/{k}") for k in tasks.KINDS}
    tasks.consume(tasks.messages(spark, f"{base}/in"), handlers, f"{base}/dead", f"{base}/checkpoint").awaitTermination()
    dead = spark.read.parquet(f"{base}/dead").select(F.lit("dead").alias("route"))
    done = [spark.read.parquet(f"{base}/out/{k}").select("route") for k in tasks.KINDS]
    for d in done:
        dead = dead.union(d)
    return dead.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with recursive e as (
      select user_id as task_id, epoch_us(ts) as micros, case event_type when 'signup' then 'submitted' when 'click' then 'submitted' when 'view' then 'done' else 'failed' end as kind,
        case when event_type = 'purchase' then [503, 429, 404][(event_id % 3 + 1)::int] end as code, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (
      select task_id, 0 as i, 'idle' as status, 0 as attempt, 0::bigint as due, false as fired, 0::bigint as fired_at, 0::bigint as micros, null::varchar as action, 0 as shown from e group by 1
      union all
      select task_id, i, case action when 'RUN' then 'running' when 'WAIT' then 'waiting' when 'DONE' then 'idle' when 'DEAD' then 'idle' else status end,
        case action when 'RUN' then 1 when 'DONE' then 0 when 'DEAD' then 0 else attempt end, case when action = 'WAIT' then micros + [60, 300, 900][attempt] * 1000000 when action is null then due else 0 end,
        fired, fired_at, micros, action, case when action = 'RUN' then 1 else attempt end
      from (
        select task_id, i, status, attempt, due, fired, fired_at, micros, case when kind = 'submitted' and status = 'idle' then 'RUN' when status = 'running' and kind = 'done' then 'DONE'
          when status = 'running' and kind = 'failed' then case when (code is null or code >= 500 or code in (408, 429)) and attempt <= 3 then 'WAIT' else 'DEAD' end end as action
        from (
          select e.task_id, e.i, e.micros, e.kind, e.code, s.status = 'waiting' and s.due <= e.micros as fired, s.due as fired_at, s.due, case when s.status = 'waiting' and s.due <= e.micros then 'running' else s.status end as status,
            case when s.status = 'waiting' and s.due <= e.micros then s.attempt + 1 else s.attempt end as attempt from s join e on e.task_id = s.task_id and e.i = s.i + 1))),
    last as (select *, max(i) over (partition by task_id) as n from s),
    told as (
      select task_id, micros, action, shown as attempt, i from s where action is not null
      union all select b.task_id, a.fired_at, 'RUN', b.attempt + 1, a.i from s a join s b on b.task_id = a.task_id and b.i = a.i - 1 where a.fired
      union all select task_id, due, 'RUN', attempt + 1, i + 1 from last where i = n and status = 'waiting' and due // 1000 < (select max(micros) // 1000 from e) - 600000)
    select task_id, micros as "at", action, attempt::int as attempt from told"""
)
def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of submissions, failures and ends does about its tasks, a user's events for each."""
    base = new_folder(spark, "retries")
    kind = F.when(F.col("event_type").isin("signup", "click"), "submitted").when(F.col("event_type") == "view", "done").otherwise("failed")
    code = F.when(F.col("event_type") == "purchase", F.get(F.array(F.lit(503), F.lit(429), F.lit(404)), (F.col("event_id") % 3).cast("int")))
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_id", at.alias("at"), kind.alias("kind"), code.alias("code"))
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    sink = retries.attempts(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    sink.start().awaitTermination()
    return spark.read.schema(retries.STEPS).parquet(f"{base}/out").select("task_id", F.unix_micros("at").alias("at"), "action", "attempt")


def _keep(path: str):
    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")  # a repeated batch replaces its own rows only

    return keep
