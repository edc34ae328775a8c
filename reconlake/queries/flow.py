"""Sinks, uploads, reports and states of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import metrics, operations, reports
from reconlake.plans.lineage import shared_dir
from reconlake.queries.operating import NOW, _now, _s
from reconlake.queries.packages import LEDGER_SQL, _ledger
from reconlake.queries.registry import query
from reconlake.sources import sinks
from reconlake.sources.tables import table
from reconlake.streaming import states


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"


@query(
    """select p_partkey as page, p_size as file_id, p_name as text from part where p_size > 10 union all
    select p_partkey + 100000, p_size, 'new ' || p_name from part where p_size <= 10 and p_partkey % 2 = 0 union all
    select p_partkey, p_size, p_name from part where p_size <= 10 and p_size not in (select p_size from part where p_size <= 10 and p_partkey % 2 = 0)"""
)
def pages_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "pages")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.col("p_size").alias("file_id"), F.col("p_name").alias("text"))
    sinks.replace_partitions(rows, path, "file_id")
    again = rows.where("file_id <= 10 and page % 2 = 0").select((F.col("page") + 100000).alias("page"), "file_id", F.concat(F.lit("new "), "text").alias("text"))
    sinks.replace_partitions(again, path, "file_id")
    return spark.read.parquet(path).select("page", "file_id", "text")


@query(
    """select p_brand as code, min(p_partkey) as id from part where p_partkey % 3 = 0 group by 1 union all
    select p_brand, min(p_partkey) from part where p_partkey % 3 > 0 and p_brand not in (select p_brand from part where p_partkey % 3 = 0) group by 1"""
)
def params_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "params")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.col("p_partkey").alias("id"))
    none = spark.createDataFrame([], "code string, id bigint")
    sinks.insert_absent(rows.where("id % 3 = 0"), none, path, ["code"], "id")
    sinks.insert_absent(rows.where("id % 3 > 0"), spark.read.parquet(path), path, ["code"], "id")
    return spark.read.parquet(path)


@query(
    """with o as (select o_custkey as process_id, o_orderkey as group_id, 'SUSPICION' as status, case when o_orderkey % 4 = 0 then o_custkey end as verified_by from orders where o_orderkey % 3 > 0),
    n as (select o_custkey as process_id, o_orderkey as group_id, 'SUSPICION' as status, null::bigint as verified_by from orders where o_orderkey % 3 <> 1)
    select * from o where process_id % 10 = 0 or verified_by is not null union all
    select * from n where process_id % 10 > 0 and not exists (select 1 from o where o.process_id = n.process_id and o.group_id = n.group_id and o.verified_by is not null)"""
)
def hypotheses_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("process_id"), k.alias("group_id"), F.lit("SUSPICION").alias("status"), F.when(k % 4 == 0, F.col("o_custkey")).alias("verified_by"))
    new = rows.where("group_id % 3 <> 1").withColumn("verified_by", F.lit(None).cast("bigint"))
    return sinks.upserted(rows.where("group_id % 3 > 0"), new, rows.where("process_id % 10 = 0").select("process_id"))


@query(
    """select o_orderkey as file_id, case when o_orderkey % 6 = 0 then 'FAILED' when o_orderkey % 2 = 0 then 'PARSED' else 'NEW' end as status, case when o_orderkey % 6 = 0 then 'timeout' when o_orderkey % 4 = 0 then 'old' end as error,
      o_custkey as pages from orders"""
)
def files_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("file_id")
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.lit("NEW").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, "old").alias("error"), F.col("o_custkey").alias("pages"))
    first = state.where(k % 2 == 0).select("file_id", F.lit(1).alias("seq"), F.lit("PARSED").alias("status"), F.lit(None).cast("string").alias("error"))
    second = state.where(k % 6 == 0).select("file_id", F.lit(2).alias("seq"), F.lit("FAILED").alias("status"), F.lit("timeout").alias("error"))
    return sinks.changed(state, first.union(second), "file_id", "seq")


@query(
    """select doc_id, case doc_id % 5 when 0 then 'miss' when 1 then 'miss' when 2 then 'corrupt' else 'hit' end as outcome, case when doc_id % 5 > 2 then doc_id % 7 end as pages from documents"""
)
def parse_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("h"), k.cast("string")).alias("file_hash"))
    good = F.to_json(F.struct((k % 7).alias("pages")))
    cache = files.where(k % 5 > 0).select("file_hash", F.when(k % 5 == 1, "v1").otherwise("v2").alias("version"), F.when(k % 5 == 2, F.left(good, F.lit(5))).otherwise(good).alias("content"))
    return sinks.cached(files, cache, "v2", "pages bigint").select("doc_id", "outcome", "parsed.pages")


@query(
    """with u as (select event_id, user_id as batch_id, case event_id % 6 when 0 then 'application/pdf' when 1 then 'text/csv' when 2 then 'image/png' when 3 then 'video/mp4' when 4 then 'application/json' else 'application/pdf' end as mime,
      event_id % 40 as size, event_id % 6 < 5 as intact from events)
    select event_id, case when mime = 'video/mp4' then 'UNSUPPORTED_FORMAT'
      when mime in ('text/csv', 'application/json') and event_id > min(event_id) filter (mime in ('text/csv', 'application/json')) over (partition by batch_id) then 'MULTIPLE_MANIFESTS'
      when size > 35 then 'FILE_TOO_LARGE' when size = 0 or not intact then 'CORRUPTED_FILE' end as refused from u"""
)
def uploads_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    mime = F.get(F.array(*map(F.lit, ("application/pdf", "text/csv", "image/png", "video/mp4", "application/json", "application/pdf"))), (k % 6).cast("int"))
    head = F.when(k % 6 == 0, "JVBERi0x").when(k % 6 == 2, "iVBORw0K").when(k % 6 == 5, "AAAAAAAA").otherwise("e30=")
    uploads = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("batch_id"), k.alias("arrival"), mime.alias("mime"), (k % 40).alias("size"), head.alias("base64"))
    return sinks.validated(sinks.decoded(uploads).withColumnRenamed("content", "head"), 35).select("event_id", "refused")


@query(
    """with e as (select o_orderkey as entry_id, 'f' || o_orderkey % 700 as file_name, case when o_orderkey % 5 = 0 then 'f' || o_orderkey % 900 end as predecessor_name, o_custkey as object_id,
        ['PD', 'RD', 'ID'][(o_orderkey % 3 + 1)::int] as stage from orders),
    f as (select 'f' || p_partkey % 150 as file_name, max(p_partkey) as file_id from part group by 1),
    c as (select object_id, count(*) filter (stage = 'PD') as pd, count(*) filter (stage = 'RD') as rd, count(*) filter (stage = 'ID') as id from e group by 1)
    select entry_id, f.file_id, p.file_id as predecessor_id, pd, rd, id from e join c using (object_id) left join f using (file_name) left join f p on p.file_name = predecessor_name"""
)
def registry_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    named = lambda n: F.concat(F.lit("f"), n.cast("string"))
    stage = F.get(F.array(F.lit("PD"), F.lit("RD"), F.lit("ID")), (k % 3).cast("int"))
    entries = table(spark, sf_dir, "orders").select(k.alias("entry_id"), named(k % 700).alias("file_name"), F.when(k % 5 == 0, named(k % 900)).alias("predecessor_name"), F.col("o_custkey").alias("object_id"), stage.alias("stage"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), named(F.col("p_partkey") % 150).alias("file_name"), F.col("p_partkey").alias("arrival"))
    return sinks.registry_files(entries, files).join(sinks.expected_counts(entries), "object_id").select("entry_id", "file_id", "predecessor_id", "pd", "rd", "id")


@query(
    """with d as (select p_brand, length(p_name) as n, levenshtein(lower(p_name), lower(p_type)) as d from part)
    select p_brand, sum(n)::bigint as characters, printf('%.6f', greatest(0e0, 1 - sum(d) / sum(n)::double)) as accuracy from d group by 1"""
)
def pooled_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", F.length("p_name").alias("length"), F.levenshtein(F.lower("p_name"), F.lower("p_type")).alias("distance"))
    return reports.pooled_accuracy(rows, "p_brand").withColumn("accuracy", scalars.fixed(F.col("accuracy"), 6))


@query(
    f"""with {LEDGER_SQL}, c as (select source, count(*) filter (label = 'POSITIVE' and engine_status is not null) as tp, count(*) filter (label = 'NEGATIVE' and engine_status is not null) as fp,
        count(*) filter (label = 'POSITIVE' and engine_status is null) as fn, count(*) filter (label = 'NEGATIVE' and engine_status is null) as tn from ledger group by 1),
    r as (select source, tp / nullif(tp + fp, 0)::double as p, tp / nullif(tp + fn, 0)::double as q, fp / nullif(fp + tn, 0)::double as fpr from c),
    s as (select *, case when p + q > 0 then 2 * p * q / (p + q) end as f1 from r)
    select source as modality from s where not (coalesce(p >= 9e-1, true) and coalesce(q >= 8e-1, true) and coalesce(f1 >= 85e-2, true) and coalesce(fpr <= 1e-1, true))
      and coalesce(p, q, f1, fpr) is not null order by coalesce(f1, 1), source limit 1"""
)
def worst_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = metrics.rated(metrics.confusion(_ledger(spark, sf_dir), "source"))
    return reports.worst_group(rated, "source").select(F.col("source").alias("modality"))


@query(
    f"""with l as (select event_id, case when event_id % 3 > 0 then 'POSITIVE' else 'NEGATIVE' end as label, case when event_id % 5 < 3 then 'CANDIDATE' end as e,
        case when ts > timestamp '{NOW}' - interval 7 days and ts <= timestamp '{NOW}' then 0 when ts > timestamp '{NOW}' - interval 14 days and ts <= timestamp '{NOW}' - interval 7 days then 1 end as period from events),
    c as (select period, count(*) filter (label = 'POSITIVE' and e is not null) as tp, count(*) filter (label = 'NEGATIVE' and e is not null) as fp, count(*) filter (label = 'POSITIVE' and e is null) as fn,
        count(*) filter (label = 'NEGATIVE' and e is null) as tn from l where period is not null group by 1),
    r as (select period, tp / nullif(tp + fp, 0)::double as p, tp / nullif(tp + fn, 0)::double as q, fp / nullif(fp + tn, 0)::double as fpr from c),
    m as (select period, unnest(['precision', 'recall', 'f1', 'fpr']) as metric, unnest([p, q, case when p + q > 0 then 2 * p * q / (p + q) end, fpr]) as value from r)
    select metric, printf('%.6f', max(value) filter (period = 0)) as now, printf('%.6f', max(value) filter (period = 1)) as before, printf('%.6f', max(value) filter (period = 0) - max(value) filter (period = 1)) as delta from m group by 1"""
)
def weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    labels = table(spark, sf_dir, "events").select(F.when(k % 3 > 0, "POSITIVE").otherwise("NEGATIVE").alias("label"), F.when(k % 5 < 3, "CANDIDATE").alias("engine_status"), F.col("ts").cast("timestamp").alias("at"))
    found = reports.two_periods(labels, "at", _now())
    return found.select("metric", *[scalars.fixed(F.col(c), 6).alias(c) for c in ("now", "before", "delta")])


@query(
    f"""with {LEDGER_SQL}, w as (select l_orderkey as id from lineitem where l_linenumber = 1), r as (select * from ledger where id in (select id from w)),
    t as (select 'gold-' || strftime(o_orderdate, '%Y.%m.%d') || case when o_orderkey % 2 = 0 then '-2' else '' end as tag, o_orderdate as released_at from orders)
    select (select count(*) from r) as labels, (select sha256(string_agg(id::varchar, chr(10) order by id::varchar)) from r) as manifest,
      'gold-1995.03.15' || coalesce((select '-' || (count(*) + 1) from t where starts_with(tag, 'gold-1995.03.15') having count(*) > 0), '') as tag, (select max_by(tag, (released_at, tag)) from t) as last_tag"""
)
def label_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    frozen = metrics.release(reports.release(_ledger(spark, sf_dir), wanted))
    day = F.date_format("o_orderdate", "yyyy.MM.dd")
    tags = table(spark, sf_dir, "orders").select(F.concat(F.lit("gold-"), day, F.when(F.col("o_orderkey") % 2 == 0, "-2").otherwise("")).alias("tag"), F.col("o_orderdate").alias("released_at"))
    tag = reports.version_tag(tags, F.lit("1995-03-15").cast("date")).select("tag").scalar()
    last = reports.latest_tag(tags, "rules").select("tag").scalar()
    return frozen.select(F.col("n").alias("labels"), "manifest", tag.alias("tag"), last.alias("last_tag"))


@query(
    f"""select event_id, hour(timestamp '{NOW}') >= 3 and ts::date < date '2024-01-31' as daily, dayofweek(timestamp '{NOW}') + 1 = 4 and hour(timestamp '{NOW}') >= 9
      and floor(epoch(timestamp '{NOW}')) - floor(epoch(ts)) >= 6 * 86400 as weekly from events"""
)
def jobs_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", reports.daily_due(ts, _now(), 3).alias("daily"), reports.weekly_due(ts, _now(), 4, 9).alias("weekly"))


@query(
    """with o as (select event_type, ts, floor(value) as value, lag(floor(value)) over (partition by event_type order by ts, floor(value)) as was from events),
    s as (select event_type, time_bucket(interval '1 hour', ts) as start, sum(case when was is null then 0 when value < was then value else value - was end) as increase from o group by all),
    r as (select *, increase / 3600e0 > 5e-3 as is_on, sum(case when increase / 3600e0 > 5e-3 then 0 else 1 end) over (partition by event_type order by start) as run from s)
    select event_type, epoch(min(start))::bigint as first_s, epoch(max(start))::bigint as last_s, count(*) as n from r where is_on group by event_type, run having count(*) >= 2"""
)
def rate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select("event_type", "ts", F.floor("value").cast("double").alias("value"))
    found = reports.rate_alert(operations.increases(samples, "1 hour", "event_type"), 3600, 0.005, 2, "event_type")
    return found.select("event_type", _s("first").alias("first_s"), _s("last").alias("last_s"), "n")


@query(
    """with b as (select event_type, time_bucket(interval '1 day', ts) as start, count(*) as n, count(*) filter (value <= 10) as b0, count(*) filter (value <= 50) as b1, count(*) filter (value <= 200) as b2 from events group by all)
    select event_type, epoch(start)::bigint as start_s, printf('%.6f', case when b0 >= n * 9e-1 then 10 * coalesce(n * 9e-1 / nullif(b0, 0), 0) when b1 >= n * 9e-1 then 10 + 40 * (n * 9e-1 - b0) / (b1 - b0)
      when b2 >= n * 9e-1 then 50 + 150 * (n * 9e-1 - b1) / (b2 - b1) else 200 end) as p90 from b"""
)
def bucket_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    found = reports.bucket_quantile(rows, [10.0, 50.0, 200.0], 0.9, "1 day", "event_type")
    return found.select("event_type", _s("start").alias("start_s"), scalars.fixed(F.col("value"), 6).alias("p90"))


@query(
    """select event_type, epoch(time_bucket(interval '1 day', ts))::bigint as start_s, printf('%.6f', count(*) / 86400e0) as per_second, printf('%.6f', count(*) filter (event_id % 7 = 0) / count(*)::double) as failed_share,
      count(*) as n from events group by all"""
)
def request_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "value", (F.col("event_id") % 7 == 0).alias("failed"))
    found = reports.panels(rows, "1 day", 86400, "event_type")
    counts = rows.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
    return found.join(counts, ["event_type", "start"]).select("event_type", _s("start").alias("start_s"), "per_second", "failed_share", "n")


@query(
    """with t as (select event_id, event_id % 4 as attempt, event_id % 3 = 0 as failed, case event_id % 2 when 0 then 'process.start' else 'process.hypotheses' end as type from events)
    select event_id, case when not failed then 'DONE' when attempt < 2 then 'RETRY' else 'FAILED' end as status, case when failed and attempt < 2 then attempt + 1 else attempt end as attempt, failed and attempt >= 2 as notify,
      not failed and type = 'process.start' as asks from t"""
)
def task_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    tasks = table(spark, sf_dir, "events").select(k, F.when(k % 2 == 0, "process.start").otherwise("process.hypotheses").alias("type"), k.alias("process_id"), states.task_outcome(k % 4, k % 3 == 0).alias("s"))
    rows = tasks.select("event_id", "type", "process_id", "s.*")
    asks = states.follow_ups(rows).select(F.col("process_id").alias("event_id"), F.lit(True).alias("asks"))
    return rows.join(asks, "event_id", "left").select("event_id", "status", "attempt", "notify", F.coalesce("asks", F.lit(False)).alias("asks"))


@query("select event_id, event_id % 4 < 2 as ok, case event_id % 4 when 2 then 'UNREADABLE' when 3 then 'EMPTY' end as error from events")
def file_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    files = table(spark, sf_dir, "events").select(k, F.when(k % 4 < 2, k.cast("string")).when(k % 4 == 2, "torn").alias("content"))
    return states.file_outcomes(files, F.col("content").try_cast("bigint")).select("event_id", "ok", "error")


@query(
    """with t as (select o_orderkey as id, ['PENDING', 'SENT', 'FAILED'][(o_orderkey % 3 + 1)::int] as status, o_orderkey % 4 as attempt from orders where o_orderkey % 5 > 0), q as (select o_orderkey as id, case when o_orderkey % 7 < 4 then 'enqueue' else 'cancel' end as kind from orders where o_orderkey % 2 = 0),
    j as (select coalesce(t.id, q.id) as id, status, attempt, kind from t full outer join q on t.id = q.id)
    select id as protocol_id, case when kind = 'enqueue' and coalesce(status, '') <> 'SENT' then 'PENDING' when kind = 'cancel' and status = 'PENDING' then 'CANCELLED' else status end as status,
      case when kind = 'enqueue' and coalesce(status, '') <> 'SENT' then 0 else attempt end as attempt from j where status is not null or kind = 'enqueue'"""
)
def transfer_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("protocol_id")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("protocol_id"))
    held = o.where(k % 5 > 0).select("protocol_id", F.get(F.array(F.lit("PENDING"), F.lit("SENT"), F.lit("FAILED")), (k % 3).cast("int")).alias("status"), (k % 4).alias("attempt"))
    asked = o.where(k % 2 == 0).select("protocol_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    last = F.when(k % 7 < 4, "enqueue").otherwise("cancel")
    requests = asked.select("protocol_id", "at", F.when(F.col("at") == 2, last).otherwise(F.when(last == "enqueue", "cancel").otherwise("enqueue")).alias("kind"))
    return states.queued(held, requests)


@query(
    """select o_orderkey, case when o_orderkey % 5 < 2 then 'PROCESS_BUSY' when o_orderkey % 3 = 0 then 'PROTOCOL_FINALIZED' when o_orderkey % 3 = 1 then 'NO_PROTOCOL' end as update_refused,
      case when o_orderkey % 5 > 0 then 'ALREADY_STARTED' when o_orderkey % 2 = 0 then 'NO_FILES' end as start_refused, case when o_orderkey % 3 = 0 then 'UPLOADED' else 'NOT_APPLICABLE' end as pd, o_orderkey % 4 = 0 as is_registry from orders"""
)
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    process = F.get(F.array(*map(F.lit, ("PENDING", "PARSING", "READY", "VERIFYING", "COMPLETED"))), (k % 5).cast("int"))
    protocol = F.when(k % 3 == 0, "PROTOCOL_FINALIZED").when(k % 3 == 2, "READY")
    none = F.lit(None).cast("string")
    stages = sinks.completeness_struct(F.when(k % 3 == 0, "UPLOADED"), none, none)
    registry = sinks.is_registry_row(F.when(k % 2 == 1, "PD"), F.when(k % 4 == 0, "same").otherwise("other"), F.lit("same"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", states.update_refused(process, protocol).alias("update_refused"), states.start_refused(process, F.when(k % 2 == 1, 1)).alias("start_refused"), stages["pd"].alias("pd"), registry.alias("is_registry")
    )
