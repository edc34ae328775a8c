"""Revisions, completeness, registries, checks, merges and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import merging, metrics, registry, rooms, sources, views
from reconlake.plans import shapes
from reconlake.plans.shapes import CHECKS_SQL, FILES_SQL
from reconlake.queries.reconciliation import _found, found_sql
from reconlake.queries.registry import query
from reconlake.sources.tables import table


@query(
    f"""with {FILES_SQL},
    alive as (select * from files where status not in ('CANCELLED','SUPERSEDED')),
    cur as (select * from alive a where not exists (select 1 from alive b where b.predecessor_id = a.file_id and b.object_id = a.object_id
      and b.discipline is not distinct from a.discipline and b.stage = a.stage)),
    ok as (select *, max(approved_on) over (partition by object_id, discipline, stage) as latest from cur where status in ('APPROVED','FOR_CONSTRUCTION')),
    g as (select object_id, discipline, stage, count(*) as n, count(*) filter (approved_on is null) as undated, count(*) filter (approved_on = latest) as at_latest,
      max(file_id) filter (approved_on = latest) as newest, max(file_id) as only_one from ok group by all),
    c as (select distinct object_id, discipline, stage from cur)
    select f.object_id, f.discipline, f.stage,
      case when c.stage is null then 'MISSING_EVIDENCE' when n is null then 'CLARIFICATION_REQUIRED' when n = 1 or (undated = 0 and at_latest = 1) then 'COMPLETE'
        else 'CLARIFICATION_REQUIRED' end as outcome,
      case when n = 1 then only_one when undated = 0 and at_latest = 1 then newest end as file_id
    from (select distinct object_id, discipline, stage from files) f left join c using (object_id, discipline, stage) left join g using (object_id, discipline, stage)"""
)
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.select_source(shapes.files(spark, sf_dir), ["object_id", "discipline", "stage"])


@query(
    f"""with {FILES_SQL},
    coded as (select *, case when file_id % 10 > 0 then 'D' || file_id % 2 end as code from files),
    alive as (select * from coded where code is not null and status not in ('CANCELLED','SUPERSEDED')),
    cur as (select * from alive a where not exists (select 1 from alive b where b.predecessor_id = a.file_id and b.object_id = a.object_id
      and b.discipline is not distinct from a.discipline and b.stage = a.stage and b.code = a.code)),
    ok as (select *, max(approved_on) over (partition by object_id, discipline, stage, code) as latest from cur where status in ('APPROVED','FOR_CONSTRUCTION')),
    g as (select object_id, discipline, stage, code, count(*) as n, count(*) filter (approved_on is null) as undated, count(*) filter (approved_on = latest) as at_latest,
      max(file_id) filter (approved_on = latest) as newest, max(file_id) as only_one from ok group by all),
    c as (select distinct object_id, discipline, stage, code from cur),
    r as (select object_id, discipline, stage, code, count(*) as raw from coded where status in ('APPROVED','FOR_CONSTRUCTION') group by all),
    o as (select f.*, case when c.stage is null then 'MISSING_EVIDENCE' when n is null then 'CLARIFICATION_REQUIRED' when n = 1 or (undated = 0 and at_latest = 1) then 'COMPLETE' else 'CLARIFICATION_REQUIRED' end as outcome,
        case when n = 1 then only_one when undated = 0 and at_latest = 1 then newest end as file_id, raw
      from (select distinct object_id, discipline, stage, code from coded where code is not null) f left join c using (object_id, discipline, stage, code) left join g using (object_id, discipline, stage, code)
      left join r using (object_id, discipline, stage, code))
    select 'document:' || concat_ws(':', object_id, discipline, stage, code) as label, outcome, file_id, case when outcome = 'MISSING_EVIDENCE' then 'no current file' when outcome = 'COMPLETE' and raw = 1 then 'one approved file'
      when outcome = 'COMPLETE' then 'latest approval' when raw is null then 'no approved file' else 'several approved files without one latest date' end as reason from o
    union all select 'file:' || file_id, 'CLARIFICATION_REQUIRED', null, 'no document code' from coded where code is null"""
)
def document_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("file_id")
    files = shapes.files(spark, sf_dir).withColumn("code", F.when(k % 10 > 0, F.concat(F.lit("D"), (k % 2).cast("string"))))
    return sources.select_documents(files, ["object_id", "discipline", "stage"]).select("label", "outcome", "file_id", "reason")


COUNTS_SQL = f"""{FILES_SQL},
    counts as (select object_id, stage, count(*) filter (status <> 'DRAFT') as uploaded, count(*) filter (status <> 'DRAFT' or object_id % 5 = 0) as expected from files group by all),
    every as (select object_id, stage from (select distinct object_id from counts) cross join (select unnest(['PD','RD','ID']) as stage)),
    complete as (select object_id, stage, coalesce(expected, 0) as expected, coalesce(uploaded, 0) as uploaded,
      case when coalesce(expected, 0) = 0 and coalesce(uploaded, 0) = 0 then 'NOT_APPLICABLE' when coalesce(uploaded, 0) = 0 then 'MISSING'
        when uploaded < expected then 'PARTIAL' else 'UPLOADED' end as completeness from every left join counts using (object_id, stage))"""


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = F.col("status") != "DRAFT"
    counts = shapes.files(spark, sf_dir).groupBy("object_id", "stage").agg(
        F.count_if(real).alias("uploaded"), F.count_if(real | (F.col("object_id") % 5 == 0)).alias("expected")
    )
    return sources.completeness(counts)


@query(f"with {COUNTS_SQL} select * from complete")
def stage_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, sf_dir)


@query(
    f"""with {COUNTS_SQL}, f as (select object_id, bool_or(completeness = 'PARTIAL') as partial, list(stage order by list_position(['PD','RD','ID'], stage)) filter (completeness = 'UPLOADED') as up
      from complete group by 1)
    select object_id, case when partial then 'PARTIALLY_LOADED' when up is null or len(up) = 0 then null when len(up) = 3 then 'FULL'
      when len(up) = 1 then 'SINGLE_' || up[1] else array_to_string(up, '_') end as scenario from f"""
)
def load_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.scenario(_complete(spark, sf_dir))


ENTRIES_SQL = """entries as (select o_orderkey + 1 as row_number, case when o_orderkey % 17 = 0 then ' ' else o_custkey::varchar end as object_id,
    'file' || (o_orderkey % 900) || '.pdf' as file_name, case o_orderkey % 5 when 0 then 'pd' when 1 then ' RD ' when 2 then 'ID' when 3 then 'XX' else null end as doc_stage,
    case o_orderkey % 7 when 0 then 'approved' when 1 then '' when 2 then 'Draft' when 3 then 'maybe' else o_orderpriority end as raw_status,
    case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d.%m.%Y') when 2 then 'soon' else null end as approval_date,
    o_orderdate::date as day, o_orderkey as k from orders)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    choose = lambda n, *options: F.get(F.array(*options), (k % n).cast("int"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        (k + 1).alias("row_number"), F.when(k % 17 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("object_id"),
        F.concat(F.lit("file"), (k % 900).cast("string"), F.lit(".pdf")).alias("file_name"),
        choose(5, F.lit("pd"), F.lit(" RD "), F.lit("ID"), F.lit("XX"), none).alias("doc_stage"),
        choose(7, F.lit("approved"), F.lit(""), F.lit("Draft"), F.lit("maybe"), *[F.col("o_orderpriority")] * 3).alias("approval_status"),
        choose(4, F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit("soon"), none).alias("approval_date"),
    )


@query(
    f"""with {ENTRIES_SQL}, s as (select *, upper(trim(doc_stage)) as stage, case when trim(coalesce(raw_status, '')) = '' then 'DRAFT' else upper(trim(raw_status)) end as status from entries),
    e as (select *, list_filter([case when trim(object_id) = '' then 'EMPTY_OBJECT_ID' end, case when doc_stage is null then 'EMPTY_DOC_STAGE' end,
        case when stage not in ('PD','RD','ID') then 'UNKNOWN_STAGE' end,
        case when status not in ('DRAFT','APPROVED','FOR_CONSTRUCTION','SUPERSEDED','CANCELLED') then 'UNKNOWN_APPROVAL' end], lambda x: x is not null) as fatal from s)
    select row_number, trim(object_id) as object_id, file_name, stage as doc_stage, status as approval_status, case when k % 4 < 2 then day end as approval_date,
      array_to_string(fatal || case when k % 4 = 2 then ['BAD_DATE'] else [] end, ',') as errors, len(fatal) = 0 as kept from e"""
)
def registry_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.parse(_entries(spark, sf_dir)).withColumn("errors", F.array_join("errors", ","))


@query(
    """with e as (select distinct 'f' || o_orderkey % 700 as file_name from orders where o_orderkey % 3 > 0), f as (select 'f' || (p_partkey % 750) * 2 as file_name from part group by all)
    select 'entry' as side, file_name from e where file_name not in (select file_name from f) union all
    select 'file' as side, file_name from f where file_name not in (select file_name from e)"""
)
def registry_coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda n: F.concat(F.lit("f"), n.cast("string")).alias("file_name")
    entries = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0").select(named(F.col("o_orderkey") % 700)).distinct()
    files = table(spark, sf_dir, "part").select(named(F.col("p_partkey") % 750 * 2)).distinct()
    return sources.coverage_gap(entries, files, "file_name")


@query(f"with {CHECKS_SQL} select check_id, parent_id, status from visible")
def visible_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.visible(shapes.checks(spark, sf_dir)).select("check_id", "parent_id", "status")


SUMMARY = """count(*) as total, count(*) filter (status = 'CANDIDATE') as candidates, count(*) filter (status = 'CONFIRMED_VIOLATION') as confirmed,
    count(*) filter (status = 'NEGATIVE_VERIFIED' and verified_by is not null) as rejected, count(*) filter (status = 'NEGATIVE_VERIFIED' and verified_by is null) as verified,
    count(*) filter (status = 'SUSPICION') as suspicions, count(*) filter (status = 'CLARIFICATION_REQUIRED') as clarifications,
    count(*) filter (status is null) as completeness, count(*) filter (status in ('CANDIDATE','CLARIFICATION_REQUIRED')) as awaiting"""


@query(f"with {CHECKS_SQL} select object_id, {SUMMARY} from visible group by 1")
def protocol_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(views.visible(shapes.checks(spark, sf_dir)), "object_id")


@query(f"with {CHECKS_SQL} select process_id, {SUMMARY} from visible group by 1")
def finding_counts_by_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(views.visible(shapes.checks(spark, sf_dir)), "process_id")


@query(f"with {CHECKS_SQL} select {SUMMARY} from visible")
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(views.visible(shapes.checks(spark, sf_dir)))


@query(
    f"""with {CHECKS_SQL} select case when status is null then 'completeness' when status = 'CONFIRMED_VIOLATION' then 'violations' when status = 'NEGATIVE_VERIFIED' then 'verified'
      when status = 'CANDIDATE' then 'open' when status = 'CLARIFICATION_REQUIRED' then 'clarifications' else 'other' end as bucket, count(*) as n from visible group by 1"""
)
def export_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = views.visible(shapes.checks(spark, sf_dir))
    return shown.groupBy(views.export_bucket(F.col("status")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CHECKS_SQL} select process_id, case when status is null then 'completeness' when status = 'SUSPICION' then 'suspicion' else 'finding' end as bucket, count(*) as n from visible group by all")
def view_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = views.visible(shapes.checks(spark, sf_dir))
    return shown.groupBy("process_id", views.bucket(F.col("status")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """select p_partkey, case p_partkey % 4 when 0 then 'object_id' when 1 then 'file_name' when 2 then 'doc_stage' else 'code_' || p_size end as header from part"""
)
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, "\ufeffObject ID").when(k % 4 == 1, " File\u00a0- name").when(k % 4 == 2, "DOC__Stage ").otherwise(F.concat(F.lit("Code - "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", registry.canonical(raw).alias("header"))


@query(
    """select o_custkey, o_orderkey, o_orderdate::varchar as o_orderdate, o_orderstatus from
      (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1"""
)
def latest_version_per_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    newest = views.latest(rows, "o_custkey", "o_orderdate", "o_orderkey")
    return newest.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"""with {CHECKS_SQL}, s as (select object_id, {SUMMARY} from visible group by 1), o as (select k as object_id from (select unnest(range(0, 110)) as k))
    select o.object_id, case when total is null then 'yellow' when confirmed > 4 then 'red' when awaiting > 300 then 'yellow'
      when o.object_id % 3 > 0 then 'green' else 'yellow' end as indicator from o left join s using (object_id)"""
)
def object_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.summary(views.visible(shapes.checks(spark, sf_dir)), "object_id")
    objects = spark.range(110).withColumnRenamed("id", "object_id").join(counts, "object_id", "left")
    status = F.when(F.col("object_id") % 3 == 0, "READY").otherwise("VERIFICATION_COMPLETED")
    # Thresholds shifted, since nearly every object of the test data has some confirmed and open checks.
    shown = views.indicator(F.col("total").isNotNull(), F.greatest(F.col("confirmed") - 4, F.lit(0)), F.greatest(F.col("awaiting") - 300, F.lit(0)), status)
    return objects.select("object_id", shown.alias("indicator"))


@query(
    f"""with {CHECKS_SQL} select check_id, object_id, status from visible where status = 'SUSPICION' and object_id % 2 = 1 order by amount desc, check_id limit 100 offset 40"""
)
def protocol_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = views.visible(shapes.checks(spark, sf_dir)).where("status = 'SUSPICION' and object_id % 2 = 1")
    return views.page(shown, [F.desc("amount"), F.col("check_id")], limit=500, offset=40).select("check_id", "object_id", "status")


@query(
    f"""with {CHECKS_SQL}, s as (select object_id, count(*) filter (status = 'CANDIDATE') as n from visible group by 1)
    select c_custkey, c_name, n, case when n >= 10 then 'many' when n >= 4 then 'some' else 'few' end as band from customer join s on object_id = c_custkey
    where contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build')"""
)
def dashboard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.visible(shapes.checks(spark, sf_dir)).groupBy("object_id").agg(F.count_if(F.col("status") == "CANDIDATE").alias("n"))
    joined = table(spark, sf_dir, "customer").join(n, F.col("object_id") == F.col("c_custkey"))
    named = joined.where(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("build")))
    return named.select("c_custkey", "c_name", "n", F.when(F.col("n") >= 10, "many").when(F.col("n") >= 4, "some").otherwise("few").alias("band"))


@query(f"with {CHECKS_SQL} select process_id, check_id, status, amount from checks where status is not null")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shapes.checks(spark, sf_dir).where("status is not null").select("process_id", "check_id", "status", "amount")
    return views.from_snapshot(views.snapshot(rows, "process_id"), "process_id", "check_id bigint, status string, amount double")


MERGE_SQL = f"""{found_sql(0.25)},
    old as (select sheet, number, status, expected, actual, delta, sheet % 3 = 0 as decided from found where status is not null and sheet % 7 > 0),
    new as (select sheet, number, case when pa is null or ra is null then status when abs(ra - pa) <= 5e-1::double * pa or abs(ra - pa) <= 1e-1 + 1e-9 then 'NEGATIVE_VERIFIED' else 'CANDIDATE' end as status,
      expected, actual, case when status = 'CANDIDATE' and pa is not null and ra is not null and not (abs(ra - pa) <= 5e-1::double * pa or abs(ra - pa) <= 1e-1 + 1e-9) then delta end as delta
      from found where status is not null and (sheet + number::int) % 11 > 0),
    plan as (select coalesce(o.sheet, n.sheet) as sheet, coalesce(o.number, n.number) as number,
      case when o.sheet is null then 'added' when n.sheet is null then case when decided then 'kept_without_source' else 'removed' end
        when (o.status, o.expected, o.actual, o.delta) is not distinct from (n.status, n.expected, n.actual, n.delta) then 'kept' else 'changed' end as action,
      coalesce(decided, false) as d, n.sheet is not null as in_new from old o full outer join new n on o.sheet = n.sheet and o.number = n.number),
    marked as (select sheet, number, action, d and action in ('kept', 'kept_without_source') as decision_survived, d and not action = 'kept' as noted from plan)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["sheet", "number", "status", "expected", "actual", "delta"]
    found = _found(spark, sf_dir, 0.25)
    old = found.where("status is not null and sheet % 7 > 0").select(*keep, (F.col("sheet") % 3 == 0).alias("decided"))
    new = rooms.stated(found, 0.5).where("status is not null and (sheet + cast(number as int)) % 11 > 0").select(*keep)
    return merging.plan(old, new, ["sheet", "number"], keep[2:])


@query(f"with {MERGE_SQL} select * from marked")
def merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(
    f"""with {MERGE_SQL} select count(*) filter (action = 'added') as added, count(*) filter (action = 'changed') as changed, count(*) filter (action = 'removed') as removed,
      count(*) filter (action = 'kept') as kept, count(*) filter (action = 'kept_without_source') as kept_without_source, count(*) filter (decision_survived) as survived,
      case when survived > 0 then 'VERIFYING' else 'READY' end as status from marked"""
)
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.counters(_plan(spark, sf_dir))


@query(f"with {CHECKS_SQL} select check_id, case status when 'CONFIRMED_VIOLATION' then 'POSITIVE' else 'NEGATIVE' end as label from visible where status in ('CONFIRMED_VIOLATION','NEGATIVE_VERIFIED')")
def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = views.visible(shapes.checks(spark, sf_dir))
    return shown.select("check_id", metrics.label_of(F.col("status")).alias("label")).where("label is not null")


LEDGER_SQL = """ledger as (select doc_id as id, case quality when 1 then 'POSITIVE' else 'NEGATIVE' end as label, case when toxic = 1 then 'CANDIDATE' end as engine_status, lang, source
    from documents join labels using (doc_id)),
    counts as (select lang, count(*) filter (label = 'POSITIVE' and engine_status is not null) as tp, count(*) filter (label = 'NEGATIVE' and engine_status is not null) as fp,
      count(*) filter (label = 'POSITIVE' and engine_status is null) as fn, count(*) filter (label = 'NEGATIVE' and engine_status is null) as tn from ledger group by 1)"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "POSITIVE").otherwise("NEGATIVE").alias("label"),
        F.when(F.col("toxic") == 1, "CANDIDATE").alias("engine_status"), "lang", "source",
    )


@query(f"with {LEDGER_SQL} select * from counts")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_ledger(spark, sf_dir), "lang")


def _wilson_sql(a: str, n: str) -> tuple[str, str]:
    p, z = f"({a} / {n}::double)", "1.96e0"
    d, c = f"(1 + {z} * {z} / {n})", f"({p} + {z} * {z} / (2 * {n}))"
    m = f"({z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n}))"
    return f"case when {n} > 0 then greatest(0e0, ({c} - {m}) / {d}) end", f"case when {n} > 0 then least(1e0, ({c} + {m}) / {d}) end"


_W = {k: _wilson_sql(a, n) for k, a, n in (("precision", "tp", "(tp + fp)"), ("recall", "tp", "(tp + fn)"), ("fpr", "fp", "(fp + tn)"))}


@query(
    f"""with {LEDGER_SQL}, r as (select *, case when tp + fp > 0 then tp / (tp + fp)::double end as "precision", case when tp + fn > 0 then tp / (tp + fn)::double end as recall,
      case when fp + tn > 0 then fp / (fp + tn)::double end as fpr from counts),
    s as (select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) end as f1 from r)
    select *, {', '.join(f'{lo} as {k}_lo, {hi} as {k}_hi' for k, (lo, hi) in _W.items())},
      case when coalesce("precision", recall, f1, fpr) is not null then coalesce("precision" >= 9e-1, true) and coalesce(recall >= 8e-1, true)
        and coalesce(f1 >= 85e-2, true) and coalesce(fpr <= 1e-1, true) end as passes from s"""
)
def wilson_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rated(metrics.confusion(_ledger(spark, sf_dir), "lang"))


@query(
    f"""with {LEDGER_SQL} select case grouping(lang, source) when 3 then 'overall' when 1 then 'modality' else 'param' end as level,
      case grouping(lang, source) when 1 then lang when 2 then source end as key,
      count(*) filter (label = 'POSITIVE' and engine_status is not null) as tp, count(*) filter (label = 'NEGATIVE' and engine_status is not null) as fp,
      count(*) filter (label = 'POSITIVE' and engine_status is null) as fn, count(*) filter (label = 'NEGATIVE' and engine_status is null) as tn
    from ledger group by grouping sets ((), (lang), (source))"""
)
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped(_ledger(spark, sf_dir), "lang", "source")


@query(f"with {LEDGER_SQL} select source as reason, count(*) as n from ledger where label = 'NEGATIVE' group by 1")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).where("label = 'NEGATIVE'").groupBy(F.col("source").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {LEDGER_SQL} select source as reason, count(*) as n from ledger where label = 'NEGATIVE' group by 1 order by n desc, reason limit 1")
def top_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_reason(_ledger(spark, sf_dir).where("label = 'NEGATIVE'").withColumnRenamed("source", "reason"))


@query(f"with {LEDGER_SQL} select lang, count(*) as n, sha256(string_agg(id::varchar, chr(10) order by id::varchar)) as manifest from ledger group by 1")
def release_manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.release(_ledger(spark, sf_dir), "lang")


@query(
    """select o_custkey, case when o_custkey % 4 = 0 then 'registry' || o_custkey else sha256(string_agg(o_orderkey::varchar, chr(10) order by o_orderkey::varchar)) end as fingerprint
    from orders group by 1"""
)
def input_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("registry"), F.col("o_custkey").cast("string")))
    ids = scalars.ids_digest(F.collect_list(F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(ids.alias("d")).select("o_custkey", F.coalesce(own, "d").alias("fingerprint"))
