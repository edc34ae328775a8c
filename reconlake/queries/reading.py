"""What protocols show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.functions import scalars, texts
from reconlake.operators import protocols, views
from reconlake.plans import shapes
from reconlake.plans.shapes import CHECKS_SQL
from reconlake.queries.operating import NOW, _now, _s
from reconlake.queries.registry import query
from reconlake.sources.tables import table

PARAMS_SQL = """params as (select k as param, 'P' || k as code, case when k % 4 > 0 then 'Parameter ' || k end as parameter_name, case when k % 3 > 0 then 'м²' end as unit,
    case when k % 2 = 0 then 'СП ' || k when k % 5 = 0 then '' end as sp, case when k % 3 = 0 then 'ГОСТ ' || k end as gost from (select unnest(range(0, 18)) as k))"""


def _params(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(18).select(
        k.alias("param"), F.concat(F.lit("P"), k.cast("string")).alias("code"), F.when(k % 4 > 0, F.concat(F.lit("Parameter "), k.cast("string"))).alias("parameter_name"), F.when(k % 3 > 0, "м²").alias("unit"),
        F.when(k % 2 == 0, F.concat(F.lit("СП "), k.cast("string"))).when(k % 5 == 0, "").alias("sp_reference"), F.when(k % 3 == 0, F.concat(F.lit("ГОСТ "), k.cast("string"))).alias("gost_reference"),
    )


@query(
    f"""with {CHECKS_SQL}, {PARAMS_SQL},
    c as (select *, 'P' || param as code, case check_id % 5 when 0 then 'room ' || check_id % 10 when 1 then 'rooms 2..' || check_id % 10 when 2 then 'floor total' when 3 then 'function hall' else 'odd' end as subject from checks),
    a as (select parent_id as check_id, string_agg(check_id::varchar, ',' order by check_id) as atoms from checks where parent_id is not null group by 1)
    select check_id, coalesce(parameter_name, c.code) || ' — ' || case check_id % 5 when 0 then 'помещение ' || check_id % 10 when 1 then 'помещения 2–' || check_id % 10 when 2 then 'итог по этажу'
        when 3 then 'назначение помещения hall' else 'odd' end as title, unit,
      nullif(concat_ws('; ', nullif(sp, ''), gost), '') as norm_reference, c_name as decided_by, atoms
    from c left join params on params.code = c.code left join customer on c_custkey = verified_by left join a using (check_id)"""
)
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("check_id")
    tail = (k % 10).cast("string")
    subject = F.when(k % 5 == 0, F.concat(F.lit("room "), tail)).when(k % 5 == 1, F.concat(F.lit("rooms 2.."), tail)).when(k % 5 == 2, "floor total").when(k % 5 == 3, "function hall").otherwise("odd")
    checks = shapes.checks(spark, sf_dir).withColumns({"code": F.concat(F.lit("P"), F.col("param").cast("string")), "subject": subject})
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    found = protocols.finding_rows(checks, _params(spark), users)
    return found.withColumn("atoms", F.array_join(F.transform("atoms", lambda x: x.cast("string")), ","))


FRAGMENTS_SQL = """fragments as (select l_orderkey * 10 + l_linenumber as check_id, l_suppkey as file_id, l_linenumber::bigint as page, case l_linestatus when 'F' then 'expected' else 'actual' end as role,
    ['PD', 'RD', 'ID'][(l_partkey % 3 + 1)::int] as stage, l_partkey as ord from lineitem where l_returnflag <> 'A')"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("check_id"), F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").cast("bigint").alias("page"),
        F.when(F.col("l_linestatus") == "F", "expected").otherwise("actual").alias("role"),
        F.get(F.array(F.lit("PD"), F.lit("RD"), F.lit("ID")), (F.col("l_partkey") % 3).cast("int")).alias("stage"), F.col("l_partkey").alias("ord"),
    )


@query(
    f"""with {CHECKS_SQL}, {FRAGMENTS_SQL} select check_id, count(*) filter (role = 'expected') as expected, count(*) filter (role = 'actual') as actual
    from checks left join fragments using (check_id) where status is not null group by 1 having expected = 0 or actual = 0"""
)
def lacking_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocols.lacking_evidence(shapes.checks(spark, sf_dir), _fragments(spark, sf_dir))


@query(
    f"""with {FRAGMENTS_SQL}, f as (select check_id, stage, min(ord) as first from fragments group by all),
    q as (select check_id, count(*) filter (file_id % 4 = 0 and page < 6) as scans, count(*) filter (page >= 6) as unknown from fragments group by 1)
    select check_id, string_agg(stage, ',' order by first, stage) as stages, any_value(scans) as scans, any_value(unknown) as unknown from f join q using (check_id) group by 1"""
)
def evidence_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = _fragments(spark, sf_dir)
    pages = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("file_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("page"), (F.col("s_suppkey") % 4 == 0).alias("needs_ocr"), F.lit("OK").alias("quality")
    )
    judged = protocols.with_page_quality(fragments, pages).groupBy("check_id").agg(F.count_if("needs_ocr").alias("scans"), F.count_if(F.col("quality").isNull()).alias("unknown"))
    return protocols.stages_of(fragments, "check_id").withColumn("stages", F.array_join("stages", ",")).join(judged, "check_id")


@query(
    f"""with {CHECKS_SQL}, p as (select c_custkey as object_id, c_custkey * 10 + v as process_id, v as version from customer cross join (values (1), (2), (3)) x(v) where v <= c_custkey % 3 + 1),
    last as (select object_id, process_id from (select *, row_number() over (partition by object_id order by version desc) as k from p) where k = 1)
    select check_id, last.object_id from checks c join last using (process_id) where status = 'SUSPICION' order by amount desc, check_id desc limit 200"""
)
def suspicion_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("version"))
    held = versions.withColumn("process_id", F.col("object_id") * 10 + F.col("version"))
    checks = shapes.checks(spark, sf_dir).drop("object_id").withColumnRenamed("amount", "created_at")
    return protocols.suspicions(held, checks).select("check_id", "object_id")


@query(
    """with mine as (select event_id, ts from events where user_id = 7 and event_id % 3 > 0)
    select event_id as notification_id, (select count(*) from mine) as unread from mine order by ts desc, event_id desc limit 50"""
)
def unread_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("notification_id"), "user_id", F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("read_at"))
    return protocols.unread(e, 7).select("notification_id", "unread")


@query("select p_partkey as code, p_brand as section from part where p_brand = 'Brand#12' and p_size % 3 = 1 order by code")
def params_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("section"), (F.col("p_size") % 3).cast("string").alias("priority"), F.lit(True).alias("active"))
    return protocols.params(rows, section="Brand#12", priority="1", active=True).select("code", "section")


@query(
    f"""with {CHECKS_SQL} select process_id, case when status is null then 'completeness' when status = 'SUSPICION' then 'suspicions' else lower(status) end as tab, count(*) as n,
      count(*) filter (verified_by is not null and status = 'CONFIRMED_VIOLATION') as confirmed from visible where param % 2 = 1 group by all"""
)
def protocol_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = views.visible(shapes.checks(spark, sf_dir)).withColumn("priority", F.when(F.col("param") % 2 == 1, "HIGH").otherwise("LOW"))
    counts = protocols.verification(protocols.by_status(shown, "CONFIRMED_VIOLATION").where("priority = 'HIGH'"), "process_id").withColumn("tab", F.lit("confirmed_violation")).drop("rejected")
    return protocols.tabs(shown, "process_id", priority="HIGH").join(counts, ["process_id", "tab"], "left").fillna(0, ["confirmed"])


@query(
    """select c_custkey as object_id, count(o_orderkey) as files, coalesce(sum(o_orderkey % 50), 0)::bigint as pages, coalesce(sum(floor(o_totalprice)), 0)::bigint as bytes, count(*) filter (o_orderkey % 3 = 0) as pd,
      count(*) filter (o_orderkey % 3 = 1) as rd, count(*) filter (o_orderkey % 3 = 2) as id from customer left join orders on o_custkey = c_custkey group by 1"""
)
def object_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    stage = F.get(F.array(F.lit("PD"), F.lit("RD"), F.lit("ID")), (key % 3).cast("int"))
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object_id"), stage.alias("stage"), (key % 50).alias("pages"), F.floor("o_totalprice").alias("bytes"))
    return protocols.sizes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id")), files, "object_id")


@query(
    """select o_custkey, count(*) as files_total, count(*) filter (o_orderkey % 4 > 0) as files_pdf, count(*) filter (o_orderkey % 4 > 0 and o_orderstatus = 'F') as files_parsed, sum(o_orderkey % 50)::bigint as pages_total,
      sum(o_orderkey % 5)::bigint as ocr_done, sum(o_orderkey % 2)::bigint as ocr_failed, sum(o_orderkey % 3)::bigint as ocr_pending, sum(o_orderkey % 5 + o_orderkey % 2 + o_orderkey % 3)::bigint as ocr_needed from orders group by 1"""
)
def progress_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(
        "o_custkey", F.when(k % 4 > 0, "application/pdf").otherwise("text/csv").alias("mime"), (F.col("o_orderstatus") == "F").alias("parsed"), (k % 50).alias("pages"),
        (k % 5).alias("ocr_done"), (k % 2).alias("ocr_failed"), (k % 3).alias("ocr_pending"),
    )
    return protocols.progress(files, "o_custkey")


@query(
    """with f as (select o_orderkey, o_orderdate, c_name from orders join customer on c_custkey = o_custkey where contains(lower(c_name), '#0000000'))
    select o_orderkey as protocol_id, c_name as name, (select count(*) from f) as total from f order by o_orderdate desc, o_orderkey desc limit 100 offset 10"""
)
def protocol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("protocol_id"), F.col("o_custkey").alias("object_id"), F.col("o_orderdate").alias("created_at"))
    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"), F.col("c_name").alias("name"))
    return protocols.search(held, objects, "#0000000", limit=400, offset=10).select("protocol_id", "name", "total")


@query(f"with {CHECKS_SQL} select check_id, verified_by, c_name as user_name from checks left join customer on c_custkey = verified_by")
def decision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return protocols.with_names(shapes.checks(spark, sf_dir).select("check_id", "verified_by"), users)


@query(
    f"""with d as (select event_id, value, floor(epoch(timestamp '{NOW}')) - floor(epoch(ts)) as s, ts, event_type from events)
    select event_id, case when floor(s / 60) < 1 then 'только что' when floor(s / 60) < 60 then floor(s / 60)::bigint || ' мин назад' when floor(s / 3600) < 24 then floor(s / 3600)::bigint || ' ч назад'
        when floor(s / 86400) < 7 then floor(s / 86400)::bigint || ' дн назад' else strftime(ts, '%d.%m.%Y %H:%M') end as age,
      case when event_id % 9 = 0 then '—' else printf('%.1f', event_id % 997 / 1024e0 * 100) || '%' end as share,
      case when event_id % 9 = 0 then '—' else case when event_id % 997 > 500 then '+' else '' end || printf('%.1f', (event_id % 997 - 500) / 1024e0 * 100) || ' п.п.' end as change,
      'documents/' || md5(event_id::varchar)[1:2] || '/' || md5(event_id::varchar)[3:4] || '/' || md5(event_id::varchar) as key,
      case event_id % 4 when 0 then 'clean' when 1 then 'infected' else 'unavailable' end as outcome, case event_id % 4 when 1 then 'Eicar-' || event_id when 2 then 'busy' when 3 then 'empty response' end as detail,
      case event_type when 'click' then 'Щелчок' else 'Прочее' end as label from d"""
)
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    none = F.lit(None).cast("double")
    share = F.when(k % 9 == 0, none).otherwise(k % 997 / F.lit(1024.0))
    change = F.when(k % 9 == 0, none).otherwise((k % 997 - 500) / F.lit(1024.0))
    reply = F.when(k % 4 == 0, "stream: OK\x00").when(k % 4 == 1, F.concat(F.lit("stream: Eicar-"), k.cast("string"), F.lit(" FOUND"))).when(k % 4 == 2, "busy").otherwise("")
    return table(spark, sf_dir, "events").select(
        "event_id", texts.relative_time(F.col("ts").cast("timestamp"), _now()).alias("age"), texts.percent(share).alias("share"), texts.trend(change).alias("change"),
        texts.storage_key(F.md5(k.cast("string").cast("binary"))).alias("key"), texts.scan_reply(reply).alias("r"), texts.labelled(F.col("event_type"), {"click": "Щелчок"}, F.lit("Прочее")).alias("label"),
    ).select("*", "r.outcome", "r.detail").drop("r")


@query(
    """select p_partkey, printf('%.4f', p_size / 2e0) as "left", printf('%.4f', p_size * 0 + 50e0) as width, printf('%.4f', case when p_size % 5 = 0 then 0 else p_size * least(100e0 / p_size, 300e0 / (p_size * 2)) end) as fit_width,
      printf('%.4f', least(200e0, 4000 * 72 / (p_size * 40e0))) as dpi, case when p_size % 4 = 0 then null when p_size % 4 = 1 then 'e' || p_partkey when p_size % 4 = 2 then 'first' else 'first' end as expected,
      p_size % 3 = 2 as parsing_done, 'Ж é' as normal from part"""
)
def evidence_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    box = F.struct((size / 200).alias("x0"), F.lit(0.1).alias("y0"), (size / 200 + 0.5).alias("x1"), F.lit(0.2).alias("y1"))
    fit = texts.fitted(F.when(size % 5 == 0, 0.0).otherwise(100.0), F.lit(300.0), size, size * 2)
    item = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    first, own = item("actual", F.lit("first")), item("expected", F.concat(F.lit("e"), F.col("p_partkey").cast("string")))
    evidence = F.when(size % 4 == 0, F.array().cast("array<struct<role:string,text:string>>")).when(size % 4 == 1, F.array(first, own)).otherwise(F.array(first))
    status = F.get(F.array(F.lit("PENDING"), F.lit("PARSING"), F.lit("READY")), (F.col("p_size") % 3).cast("int"))
    rect = texts.percent_rect(box)
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.fixed(rect["left"], 4).alias("left"), scalars.fixed(rect["width"], 4).alias("width"), scalars.fixed(fit["width"], 4).alias("fit_width"),
        scalars.fixed(texts.raster_dpi(size * 40), 4).alias("dpi"), texts.picked(evidence, "expected")["text"].alias("expected"), texts.stage_flags(status)["parsing_done"].alias("parsing_done"),
        texts.normalized_for_cer(F.lit(" Ж \n é ")).alias("normal"),
    )


@query(f"select event_id, epoch(date_trunc('month', ts))::bigint as month_s from events where ts >= date_trunc('month', timestamp '{NOW}')")
def this_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = protocols.in_range(table(spark, sf_dir, "events"), "ts", first=F.date_trunc("month", _now()))
    return rows.select("event_id", F.date_trunc("month", F.col("ts").cast("timestamp")).alias("m")).select("event_id", _s("m").alias("month_s"))
