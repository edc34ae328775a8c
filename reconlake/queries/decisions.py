"""Merging units, and people's decisions folded into states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import decisions, units
from reconlake.plans import shapes
from reconlake.plans.lineage import new_folder, written
from reconlake.plans.shapes import CHECKS_SQL
from reconlake.queries.registry import query
from reconlake.sources import versions
from reconlake.sources.tables import table

UNITS_SQL = f"""{CHECKS_SQL},
    runs(is_new) as (values (false), (true)),
    rows as (select is_new, check_id, process_id, coalesce(parent_id, check_id) as top, parent_id is null as is_top,
        'g' || case when is_new and process_id % 13 = 0 and check_id % 10 = 3 then 33 else check_id % 10 end as group_id,
        coalesce(case when check_id % 4 = 0 then 'CANDIDATE' end, status, '~') || '|' || printf('%.2f', amount + case when is_new and process_id % 5 = 0 and check_id % 10 = 6 then 1 else 0 end)
          || '|' || (process_id % 3) || ':' || (check_id % 10) || ':' || printf('%.4f', amount / 64 + case when is_new and process_id % 17 = 0 then 1e-3 else 0 end) as content,
        not is_new and (verified_by is not null or split_at is not null) as by_person
      from checks, runs where not (is_new and process_id % 7 = 0 and check_id % 10 = 2)),
    u as (select is_new, process_id, top, max(group_id) filter (is_top) as group_id, max(content) filter (is_top) || coalesce(string_agg(group_id || '=' || content, ';' order by group_id) filter (not is_top), '') as content,
        bool_or(by_person) as decided, string_agg(check_id::varchar, ',' order by not is_top, check_id) as members from rows group by all having bool_or(is_top)),
    plan as (select coalesce(o.process_id, n.process_id) as process_id, coalesce(o.group_id, n.group_id) as group_id,
        case when o.top is null then 'added' when n.top is null then case when o.decided then 'kept_without_source' else 'removed' end when o.content = n.content then 'kept' else 'changed' end as action,
        coalesce(o.decided, false) as d, o.members
      from (select * from u where not is_new) o full outer join (select * from u where is_new) n on o.process_id = n.process_id and o.group_id = n.group_id)"""


def _rows_of(checks: DataFrame, is_new: bool) -> DataFrame:
    """The checks of a run: the new one lacks some, has one under another group, and others that say something else."""
    k, p = F.col("check_id"), F.col("process_id")
    place = k % 10
    if is_new:
        checks = checks.where(~((p % 7 == 0) & (place == 2)))
    group = F.when(F.lit(is_new) & (p % 13 == 0) & (place == 3), 33).otherwise(place)
    engine = F.when(k % 4 == 0, "CANDIDATE")
    none = F.lit(None).cast("string")
    rows = checks.select(
        "check_id", "process_id", F.concat(F.lit("g"), group.cast("string")).alias("group_id"), "parent_id", (F.coalesce(engine, "status") if is_new else F.col("status")).alias("status"),
        (none if is_new else engine).alias("engine_status"), "verified_by", "split_at", none.alias("actual"), none.alias("delta"), F.lit("COMPLETE").alias("completeness"),
        scalars.fixed(F.col("amount") + F.when(F.lit(is_new) & (p % 5 == 0) & (place == 6), 1).otherwise(0)).alias("expected"),
        (F.col("amount") / 64 + F.when(F.lit(is_new) & (p % 17 == 0), 1e-3).otherwise(0.0)).alias("x0"),
    )
    at = lambda x: F.struct((p % 3).alias("file_id"), place.alias("page"), *[scalars.fixed(c, 4).alias(n) for n, c in (("x0", x), ("y0", F.lit(0.1)), ("x1", F.lit(0.2)), ("y1", F.lit(0.3)))])
    return rows.withColumn("fragments", F.array(at(F.col("x0")), at(F.col("x0") + 1e-7))).drop("x0")


def _run(checks: DataFrame, is_new: bool) -> DataFrame:
    return units.units(_rows_of(checks, is_new), decided=not is_new)


@query(
    f"""with {UNITS_SQL} select process_id, group_id, action, d and action in ('kept', 'kept_without_source') as decision_survived, d and action <> 'kept' as noted,
      case when action in ('removed', 'changed') then members else '' end as deleted from plan"""
)
def merge_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = shapes.checks(spark, sf_dir)
    return units.plan(_run(checks, False), _run(checks, True)).withColumn("deleted", F.array_join(F.transform("deleted", lambda x: x.cast("string")), ","))


MERGED_SQL = f"""{UNITS_SQL},
    tops as (select is_new, process_id, top, group_id as top_group from rows where is_top),
    said as (select r.*, t.top_group, p.action, c.status, c.verified_by, case when r.is_new then case when r.check_id % 2 > 0 then 'n' end when r.check_id % 4 > 0 then 'r' || r.check_id % 3 end as rationale
      from rows r join tops t on t.is_new = r.is_new and t.process_id = r.process_id and t.top = r.top join checks c on c.check_id = r.check_id
      join plan p on p.process_id = r.process_id and p.group_id = t.top_group),
    labels as (select process_id, top_group, string_agg(coalesce(status, 'None') || ', ' || case when verified_by is null then 'инспектором' when verified_by % 2 = 0 then 'user ' || verified_by else verified_by::varchar end, '; ' order by not is_top, check_id) as labels
      from said where by_person and action = 'changed' group by all),
    merged as (
      select process_id, check_id, group_id, case when action = 'kept_without_source' and by_person then coalesce(rationale || chr(10) || chr(10), '') || '{units.REMOVED_NOTE}' else rationale end as rationale
      from said where not is_new and action in ('kept', 'kept_without_source')
      union all
      select process_id, check_id + 1000000000, group_id, case when is_top and labels is not null then coalesce(rationale || chr(10) || chr(10), '') || '{units.CHANGED_NOTE[0]}' || labels || '{units.CHANGED_NOTE[1]}' else rationale end
      from said left join labels using (process_id, top_group) where is_new and action in ('added', 'changed'))"""


def _merge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both runs with reasons, the new one with ids of its own, and the plan of merging them."""
    checks = shapes.checks(spark, sf_dir)
    k = F.col("check_id")
    old = _rows_of(checks, False).withColumn("rationale", F.when(k % 4 > 0, F.concat(F.lit("r"), (k % 3).cast("string"))))
    new = _rows_of(checks, True).withColumn("rationale", F.when(k % 2 > 0, "n"))
    new = new.withColumns({c: F.col(c) + 1_000_000_000 for c in ("check_id", "parent_id")})
    return old, new, units.plan(units.units(old, True), units.units(new, False))


@query(f"with {MERGED_SQL} select process_id, check_id, group_id, rationale from merged")
def merge_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, planned = _merge(spark, sf_dir)
    users = spark.createDataFrame([(i, f"user {i}") for i in range(0, 7, 2)], "user_id long, name string")
    return units.after_merge(old, new, written(planned, "plan"), users).select("process_id", "check_id", "group_id", "rationale")


@query(
    f"""with {MERGED_SQL}, m as (select process_id, bool_or(d and action in ('kept', 'kept_without_source')) as survived from plan group by 1),
    before as (select process_id, 1 as version, 'SUPERSEDED' as status from checks group by 1 having process_id % 3 = 0 union all
      select process_id, 2 - (process_id % 3 > 0)::int, 'VERIFICATION_COMPLETED' from checks group by 1 having process_id % 11 > 0 or process_id % 3 = 0),
    counted as (select process_id, count(*) as n from merged group by 1),
    issued as (select b.process_id, version, case when version = max(version) over (partition by b.process_id) and survived is not null then 'SUPERSEDED' else status end as status from before b left join m using (process_id)
      union all select process_id, coalesce(max(version), 0) + 1, case when any_value(survived) then 'VERIFYING' else 'READY' end from m left join before using (process_id) group by 1)
    select process_id, version, status, case when status in ('VERIFYING', 'READY') then coalesce(n, 0) end as findings, 2 as read_from from issued left join counted using (process_id)"""
)
def merge_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge as a change of stored state: checks and protocols of the first version become the second's in one step, and are read back from it."""
    old, new, planned = _merge(spark, sf_dir)
    planned = written(planned, "plan")
    p = F.col("process_id")
    ids = old.select("process_id").distinct()
    first = ids.where(p % 3 == 0).select("process_id", F.lit(1).alias("version"), F.lit("SUPERSEDED").alias("status"))
    last = ids.where((p % 11 > 0) | (p % 3 == 0)).select("process_id", F.when(p % 3 > 0, 1).otherwise(2).alias("version"), F.lit("VERIFICATION_COMPLETED").alias("status"))
    folder = new_folder(spark, "state")
    versions.commit(spark, folder, {"checks": [old.where("parent_id is null"), old.where("parent_id is not null")], "protocols": [first, last]})
    stored, issued = versions.read(spark, folder, "checks"), versions.read(spark, folder, "protocols")
    users = spark.createDataFrame([(i, f"user {i}") for i in range(0, 7, 2)], "user_id long, name string")
    after = written(units.after_merge(stored, new.select(*stored.columns), planned, users), "merged")  # composites and atoms are parts of their own below
    number = versions.commit(spark, folder, {"checks": [after.where("parent_id is null"), after.where("parent_id is not null")], "protocols": [units.reissued(issued, planned)]}, based_on=1)
    counted = versions.read(spark, folder, "checks").groupBy("process_id").agg(F.count(F.lit(1)).alias("n"))
    told = versions.read(spark, folder, "protocols").join(counted, "process_id", "left")
    return told.select("process_id", "version", "status", F.when(F.col("status").isin("VERIFYING", "READY"), F.coalesce("n", F.lit(0))).alias("findings"), F.lit(number).alias("read_from"))


@query(
    """with b as (select l_partkey as sheet, l_quantity / 64 as x0, l_tax as y0, l_quantity / 64 + l_discount as x1, l_tax + 5e-2::double as y1 from lineitem)
    select sheet, printf('%.6f', min(x0)) as x0, printf('%.6f', min(y0)) as y0, printf('%.6f', max(x1)) as x1, printf('%.6f', max(y1)) as y1 from b group by 1"""
)
def composite_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = F.col("l_quantity") / 64
    box = F.struct(x0.alias("x0"), F.col("l_tax").alias("y0"), (x0 + F.col("l_discount")).alias("x1"), (F.col("l_tax") + 0.05).alias("y1"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sheet"), box.alias("box")).groupBy("sheet").agg(units.box_of("box").alias("b"))
    return found.select("sheet", *[scalars.fixed(F.col(f"b.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    """with p as (select l_partkey as pd_file, l_suppkey as rd_file from lineitem group by all), f as (select p_partkey as file_id from part where p_size = 7)
    select pd_file, rd_file from p where pd_file in (select file_id from f) or rd_file in (select file_id from f)"""
)
def touched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pd_file"), F.col("l_suppkey").alias("rd_file")).distinct()
    return units.touched_pairs(pairs, table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("file_id")))


DECISIONS_SQL = f"""{CHECKS_SQL},
    full_checks as (select c.*, coalesce(n, 0) as n_atoms from checks c left join (select parent_id as p, count(*) as n from checks where parent_id is not null group by 1) a on a.p = c.check_id),
    protocols as (select process_id, version, process_id * 10 + version as protocol_id, case when version = 2 and process_id % 6 = 0 then 'PROTOCOL_FINALIZED' when version = 1 then 'SUPERSEDED' else 'READY' end as status
      from (select distinct process_id from checks where process_id % 6 <> 1) cross join (values (1), (2)) v(version)),
    events as (select check_id * 10 + e as event_id, check_id, (check_id * 3 + e * 5) % 11 as moment, case when check_id % 10 = 1 and e = 2 then 'split' when (check_id + e) % 7 = 5 then 'promote' else 'verdict' end as kind,
        case (check_id + e) % 3 when 0 then 'CONFIRMED_VIOLATION' when 1 then 'NEGATIVE_VERIFIED' else 'CLARIFICATION_REQUIRED' end as decision,
        case when check_id % 5 > 0 then 'R' || check_id % 4 end as reason_code, case when check_id % 11 > 0 then 'why' else ' ' end as comment, (check_id + e) % 9 as user_id
      from (select check_id from checks union all select check_id + 8 from checks where check_id % 10 = 1) cross join (values (1), (2), (3)) v(e) where check_id % 3 = 0 or check_id % 10 in (1, 5, 6, 9)),
    placed as (select e.*, c.process_id, coalesce(c.parent_id, c.check_id) as unit, p.status as protocol_status,
        row_number() over (partition by coalesce(c.parent_id, c.check_id) order by moment, event_id) as i
      from events e left join checks c using (check_id) left join protocols p on p.process_id = c.process_id and p.version = 2),
    held as (select coalesce(parent_id, check_id) as unit, coalesce(bool_or(parent_id is null and split_at is not null), false) as split,
        list({{'id': check_id, 'top': parent_id is null, 'status': status, 'verified': verified_by}} order by check_id) as members from checks group by 1),
    fold as (
      select unit, 0 as i, null::bigint as event_id, null::varchar as refused, split, members from held where unit in (select unit from placed)
      union all
      select unit, i, event_id, refused, split or (kind = 'split' and refused is null),
        case when refused is null and kind <> 'split' then list_transform(members, lambda m: case when m.id = check_id
          then {{'id': m.id, 'top': m.top, 'status': case kind when 'verdict' then decision else 'CANDIDATE' end, 'verified': case kind when 'verdict' then user_id else m.verified end}} else m end) else members end
      from (
        select unit, i, event_id, check_id, kind, decision, user_id, split, members,
          case when kind = 'verdict' and decision = 'NEGATIVE_VERIFIED' and (coalesce(reason_code, '') = '' or trim(comment) = '') then 'REJECTION_REQUIRES_REASON'
            when kind = 'split' and not (me.top and len(members) > 1) then 'NOT_A_COMPOSITE' when kind = 'split' and split then 'ALREADY_SPLIT'
            when kind = 'promote' and not coalesce(me.status = 'SUSPICION', false) then 'NOT_A_SUSPICION'
            when protocol_status is null then 'PROTOCOL_NOT_FOUND' when protocol_status = 'PROTOCOL_FINALIZED' then 'PROTOCOL_FINALIZED'
            when kind = 'verdict' and me.top and len(members) > 1 and not split then 'COMPOSITE_NOT_SPLIT' when kind = 'verdict' and not me.top and not split then 'NOT_A_CANDIDATE'
            when kind = 'verdict' and not (coalesce(me.status in ('CANDIDATE', 'CLARIFICATION_REQUIRED'), false) or me.verified is not null) then 'NOT_A_CANDIDATE' end as refused
        from (select p.*, f.split, f.members, list_filter(f.members, lambda m: m.id = p.check_id)[1] as me from fold f join placed p on p.unit = f.unit and p.i = f.i + 1))),
    opened as (select unit, i, event_id, refused, len(list_filter(members, lambda m: coalesce(m.status = 'CANDIDATE', false) and m.top <> split)) as open, max(i) over (partition by unit) as last, members, split from fold),
    refusals as (select p.*, case when p.unit is not null then o.refused when kind = 'verdict' and decision = 'NEGATIVE_VERIFIED' and (coalesce(reason_code, '') = '' or trim(comment) = '') then 'REJECTION_REQUIRES_REASON'
        else 'FINDING_NOT_FOUND' end as refused, o.open - b.open as change
      from placed p left join opened o on o.event_id = p.event_id left join opened b on b.unit = p.unit and b.i = p.i - 1),
    allowed as (select * from refusals where refused is null),
    touched as (select check_id, count(*) as n, first(decision order by moment, event_id) as first_status from allowed where kind <> 'split' group by 1),
    state as (select c.check_id, c.process_id, c.parent_id, coalesce(m.status, c.status) as status, case when t.check_id is not null then coalesce(c.status, case when t.n > 1 then t.first_status end) end as engine_status, coalesce(m.verified, c.verified_by) as verified_by,
        c.split_at is not null or (c.parent_id is null and coalesce(o.split, false)) as is_split
      from checks c left join (select unit, split, unnest(members) as m from opened where i = last) o on o.m.id = c.check_id left join touched t on t.check_id = c.check_id),
    shown as (select s.* from state s left join state up on s.parent_id = up.check_id where (s.parent_id is null and not s.is_split) or up.is_split),
    pending as (select process_id, count(*) filter (status = 'CANDIDATE') as pending from shown group by 1)"""


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    checks = written(shapes.checks(spark, sf_dir), "checks")  # read many times below
    known = checks.withColumn("engine_status", F.lit(None).cast("string"))
    p = F.col("process_id")
    versions = checks.where(p % 6 != 1).select("process_id").distinct().withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    status = F.when((F.col("version") == 2) & (p % 6 == 0), "PROTOCOL_FINALIZED").when(F.col("version") == 1, "SUPERSEDED").otherwise("READY")
    protocols = versions.withColumns({"protocol_id": p * 10 + F.col("version"), "status": status})
    k, e = F.col("check_id"), F.col("e")
    ids = checks.select("check_id").union(checks.where(k % 10 == 1).select(k + 8))  # no order has a ninth line
    each = ids.where((k % 3 == 0) | (k % 10).isin(1, 5, 6, 9)).select("check_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("e"))
    kind = F.when((k % 10 == 1) & (e == 2), "split").when((k + e) % 7 == 5, "promote").otherwise("verdict")
    decision = F.when((k + e) % 3 == 0, "CONFIRMED_VIOLATION").when((k + e) % 3 == 1, "NEGATIVE_VERIFIED").otherwise("CLARIFICATION_REQUIRED")
    events = each.select(
        (k * 10 + e).alias("event_id"), "check_id", ((k * 3 + e * 5) % 11).alias("at"), kind.alias("kind"), decision.alias("decision"), F.when(k % 5 > 0, F.concat(F.lit("R"), (k % 4).cast("string"))).alias("reason_code"),
        F.when(k % 11 > 0, "why").otherwise(" ").alias("comment"), ((k + e) % 9).alias("user_id"),
    )
    return known, protocols, events


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    checks, protocols, events = _parts(spark, sf_dir)
    allowed = decisions.refusal(checks, events, protocols).where("refused is null")
    split = checks.withColumn("split_at", F.when(F.col("split_at").isNotNull(), F.lit(0).cast("bigint")))  # as the events' own times
    return decisions.applied(split, allowed), protocols


@query(f"with recursive {DECISIONS_SQL} select event_id, check_id, kind, refused from refusals")
def verdict_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks, protocols, events = _parts(spark, sf_dir)
    return decisions.refusal(checks, events, protocols).select("event_id", "check_id", "kind", "refused")


@query(f"with recursive {DECISIONS_SQL} select check_id, status, engine_status, verified_by, is_split from state")
def verdict_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)[0].select("check_id", "status", "engine_status", "verified_by", F.col("split_at").isNotNull().alias("is_split"))


@query(
    f"""with recursive {DECISIONS_SQL},
    first as (select process_id, count(*) filter (status = 'CANDIDATE') as pending from visible group by 1),
    run as (select r.process_id, r.event_id, r.moment, r.kind, r.refused, coalesce(f.pending, 0) + sum(r.change) over w as pending, row_number() over w as place
      from refusals r left join first f using (process_id) where r.unit is not null window w as (partition by r.process_id order by r.moment, r.event_id)),
    steps as (select *, case when refused is null and kind = 'verdict' then case when pending = 0 then 'done' else 'working' end when refused is null and kind = 'promote' then 'again' end as what from run),
    said as (select *, last_value(case when what <> 'again' then what end ignore nulls) over w as last_verdict, last_value(what ignore nulls) over w as last_what from steps
      window w as (partition by process_id order by place))
    select s.process_id, event_id, refused, pending::bigint as pending,
      case when last_verdict = 'done' and last_what = 'done' then 'VERIFICATION_COMPLETED' when last_verdict is not null then 'VERIFYING'
        when last_what = 'again' and p.status = 'VERIFICATION_COMPLETED' then 'VERIFYING' else p.status end as protocol_status,
      case when last_verdict = 'done' and last_what = 'done' then 'COMPLETED' when last_verdict is not null or last_what = 'again' or s.process_id % 4 > 0 then 'VERIFYING' else 'COMPLETED' end as process_status
    from said s left join protocols p on p.process_id = s.process_id and p.version = 2"""
)
def protocol_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks, protocols, events = _parts(spark, sf_dir)
    processes = checks.select("process_id").distinct().withColumn("status", F.when(F.col("process_id") % 4 > 0, "VERIFYING").otherwise("COMPLETED"))
    log = decisions.protocol_log(checks, decisions.folded(checks, events, protocols), protocols, processes)
    return log.select("process_id", "event_id", "refused", "pending", "protocol_status", "process_status")


@query(
    f"""with recursive {DECISIONS_SQL} select process_id, pending, case when pending = 0 then 'VERIFICATION_COMPLETED' else 'VERIFYING' end as protocol_status,
      case when pending = 0 then 'COMPLETED' else 'VERIFYING' end as process_status from pending"""
)
def protocol_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.protocol_states(written(_state(spark, sf_dir)[0], "decided"))  # read three times


@query(
    f"""with recursive {DECISIONS_SQL}, f as (select protocol_id, process_id, case when status = 'PROTOCOL_FINALIZED' then 'ALREADY_FINALIZED' when status = 'SUPERSEDED' then 'PROTOCOL_SUPERSEDED'
        when coalesce(pending, 0) > 0 then 'CANDIDATES_PENDING' end as refused from protocols left join pending using (process_id)),
    l as (select protocol_id, count(*) as labels, count(*) filter (s.status = 'CONFIRMED_VIOLATION') as positive from f join shown s using (process_id) where refused is null and s.status in ('CONFIRMED_VIOLATION', 'NEGATIVE_VERIFIED') group by 1)
    select protocol_id, refused, case when protocol_id % 4 > 0 then coalesce(labels, 0) else 0 end as labels, case when protocol_id % 4 > 0 then coalesce(positive, 0) else 0 end as positive,
      case when refused is null then case when protocol_id % 4 = 0 then 'CANCELLED' else 'PENDING' end end as transfer,
      case when refused is null then case when protocol_id % 4 = 0 then 'VERIFICATION_COMPLETED' else 'PROTOCOL_FINALIZED' end end as state
    from f left join l using (protocol_id)"""
)
def protocol_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, protocols = _state(spark, sf_dir)
    state = written(state, "decided")  # read three times below
    verdicts = written(decisions.finalizable(protocols, decisions.protocol_states(state)), "verdicts")
    allowed = verdicts.where("refused is null").select("protocol_id", "process_id")
    labels, transfers = decisions.finalized(state, allowed)
    final = allowed.select("protocol_id", F.lit("PROTOCOL_FINALIZED").alias("status"))
    # A quarter of them is opened again.
    after, left, sent = decisions.unfinalized(final, labels, transfers, allowed.where("protocol_id % 4 = 0"))
    counted = left.groupBy("protocol_id").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("label") == "POSITIVE").alias("positive"))
    whole = verdicts.select("protocol_id", "refused").join(counted, "protocol_id", "left").fillna(0, ["labels", "positive"])
    return whole.join(sent.withColumnRenamed("status", "transfer"), "protocol_id", "left").join(after.withColumnRenamed("status", "state"), "protocol_id", "left")


@query(f"with recursive {DECISIONS_SQL} select reason_code as reason, count(*) as n from allowed where kind = 'verdict' and decision = 'NEGATIVE_VERIFIED' group by 1")
def rejection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks, protocols, events = _parts(spark, sf_dir)
    allowed = decisions.refusal(checks, events, protocols).where("refused is null")
    return decisions.rejections(allowed).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with old as (select o_custkey as object_id, count(*) as last from orders where o_orderstatus = 'F' group by 1)
    select o_orderkey as seq, o_custkey as object_id, coalesce(last, 0) + row_number() over (partition by o_custkey order by o_orderkey) as version
    from orders left join old on object_id = o_custkey where o_orderstatus = 'P'"""
)
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("object_id")).agg(F.count(F.lit(1)).alias("version"))
    return decisions.next_versions(old, o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("object_id")))


@query(
    """with n as (select event_id, user_id, case when event_id % 6 = 0 then 5 end as read_at from events), r as (select event_id, user_id, min(event_id % 50) as at from events where event_id % 2 = 0 group by all)
    select n.event_id as notification_id, n.user_id, coalesce(read_at, r.at) as read_at from n left join r on n.event_id = r.event_id and n.user_id = r.user_id"""
)
def notifications_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events")
    notes = e.select(k.alias("notification_id"), "user_id", F.when(k % 6 == 0, F.lit(5).cast("bigint")).alias("read_at"))
    asked = e.where(k % 2 == 0).select(k.alias("notification_id"), F.col("user_id"), (k % 50).alias("at"))
    foreign = asked.withColumn("user_id", F.col("user_id") + 1)  # someone else's request changes nothing
    return decisions.mark_read(notes, asked.union(foreign))
