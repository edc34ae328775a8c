"""The rule matrix as a whole: labels, workbook rows, outcomes, checks, hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import matrix, rooms, rules, sources, specs
from reconlake.plans import shapes
from reconlake.plans.dealing import parts
from reconlake.plans.shapes import FILES_SQL
from reconlake.queries.reconciliation import ISLANDS_SQL, _found, found_sql
from reconlake.queries.registry import query
from reconlake.sources.tables import table


def _values(rows: list[tuple]) -> str:
    shown = lambda v: "null" if v is None else repr(v) if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v)
    return ", ".join(f"({i}, {', '.join(map(shown, r))})" for i, r in enumerate(rows))


def _chosen(rows: list[tuple], place: int) -> Column:
    """Of the literal rows, the field `place` of the one that a part's key falls to."""
    return F.get(F.array(*[F.lit(r[place]) for r in rows]), (F.col("p_partkey") % len(rows)).cast("int"))


@query(
    """with p as (select p_partkey, p_partkey % 4 as kind, lower(p_name) as name, lower(p_type) as type, lower(p_brand) as brand, p_type, p_size from part)
    select p_partkey, case kind
        when 0 then name || ' ' || type || case when len(type) <= 6 then '|' || type || '|' || name else '' end || '|' || brand || '|отм'
        when 1 then name || ' этажа|' || split_part(name, ' ', 1) || ' ' || type || ' этажа|' || brand || '|отм'
        when 2 then 'емкость ' || brand || '/' || name || ' №' || p_size || '|' || brand || '|отм'
        else type || ' ' || p_size || ' %|' || brand || '|отм' end as variants,
      case kind when 0 then 'АР,' || lpad(p_size::varchar, 2, '0') when 1 then 'ПЗ' when 2 then 'ВК,ОВ' else '' end as hints
    from p"""
)
def label_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with an abbreviation, with spaced alternatives, with a slash within words, with quotes; synonyms, one of them twice."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    name = (
        F.when(k == 0, F.concat(F.initcap("p_name"), F.lit(" ("), "p_type", F.lit(")"))).when(k == 1, F.concat("p_name", F.lit(" / "), "p_type", F.lit(" этажа")))
        .when(k == 2, F.concat(F.lit("Ёмкость "), "p_brand", F.lit("/"), "p_name", F.lit(" №"), size)).otherwise(F.concat(F.lit("«"), "p_type", F.lit("»,  "), size, F.lit(" %")))
    )
    source = F.when(k == 0, F.concat(F.lit("Том (АР/"), F.lpad(size, 2, "0"), F.lit(")"))).when(k == 1, "Раздел ПЗ").when(k == 2, "см. (ВК) и Раздел ОВ, (ВК)")
    synonyms = F.array(F.concat(F.lit("  "), "p_brand"), F.lit("Отм."), F.upper("p_brand"), F.lit(" - "))
    found = table(spark, sf_dir, "part").select("p_partkey", specs.label_variants(name, synonyms).alias("v"), specs.discipline_hints(source).alias("h"))
    return found.select("p_partkey", F.array_join("v", "|").alias("variants"), F.array_join("h", ",").alias("hints"))


#: Workbook rows: section, code, name, unit, source_pd, source_rd, logic, norms; then section, type, modality, operator, threshold, references.
BOOK = [
    ("Раздел 1. Общие  сведения", "M-001", "Площадь", "м²", "ТЭП", "Общие данные", "расхождение > 0,5 м", "СП 54.13330.2022; СП 1.2", "Общие сведения", "number", "scalar_text", "delta_gt", 0.5, "СП 54.13330.2022; СП 1.2", None, None),
    ("Прочее", " M-002 ", "Класс", "Класс бетона", "", "", "", "ГОСТ Р 26633-2015 и ГОСТ Р 2.105-95, 384-ФЗ", "Прочее", "enum", "scalar_text", None, None, None, "ГОСТ Р 2.105-95", "384-ФЗ"),
    ("Раздел 2. Планы", "M-003", "Координата", "Коорд.", "чертеж", "", "менее 3 м", "", "Планы", "coordinate", "drawing_measure", "value_lt", 3.0, None, None, None),
    ("Раздел 2. Планы", "M-004", "Ось", "—", "чертеж", "план", "более 5 %", "", "Планы", "string", "drawing_entity", "relative_delta_gt", 0.05, None, None, None),
    ("Раздел 3. Акты", "M-005", "Акт", "Статус", "", "", "> 1-2 м", None, "Акты", "enum", "doc_presence", None, None, None, None, None),
    ("Раздел 3. Акты", "M-006", "Ширина", "мм", "чертеж", "разрез", "> 900 мм", None, "Акты", "number", "drawing_measure", "value_gt", 900.0, None, None, None),
    ("Раздел 4. Пусто", "  ", "Без кода", "м", "", "", "", None, None, None, None, None, None, None, None, None),
]


@query(
    f"""select p_partkey, code, section, data_type, modality, compare_op, compare_threshold, sp, gost, fz
    from part join (values {_values([(r[1].strip(), *r[8:]) for r in BOOK])}) b(i, code, section, data_type, modality, compare_op, compare_threshold, sp, gost, fz)
      on p_partkey % {len(BOOK)} = i where code <> ''"""
)
def workbook_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("section", "code", "name", "unit", "source_pd", "source_rd", "logic", "norms")
    rows = table(spark, sf_dir, "part").select("p_partkey", *[_chosen(BOOK, i).alias(n) for i, n in enumerate(names)], F.lit(None).cast("string").alias("source_id"))
    # A workbook's codes are unique; here they are made so by the part, which is split off again.
    found = specs.from_workbook(rows.withColumn("code", F.when(F.trim("code") != "", F.concat(F.trim("code"), F.lit("#"), F.col("p_partkey").cast("string")))))
    return found.select(
        F.split_part("code", F.lit("#"), F.lit(2)).cast("bigint").alias("p_partkey"), F.split_part("code", F.lit("#"), F.lit(1)).alias("code"), "section", "data_type",
        "modality", "compare_op", "compare_threshold", F.col("sp_reference").alias("sp"), F.col("gost_reference").alias("gost"), F.col("fz_reference").alias("fz"),
    )


#: Rules of the demonstration matrix: code, modality, operator, threshold.
RULES = [
    ("L-1", "scalar_text", "delta_gt", 10.0), ("L-2", "scalar_text", "relative_delta_gt", 0.25), ("L-3", "scalar_text", "value_gt", 40.0),
    ("L-4", "scalar_text", "value_lt", 10.0), ("L-5", "scalar_text", None, None), ("L-6", "doc_presence", None, None), ("L-7", "scalar_text", "delta_gt", None),
    ("L-8", "drawing_measure", None, None), ("L-9", "scalar_text", None, None), ("M-003", "scalar_text", None, None),
]

OUTCOMES_SQL = f"""
    specs(i, code, modality, op, t) as (values {_values(RULES)}),
    c as (select l_partkey as object_id, 'L-' || l_linenumber as code, case when l_returnflag = 'N' then 'ID' when l_returnflag = 'A' then 'PD' else 'RD' end as stage, l_quantity as v,
      printf('%.1f', l_quantity) as k, case when l_tax < 1e-2 then 6e-1 else 1e0 end as conf from lineitem where l_linestatus = 'F'),
    s as (select object_id, code, stage, count(distinct k) as n, case when count(distinct k) = 1 then max(v) end as v, max(conf) as conf, string_agg(distinct k, '; ' order by k) as shown from c group by all),
    pair(a, b, step) as (values ('PD', 'RD', 1), ('RD', 'ID', 2)),
    q as (select coalesce(l.object_id, r.object_id) as object_id, coalesce(l.code, r.code) as code, coalesce(l.step, r.step) as step, coalesce(l.a, r.a) as a, coalesce(l.b, r.b) as b, l.n as ln, r.n as rn,
        l.v as lv, r.v as rv, l.conf as lc, r.conf as rc, l.shown as ls, r.shown as rs
      from (select * from s join pair on stage = a) l full outer join (select * from s join pair on stage = b) r on l.object_id = r.object_id and l.code = r.code and l.step = r.step),
    d as (select q.*, case when ln > 1 or rn > 1 then 'CLARIFICATION_REQUIRED' when lv is null and rv is null then 'NOT_COMPARABLE' when lv is null or rv is null then 'MISSING_EVIDENCE'
        when coalesce(lc, 0) < 7e-1 or coalesce(rc, 0) < 7e-1 then 'NOT_COMPARABLE'
        when case when op is null then not (abs(rv - lv) <= 1e-1 + 1e-9) else coalesce(case op when 'delta_gt' then abs(rv - lv) > t when 'relative_delta_gt' then abs(rv - lv) / lv > t
          when 'value_gt' then rv > t else rv < t end, false) end then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as status,
        case when ln > 1 then a || ': ' || ls when rn > 1 then b || ': ' || rs when lv is null and rv is null then 'nowhere' when lv is null then 'not in ' || a when rv is null then 'not in ' || b
          when coalesce(lc, 0) < 7e-1 or coalesce(rc, 0) < 7e-1 then 'low confidence' end as why
      from q join specs using (code) where modality = 'scalar_text' and code <> 'M-003'),
    chosen as (select one.object_id, one.code, case when weak then coalesce(two.status, one.status) else one.status end as status, case when weak and two.status is not null then two.why else one.why end as reason,
        case when weak and two.status is not null then two.lv else one.lv end as lv, case when weak and two.status is not null then two.rv else one.rv end as rv
      from (select *, status in ('MISSING_EVIDENCE', 'NOT_COMPARABLE') as weak from d where step = 1) one
      left join (select * from d where step = 2 and status not in ('MISSING_EVIDENCE', 'NOT_COMPARABLE')) two using (object_id, code)),
    outcomes as (select o.object_id, specs.code, coalesce(status, 'NOT_COMPARABLE') as status,
        case when status is null then case when modality like 'drawing%' then 'DRAWINGS_NOT_READ' else 'NO_EVALUATOR' end else reason end as reason,
        case when status in ('CANDIDATE', 'NEGATIVE_VERIFIED') then lv::bigint::varchar end as expected, case when status in ('CANDIDATE', 'NEGATIVE_VERIFIED') then rv::bigint::varchar end as actual,
        case when status = 'CANDIDATE' then printf('%+.2f', rv - lv) end as delta
      from (select distinct l_partkey as object_id from lineitem) o join specs on specs.code <> 'M-003' left join chosen on chosen.object_id = o.object_id and chosen.code = specs.code)"""


def _matrix(spark: SparkSession) -> DataFrame:
    rows = [{"code": c, "modality": m, "compare_op": o, "compare_threshold": t, "review_priority": "HIGH" if o else "LOW"} for c, m, o, t in RULES]
    return specs.from_rows(spark, rows, len(RULES))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    stage = F.when(F.col("l_returnflag") == "N", "ID").when(F.col("l_returnflag") == "A", "PD").otherwise("RD")
    candidates = lines.where("l_linestatus = 'F'").select(
        F.col("l_partkey").alias("object_id"), F.concat(F.lit("L-"), "l_linenumber").alias("code"), stage.alias("stage"), F.col("l_quantity").alias("value"),
        F.col("l_orderkey").alias("ord"), F.when(F.col("l_tax") < 0.01, 0.6).otherwise(1.0).alias("confidence"),
    )
    sides = matrix.resolve_side(candidates, "object_id", "code", "stage")
    m = _matrix(spark)
    compared = rules.with_fallback(rules.compare_sides(m, sides, "PD", "RD"), rules.compare_sides(m, sides, "RD", "ID"))
    return rules.evaluate_all(m, lines.select(F.col("l_partkey").alias("object_id")), {"scalar_text": compared})


@query(f"with {OUTCOMES_SQL} select * from outcomes")
def evaluate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@query(
    f"""with {OUTCOMES_SQL} select object_id || ':' || code || ':matrix' as group_id, code, case when status in ('CANDIDATE', 'NEGATIVE_VERIFIED') then 'COMPLETE' else status end as completeness,
      case when status in ('CANDIDATE', 'NEGATIVE_VERIFIED') then status end as finding_status, case when op is null then 'LOW' else 'HIGH' end as priority, reason as rationale,
      case when code <> 'L-2' then substr(code, 3)::bigint * 10 end as param_id
    from outcomes join specs using (code)"""
)
def matrix_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark)
    params = spark.createDataFrame([(c, int(c[2:]) * 10) for c, *_ in RULES if c.startswith("L-") and c != "L-2"], "code string, id long")
    rows = rules.with_param(rules.check_rows(_outcomes(spark, sf_dir), m), params)
    return rows.select("group_id", "code", "completeness", "finding_status", "priority", "rationale", "param_id")


@query(f"with {OUTCOMES_SQL} select status, count(*) as n from outcomes where status in ('CANDIDATE', 'NEGATIVE_VERIFIED') group by 1")
def findings_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings_metric(rules.check_rows(_outcomes(spark, sf_dir), _matrix(spark)))


@query(
    f"""with {found_sql(0.5)}, {ISLANDS_SQL},
    numbered as (select *, 'rooms ' || first_number || '..' || last_number as subject from islands where atoms >= 2),
    atoms as (select o.sheet, o.number, o.status, o.expected, o.actual, o.delta, n.subject as parent from o
      left join numbered n on n.sheet = o.sheet and o.status = 'CANDIDATE' and o.number::int between n.first_number::int and n.last_number::int where o.status is not null)
    select sheet || ':M-003:p' || sheet || ':' || subject as group_id, 'CANDIDATE' as finding_status, expected, actual, delta, null as parent_group_id from numbered
    union all select sheet || ':M-003:p' || sheet || ':room ' || number, status, expected, actual, delta, sheet || ':M-003:p' || sheet || ':' || parent from atoms"""
)
def room_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda df: df.withColumns({"object_id": F.col("sheet"), "pair": F.concat(F.lit("p"), F.col("sheet").cast("string"))})
    n = parts(table(spark, sf_dir, "lineitem"))
    found = _found(spark, sf_dir, 0.5)
    rows = rules.room_check_rows(named(found), named(rooms.islands(found)), parts=n)
    return rows.select("group_id", "finding_status", "expected", "actual", "delta", "parent_group_id")


@query(
    f"""with {found_sql(0.5)}, {ISLANDS_SQL},
    boxes as (select sheet, num, side, sheet * 10 + case side when 'F' then 1 else 2 end as file, sheet % 7 as page, num / 16.0::double as x0, area / 4096 as y0, num / 16.0::double + 5e-2 as x1, area / 4096 + 1e-2 as y1 from rooms),
    places as (
      select o.sheet, o.number, o.status, o.expected, o.actual, s.side, case s.side when 'F' then o.expected else o.actual end as value, s.place, min(b.file) as file, min(b.page) as page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1,
        case when case s.side when 'F' then pa else ra end is null then 2 else 1 end as needed, count(b.num) as n
      from o cross join (values ('F', 'expected'), ('O', 'actual')) s(side, place)
      left join boxes b on b.sheet = o.sheet and b.side = s.side and (b.num = o.number::int or (case s.side when 'F' then pa else ra end is null and b.num in (o.number::int - 1, o.number::int + 1)))
      where o.status is not null group by all),
    numbered as (select *, 'rooms ' || first_number || '..' || last_number as subject from islands where atoms >= 2),
    tops as (select n.sheet, n.subject, p.place, min(file) as file, min(page) as page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, case p.place when 'expected' then n.expected else n.actual end as value
      from numbered n join places p on p.sheet = n.sheet and p.status = 'CANDIDATE' and p.number::int between n.first_number::int and n.last_number::int group by all),
    every as (select sheet, 'room ' || number as subject, place, file, page, x0, y0, x1, y1, value from places where n = needed union all select sheet, subject, place, file, page, x0, y0, x1, y1, value from tops)
    select sheet || ':M-003:p' || sheet || ':' || subject as group_id, string_agg(place || ' ' || coalesce(value, '-') || ' ' || file || '/' || page || ' ' || printf('%.4f %.4f %.4f %.4f', x0, y0, x1, y1), '; ' order by place desc) as fragments from every group by 1"""
)
def room_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of rooms and of their composites, each with what it points at on either side."""
    number, f = F.col("number").cast("double"), F.col("side") == "F"
    x0, y0 = number / 16, F.col("area") / 4096
    box = F.struct((F.col("sheet") * 10 + F.when(f, 1).otherwise(2)).alias("file_id"), (F.col("sheet") % 7).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 0.05).alias("x1"), (y0 + 0.01).alias("y1"))
    seen = shapes.rooms(spark, sf_dir).withColumn("evidence", box)
    n = parts(table(spark, sf_dir, "lineitem"))
    found = rooms.reconcile(shapes.side(seen, shapes.DESIGN), shapes.side(seen, shapes.WORKING), 0.5, n)
    named = lambda df: df.withColumns({"object_id": F.col("sheet"), "pair": F.concat(F.lit("p"), F.col("sheet").cast("string"))})
    rows = rules.room_check_rows(named(found), named(rooms.islands(found)), parts=n)
    said = lambda x: F.concat_ws(" ", x["role"], F.coalesce(x["value"], F.lit("-")), F.concat(x["file_id"].cast("string"), F.lit("/"), x["page"].cast("string")), *[scalars.fixed(x[c], 4) for c in ("x0", "y0", "x1", "y1")])
    return rows.select("group_id", F.array_join(F.transform("fragments", said), "; ").alias("fragments"))


@query(
    f"""with {FILES_SQL},
    alive as (select * from files where status not in ('CANCELLED','SUPERSEDED') and stage <> 'ID'),
    has as (select object_id, count(distinct stage) as n from alive group by 1),
    known as (select distinct object_id from files)
    select object_id || ':M-003:no-source' as group_id, 'MISSING_EVIDENCE' as completeness from known left join has using (object_id) where coalesce(n, 0) < 2
    union all select object_id || ':M-003:no-pair', 'NOT_COMPARABLE' from known join has using (object_id) where n = 2 and object_id % 3 = 0"""
)
def explication_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = shapes.files(spark, sf_dir)
    alive = files.where(~F.col("status").isin(*sources.DROPPED))
    none = files.limit(0).select(*rules.completeness_row(F.col("object_id"), "", "", "", "", ""))
    rows = rules.explication_rows(files.select("object_id"), alive, files.where("object_id % 3 > 0"), none)
    return rows.select("group_id", "completeness")


@query(
    """with r as (select l_partkey as sheet, l_linenumber as n from lineitem group by all), m as (select *, row_number() over (partition by sheet order by n) as k from r)
    select sheet, n::varchar as number, 'p' || k as key, ((k - 1) // 3)::int as batch from m"""
)
def hypothesis_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sheet"), F.col("l_linenumber").cast("string").alias("number")).distinct()
    return rules.hypothesis_batches(pairs, 3, "sheet")


#: Parts of a model's answer, and whether each is taken.
ANSWERS = [
    ('{"key":"p1","same_function":true,"confidence":0.75,"reason":"same use"}', True),
    ('{"key":"p1","same_function":false,"confidence":0.5,"reason":"again"}', False),
    ('{"key":2,"same_function":true,"confidence":0.5,"reason":"a number"}', False),
    ('{"key":"p3","same_function":"yes","confidence":0.5,"reason":"a text"}', False),
    ('{"key":"p4","same_function":true,"confidence":true,"reason":"a boolean"}', False),
    ('{"key":"p5","same_function":true,"confidence":1.5,"reason":"too sure"}', False),
    ('{"key":"p6","same_function":false,"confidence":1,"reason":"other"}', True),
    ('{"key":"p7","same_function":true,"confidence":0.5,"reason":" "}', False),
    ('{"key":"p99","same_function":true,"confidence":0.5,"reason":"not asked"}', False),
    ('"noise"', False),
]


@query(
    """select event_id, 'p1' as key, true as same_function, 75e-2 as confidence, 'same use' as reason from events where event_id % 4 < 3 union all
    select event_id, 'p6', false, 1e0, 'other' from events where event_id % 4 < 3"""
)
def verdict_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, body = F.col("event_id"), "[" + ",".join(a for a, _ in ANSWERS) + "]"
    wrapped = F.when(k % 4 == 0, body).when(k % 4 == 1, f"<think>[1]</think>Here it is:\n```json\n{body}\n```").when(k % 4 == 2, f"Sure: {body} Anything else?").otherwise("no JSON [")
    answers = table(spark, sf_dir, "events").select(k, wrapped.alias("answer"))
    requested = answers.select(k, F.explode(F.array(*[F.lit(f"p{i}") for i in range(1, 8)])).alias("key"))
    return rules.parse_verdicts(answers, requested, "event_id")


@query(
    """select p_partkey, case when p_partkey % 3 = 0 then p_size::varchar else rtrim(rtrim(printf('%.2f', p_retailprice), '0'), '.') end as stored,
      case when p_partkey % 7 = 0 then 'II' else replace(case when p_partkey % 3 = 0 then p_size::varchar else rtrim(rtrim(printf('%.2f', p_retailprice), '0'), '.') end, '.', ',') || case p_partkey % 4 when 0 then ' м²' when 1 then '' when 2 then '' else '' end end as shown
    from part"""
)
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, F.col("p_size").cast("double")).otherwise(F.col("p_retailprice"))
    unit = F.when(k % 4 == 0, "м²").when(k % 4 == 1, "—").when(k % 4 == 2, "Статус")
    shown = rules.display_value(F.when(k % 7 > 0, value), F.lit("II"), unit)
    return table(spark, sf_dir, "part").select("p_partkey", rules.stored_value(value, F.lit(None)).alias("stored"), shown.alias("shown"))
