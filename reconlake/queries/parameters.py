"""Labels, values, comparisons, presence and derived rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import labels as label_operators
from reconlake.operators import matrix
from reconlake.plans import shapes
from reconlake.plans.dealing import dealt
from reconlake.queries.registry import query
from reconlake.sources.tables import table

PARTS = 10_000  # of one task

LABELS = ["total floor area", "building height", "parking spaces", "fire class"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages: in turn label with value, label beside its value, label above its value, prose."""
    k = F.col("p_partkey")
    label = F.initcap(F.get(F.array(*map(F.lit, LABELS)), (k % 4).cast("int")))
    page = (k / 10).cast("bigint")
    y = (k % 10).cast("double") / 10 + 0.02
    kind = (k / 4).cast("bigint") % 4
    number = F.regexp_replace(scalars.fixed(F.col("p_retailprice")), "[.]", ",")
    first = F.when(kind == 0, F.concat(label, F.lit(", m2: "), number)).when(kind == 3, F.concat(F.lit("see "), F.lower("p_type"))).otherwise(label)
    second = F.when(kind.isin(1, 2), number)
    rows = F.array(
        F.struct(first.alias("text"), F.lit(0.1).alias("x0"), y.alias("y0"), F.lit(0.3).alias("x1"), (y + 0.01).alias("y1"), (k * 2).alias("line")),
        F.struct(
            second.alias("text"), F.when(kind == 1, 0.5).otherwise(0.1).alias("x0"), F.when(kind == 1, y).otherwise(y + 0.02).alias("y0"),
            F.when(kind == 1, 0.6).otherwise(0.2).alias("x1"), F.when(kind == 1, y + 0.01).otherwise(y + 0.03).alias("y1"), (k * 2 + 1).alias("line"),
        ),
    )
    return dealt(table(spark, sf_dir, "part"), "p_partkey", most=PARTS).select(page.alias("page"), F.inline(rows)).where("text is not null")


@query(
    f"""with p as (select p_partkey as k, p_partkey // 10 as page, {LABELS}[(p_partkey % 4 + 1)::int] as label, (p_partkey // 4) % 4 as kind, p_retailprice as v from part)
    select page, label, k * 2 as line, case kind when 0 then 'same_line' when 1 then 'same_row' else 'next_line' end as method, printf('%.2f', v) as value from p where kind < 3"""
)
def label_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([(x, "m2") for x in LABELS], "label string, unit string")
    found = matrix.locate(_lines(spark, sf_dir), labels)
    return found.select("page", "label", "line", "method", scalars.fixed(F.col("value")).alias("value"))


@query(
    """with p as (select p_partkey, p_partkey % 6 as kind, p_name || '|' || p_brand as code, lower(p_name) as name, lower(p_brand) as brand, p_size as n, p_type from part)
    select p_partkey as page, p_partkey * 4 as line, code, case when kind = 1 then brand || '/' || name else name || ' ' || brand end as label,
      case kind when 4 then 'same_row' when 5 then 'next_line' else 'same_line' end as method, case when kind in (4, 5) then p_partkey * 4 + 1 else p_partkey * 4 end as value_line,
      case when code[1] < 'i' then printf('%d,5', n) || case when kind in (0, 4) then ' м2' else '' end else case kind when 0 then n || ',5 м2 ' || lower(p_type) when 1 then '(' || n || ',5)' when 2 then '= ' || n || ',5'
        when 3 then n || ',5' when 4 then n || ',5 м2' else n || ',5' end end as raw, case when code[1] < 'i' then printf('%.2f', n + 5e-1) end as value,
      case when kind in (4, 5) then printf('%.2f', case kind when 4 then 1e-1 else 2e-1 end) else '0.10' end as y0
    from p"""
)
def label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of a part with every brand is a label with two variants; a line holds one, the second, both, or one run together; beside or above its value. Names from 'i' on are rules for texts."""
    k, n = F.col("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit(",5"))
    part = table(spark, sf_dir, "part")
    one, two = F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws("/", "p_brand", "p_name")
    kinds = part.select("p_name", "p_brand").distinct().withColumn("data_type", F.when(F.col("p_name") < "i", "number").otherwise("string"))
    each = kinds.select(F.concat_ws("|", "p_name", "p_brand").alias("code"), F.posexplode(F.array(one, two)).alias("ord", "label"), F.lit("м²").alias("unit"), "data_type")
    kind = k % 6
    text = (
        F.when(kind == 0, F.concat(F.initcap("p_name"), F.lit(", "), "p_brand", F.lit(": "), n, F.lit(" м2 "), F.lower("p_type"))).when(kind == 1, F.concat(F.lit("see "), F.upper(two), F.lit(" ("), n, F.lit(")")))
        .when(kind == 2, F.concat(two, F.lit("; "), F.upper(one), F.lit(" = "), n)).when(kind == 3, F.concat(F.lit("xx"), one, F.lit("; "), "p_name", "p_brand", F.lit(" — "), n, F.lit(";"))).otherwise(one)
    )
    line = lambda at, text, x0, y0: F.struct((k * 4 + at).alias("line"), text.alias("text"), F.lit(x0).alias("x0"), y0.alias("y0"), F.lit(x0 + 0.2).alias("x1"), (y0 + 0.01).alias("y1"))
    top = F.when(kind == 5, 0.2).otherwise(0.1)
    value = F.when(kind == 4, F.concat(n, F.lit(" м2"))).when(kind == 5, n)
    rows = F.array(line(0, text, 0.1, top), line(1, value, 0.35, F.when(kind == 4, top).otherwise(top + 5.0)), line(2, value, 0.12, F.when(kind == 5, top + 0.03).otherwise(top + 5.0)))
    # Of a page's two places for the value only one is near; the other line is far below.
    near = F.when(kind == 4, 1).when(kind == 5, 2)
    lines = dealt(part, "p_partkey", most=PARTS).select(k.alias("page"), kind.alias("kind"), F.inline(rows)).where((F.col("line") % 4 == 0) | (F.col("line") % 4 == near)).withColumn("line", F.when(F.col("line") % 4 == 2, F.col("line") - 1).otherwise(F.col("line")))
    wanted = each.withColumn("label", label_operators.normalized(F.col("label")))
    found = matrix.locate(lines, wanted)
    return found.select("page", "line", "code", "label", "method", "value_line", "raw", scalars.fixed(F.col("value")).alias("value"), scalars.fixed(F.col("box.y0")).alias("y0"))


@query(
    """select p_partkey, case p_partkey % 10 when 0 then printf('%.2f', p_retailprice) when 1 then printf('%.2f', p_retailprice) when 2 then printf('%.2f', p_size::double)
      when 3 then printf('%.2f', p_size::double) when 5 then printf('%.2f', floor(p_retailprice)) when 6 then printf('%.2f', 7000 + p_size + 25e-2::double) when 7 then '2024.00'
      when 8 then printf('%.2f', p_size::double) when 9 then printf('%.2f', p_size::double) end as value,
      case p_partkey % 10 when 0 then 'м2' when 1 then 'кв.м' when 2 then '%' when 3 then 'доли' when 8 then ['ед', 'ед', 'шт', 'шт', 'чел', 'чел', 'мм', 'м'][(p_size % 8 + 1)::int] end as unit from part"""
)
def number_unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price, size = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size")
    text = F.get(
        F.array(
            F.concat(F.lit("S м2: "), scalars.comma(scalars.fixed(price)), F.lit(" м2")), F.concat(scalars.comma(scalars.fixed(price)), F.lit(" кв.м")),
            F.concat(size.cast("string"), F.lit(" %")), F.concat(scalars.comma(scalars.fixed(size / 100)), F.lit(" доли")),
            F.concat(F.lit("1 "), F.lpad(size.cast("string"), 3, "0"), F.lit(",5 м³")),
            F.concat(F.lit("— "), scalars.fixed(price), F.lit(" м2")),  # a dotted number is read up to the dot
            F.concat(F.lit("7 "), F.lpad(size.cast("string"), 3, "0"), F.lit(",25")),
            F.lit("2024 100 лет"),  # no thousands: four digits before the space
            F.concat(size.cast("string"), F.get(F.array(*map(F.lit, ["ед.", "ед", " шт.", "шт", "чел.", "чел", "мм", "м"])), size % 8)),
            F.concat(F.lit(": "), size.cast("string"), F.lit(" RAL")),
        ), (k % 10).cast("int"),
    )
    wanted = F.when(k % 10 < 2, "м²").when(k % 10 < 4, "%").otherwise("м²")
    found = matrix.value_of(text, wanted)
    return table(spark, sf_dir, "part").select("p_partkey", scalars.fixed(found["value"]).alias("value"), found["unit"].alias("unit"))


@query(
    """with c as (select l_partkey as code, l_linestatus as side, printf('%.1f', l_tax * 10) as key, l_orderkey * 10 + l_linenumber as ord, l_tax * 10 as value,
      case when l_quantity > 25 then 85e-2 else 1e0 end as confidence from lineitem),
    b as (select *, row_number() over (partition by code, side order by confidence desc, ord, value) as k from c)
    select code, side, count(distinct key) as n_values, case when count(distinct key) = 1 then max(printf('%.2f', value)) filter (k = 1) end as value,
      max(confidence) as confidence, string_agg(distinct key, '; ' order by key) as shown from b group by all"""
)
def side_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("code"), F.col("l_linestatus").alias("side"), (F.col("l_tax") * 10).alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_quantity") > 25, 0.85).otherwise(1.0).alias("confidence"),
    )
    return matrix.resolve_side(rows, "code", "side").withColumn("value", scalars.fixed(F.col("value")))


@query(
    """with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as a, l_tax * 500 as b from lineitem),
    q as (select *, ['delta_gt','relative_delta_gt','value_gt','value_lt'][(l_partkey % 6 + 1)::int] as op, case when l_partkey % 12 < 11 then (l_partkey % 4) * 5::double end as t,
      case when l_suppkey % 9 = 0 then 2 else 1 end as nl, case when l_suppkey % 9 = 1 then 2 else 1 end as nr,
      case when l_suppkey % 9 not in (2, 4) then a end as l, case when l_suppkey % 9 not in (3, 4) then b end as r from p)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when nl > 1 then 'CONFLICT_LEFT' when nr > 1 then 'CONFLICT_RIGHT' when l is null and r is null then 'NOT_COMPARABLE'
      when l is null or r is null then 'MISSING_EVIDENCE' when l_suppkey % 9 = 5 then 'NOT_COMPARABLE'
      when case when op is null then not (abs(b - a) <= 5e-3 or abs(b - a) <= (case when abs(a * 10 - round_even(a * 10, 0)) < 1e-6 and abs(b * 10 - round_even(b * 10, 0)) < 1e-6 then 1e-1 else 1e-2 end) + 1e-9)
        else coalesce(case op when 'delta_gt' then abs(b - a) > t when 'relative_delta_gt' then (case when a = 0 then 0 else abs(b - a) / a end) > t when 'value_gt' then b > t else b < t end, false) end
      then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as outcome, count(*) as copies from q group by all"""
)
def scalar_pair_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, s, a, b = F.col("l_partkey"), F.col("l_suppkey") % 9, F.col("l_quantity"), F.col("l_tax") * 500
    none = F.lit(None).cast("string")
    op = F.get(F.array(*map(F.lit, ("delta_gt", "relative_delta_gt", "value_gt", "value_lt")), none, none), (part % 6).cast("int"))
    threshold = F.when(part % 12 < 11, (part % 4 * 5).cast("double"))
    outcome = matrix.compare_pair(
        F.when(s == 0, 2).otherwise(1), F.when(s == 1, 2).otherwise(1), F.when(~s.isin(2, 4), a), F.when(~s.isin(3, 4), b), s != 5,
        matrix.violates(op, a, b, threshold),
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").groupBy(*keys, outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("copies"))


@query(
    """select p_partkey, case when p_partkey % 7 = 0 then 'NOT_COMPARABLE' when p_partkey % 5 = 0 and p_partkey % 3 = 0 then 'MISSING_EVIDENCE'
      when case when p_partkey % 5 > 0 then p_size else p_retailprice / 50 end < 10 or (p_partkey % 7 <> 1 and case when p_partkey % 5 > 0 then p_size else p_retailprice / 50 end > 40)
      then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as outcome from part"""
)
def normative_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    working, design = F.when(k % 5 > 0, F.col("p_size").cast("double")), F.when(k % 3 > 0, F.col("p_retailprice") / 50)
    least, most = F.when(k % 7 > 0, F.lit(10.0)), F.when(k % 7 > 1, F.lit(40.0))
    return table(spark, sf_dir, "part").select("p_partkey", matrix.normative(working, design, least, most).alias("outcome"))


@query(
    """select p_partkey, case when p_partkey % 9 = 0 then null else contains(lower(p_name) || ' ' || lower(p_type), 'steel') or contains(lower(p_name) || ' ' || lower(p_type), 'small') end as is_present
    from part"""
)
def doc_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = F.when(F.col("p_partkey") % 9 == 0, " ; ").otherwise(" STEEL;small ;")
    haystack = F.array(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", matrix.present(keywords, haystack).alias("is_present"))


RULES = [
    ("Расхождение более 5 %", "%", "relative_delta_gt", 0.05),
    ("Расхождение > 2,5 мм между стадиями", "мм", "delta_gt", 2.5),
    ("Высота > 3 м", "м", "value_gt", 3.0),
    ("Ширина менее 1,2 м", "м", "value_lt", 1.2),
    ("Ширина менее 3,5 м", "шт. / м", None, None),
    ("доля < 30 %", "%", None, None),
    ("> 1 м и < 2 м", "м", None, None),
    ("без сравнения", "м", None, None),
    ("высота > 3-5 м", "м", None, None),
    ("шаг менее 0.8 - 1,2 м", "м", None, None),
]


@query(
    f"""with r(i, logic, op, threshold) as (values {', '.join(f"({i}, '{t}', {op!r}, {v}::double)" if op else f"({i}, '{t}', null, null)" for i, (t, u, op, v) in enumerate(RULES))})
    select p_partkey, logic, op, threshold, case when op = 'value_lt' then threshold end as min_value, case when op = 'value_gt' then threshold end as max_value from part join r on p_partkey % {len(RULES)} = i"""
)
def derive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("p_partkey") % len(RULES)).cast("int")
    logic, unit = (F.get(F.array(*[F.lit(r[j]) for r in RULES]), at) for j in (0, 1))
    rule = matrix.derive_rule(logic, unit)
    return table(spark, sf_dir, "part").select("p_partkey", logic.alias("logic"), rule.alias("r")).select("p_partkey", "logic", "r.*")


@query(
    f"""with {shapes.ROOMS_SQL}, n as (select sheet, number, side, ['store','Store-room','office','OFFICE.'][(sheet % 4 + case side when 'F' then 1 else number::int % 2 + 1 end - 1) % 4 + 1] as name from rooms)
    select p.sheet, p.number, p.name as was, r.name as becomes from n p join n r on p.sheet = r.sheet and p.number = r.number and p.side = 'F' and r.side = 'O'
    where trim(regexp_replace(lower(p.name), '[^a-z]+', ' ', 'g')) <> trim(regexp_replace(lower(r.name), '[^a-z]+', ' ', 'g'))"""
)
def name_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["store", "Store-room", "office", "OFFICE."]))
    shift = F.when(F.col("side") == "F", 0).otherwise(F.col("number").cast("int") % 2)
    named = shapes.rooms(spark, sf_dir).select("sheet", "number", "side", F.get(names, ((F.col("sheet") % 4 + shift) % 4).cast("int")).alias("name"))
    a = shapes.side(named, "F").withColumnRenamed("name", "was")
    b = shapes.side(named, "O").withColumnRenamed("name", "becomes")
    return a.join(b, ["sheet", "number"]).where(scalars.room_name(F.col("was")) != scalars.room_name(F.col("becomes")))
