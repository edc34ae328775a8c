"""Shapes of the engine derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.plans.dealing import dealt
from reconlake.sources.tables import table

DESIGN, WORKING = "F", "O"


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, scope, number, side, area from order lines: a part is a sheet, a line number a room."""
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_partkey").groupBy("l_partkey", "l_linenumber", "l_linestatus").agg(F.sum("l_quantity").alias("area"))
    return lines.select(
        F.col("l_partkey").alias("sheet"), F.lit(None).cast("string").alias("scope"), F.col("l_linenumber").cast("string").alias("number"),
        F.col("l_linestatus").alias("side"), "area",
    )


def side(rows: DataFrame, which: str) -> DataFrame:
    return rows.where(F.col("side") == which).drop("side")


#: rooms() in SQL.
ROOMS_SQL = "rooms as (select l_partkey as sheet, l_linenumber::varchar as number, l_linestatus as side, sum(l_quantity) as area from lineitem group by all)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, object_id, discipline, stage, status, approved_on, predecessor_id from orders."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    stage = F.element_at(F.array(F.lit("PD"), F.lit("RD"), F.lit("ID")), (key % 3 + 1).cast("int"))
    status = (
        F.when(key % 11 == 0, "CANCELLED").when(key % 11 == 1, "SUPERSEDED").when(F.col("o_orderstatus") == "F", "APPROVED")
        .when(F.col("o_orderstatus") == "O", "FOR_CONSTRUCTION").otherwise("DRAFT")
    )
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority", key % 3).orderBy("o_orderkey"))
    return o.select(
        key.alias("file_id"), F.col("o_custkey").alias("object_id"), F.col("o_orderpriority").alias("discipline"), stage.alias("stage"),
        status.alias("status"), F.when(key % 13 != 0, F.to_date("o_orderdate")).alias("approved_on"), F.when(key % 4 == 0, before).alias("predecessor_id"),
        F.col("o_totalprice").alias("price"),
    )


FILES_SQL = """files as (
  select o_orderkey as file_id, o_custkey as object_id, o_orderpriority as discipline, ['PD','RD','ID'][(o_orderkey % 3 + 1)::int] as stage,
    case when o_orderkey % 11 = 0 then 'CANCELLED' when o_orderkey % 11 = 1 then 'SUPERSEDED' when o_orderstatus = 'F' then 'APPROVED'
         when o_orderstatus = 'O' then 'FOR_CONSTRUCTION' else 'DRAFT' end as status,
    case when o_orderkey % 13 <> 0 then o_orderdate::date end as approved_on,
    case when o_orderkey % 4 = 0 then lag(o_orderkey) over (partition by o_custkey, o_orderpriority, o_orderkey % 3 order by o_orderkey) end as predecessor_id
  from orders)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check_id, object_id, process_id, parent_id, split_at, status, engine_status, verified_by, param, amount from order lines."""
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("rf"), F.min("l_linestatus").alias("ls"), F.min("l_shipdate").alias("ship"), F.min("l_partkey").alias("part"),
        F.min("l_quantity").alias("amount"),
    )
    code = F.concat("rf", "ls")
    status = (
        F.when(code == "AF", "CANDIDATE").when(code == "AO", "CONFIRMED_VIOLATION").when(code == "NF", "NEGATIVE_VERIFIED")
        .when(code == "NO", "SUSPICION").when(code == "RF", "CLARIFICATION_REQUIRED")
    )
    key, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    return lines.select(
        (key * 10 + line).alias("check_id"), key.alias("process_id"), (key % 100).alias("object_id"), F.when(line > 4, key * 10 + 1).alias("parent_id"),
        F.when((line == 1) & (F.dayofmonth("ship") % 2 == 0), F.col("ship")).alias("split_at"), status.alias("status"),
        F.when(F.col("part") % 5 == 0, F.col("part") % 7).alias("verified_by"), (F.col("part") % 20).alias("param"), "amount",
    )


CHECKS_SQL = """lines as (
  select l_orderkey as k, l_linenumber::bigint as n, min(l_returnflag) || min(l_linestatus) as code, min(l_shipdate) as ship, min(l_partkey) as part,
    min(l_quantity) as amount from lineitem group by all),
checks as (
  select k * 10 + n as check_id, k as process_id, k % 100 as object_id, case when n > 4 then k * 10 + 1 end as parent_id,
    case when n = 1 and day(ship) % 2 = 0 then ship end as split_at,
    case code when 'AF' then 'CANDIDATE' when 'AO' then 'CONFIRMED_VIOLATION' when 'NF' then 'NEGATIVE_VERIFIED' when 'NO' then 'SUSPICION'
      when 'RF' then 'CLARIFICATION_REQUIRED' end as status,
    case when part % 5 = 0 then part % 7 end as verified_by, part % 20 as param, amount from lines),
visible as (
  select c.* from checks c left join checks p on c.parent_id = p.check_id
  where (c.parent_id is null and c.split_at is null) or p.split_at is not null)"""
