"""Tables, captions, totals and tags found on pages of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import sheets, textlayer
from reconlake.plans.dealing import dealt
from reconlake.queries.registry import query
from reconlake.sources.tables import table

PARTS = 10_000  # of one task; each becomes some forty lines


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a table with caption, decoy headers, rows whose names are shifted, a total with a decoy, and tags; one page for each part."""
    k = F.col("p_partkey")
    shift = (k % 5) * 0.0035

    def line(block: int, no: int, text, x0, y0, width: float = 0.04, height: float = 0.01):
        x0, y0 = F.lit(x0).cast("double") if isinstance(x0, float) else x0, F.lit(y0).cast("double") if isinstance(y0, float) else y0
        text = F.lit(text) if isinstance(text, str) else text
        return F.struct(F.lit(block).alias("block"), F.lit(no).alias("line"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + width).alias("x1"), (y0 + height).alias("y1"))

    size = F.concat(F.col("p_size").cast("string"), F.lit(",5"))
    rows = [
        line(0, 0, "Экспликация помещений", 0.1, F.when(k % 3 == 0, 0.01).otherwise(0.05)), line(1, 1, F.concat(F.lit("План "), k.cast("string")), 0.1, 0.06, height=0.005),
        line(2, 2, "№", 0.02, 0.07), line(2, 3, "№", 0.1, 0.072), line(2, 4, "Наименование", 0.2, 0.07), line(2, 5, "Площадь, м²", 0.4, 0.071), line(2, 6, "Площадь", 0.8, 0.07),
        line(3, 10, "1", 0.1, 0.1), line(3, 11, "2", 0.1, 0.13), line(4, 12, "Office", 0.2, 0.1 + shift), line(4, 13, "big", 0.25, 0.1 + shift), line(4, 14, "Store", 0.2, 0.13 - shift),
        line(5, 15, size, 0.4, 0.1), line(5, 16, "7.25 м²", 0.4, 0.13), line(5, 17, "7.25", 0.4, 0.15),
        line(6, 20, "Итого:", 0.2, 0.3), line(6, 21, "ИТОГ по этажу", 0.2, 0.304), line(7, 22, F.concat(F.lit("1"), size), 0.4, 0.305), line(7, 23, "3,25", 0.4, 0.299), line(7, 24, "9,75", 0.1, 0.3),
        line(8, 30, "1.0.1", 0.7, 0.5), line(8, 31, "5,95", 0.7, 0.51), line(8, 32, "Hall", 0.7, 0.52), line(9, 33, "1.0.2", 0.8, 0.5), line(9, 34, size, 0.8, 0.51),
        line(10, 35, "1.5", 0.9, 0.5), line(10, 36, "4,25", 0.9, 0.51), line(11, 37, "1.0.3", 0.15, 0.6), line(11, 38, "8,25", 0.15, 0.61), line(12, 39, "1.0.4", 0.6, 0.6),
    ]
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", most=PARTS).select(k.alias("page"), F.inline(F.array(*rows)))


@query(
    """select p_partkey as page, '0.1000' as x_left, '0.4400' as x_right, '0.0820' as y_top, '0.0700' as header_top, case when p_partkey % 3 > 0 then 'Экспликация помещений' end as caption from part"""
)
def table_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    found = textlayer.captions(textlayer.anchors(lines), textlayer.blocks(lines))
    return found.select("page", *[scalars.fixed(F.col(c), 4).alias(c) for c in ("x_left", "x_right", "y_top", "header_top")], "caption")


@query(
    """select p_partkey as page, 10 as number_line, 'Office big' as name from part where p_partkey % 5 < 4 union all
    select p_partkey, 11, 'Store' from part where p_partkey % 5 < 4"""
)
def row_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("block") == 3, "number").when(F.col("block") == 4, "name")
    found = textlayer.names_of_rows(_lines(spark, sf_dir).withColumn("kind", kind).where("kind is not null"))
    return found.select("page", "number_line", "name")


@query(
    """select p_partkey as page, 20 as label_line, 23 as value_line, '3.25' as area, '0.2990' as y0 from part union all
    select p_partkey, 21, 22, printf('%.2f', ('1' || p_size || '.5')::double), '0.3040' from part"""
)
def floor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = textlayer.floor_totals(_lines(spark, sf_dir).withColumn("line", F.col("line").cast("bigint")))
    return found.select("page", F.col("label_line").cast("int").alias("label_line"), F.col("value_line").cast("int").alias("value_line"), scalars.fixed(F.col("area")).alias("area"), scalars.fixed(F.col("y0"), 4).alias("y0"))


@query(
    """select p_partkey as page, '1.0.1' as number, '5.95' as area, 'Hall' as name, '1.0.1' as key, 1 as place from part union all
    select p_partkey, '1.0.2', printf('%.2f', p_size + 5e-1), null, '1.0.2', 2 from part union all select p_partkey, '1.0.3', '8.25', null, '1.0.3', 3 from part"""
)
def plan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sheets.dealt(_lines(spark, sf_dir))
    found = sheets.tags(lines, sheets.bands(lines)).select("page", "number", "area", "name", "scope", "box.x0", "box.y0", F.col("place").alias("block"))
    keyed = textlayer.room_keys(textlayer.top_down(found))
    return keyed.select("page", "number", scalars.fixed(F.col("area")).alias("area"), "name", "key", "place")


@query(
    """with r as (select l_partkey as page, l_linenumber::varchar as number, case when l_suppkey % 3 > 0 then 's' || l_suppkey % 3 end as scope from lineitem group by all),
    n as (select *, count(*) over (partition by page, number) as n, count(*) over (partition by page, scope) as m, dense_rank() over (partition by page order by scope nulls last) as place from r)
    select page, number, scope, case when n = 1 then number else coalesce(scope, 'None') || '|' || number end as key, m, place from n"""
)
def room_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey") % 3
    rooms = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("page"), F.col("l_linenumber").cast("string").alias("number"), F.when(s > 0, F.concat(F.lit("s"), s.cast("string"))).alias("scope")).distinct()
    sizes = textlayer.scopes(rooms).select(F.col("page").alias("p"), F.col("scope").alias("sc"), F.col("n").alias("m"), "place")
    keyed = textlayer.room_keys(rooms)
    return keyed.join(sizes, (F.col("page") == F.col("p")) & F.col("scope").eqNullSafe(F.col("sc"))).select("page", "number", "scope", "key", "m", "place")


@query("""select p_partkey as page, block, text, place from part cross join (values (0, 'Экспликация помещений', 1), (8, '1.0.1' || chr(10) || '5,95' || chr(10) || 'Hall', 21)) v(block, text, place)""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = textlayer.reading_order(_lines(spark, sf_dir))
    first = lines.groupBy("page", "block").agg(F.min("place").alias("place"))
    return textlayer.blocks(lines).where("block in (0, 8)").join(first, ["page", "block"]).select("page", "block", "text", "place")
