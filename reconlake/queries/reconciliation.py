"""Rooms, totals, composites and sheet pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import rooms
from reconlake.plans import shapes
from reconlake.plans.dealing import dealt, parts
from reconlake.plans.shapes import DESIGN, ROOMS_SQL, WORKING
from reconlake.queries.registry import query
from reconlake.sources.tables import table


def found_sql(relative: float) -> str:
    """SQL of rooms.reconcile over shapes.rooms."""
    return f"""rooms as materialized (select l_partkey as sheet, l_linenumber::bigint as num, l_linestatus as side, sum(l_quantity) as area from lineitem group by all),
    j as materialized (select sheet, num, max(area) filter (side = 'F') as pa, max(area) filter (side = 'O') as ra from rooms group by all),
    n as materialized (select j.*, lo.pa as lpa, lo.ra as lra, up.pa as upa, up.ra as ura from j
          left join j lo on lo.sheet = j.sheet and lo.num + 1 = j.num left join j up on up.sheet = j.sheet and up.num - 1 = j.num),
    f as (select sheet, num::varchar as number, pa, ra, case
            when pa is null then case when lpa is not null and upa is not null then 'CANDIDATE' end
            when ra is null then case when lra is not null and ura is not null then 'CANDIDATE' end
            when abs(ra - pa) <= 5e-3 or (pa <> 0 and abs(ra - pa) <= {relative}::double * abs(pa))
              or abs(ra - pa) <= (case when abs(pa * 10 - round_even(pa * 10, 0)) < 1e-6 and abs(ra * 10 - round_even(ra * 10, 0)) < 1e-6 then 1e-1 else 1e-2 end) + 1e-9
              then 'NEGATIVE_VERIFIED' else 'CANDIDATE' end as status from n),
    found as (select sheet, number, pa, ra, status, case when status is not null then printf('%.2f', pa) end as expected,
            case when status is not null then printf('%.2f', ra) end as actual,
            case when status = 'CANDIDATE' and pa is not null and ra is not null then printf('%+.2f', ra - pa) end as delta from f)"""


ISLANDS_SQL = """
    o as (select *, sum(case when status = 'CANDIDATE' then 0 else 1 end) over (partition by sheet order by number::int) as run from found),
    islands as (select sheet, min_by(number, number::int) as first_number, max_by(number, number::int) as last_number, count(*)::bigint as atoms,
      printf('%.2f', sum(pa)) as expected, printf('%.2f', sum(ra)) as actual, printf('%+.2f', sum(ra - pa)) as delta
      from o where status = 'CANDIDATE' group by sheet, run)"""


def _found(spark: SparkSession, sf_dir: str, relative: float) -> DataFrame:
    all_rooms = shapes.rooms(spark, sf_dir)
    return rooms.reconcile(shapes.side(all_rooms, DESIGN), shapes.side(all_rooms, WORKING), relative, parts(table(spark, sf_dir, "lineitem")))


@query(f"with {found_sql(0.5)}, {ISLANDS_SQL} select * from islands")
def reconcile_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms.islands(_found(spark, sf_dir, 0.5)).drop("scope")


@query(f"with {found_sql(0.01)} select sheet, number, status, expected, actual, delta from found")
def reconcile_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, 0.01).select("sheet", "number", "status", "expected", "actual", "delta")


@query(f"with {found_sql(0.5)}, {ISLANDS_SQL} select * from islands where atoms >= 2")
def composite_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms.islands(_found(spark, sf_dir, 0.5)).where("atoms >= 2").drop("scope")


@query(f"with {found_sql(0.5)} select sheet, number, expected, actual from found where status = 'CANDIDATE' and (pa is null or ra is null)")
def neighbour_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, 0.5).where("status = 'CANDIDATE' and (pd_area is null or rd_area is null)").select("sheet", "number", "expected", "actual")


@query(
    """select l_orderkey as k, l_linenumber as n, l_quantity as a, l_tax * 100 as b,
      case when abs(l_tax * 100 - l_quantity) <= 5e-3 or (l_quantity <> 0 and abs(l_tax * 100 - l_quantity) <= 1e-2::double * abs(l_quantity))
        or abs(l_tax * 100 - l_quantity) <= (case when abs(l_quantity * 10 - round_even(l_quantity * 10, 0)) < 1e-6
          and abs(l_tax * 100 * 10 - round_even(l_tax * 100 * 10, 0)) < 1e-6 then 1e-1 else 1e-2 end) + 1e-9 then 'NEGATIVE_VERIFIED' else 'CANDIDATE' end as status
    from lineitem"""
)
def tolerance_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_quantity"), F.col("l_tax") * 100
    return lines.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), a.alias("a"), b.alias("b"), rooms.verdict(a, b, 0.01).alias("status")
    )


@query(
    f"""with {ROOMS_SQL}, t as (select sheet, side, sum(area) as area from rooms group by all)
    select p.sheet, case when abs(r.area - p.area) <= 5e-3 or abs(r.area - p.area) <= 1e-2::double * p.area or abs(r.area - p.area) <= 1e-1 + 1e-9
        then 'NEGATIVE_VERIFIED' else 'CANDIDATE' end as status, printf('%.2f', p.area) as expected, printf('%.2f', r.area) as actual,
      case when status = 'CANDIDATE' then printf('%+.2f', r.area - p.area) end as delta
    from t p join t r on p.sheet = r.sheet and p.side = 'F' and r.side = 'O'"""
)
def floor_totals_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = shapes.rooms(spark, sf_dir).groupBy("sheet", "side").agg(F.sum("area").alias("area"))
    return rooms.totals(shapes.side(sums, DESIGN), shapes.side(sums, WORKING), 0.01)


@query(
    """with s as (select distinct l_partkey as object_id, l_suppkey as sheet, l_linenumber as number, l_linestatus as side from lineitem),
    n as (select object_id, sheet, side, count(*) as n from s group by all),
    o as (select object_id, r.sheet as rd_sheet, p.sheet as pd_sheet, count(*) as shared from s p join s r using (object_id, number) where p.side = 'F' and r.side = 'O' group by all),
    q as (select o.*, shared / least(np.n, nr.n)::double as share from o join n np on np.object_id = o.object_id and np.sheet = pd_sheet and np.side = 'F'
          join n nr on nr.object_id = o.object_id and nr.sheet = rd_sheet and nr.side = 'O'),
    b as (select *, row_number() over (partition by object_id, rd_sheet order by share desc, pd_sheet) as k from q)
    select object_id, rd_sheet, pd_sheet, shared, share from b where k = 1 and share >= 5e-1"""
)
def sheet_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("object_id"), F.col("l_suppkey").alias("sheet"), F.col("l_linenumber").alias("number"), F.col("l_linestatus").alias("side")
    ).distinct()
    return rooms.pair_sheets(shapes.side(s, DESIGN), shapes.side(s, WORKING), "object_id")


READINGS_SQL = """readings as (select l_partkey as sheet, l_linenumber::varchar as number, l_quantity / 500 as area,
    case when l_suppkey % 9 > 0 then case when l_quantity <= 25 then 'a' else 'b' end end as scope from lineitem),
    marked as (select *, case when area - lag(area) over w <= 5e-3 then 0 else 1 end as fresh from readings window w as (partition by sheet, number order by area)),
    clustered as (select *, sum(fresh) over (partition by sheet, number order by area) as cluster from marked)"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("l_suppkey") % 9 > 0, F.when(F.col("l_quantity") <= 25, "a").otherwise("b"))
    return dealt(table(spark, sf_dir, "lineitem"), "l_partkey").select(
        F.col("l_partkey").alias("sheet"), F.col("l_linenumber").cast("string").alias("number"), (F.col("l_quantity") / 500).alias("area"),
        scope.alias("scope"),
    )


@query(f"with {READINGS_SQL} select sheet, number, cluster::bigint as cluster, count(*) as members, min(area) as least, max(area) as most from clustered group by all")
def cluster_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rooms.chain_clusters(_readings(spark, sf_dir))
    return found.groupBy("sheet", "number", "cluster").agg(F.count(F.lit(1)).alias("members"), F.min("area").alias("least"), F.max("area").alias("most"))


@query(
    f"""with {READINGS_SQL},
    c as (select sheet, number, cluster, min(area) as area, count(distinct scope) as scopes, min(scope) as scope, count(*) as members from clustered group by all),
    n as (select sheet, number, count(*) as n, max(scopes) as most, min(scopes) as fewest, count(distinct scope) as different from c group by all)
    select c.sheet, c.number, c.scope, c.area, c.members from c join n using (sheet, number) where n = 1 or (most = 1 and fewest = 1 and different = n)"""
)
def dedupe_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rooms.dedupe(_readings(spark, sf_dir))


NAMES = ["Тех.помещение", "С/У", "с / у мужской", "Пом. охраны", "ЛК-1", "Кл. лестничная", "ПУИ", "Тёмная комната", "Office, main", "Store-room"]


@query(
    f"""with names(i, name) as (select unnest(range(0, {len(NAMES)})), unnest({NAMES})),
    known(a, b) as (values ('тех','техническое'),('пом','помещение'),('су','санузел'),('кл','клетка'),('лк','лестничная клетка'),('пуи','помещение уборочного инвентаря')),
    t as (select i, name, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(name)), 'ё', 'е'), 'с\\s*/\\s*у([^а-я]|$)', 'санузел\\1', 'g'), '[^a-zа-я0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as x from names),
    w as (select i, name, unnest(string_split(x, ' ')) as word, unnest(range(len(string_split(x, ' ')))) as pos from t),
    done as (select i, name, string_agg(coalesce(b, word), ' ' order by pos) as normal from w left join known on word = a group by all)
    select p_partkey, name, normal from part join done on p_partkey % {len(NAMES)} = i"""
)
def room_name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, NAMES))
    name = F.get(names, (F.col("p_partkey") % len(NAMES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), scalars.room_name(name).alias("normal"))
