"""Two-sided reconciliation of rooms, and the composites of adjacent changes.

Both sides are dealt once by (sheet, scope) and meet in an aggregate. A
one-sided room counts only if its sheet's other side shows both neighbours,
which a window over the numbers of one prefix proves. The composites keep the
same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions import scalars

VERIFIED, CANDIDATE = "NEGATIVE_VERIFIED", "CANDIDATE"


def verdict(pd_area: Column, rd_area: Column, relative: float) -> Column:
    return F.when(scalars.equal_within(pd_area, rd_area, relative), VERIFIED).otherwise(CANDIDATE)


def reconcile(pd: DataFrame, rd: DataFrame, relative: float, parts: int | None = None) -> DataFrame:
    """sheet, scope, number, pd_area, rd_area, proved, status (null: no finding), expected, actual, delta (texts) for the union of rooms.

    pd, rd: sheet, scope, number, area; unique by the first three. The rooms of
    both sides are dealt once by (sheet, scope); meeting the other side,
    finding neighbours and later the composites all keep that partitioning.
    parts: how many, by default as many as any shuffle has.

    With a column evidence (struct<file_id,page,x0,y0,x1,y1>) on both sides,
    pd_evidence and rd_evidence say where each finding is seen: at the room
    itself, or on the side that lacks it around both its neighbours.
    """
    seen = "evidence" in pd.columns
    kinds = {"area": "double"} | ({"evidence": pd.schema["evidence"].dataType} if seen else {})

    def of(rooms: DataFrame, own: str, other: str) -> DataFrame:
        known = [c for name, kind in kinds.items() for c in (F.col(name).alias(f"{own}_{name}"), F.lit(None).cast(kind).alias(f"{other}_{name}"))]
        return rooms.select("sheet", "scope", "number", *known)

    sides = of(pd, "pd", "rd").unionByName(of(rd, "rd", "pd"))
    values = [f"{side}_{name}" for name in kinds for side in ("pd", "rd")]
    both = sides.repartition(*([parts] if parts else []), "sheet", "scope").groupBy("sheet", "scope", "number").agg(*[F.max(c).alias(c) for c in values])
    prefix, place = scalars.numbered(F.col("number"))
    row = both.withColumns({"__prefix": prefix, "__at": place})
    shown = F.struct("number", F.col("pd_area").isNotNull().alias("in_pd"), F.col("rd_area").isNotNull().alias("in_rd"), *(["pd_evidence", "rd_evidence"] if seen else []))

    def near(step: int) -> Column:
        at = Window.partitionBy("sheet", "scope", "__prefix").orderBy("__at").rangeBetween(step, step)
        return F.collect_list(shown).over(at)

    found = row.withColumns({"__lower": near(-1), "__upper": near(1)})

    def proved(side: str) -> Column:
        same = lambda name, step: F.exists(name, lambda x: (x["number"] == scalars.neighbour(F.col("number"), step)) & x[side])
        return F.coalesce(same("__lower", -1) & same("__upper", 1), F.lit(False))

    def around(side: str) -> Column:
        """The least box around both neighbours on the side that lacks the room."""
        at = lambda name, step: F.get(F.filter(name, lambda x: (x["number"] == scalars.neighbour(F.col("number"), step)) & x[f"in_{side}"]), F.lit(0))[f"{side}_evidence"]
        both_ends = F.filter(F.array(at("__lower", -1), at("__upper", 1)), lambda x: x.isNotNull())
        return F.transform(F.array(both_ends), lambda e: F.when(F.size(e) == 2, F.struct(e[0]["file_id"].alias("file_id"), e[0]["page"].alias("page"), *_box(lambda c, f: f(e[0][c], e[1][c])))))[0]

    with_proof = found.withColumn("proved", F.when(F.col("pd_area").isNull(), proved("in_pd")).when(F.col("rd_area").isNull(), proved("in_rd")))
    evidence = [F.when(F.col(f"{side}_area").isNotNull(), F.col(f"{side}_evidence")).when(F.col("proved"), around(side)).alias(f"{side}_evidence") for side in ("pd", "rd")] if seen else []
    return stated(with_proof.select("sheet", "scope", "number", "pd_area", "rd_area", "proved", *evidence), relative)


def _box(corner) -> list[Column]:
    """Corners of the least box around boxes; corner: (name, how the corners of the boxes are taken together)."""
    return [corner(c, f).alias(c) for c, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))]


def stated(both: DataFrame, relative: float) -> DataFrame:
    """Findings of rooms (pd_area, rd_area, proved: do both neighbours of a one-sided room stand on the other side) at a tolerance."""
    status = F.when(F.col("proved").isNull(), verdict(F.col("pd_area"), F.col("rd_area"), relative)).when(F.col("proved"), CANDIDATE)
    seen = [c for c in ("pd_evidence", "rd_evidence") if c in both.columns]
    with_status = both.select("sheet", "scope", "number", "pd_area", "rd_area", "proved", *seen, status.alias("status"))
    found = F.col("status").isNotNull()
    changed = F.col("status") == CANDIDATE
    return with_status.select(
        "*",
        F.when(found, scalars.fixed(F.col("pd_area"))).alias("expected"),
        F.when(found, scalars.fixed(F.col("rd_area"))).alias("actual"),
        F.when(changed, scalars.signed(F.col("rd_area") - F.col("pd_area"))).alias("delta"),
    )


def islands(findings: DataFrame) -> DataFrame:
    """sheet, scope, first_number, last_number, atoms, expected, actual, delta of every run of adjacent candidates, single ones included; with evidence, the least boxes around its rooms.

    Rooms without a finding stay in the order and break a run.
    """
    by = Window.partitionBy("sheet", "scope")
    order = [c.asc() for c in scalars.natural_key(F.col("number"))]
    changed = F.coalesce(F.col("status") == CANDIDATE, F.lit(False))
    breaks = F.sum(F.when(changed, 0).otherwise(1)).over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(by.orderBy(*order))
    runs = findings.select("*", breaks.alias("run"), place.alias("place")).where(changed)
    corners = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    seen = [side for side in ("pd_evidence", "rd_evidence") if side in findings.columns]
    around = [F.struct(F.min(f"{e}.file_id").alias("file_id"), F.min(f"{e}.page").alias("page"), *[f(F.col(f"{e}.{c}")).alias(c) for c, f in corners.items()]).alias(e) for e in seen]
    grouped = runs.groupBy("sheet", "scope", "run").agg(
        *around, F.min_by("number", "place").alias("first_number"), F.max_by("number", "place").alias("last_number"), F.count(F.lit(1)).alias("atoms"),
        F.sum("pd_area").alias("e"), F.sum("rd_area").alias("a"), F.sum(F.col("rd_area") - F.col("pd_area")).alias("d"),
    )
    return grouped.select(
        "sheet", "scope", "first_number", "last_number", "atoms",
        scalars.fixed(F.col("e")).alias("expected"), scalars.fixed(F.col("a")).alias("actual"), scalars.signed(F.col("d")).alias("delta"), *seen,
    )


def totals(pd: DataFrame, rd: DataFrame, relative: float) -> DataFrame:
    """sheet, status, expected, actual, delta of sheets with exactly one total (sheet, area) on each side."""

    def single(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.first("area").alias(name)).where("n = 1").drop("n")

    both = single(pd, "pd_area").join(single(rd, "rd_area"), "sheet")
    status = verdict(F.col("pd_area"), F.col("rd_area"), relative)
    return both.select(
        "sheet", status.alias("status"), scalars.fixed(F.col("pd_area")).alias("expected"), scalars.fixed(F.col("rd_area")).alias("actual"),
        F.when(status == CANDIDATE, scalars.signed(F.col("rd_area") - F.col("pd_area"))).alias("delta"),
    )


def pair_sheets(pd: DataFrame, rd: DataFrame, *within: str, least: float = 0.5) -> DataFrame:
    """within, rd_sheet, pd_sheet, shared, share: the PD sheet that shares most numbers with each RD sheet, relative to the smaller of both.

    pd, rd: the columns `within`, sheet, number; unique. Ties go to the lesser
    PD sheet. Only sheets of one object (`within`) that share a number meet,
    through an equi-join on both, so that a number which every sheet holds
    pairs no more than the sheets of one package.
    """
    keys = list(within)
    n_pd = pd.groupBy(*keys, F.col("sheet").alias("pd_sheet")).agg(F.count(F.lit(1)).alias("n_pd"))
    n_rd = rd.groupBy(*keys, F.col("sheet").alias("rd_sheet")).agg(F.count(F.lit(1)).alias("n_rd"))
    shared = (
        pd.select(*keys, F.col("sheet").alias("pd_sheet"), "number")
        .join(rd.select(*keys, F.col("sheet").alias("rd_sheet"), "number"), [*keys, "number"])
        .groupBy(*keys, "rd_sheet", "pd_sheet")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    share = F.col("shared") / F.least("n_pd", "n_rd")
    rated = shared.join(n_pd, [*keys, "pd_sheet"]).join(n_rd, [*keys, "rd_sheet"]).withColumn("share", share)
    best = F.max_by(F.struct("pd_sheet", "shared", "share"), F.struct("share", -F.col("pd_sheet")))
    return rated.groupBy(*keys, "rd_sheet").agg(best.alias("b")).select(*keys, "rd_sheet", "b.*").where(F.col("share") >= least)


def chain_clusters(rooms: DataFrame, gap: float = 0.005) -> DataFrame:
    """`rooms` (sheet, number, area, …) with `cluster`: areas of one number in order, a new cluster where the step is over `gap`."""
    order = Window.partitionBy("sheet", "number").orderBy("area")
    new = F.coalesce(F.col("area") - F.lag("area").over(order) > gap, F.lit(True))
    running = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal areas together
    return rooms.withColumn("__new", new.cast("int")).withColumn("cluster", F.sum("__new").over(running)).drop("__new")


def dedupe(rooms: DataFrame, gap: float = 0.005) -> DataFrame:
    """sheet, number, scope, area, members: readings of one room merged.

    A number whose areas form several clusters stays, one room each, only if
    every cluster has one scope and the scopes differ; else it is ambiguous and
    dropped.
    """
    clusters = (
        chain_clusters(rooms, gap)
        .groupBy("sheet", "number", "cluster")
        .agg(F.min("area").alias("area"), F.collect_set("scope").alias("scopes"), F.count(F.lit(1)).alias("members"))
    )
    of_number = clusters.groupBy("sheet", "number").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("scopes")).alias("most"), F.min(F.size("scopes")).alias("fewest"),
        F.count_distinct(F.try_element_at("scopes", F.lit(1))).alias("different"),
    )
    fits = (F.col("n") == 1) | ((F.col("most") == 1) & (F.col("fewest") == 1) & (F.col("different") == F.col("n")))
    scope = F.when(F.size("scopes") >= 1, F.array_min("scopes"))
    return clusters.join(of_number.where(fits), ["sheet", "number"]).select("sheet", "number", scope.alias("scope"), "area", "members")
