"""Merging by evidence: a composite and its atoms are one unit, keyed by its evidence group.

Both runs become one row for each unit, with a digest of what its check, its
fragments and its atoms say; units then meet in one aggregate by (process,
group). No unit is split over rows after the first aggregate, so a decided atom
protects its whole composite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions import scalars

CONTENT = ("expected", "actual", "delta", "completeness")


def union_box(*boxes: Column) -> Column:
    """The least box around all; null ones are left out."""
    at = lambda name, f: f(*[b[name] for b in boxes]) if len(boxes) > 1 else boxes[0][name]
    return F.struct(at("x0", F.least).alias("x0"), at("y0", F.least).alias("y0"), at("x1", F.greatest).alias("x1"), at("y1", F.greatest).alias("y1"))


def box_of(box: str) -> Column:
    """As an aggregate: the least box around all boxes of a group."""
    return F.struct(*[f(F.col(f"{box}.{n}")).alias(n) for n, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))])


def fragment_set(fragments: DataFrame, *keys: str) -> DataFrame:
    """keys, fragments: what a check points at, as a sorted array of different (file, page, box rounded to four places)."""
    corner = [scalars.fixed(F.col(c), 4).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return fragments.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("file_id", "page", *corner))).alias("fragments"))


def _digest(*columns) -> Column:
    """128 bits that stand for the values, nulls and their places included."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def units(checks: DataFrame, decided: bool) -> DataFrame:
    """process_id, group_id, content (a digest), decided, members of every top-level check.

    checks: check_id, process_id, group_id, parent_id, status, engine_status,
    CONTENT and fragments (an array as of fragment_set, see with_fragments; its
    order and repeats don't matter), with `decided` also verified_by and
    split_at. An old check's status is what the engine had said before anyone
    decided. members: check ids, the top first. A unit's content is that of its
    top and of its atoms with their groups; only digests of it are shuffled.
    Atoms whose top is missing, and tops without a group, are no units.
    """
    shown = F.array_sort(F.array_distinct(F.coalesce("fragments", F.array().cast(checks.schema["fragments"].dataType))))
    content = _digest(F.coalesce("engine_status", "status").alias("status"), *CONTENT, shown.alias("fragments"))
    by_person = (F.col("verified_by").isNotNull() | F.col("split_at").isNotNull()) if decided else F.lit(False)
    is_top = F.col("parent_id").isNull()
    rows = checks.select("process_id", F.coalesce("parent_id", "check_id").alias("top"), "check_id", "group_id", is_top.alias("is_top"), content.alias("content"), by_person.alias("by_person"))
    own = rows.groupBy("process_id", "top").agg(
        F.max(F.when(F.col("is_top"), F.struct("group_id", "content"))).alias("t"), F.array_sort(F.collect_list(F.when(~F.col("is_top"), F.struct("group_id", "content")))).alias("atoms"),
        F.bool_or("by_person").alias("decided"), F.transform(F.array_sort(F.collect_list(F.struct(~F.col("is_top"), "check_id"))), lambda x: x["check_id"]).alias("members"),
    )
    return own.where("t.group_id is not null").select("process_id", "t.group_id", _digest("t.content", "atoms").alias("content"), "decided", "members")


def with_fragments(checks: DataFrame, fragments: DataFrame) -> DataFrame:
    """`checks` with the array of their fragments (check_id, file_id, page, x0, y0, x1, y1)."""
    return checks.join(fragment_set(fragments, "check_id"), "check_id", "left")


def plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """process_id, group_id, action, decision_survived, noted, deleted (ids) of every unit of either run (units).

    Both runs are dealt once by process and group and meet in an aggregate.
    """
    of = lambda run, is_old: run.select("process_id", "group_id", F.lit(is_old).alias("is_old"), F.struct("content", "decided", "members").alias("u"))
    both = of(old, True).union(of(new, False)).groupBy("process_id", "group_id").agg(
        F.max(F.when(F.col("is_old"), F.col("u"))).alias("was"), F.max(F.when(~F.col("is_old"), F.col("u.content"))).alias("now")
    )
    gone, fresh = F.col("now").isNull(), F.col("was").isNull()
    same, decided = F.col("was.content").eqNullSafe(F.col("now")), F.coalesce("was.decided", F.lit(False))
    action = F.when(fresh, "added").when(gone, F.when(decided, "kept_without_source").otherwise("removed")).when(same, "kept").otherwise("changed")
    return both.select(
        "process_id", "group_id", action.alias("action"), (decided & (gone | same)).alias("decision_survived"), (decided & (gone | ~same)).alias("noted"),
        F.when(action.isin("removed", "changed"), F.col("was.members")).otherwise(F.array().cast("array<bigint>")).alias("deleted"),
    )


#: What people are told of decisions that a merge could not keep, and of findings that are no longer made.
CHANGED_NOTE = ("Предыдущее решение (", ") было вынесено по прежним данным и не перенесено после дозагрузки — параметры изменились.")
REMOVED_NOTE = "После дозагрузки система больше не формирует эту находку по текущим данным."
SOMEONE = "инспектором"


def _noted(rationale: Column, note: Column) -> Column:
    return F.when(F.coalesce(rationale, F.lit("")) == "", note).otherwise(F.concat(rationale, F.lit("\n\n"), note))


def _placed(checks: DataFrame) -> DataFrame:
    """`checks` with top_group, the group of their unit's top."""
    unit = Window.partitionBy("process_id", F.coalesce("parent_id", "check_id"))
    return checks.withColumn("top_group", F.max(F.when(F.col("parent_id").isNull(), F.col("group_id"))).over(unit))


def after_merge(old: DataFrame, new: DataFrame, planned: DataFrame, users: DataFrame) -> DataFrame:
    """The checks after a merge (plan), in the columns of `old`.

    Units that are kept stay as they are, decided ones that lost their source
    with a note on each decided row; changed and fresh units come from the new
    run, where a changed unit's top tells which decisions were not kept.
    old, new: as for units, with rationale; new ids differ from old ones.
    users: user_id, name.
    """
    columns = old.columns
    plans = planned.select("process_id", F.col("group_id").alias("top_group"), "action", "noted")
    by_person = F.col("verified_by").isNotNull() | F.col("split_at").isNotNull()
    was = _placed(old).join(plans, ["process_id", "top_group"])
    stays = was.where("action in ('kept', 'kept_without_source')")
    told = F.when((F.col("action") == "kept_without_source") & by_person, _noted(F.col("rationale"), F.lit(REMOVED_NOTE))).otherwise(F.col("rationale"))
    names = users.select(F.col("user_id").alias("verified_by"), "name")
    decided = was.where(by_person & (F.col("action") == "changed")).join(names, "verified_by", "left")
    label = F.concat_ws(", ", F.coalesce("status", F.lit("None")), F.coalesce("name", F.col("verified_by").cast("string"), F.lit(SOMEONE)))
    order = F.struct(F.col("parent_id").isNotNull(), "check_id", label.alias("label"))
    labels = decided.groupBy("process_id", "top_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["label"]), "; ").alias("labels"))
    fresh = _placed(new).join(plans.where("action in ('added', 'changed')"), ["process_id", "top_group"]).join(labels, ["process_id", "top_group"], "left")
    note = F.concat(F.lit(CHANGED_NOTE[0]), F.col("labels"), F.lit(CHANGED_NOTE[1]))
    new_told = F.when(F.col("labels").isNotNull() & F.col("parent_id").isNull(), _noted(F.col("rationale"), note)).otherwise(F.col("rationale"))
    return stays.withColumn("rationale", told).select(*columns).union(fresh.withColumn("rationale", new_told).select(*columns))


def reissued(protocols: DataFrame, planned: DataFrame) -> DataFrame:
    """`protocols` (process_id, version, status) after merges: the last of each process that was merged is superseded, and a next one begins, under verification where a decision survived."""
    merged = planned.groupBy("process_id").agg(F.bool_or("decision_survived").alias("survived"))
    last = protocols.groupBy("process_id").agg(F.max("version").alias("last"))
    known = protocols.join(last, "process_id").join(merged, "process_id", "left")
    old = known.withColumn("status", F.when(F.col("survived").isNotNull() & (F.col("version") == F.col("last")), "SUPERSEDED").otherwise(F.col("status")))
    status = F.when(F.col("survived"), "VERIFYING").otherwise("READY")
    new = merged.join(last, "process_id", "left").select("process_id", (F.coalesce("last", F.lit(0)) + 1).cast(protocols.schema["version"].dataType).alias("version"), status.alias("status"))
    return old.select("process_id", "version", "status").union(new)


def matrix_rows(checks: DataFrame, hypotheses: str = "SEM-ROOM-FN") -> DataFrame:
    """Checks of the rule matrix only: hypotheses keep to their own run and never take part in a merge."""
    return checks.where(F.col("code") != hypotheses)


def touched_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs (pd_file, rd_file) with a file of `files` (file_id) on either side."""
    ids = files.select("file_id").distinct()
    left = pairs.join(ids, F.col("pd_file") == F.col("file_id"), "left_semi")
    right = pairs.join(ids, F.col("pd_file") == F.col("file_id"), "left_anti").join(ids, F.col("rd_file") == F.col("file_id"), "left_semi")
    return left.union(right)
