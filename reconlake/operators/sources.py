"""Choosing the authoritative file of each document, and what a package lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROPPED = ("CANCELLED", "SUPERSEDED")
APPROVED = ("APPROVED", "FOR_CONSTRUCTION")
STAGES = ("PD", "RD", "ID")


def select_source(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, outcome, file_id: the file that speaks for each group, or why there is none.

    files: keys…, file_id, status, approved_on, predecessor_id. Cancelled and
    superseded files are dropped first; then files that a remaining file of the
    group names as its predecessor, found by an anti-join on (keys, file_id).
    """
    alive = files.where(~F.col("status").isin(*DROPPED))
    named = alive.where("predecessor_id is not null").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("predecessor_id").alias("__p")).distinct()
    same = F.col("file_id") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    current = alive.join(named, same, "left_anti")
    ok = F.col("status").isin(*APPROVED)
    latest = F.max(F.when(ok, F.struct("approved_on", "file_id")))
    counted = current.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), F.count_if(ok & F.col("approved_on").isNull()).alias("undated"), latest.alias("latest"),
        F.collect_list(F.when(ok, F.col("approved_on"))).alias("dates"), F.max(F.when(ok, F.col("file_id"))).alias("only"),
    )
    at_latest = F.size(F.filter("dates", lambda d: d == F.col("latest.approved_on")))
    outcome = (
        F.when(F.col("n").isNull(), "MISSING_EVIDENCE").when(F.col("n") == 0, "CLARIFICATION_REQUIRED").when(F.col("n") == 1, "COMPLETE")
        .when((F.col("undated") == 0) & (at_latest == 1), "COMPLETE").otherwise("CLARIFICATION_REQUIRED")
    )
    groups = files.select(*keys).distinct()
    on = F.lit(True)
    renamed = counted
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    file_id = F.when(F.col("outcome") == "COMPLETE", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("latest.file_id")))
    return groups.join(renamed, on, "left").withColumn("outcome", outcome).select(*keys, "outcome", file_id.alias("file_id"))


#: Why a group has no file, or which rule chose it.
REASONS = {
    "MISSING_EVIDENCE": "no current file", "no approved": "no approved file", "single": "one approved file", "latest": "latest approval",
    "tie": "several approved files without one latest date", "no code": "no document code",
}


def select_documents(files: DataFrame, keys: Sequence[str], code: str = "code") -> DataFrame:
    """keys, code, label, outcome, file_id, reason: select_source for each document, and one row that asks for its code for each file without one."""
    chosen = select_source(files.where(F.col(code).isNotNull()), [*keys, code])
    approved = files.where(F.col(code).isNotNull() & F.col("status").isin(*APPROVED)).groupBy(*keys, code).agg(F.count(F.lit(1)).alias("__n"))
    on = F.col(f"c.{code}") == F.col(f"a.{code}")
    for k in keys:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"a.{k}"))
    joined = chosen.alias("c").join(approved.alias("a"), on, "left").select("c.*", "__n")
    complete = F.col("outcome") == "COMPLETE"
    why = (
        F.when(F.col("outcome") == "MISSING_EVIDENCE", REASONS["MISSING_EVIDENCE"]).when(complete & (F.col("__n") == 1), REASONS["single"]).when(complete, REASONS["latest"])
        .when(F.col("__n").isNull(), REASONS["no approved"]).otherwise(REASONS["tie"])
    )
    label = F.concat(F.lit("document:"), F.concat_ws(":", *keys, code))
    named = joined.select(*keys, code, label.alias("label"), "outcome", "file_id", why.alias("reason"))
    bare = files.where(F.col(code).isNull()).select(
        *keys, code, F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("label"), F.lit("CLARIFICATION_REQUIRED").alias("outcome"),
        F.lit(None).cast("bigint").alias("file_id"), F.lit(REASONS["no code"]).alias("reason"),
    )
    return named.union(bare)


def stage_status(expected: Column, uploaded: Column) -> Column:
    return (
        F.when((expected == 0) & (uploaded == 0), "NOT_APPLICABLE").when(uploaded == 0, "MISSING")
        .when(uploaded < expected, "PARTIAL").otherwise("UPLOADED")
    )


def completeness(counts: DataFrame) -> DataFrame:
    """object_id, stage, expected, uploaded, completeness for every stage of every object of counts (object_id, stage, expected, uploaded)."""
    stages = F.explode(F.array(*map(F.lit, STAGES))).alias("stage")
    every = counts.select("object_id").distinct().select("object_id", stages)
    filled = every.join(counts, ["object_id", "stage"], "left").fillna(0, ["expected", "uploaded"])
    return filled.withColumn("completeness", stage_status(F.col("expected"), F.col("uploaded")))


def scenario(complete: DataFrame) -> DataFrame:
    """object_id, scenario (null: nothing is fully uploaded)."""
    up = {s: F.bool_or((F.col("stage") == s) & (F.col("completeness") == "UPLOADED")) for s in STAGES}
    flags = complete.groupBy("object_id").agg(F.bool_or(F.col("completeness") == "PARTIAL").alias("partial"), *[c.alias(s) for s, c in up.items()])
    present = F.concat_ws("_", *[F.when(F.col(s), s) for s in STAGES])
    n = sum((F.col(s).cast("int") for s in STAGES), F.lit(0))
    kind = F.when(F.col("partial"), "PARTIALLY_LOADED").when(n == 3, "FULL").when(n == 0, F.lit(None)).when(n == 1, F.concat(F.lit("SINGLE_"), present))
    return flags.select("object_id", kind.otherwise(present).alias("scenario"))


def coverage_gap(entries: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """side ('entry' or 'file'), key: registry entries without a file and files without an entry."""
    a = entries.select(key).join(files.select(key), key, "left_anti").select(F.lit("entry").alias("side"), key)
    b = files.select(key).join(entries.select(key), key, "left_anti").select(F.lit("file").alias("side"), key)
    return a.union(b)
