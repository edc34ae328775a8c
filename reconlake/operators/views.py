"""Read-side views of checks: visibility, buckets, counters, latest versions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = ("CANDIDATE", "CLARIFICATION_REQUIRED")


def visible(checks: DataFrame) -> DataFrame:
    """Checks that stand by themselves: unsplit tops, and atoms of composites that were split. Every count goes through here."""
    # Only atoms meet their parents; the many checks without one never share a key.
    split = checks.where("split_at is not null").select(F.col("check_id").alias("__parent"))
    atoms = checks.where("parent_id is not null").join(split, F.col("parent_id") == F.col("__parent"), "left_semi")
    return checks.where("parent_id is null and split_at is null").union(atoms)


def bucket(status: Column) -> Column:
    """finding, suspicion or completeness."""
    return F.when(status.isNull(), "completeness").when(status == "SUSPICION", "suspicion").otherwise("finding")


def export_bucket(status: Column) -> Column:
    known = {"CONFIRMED_VIOLATION": "violations", "NEGATIVE_VERIFIED": "verified", "CANDIDATE": "open", "CLARIFICATION_REQUIRED": "clarifications"}
    out = F.when(status.isNull(), "completeness")
    for k, v in known.items():
        out = out.when(status == k, v)
    return out.otherwise("other")


def summary(checks: DataFrame, *keys: str) -> DataFrame:
    """Counters of visible checks; a rejection counts only if a person made it."""
    s = F.col("status")
    by_person = F.col("verified_by").isNotNull()
    return checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "CANDIDATE").alias("candidates"), F.count_if(s == "CONFIRMED_VIOLATION").alias("confirmed"),
        F.count_if((s == "NEGATIVE_VERIFIED") & by_person).alias("rejected"), F.count_if((s == "NEGATIVE_VERIFIED") & ~by_person).alias("verified"),
        F.count_if(s == "SUSPICION").alias("suspicions"), F.count_if(s == "CLARIFICATION_REQUIRED").alias("clarifications"),
        F.count_if(s.isNull()).alias("completeness"), F.count_if(s.isin(*OPEN)).alias("awaiting"),
    )


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last by `order`, which should be total; no sort, one aggregate."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def indicator(has_protocol: Column, confirmed: Column, awaiting: Column, status: Column) -> Column:
    """Traffic light of an object."""
    return (
        F.when(~has_protocol, "yellow").when(confirmed > 0, "red").when(awaiting > 0, "yellow")
        .when(status.isin("VERIFICATION_COMPLETED", "PROTOCOL_FINALIZED"), "green").otherwise("yellow")
    )


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, default: int = 50, most: int = 100) -> DataFrame:
    """One page by a total order; the limit is at most `most`."""
    return rows.orderBy(*order).offset(offset).limit(min(limit or default, most))


def snapshot(checks: DataFrame, key: str) -> DataFrame:
    """key, snapshot: the checks of each key as one JSON text, in the order of check_id."""
    rows = F.array_sort(F.collect_list(F.struct("check_id", *[c for c in checks.columns if c not in ("check_id", key)])))
    return checks.groupBy(key).agg(F.to_json(rows).alias("snapshot"))


def from_snapshot(snapshots: DataFrame, key: str, schema: str) -> DataFrame:
    """The rows of snapshots again."""
    return snapshots.select(key, F.inline(F.from_json("snapshot", f"array<struct<{schema}>>")))
