"""Merging a new run into an old one without losing people's decisions.

Units are keyed by evidence group and meet in one full outer join; the plan is
a DataFrame of actions, and the next state is computed, never updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(old: DataFrame, new: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """key…, action, decision_survived, noted, old_seen, new_seen.

    old: key…, content…, decided (boolean); new: key…, content….
    """
    a = old.select(*key, F.struct(*content).alias("old"), "decided", F.lit(True).alias("in_old"))
    b = new.select(*key, F.struct(*content).alias("new"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    was, now = F.coalesce("in_old", F.lit(False)), F.coalesce("in_new", F.lit(False))
    same, decided = F.col("old").eqNullSafe(F.col("new")), F.coalesce("decided", F.lit(False))
    action = F.when(~was, "added").when(~now, F.when(decided, "kept_without_source").otherwise("removed")).when(same, "kept").otherwise("changed")
    survives = was & decided & (~now | same)
    return both.select(*key, action.alias("action"), survives.alias("decision_survived"), (decided & ~(now & same)).alias("noted"))


def counters(planned: DataFrame) -> DataFrame:
    """added, changed, removed, kept, survived and the protocol's next status."""
    c = planned.agg(
        *[F.count_if(F.col("action") == x).alias(x) for x in ("added", "changed", "removed", "kept", "kept_without_source")],
        F.count_if("decision_survived").alias("survived"),
    )
    return c.withColumn("status", F.when(F.col("survived") > 0, "VERIFYING").otherwise("READY"))


def next_state(old: DataFrame, new: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """The checks after the merge: old rows that are kept, new rows that are added or changed."""
    p = plan(old, new, key, content)
    kept = old.join(p.where("action in ('kept', 'kept_without_source')").select(*key), key, "left_semi")
    fresh = new.join(p.where("action in ('added', 'changed')").select(*key), key, "left_semi")
    return kept.select(*key, *content, "decided").unionByName(fresh.select(*key, *content).withColumn("decided", F.lit(False)))
