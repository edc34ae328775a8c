"""Labels, confusion counts, intervals, reports and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.functions import scalars
from reconlake.operators import digests

THRESHOLDS = {"precision": (0.90, True), "recall": (0.80, True), "f1": (0.85, True), "fpr": (0.10, False)}


def label_of(status: Column) -> Column:
    """The label that a final status gives; null for statuses that give none."""
    return F.when(status == "CONFIRMED_VIOLATION", "POSITIVE").when(status == "NEGATIVE_VERIFIED", "NEGATIVE")


def confusion(labels: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, tn by keys of labels (label, engine_status); an unknown engine status is no candidate."""
    hit = F.coalesce(F.col("engine_status") == "CANDIDATE", F.lit(False))
    yes = F.col("label") == "POSITIVE"
    return labels.groupBy(*keys).agg(
        F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn")
    )


def rated(counts: DataFrame) -> DataFrame:
    """`counts` with precision, recall, f1, fpr, their Wilson bounds and whether they pass; null without observations."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, n: F.when(n > 0, a / n)
    out = counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "fpr": share(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)))
    for name, a, n in (("precision", tp, tp + fp), ("recall", tp, tp + fn), ("fpr", fp, fp + tn)):
        w = scalars.wilson(a, n)
        out = out.withColumns({f"{name}_lo": w["lo"], f"{name}_hi": w["hi"]})
    passes = {k: F.col(k) >= t if up else F.col(k) <= t for k, (t, up) in THRESHOLDS.items()}
    fails = sum((F.coalesce(~c, F.lit(False)).cast("int") for c in passes.values()), F.lit(0))
    nothing = F.coalesce(*[F.col(k) for k in THRESHOLDS]).isNull()
    return out.withColumn("passes", F.when(~nothing, fails == 0))


def grouped(labels: DataFrame, modality: str, param: str) -> DataFrame:
    """Confusion counts overall, by modality and by param in one pass: level, key and the counts."""
    named = labels.withColumn(modality, F.coalesce(modality, F.lit("UNKNOWN")))
    hit = F.coalesce(F.col("engine_status") == "CANDIDATE", F.lit(False))
    yes = F.col("label") == "POSITIVE"
    m, p = F.col(modality), F.col(param)
    sets = named.groupingSets([[], [m], [p]], m, p).agg(
        F.grouping_id(m, p).alias("g"), F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"),
        F.count_if(~yes & ~hit).alias("tn"),
    )
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "modality").otherwise("param")
    key = F.when(F.col("g") == 1, m).when(F.col("g") == 2, p)
    return sets.select(level.alias("level"), key.alias("key"), "tp", "fp", "fn", "tn")


def release(labels: DataFrame, *keys: str) -> DataFrame:
    """keys, n, manifest: how many labels a release freezes, and the fingerprint of their ids."""
    return digests.of_sets(labels, "id", *keys).withColumnRenamed("digest", "manifest")


def top_reason(rejections: DataFrame) -> DataFrame:
    """reason, n: the most frequent, the first by name on ties."""
    counts = rejections.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "reason").limit(1)
