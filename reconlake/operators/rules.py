"""Running a whole rule matrix: outcomes of every rule, and the checks that they become."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.operators import matrix
from reconlake.functions import scalars
from reconlake.plans.guards import small

#: The rule with a comparison of its own, and statuses that are findings.
OWN_COMPARISON = "M-003"
FINDINGS = ("CANDIDATE", "NEGATIVE_VERIFIED")
NO_DRAWINGS, NO_RULE, SELF_CONFIRMED = "DRAWINGS_NOT_READ", "NO_EVALUATOR", "ONLY_PEOPLE_CONFIRM"
Branches = Mapping[str, DataFrame]

OUTCOME = "object_id, code, status, reason, expected, actual, delta"


def short_number(x: Column) -> Column:
    """A whole number without decimals, else at most two."""
    whole = F.abs(x - F.rint(x)) < 1e-6
    return F.when(whole, F.rint(x).cast("bigint").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(scalars.fixed(x), "0+$", ""), "[.]$", ""))


def display_value(value: Column, text: Column, unit: Column) -> Column:
    """As people read it: decimal comma and unit; texts as they are."""
    suffix = F.when(unit.isNotNull() & (unit != "") & ~unit.isin("—", "Статус"), F.concat(F.lit(" "), unit)).otherwise("")
    return F.when(value.isNotNull(), F.concat(scalars.comma(short_number(value)), suffix)).otherwise(text)


def stored_value(value: Column, text: Column) -> Column:
    return F.coalesce(short_number(value), text)


def compare_sides(specs: DataFrame, sides: DataFrame, left: str, right: str) -> DataFrame:
    """OUTCOME of every rule of every object that has values: two stages held against each other.

    sides: object_id, code, stage, n_values, value, confidence, shown (see matrix.resolve_side).
    """

    def side(stage: str, name: str) -> DataFrame:
        return sides.where(F.col("stage") == stage).select("object_id", "code", F.struct("n_values", "value", "confidence", "shown").alias(name))

    both = side(left, "l").join(side(right, "r"), ["object_id", "code"], "full_outer").join(small(specs), "code")
    l, r = F.col("l.value"), F.col("r.value")
    count = lambda n: F.coalesce(F.col(f"{n}.n_values"), F.lit(0))
    sure = (F.coalesce("l.confidence", F.lit(0.0)) >= matrix.HIGH_CONFIDENCE) & (F.coalesce("r.confidence", F.lit(0.0)) >= matrix.HIGH_CONFIDENCE)
    outcome = matrix.compare_pair(count("l"), count("r"), l, r, sure, matrix.violates(F.col("compare_op"), l, r, F.col("compare_threshold")))
    conflict = outcome.startswith("CONFLICT")
    status = F.when(conflict, "CLARIFICATION_REQUIRED").otherwise(outcome)
    reason = (
        F.when(outcome == "CONFLICT_LEFT", F.concat(F.lit(f"{left}: "), F.col("l.shown"))).when(outcome == "CONFLICT_RIGHT", F.concat(F.lit(f"{right}: "), F.col("r.shown")))
        .when(outcome == "MISSING_EVIDENCE", F.when(l.isNull(), f"not in {left}").otherwise(f"not in {right}"))
        .when(outcome == "NOT_COMPARABLE", F.when(l.isNull(), "nowhere").otherwise("low confidence"))
    )
    done = status.isin(*FINDINGS)
    return both.select(
        "object_id", "code", status.alias("status"), reason.alias("reason"), F.when(done, short_number(l)).alias("expected"),
        F.when(done, short_number(r)).alias("actual"), F.when(status == "CANDIDATE", scalars.signed(r - l)).alias("delta"),
    )


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """OUTCOME of `first`, or of `second` where the first has no evidence or can't compare and the second can."""
    weak = ("MISSING_EVIDENCE", "NOT_COMPARABLE")
    a = first.select("object_id", "code", F.struct("status", "reason", "expected", "actual", "delta").alias("a"))
    b = second.where(~F.col("status").isin(*weak)).select("object_id", "code", F.struct("status", "reason", "expected", "actual", "delta").alias("b"))
    chosen = F.when(F.col("a.status").isin(*weak), F.coalesce("b", "a")).otherwise(F.col("a"))
    return a.join(b, ["object_id", "code"], "left").select("object_id", "code", chosen.alias("o")).select("object_id", "code", "o.*")


def evaluate_all(specs: DataFrame, objects: DataFrame, branches: Branches) -> DataFrame:
    """OUTCOME of every rule of every object: each rule takes the outcome of the branch of its modality.

    Rules without a branch say so, drawings in words of their own; a rule that
    confirms a violation by itself can't be compared, since only people
    confirm; the rule with a comparison of its own is left out. The matrix is
    small and sent to the objects.
    """
    wired = []
    for name, df in branches.items():
        own = specs.where((F.col("modality") == name) & (F.col("code") != OWN_COMPARISON)).select("code")
        wired.append(df.join(small(own), "code", "left_semi").select(*OUTCOME.split(", ")))
    none = [F.lit(None).cast("string").alias(c) for c in ("status", "reason", "expected", "actual", "delta")]
    rules = specs.where(F.col("code") != OWN_COMPARISON).select("code", "modality")
    # Every rule of every object: rows of the answer, not a join of data. A matrix has hundreds of rules.
    structs = [F.struct(F.lit(r["code"]).alias("code"), F.lit(r["modality"]).alias("modality")) for r in rules.collect()]
    codes = F.explode(F.array(*structs)).alias("rule")
    every = objects.select("object_id").distinct().select("object_id", codes).select("object_id", "rule.code", "rule.modality")
    found = wired[0] if wired else objects.select("object_id", F.lit(None).cast("string").alias("code"), *none).limit(0)
    for df in wired[1:]:
        found = found.unionByName(df)
    joined = every.join(found, ["object_id", "code"], "left")
    missing = F.col("status").isNull()
    self_confirmed = F.coalesce(F.col("status") == "CONFIRMED_VIOLATION", F.lit(False))
    drawing = F.col("modality").startswith("drawing")
    reason = F.when(missing, F.when(drawing, NO_DRAWINGS).otherwise(NO_RULE)).when(self_confirmed, SELF_CONFIRMED).otherwise(F.col("reason"))
    keep = ~missing & ~self_confirmed
    return joined.select(
        "object_id", "code", F.when(keep, F.col("status")).otherwise("NOT_COMPARABLE").alias("status"), reason.alias("reason"),
        *[F.when(keep, F.col(c)).alias(c) for c in ("expected", "actual", "delta")],
    )


CHECK = "object_id, group_id, code, subject, expected, actual, delta, completeness, finding_status, priority, rationale, parent_group_id"


def check_rows(outcomes: DataFrame, specs: DataFrame, label: str = "matrix") -> DataFrame:
    """CHECK rows of outcomes: findings are complete, all else only states what is missing."""
    done = F.col("status").isin(*FINDINGS)
    none = F.lit(None).cast("string")
    joined = outcomes.join(small(specs.select("code", F.col("review_priority").alias("priority"))), "code", "left")
    return joined.select(
        "object_id", F.concat_ws(":", "object_id", "code", F.lit(label)).alias("group_id"), "code", none.alias("subject"), "expected", "actual", "delta",
        F.when(done, "COMPLETE").otherwise(F.col("status")).alias("completeness"), F.when(done, F.col("status")).alias("finding_status"), "priority",
        F.col("reason").alias("rationale"), none.alias("parent_group_id"),
    )


def room_check_rows(findings: DataFrame, composites: DataFrame, priority: str = "HIGH", parts: int | None = None) -> DataFrame:
    """CHECK rows of rooms.reconcile's findings and rooms.islands' runs: a run of two or more is a row of its own and the parent of its atoms.

    findings, composites: as from there, with object_id and pair (which sheets
    were compared). Where they hold evidence, rows have fragments: an array of
    struct<file_id,page,x0,y0,x1,y1,value,role>, what was expected first; an
    empty place lacks its fragment. parts: as of rooms.reconcile.
    """
    none = F.lit(None).cast("string")
    seen = "pd_evidence" in findings.columns

    def fragment(side: str, value: str, role: str) -> Column:
        e = F.col(f"{side}_evidence")
        return F.when(e.isNotNull(), F.struct(*[e[c].alias(c) for c in ("file_id", "page", "x0", "y0", "x1", "y1")], F.col(value).alias("value"), F.lit(role).alias("role")))

    fragments = [F.array_compact(F.array(fragment("pd", "expected", "expected"), fragment("rd", "actual", "actual"))).alias("fragments")] if seen else []
    runs = composites.where("atoms >= 2")
    run_subject = F.concat(F.lit("rooms "), F.col("first_number"), F.lit(".."), F.col("last_number"))
    group = lambda subject: F.concat_ws(":", "object_id", F.lit(OWN_COMPARISON), "pair", subject)
    tail = lambda status, parent: [
        F.lit("COMPLETE").alias("completeness"), status.alias("finding_status"), F.lit(priority).alias("priority"), none.alias("rationale"), parent.alias("parent_group_id"),
    ]
    tops = runs.select("object_id", group(run_subject).alias("group_id"), F.lit(OWN_COMPARISON).alias("code"), run_subject.alias("subject"), "expected", "actual", "delta", *tail(F.lit("CANDIDATE"), none), *fragments)
    # An atom lies between its run's first and last room in table order; runs of a sheet don't overlap, so the one that starts last before it, or at it, is its own.
    # Starts stand among the rooms as rows of their own, ahead of the room they name, so that one window serves and nothing is joined.
    order = F.struct(*scalars.natural_key(F.col("number")))
    sheet = ["object_id", "pair", "scope"]
    by = Window.partitionBy(*sheet).orderBy("o", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    run = F.struct(run_subject.alias("subject"), F.col("last_number").alias("last")).alias("run")
    starts = runs.select(*sheet, F.col("first_number").alias("number"), run)
    both = findings.where("status is not null").unionByName(starts, allowMissingColumns=True).repartition(*([parts] if parts else []), *sheet)
    placed = both.withColumn("o", order).withColumn("last_run", F.last("run", ignorenulls=True).over(by)).where("run is null")
    ends = F.struct(*scalars.natural_key(F.col("last_run.last")))
    inside = F.col("last_run").isNotNull() & (F.col("o") <= ends) & (F.col("status") == "CANDIDATE")
    subject = F.concat(F.lit("room "), F.concat_ws("|", "scope", "number"))
    atoms = placed.select(
        "object_id", group(subject).alias("group_id"), F.lit(OWN_COMPARISON).alias("code"), subject.alias("subject"), "expected", "actual", "delta",
        *tail(F.col("status"), F.when(inside, group(F.col("last_run.subject")))), *fragments,
    )
    return tops.union(atoms)


def completeness_row(object_id: Column, code: str, label: str, status: str, reason: str, priority: str) -> list[Column]:
    """Columns of the CHECK row that says why nothing could be compared."""
    none = F.lit(None).cast("string")
    return [
        object_id.alias("object_id"), F.concat_ws(":", object_id, F.lit(code), F.lit(label)).alias("group_id"), F.lit(code).alias("code"), none.alias("subject"),
        none.alias("expected"), none.alias("actual"), none.alias("delta"), F.lit(status).alias("completeness"), none.alias("finding_status"),
        F.lit(priority).alias("priority"), F.lit(reason).alias("rationale"), none.alias("parent_group_id"),
    ]


def explication_rows(objects: DataFrame, sources: DataFrame, pairs: DataFrame, room_rows: DataFrame, priority: str = "HIGH") -> DataFrame:
    """CHECK rows of the room comparison: the rooms', or why there are none: no source on a side, or no pair of sheets.

    objects: object_id; sources: object_id, stage of chosen files; pairs: object_id of paired sheets.
    """
    has = sources.where(F.col("stage").isin("PD", "RD")).groupBy("object_id").agg(F.count_distinct("stage").alias("n"))
    known = objects.select("object_id").distinct().join(has, "object_id", "left").join(pairs.select("object_id").distinct().withColumn("paired", F.lit(True)), "object_id", "left")
    both = F.coalesce("n", F.lit(0)) == 2
    none = known.where(~both).select(*completeness_row(F.col("object_id"), OWN_COMPARISON, "no-source", "MISSING_EVIDENCE", "no current PD or RD file", priority))
    unpaired = known.where(both & F.col("paired").isNull()).select(*completeness_row(F.col("object_id"), OWN_COMPARISON, "no-pair", "NOT_COMPARABLE", "no sheets to pair", priority))
    return room_rows.union(none).union(unpaired)


def findings_metric(checks: DataFrame) -> DataFrame:
    """status, n of findings, atoms included."""
    return checks.where("finding_status is not null").groupBy(F.col("finding_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def with_param(checks: DataFrame, params: DataFrame) -> DataFrame:
    """`checks` with param_id of their code; null for codes that the table of params lacks."""
    return checks.join(small(params.select("code", F.col("id").alias("param_id"))), "code", "left")


def hypothesis_batches(pairs: DataFrame, size: int, *keys: str) -> DataFrame:
    """`pairs` with key (p1, p2, …) and batch, both within `keys`, in the order of `number`."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*scalars.natural_key(F.col("number"))))
    numbered = pairs.withColumn("__at", at)
    return numbered.withColumns({"key": F.concat(F.lit("p"), F.col("__at").cast("string")), "batch": F.floor((F.col("__at") - 1) / size).cast("int")}).drop("__at")


def without_think(answer: Column) -> Column:
    """The JSON inside a chatty answer: no thinking, no code fence, nothing around the outermost brackets."""
    plain = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.nullif(F.regexp_extract(F.when(fenced != "", fenced).otherwise(plain), r"(?s)[\[{].*[\]}]", 0), F.lit(""))


def parse_verdicts(answers: DataFrame, requested: DataFrame, *keys: str) -> DataFrame:
    """keys, key, same_function, confidence, reason: the elements of an answer that are well-formed and asked for, the first of each key.

    answers: keys, answer; requested: keys, key. Types are those of the JSON
    itself: a number is no key, a boolean no confidence.
    """
    v = F.try_parse_json(without_think(F.col("answer")))
    items = answers.select(*keys, F.posexplode(F.try_variant_get(v, "$", "array<variant>")).alias("at", "x"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("x", f"$.{name}", "variant"))
    got = items.select(
        *keys, "at", F.try_variant_get("x", "$.key", "string").alias("key"), F.try_variant_get("x", "$.same_function", "boolean").alias("same_function"),
        F.try_variant_get("x", "$.confidence", "double").alias("confidence"), F.try_variant_get("x", "$.reason", "string").alias("reason"),
        ((kind("key") == "STRING") & (kind("same_function") == "BOOLEAN") & (kind("reason") == "STRING") & ~kind("confidence").isin("BOOLEAN", "STRING", "VOID")).alias("typed"),
    )
    good = got.where(F.col("typed") & F.col("confidence").between(0.0, 1.0) & (F.trim("reason") != "")).join(requested.select(*keys, "key"), [*keys, "key"], "left_semi")
    first = good.groupBy(*keys, "key").agg(F.min_by(F.struct("same_function", "confidence", "reason"), "at").alias("v"))
    return first.select(*keys, "key", "v.*")
